"""Cutting lineage between the stages of a long plan."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text up to which a stored table is sent to every executor.
SENT = 8_000_000


def settled(df: DataFrame) -> DataFrame:
    """``df`` as stored rows: written once to the folder in ``spark.checkpoint.dir`` (a temporary one where that is unset and
    the master is local), so that later plans neither repeat nor carry what made it, and a lost executor costs no more than
    a read."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="threadlens-"))
    return df.checkpoint()


def sent(stored: DataFrame) -> DataFrame:
    """``stored``, a table from ``settled``, for a join with a larger one: marked for broadcast if it is measured to be small.
    A large one is left to the join's own exchange."""
    size = stored.agg(F.sum(F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in stored.columns))))).alias("n")).first()[0] or 0
    return F.broadcast(stored) if size <= SENT else stored


def texts_of(comments: DataFrame) -> DataFrame:
    """(video_id, seq, text) of the distinct texts that are not null, each as a comment of its own: what depends on a text
    alone is found once for it, however often it is written."""
    each = comments.select("text").where("text is not null").distinct()
    return settled(each.select(F.lit("").alias("video_id"), F.monotonically_increasing_id().alias("seq"), "text"))
