"""Quality classifier by importance resampling: hashed n-gram generative models of target and raw text, Gumbel top-k.

A document's log importance weight is the log ratio of its likelihood under the target and under the raw model
(``hashed``), normalised for length: that of a text of ``SCALE`` features of the same make-up. Each document gets weight /
temperature (1 by default) plus Gumbel noise that a hash of its row decides, and the ``k`` documents with the greatest sum
are the sample: drawn without replacement in proportion to the tempered weights, whatever the partitioning. By default k
is the number of documents whose weight reaches the threshold that keeps all but ``clean_loss`` of held-out trusted
documents, so the sample is as large as the share of target-like text in this corpus; the rest is rejected.

The k-th greatest sum is found by radix selection over its 64 bits in four rounds; each sends at most 65,536 counts to
the driver, and no rows are sorted or gathered.

Defined cases: null and word-less texts have weight zero; texts of any length are weighed whole; repeated rows have equal
sums, and rows that tie with the k-th are all taken; null ids and unlabelled documents take part; k beyond the table takes
all. Further columns pass through ``sample`` unchanged (columns named like the added ones are replaced). An empty table
gives no rows; without labels all weights and the threshold are zero and every document is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kth_key, ordered, slices, stage
from .hashed import Model, model

TEMPERATURE = 1.0
#: Features of the text whose weight a document gets; the unit of the temperature.
SCALE = 64
_ADDED = ("log_weight", "gumbel_key", "_key")


def keyed(docs: DataFrame, fitted: Model, temperature: float, seed: int) -> DataFrame:
    """``docs`` with log_weight, gumbel_key and _key, a long in its order."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    through = docs.columns
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 12).cast("double") + 0.5) / F.lit(float(1 << 52))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=4 << 20):
                weight = SCALE * shared.value.score(part.column("text"))
                key = weight / temperature - np.log(-np.log(np.asarray(part.column("_key"))))
                yield pa.record_batch([*part.columns[:-1], pa.array(weight), pa.array(key), pa.array(ordered(key))], names=[*through, *_ADDED])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.withColumn("_key", uniform).mapInArrow(work, f"{schema}, log_weight double, gumbel_key double, _key long")


def sample(docs: DataFrame, labels: DataFrame, k: int | None = None, temperature: float = TEMPERATURE, clean_loss: float = 0.005, seed: int = 1, columns: list[str] | None = None) -> DataFrame:
    """The sampled rows of ``docs`` (of it ``columns``, by default all) with log_weight and gumbel_key."""
    docs = docs.drop(*_ADDED)
    fitted = model(docs, labels, clean_loss=clean_loss)
    rows = stage(keyed(docs, fitted, temperature, seed).select(*(columns or docs.columns), *_ADDED), "resample")
    if k is None:
        k = rows.where(F.col("log_weight") >= SCALE * fitted.threshold).count()
    least = kth_key(rows.select("_key"), "_key", k) if k > 0 else None
    if least is None:
        return (rows if k > 0 else rows.where("false")).drop("_key")
    return rows.where(F.col("_key") >= least).drop("_key")
