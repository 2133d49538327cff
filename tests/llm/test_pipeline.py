"""The pipeline against its stages' brute-force versions, on small tables."""

import random
from collections import Counter

import corpus_pipeline
from threadlens.llm import pii

from .test_operators import near_groups, plain_removed, split


def write(spark, tmp_path):
    r = random.Random(8)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))
    passage = prose(60)
    texts = [prose(r.randint(40, 90)) for _ in range(40)] + [prose(20) + " " + passage + " " + prose(20) for _ in range(4)]
    texts += [texts[3]] * 3 + [texts[4] + " z", "mail me at bofmf.71@mail4.example.com " + prose(30), None, ""]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, tmp_path):
    sf_dir = write(spark, tmp_path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "substrings", "personal_data", "packing"]
    rows = {}
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, sf_dir)
        if i < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs.collect(), spark.read.parquet(f"{tmp_path}/{name}")
        rows[name] = (before, docs.collect())
    before, after = rows["near_duplicates"]
    assert {r.doc_id for r in after} == near_groups([(r.doc_id, r.text) for r in before]) and len(after) < len(before)
    before, after = rows["substrings"]
    wanted = {k[0]: k for k in plain_removed([(r.doc_id, r.text) for r in before])}
    assert {r.doc_id for r in after} == {d for d, k in wanted.items() if not k[2] or k[2] < k[1]}
    assert all(len(split(r.text)) == wanted[r.doc_id][1] - wanted[r.doc_id][2] for r in after)
    before, after = rows["personal_data"]
    kept = {r.doc_id: r.text for r in after}
    for r in before:
        if not pii.windows(r.text or ""):
            assert kept[r.doc_id] == r.text
    assert any("[EMAIL]" in (t or "") for t in kept.values())
    assert {r.doc_id for r in rows["packing"][1]} == set(kept)
    final = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in final) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in rows["packing"][1])


def test_defined_cases(spark, tmp_path):
    r = random.Random(9)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))
    texts = [prose(60) for _ in range(30)]
    rows = [(i, t, "w", "seed", 1.5, "x") for i, t in enumerate(texts)] + [(3, texts[3], "w", "seed", 1.5, "x")] * 2 + [(None, texts[4], None, None, None, None), (None, prose(50), None, None, None, None), (50, None, "w", None, None, None), (51, "", "w", None, None, None), (52, prose(9000), None, None, None, None)]
    kind = "doc_id long, text string, kept string, windows string, log_weight double, fp string"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.createDataFrame(rows, kind).repartition(3), None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{tmp_path}/{name}")
        if name == "near_duplicates":
            kept = Counter((x.doc_id, x.text) for x in docs.collect())
    assert kept == Counter({(i, t): 1 for i, t in enumerate(texts)} | {rows[33][:2]: 1, (50, None): 1, (52, rows[-1][1]): 1})
    assert {x.doc_id for x in docs.collect()} == {*range(30), None, 50, 52}
    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/empty/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/empty/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
