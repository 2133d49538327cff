"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows and empty tables."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from threadlens.llm import bpe, common, elias_fano, hashed, kdtree, ngram_lm, packing, pii, queries, resample, rlz, rules, simhash, warc
from threadlens.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, length long, kept string"


def make_docs():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = prose(60)
    texts = [prose(r.randint(0, 120)) for _ in range(30)]
    texts += [prose(20) + " " + passage + "\n" + prose(r.randint(0, 30)) for _ in range(6)]
    copy = prose(80)
    texts += [copy] * 5 + [copy + " end", copy.replace(" ", "  ", 3), "the " * 90, "the " * 91, "", None, " \n\t ", prose(9000), "Ünï \x1c ÇODE  x"]
    rows = [(i, t, "en", "s", 1, 2, "x") for i, t in enumerate(texts)]
    return [*rows, rows[40], (None, copy, "en", None, None, None, None), (None, prose(50), None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make_docs(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(30)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def test_words_of_slices():
    a = pa.array(["ÀB c", None, " D\x85e f ", "", "x" * 50] * 20)
    parts = list(common.slices(pa.record_batch([a], names=["text"]), most=200))
    assert len(parts) > 1 and sum(p.num_rows for p in parts) == len(a)
    got = []
    for p in parts:
        offsets, codes, distinct = common.words(p.column("text"), lower=True)
        d = distinct.to_pylist()
        got += [[d[c] for c in codes[i:j]] for i, j in zip(offsets, offsets[1:])]
    fold = lambda w: "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
    assert got == [[fold(w) for w in split(t)] for t in a.to_pylist()]


@pytest.mark.parametrize("limits", [packing.Limits(100), packing.Limits(100, 5), packing.Limits(100, None, 3000), packing.Limits(100, 4, 2500)])
def test_plan_packs_as_piece_by_piece(limits):
    lengths = np.minimum(limits.longest, np.random.default_rng(1).geometric(0.04, 1500))
    bins = []
    need_cap = np.array([limits.tokens, limits.count, limits.cost])
    for n in sorted(lengths.tolist(), reverse=True):
        need = np.array([n, 1, n * n])
        score = packing._score(np.array(bins).reshape(-1, 3), need, need_cap.astype(float), np.array(limits.weights), limits.rule)
        if len(bins) and np.isfinite(score.min()):
            bins[int(score.argmin())] = bins[int(score.argmin())] - need
        else:
            bins.append(need_cap - need)
    plan = packing.plan(Counter(lengths.tolist()), limits)
    assert plan.sequences == len(bins)
    rank, seen = [], Counter()
    for n in lengths.tolist():
        rank.append(seen[n])
        seen[n] += 1
    seq, offset = plan.place(lengths, np.array(rank))
    for s in range(plan.sequences):
        own = lengths[seq == s][np.argsort(offset[seq == s])]
        assert (np.sort(offset[seq == s]) == np.cumsum(own) - own).all()
        assert own.sum() <= limits.tokens and len(own) <= limits.count and (own**2).sum() <= limits.cost


def test_packing_rows(spark, docs, empty):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = packing.pack(docs, path).collect()
    wanted = Counter()
    for row in make_docs():
        ids = library.encode(row[1] or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            wanted[row[0], k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == wanted
    ends = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 4096 and len(ends) <= -(-sum(ends.values()) // 4096) + 1
    assert packing.pack(empty, path).count() == 0


def plain_fingerprint(text):
    w = split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(fps):
    group = list(range(len(fps)))
    find = lambda i: i if group[i] == i else find(group[i])
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                group[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash_groups(docs, empty):
    rows = make_docs()
    fps = [plain_fingerprint(r[1]) for r in rows]
    group = plain_groups(fps)
    least = {}
    for r, g in zip(rows, group):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    wanted = Counter((r[0], f, least.get(g)) for r, f, g in zip(rows, fps, group))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.groups(docs).collect()) == wanted
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((least.get(g) for g in set(group)), key=str)
    assert simhash.groups(empty).count() == 0


def test_trie_links_and_hot_blocks(spark):
    r = np.random.default_rng(2)
    keys = []
    for base in r.integers(0, 1 << 63, 12, dtype=np.uint64).tolist():
        for _ in range(15):
            x = base
            for b in r.integers(0, 64, r.integers(0, 5)).tolist():
                x ^= 1 << b
            keys.append(x)
    keys = np.unique(np.array(keys, np.uint64))
    wanted = plain_groups(keys.tolist())
    same = lambda root: {frozenset(np.flatnonzero(np.array(root) == x).tolist()) for x in set(root)}
    assert same(simhash.local_roots(len(keys), *simhash.trie_links(keys)).tolist()) == same(wanted)
    distinct = spark.createDataFrame([(x,) for x in keys.view(np.int64).tolist()], "fp long")
    for hot in (1 << 20, 4):
        roots = {r.node: r.root for r in components(simhash.links(distinct, hot=hot)).collect()}
        assert same([roots.get(x, x) for x in keys.view(np.int64).tolist()]) == same(wanted)


def test_trie_links_at_the_last_bit(spark):
    keys = np.array([0, 1, (1 << 40) + (1 << 24) + (1 << 8)], np.uint64)
    assert simhash.local_roots(3, *simhash.trie_links(keys, fixed=16)).tolist() == [0, 0, 0]
    distinct = spark.createDataFrame([(x,) for x in keys.view(np.int64).tolist()], "fp long")
    assert {r.node: r.root for r in components(simhash.links(distinct)).collect()} == dict.fromkeys(keys.tolist(), 0)
    r = np.random.default_rng(3)
    for _ in range(200):
        x = int(r.integers(0, 1 << 63))
        keys = np.unique(np.array([x, x ^ 1, *(x ^ sum(1 << int(b) for b in r.choice(64, 3, replace=False)) for _ in range(4))], np.uint64))
        wanted = plain_groups(keys.tolist())
        got = simhash.local_roots(len(keys), *simhash.trie_links(keys)).tolist()
        assert len(set(got)) == len(set(wanted)) == len(set(zip(got, wanted)))


def shingle_set(text, size=5):
    w = split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def near_groups(rows, least=0.8):
    """The smallest id of each group of rows that are linked by their similarity."""
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    having = {}
    for i, s in sets.items():
        for x in s or {()}:
            having.setdefault(x, []).append(i)
    for i, j in {(i, j) for own in having.values() for i in own for j in own if i < j}:
        if top(i) != top(j) and jaccard(sets[i], sets[j]) >= least:
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return {top(i) for i in sets}


def test_near_copies(spark, docs, empty):
    r = random.Random(21)
    prose = lambda n: [r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randint(0, 400)) for _ in range(n)]
    rows, planted = [], []
    for k in range(120):
        first = prose(r.randint(60, 300))
        rows.append(first)
        for _ in range(r.randint(0, 3)):
            edited = list(first)
            for _ in range(r.randint(1, max(1, len(first) // 60))):
                edited[r.randrange(len(edited))] = "edit"
            rows.append(edited)
    crowd = prose(200)
    for _ in range(150):
        edited = list(crowd)
        edited[r.randrange(200)] = str(r.random())
        rows.append(edited)
    notice = prose(12)
    rows += [notice + prose(100) for _ in range(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)] + [(9000, ""), (9001, None), (9002, " \n"), (9003, "one Two"), (9004, "ONE  two"), (9005, rows[0][0])]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = simhash.near_copies(table)
    assert got.columns == ["doc_id", "text"]
    kept, wanted = [x.doc_id for x in got.collect()], near_groups(rows)
    # by the smallest hashes and sketches, 0.2 % of links and a few of those about 0.8 may be missed, none made up
    assert len(kept) == len(set(kept)) and wanted <= set(kept) and len(kept) <= len(wanted) * 1.01
    assert 9000 in kept and not {9001, 9002, 9004} & set(kept) and sum(i >= len(rows) - 66 for i in kept if i < 9000) == 60
    texts = simhash.stage(simhash.sketches(table).groupBy("w").agg(*(F.first(c).alias(c) for c in ("fp", "minima", "sketch"))), "texts")
    plain = {x.node: x.root for x in components(simhash.candidates(texts, 0.8)).collect()}
    crowded = {x.node: x.root for x in components(simhash.candidates(texts, 0.8, crowded=5, part=7)).collect()}
    groups = lambda roots: {frozenset(n for n in roots if roots[n] == g) for g in set(roots.values())}
    assert groups(plain) == groups(crowded)
    again = simhash.near_copies(docs.drop("kept")).collect()
    assert sum(x.doc_id is None for x in again) == 1 and len(again) == len({(x.doc_id, x.text) for x in again})
    assert simhash.near_copies(empty).count() == 0


def test_near_copies_lose_no_link(spark):
    r = random.Random(31)
    rows = []
    for k in range(400):
        first = [f"w{r.randint(0, 50_000)}" for _ in range(r.randint(100, 160))]
        edited, other = list(first), shingle_set(" ".join(first))
        while jaccard(other, shingle_set(" ".join(edited))) >= 0.8:
            last, at = list(edited), r.randrange(len(edited))
            edited[at] = f"e{r.randint(0, 50_000)}"
        rows += [" ".join(first), " ".join(last), " ".join(edited)]
    rows = list(enumerate(rows))
    wanted = near_groups(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {x.doc_id for x in simhash.near_copies(table).collect()} == wanted and 400 <= len(wanted) < 1200
    # the lossless join finds every link by itself, also of ranges that are cut
    texts = simhash.stage(simhash.sketches(table, often=simhash.frequent(table, 5)).withColumn("root", F.col("w")), "texts")
    for share in (simhash.SHARE, 2):
        found = {frozenset((x.a, x.b)) for x in simhash.apart(texts, 0.8, share).collect()}
        w = {x.doc_id: x.w for x in texts.collect()}
        assert all(frozenset((w[i], w[i + 1])) in found for i in range(0, 1200, 3))


def test_forest_joins_without_circles():
    r = np.random.default_rng(8)
    for n, m in ((1, 0), (10, 5), (50, 60), (200, 2000)):
        i, j = r.integers(0, n, (2, m))
        label, edge = simhash.forest(np.arange(n), i, j)
        assert (label == simhash.local_roots(n, i, j)).all() and len(edge) == n - len(set(label.tolist()))
        assert (simhash.local_roots(n, i[edge], j[edge]) == label).all()


def test_near_pairs_and_shown_similarity():
    r = np.random.default_rng(7)
    size = np.array([1, 5, 40, 2, 30])
    base = r.integers(0, 1 << 63, 5).astype(np.uint64)
    keys = np.concatenate([np.sort(np.concatenate([b ^ (np.uint64(1) << r.integers(0, 64, n // 2 + 1).astype(np.uint64)), r.integers(0, 1 << 63, n - n // 2 - 1).astype(np.uint64)])) if n > 1 else np.array([b]) for b, n in zip(base, size)])
    end = np.cumsum(size)
    for budget in (0, 3, 18, 30):
        for frontier in (1 << 20, 16):
            simhash.FRONTIER = frontier
            got = set()
            for i, j in simhash.near_pairs(keys, end - size, end, budget, np.arange(len(keys))):
                got |= {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
            wanted = {(i, j) for b, e in zip(end - size, end) for i in range(b, e) for j in range(i + 1, e) if bin(int(keys[i] ^ keys[j])).count("1") <= budget}
            distinct = {(i, j) for i, j in wanted if keys[i] != keys[j]}
            assert got <= wanted and (len(set(keys.tolist())) < len(keys) or got == distinct)
    simhash.FRONTIER = 1 << 20
    pad = (1 << 32) - 1

    def padded(s):
        return np.array([*sorted(s)[: simhash.SKETCH], *[pad] * max(0, simhash.SKETCH - len(s))], np.uint32)

    for n in (0, 3, 40, 64, 500):
        a = set(r.integers(0, pad, n).tolist())
        b = set(list(a)[: int(0.8 * n)]) | set(r.integers(0, pad, n // 10).tolist())
        shown = simhash.shown_similarity(padded(a)[None], padded(b)[None])[0]
        assert abs(shown - jaccard(a, b)) < (1e-9 if n < 58 else 0.2)


def plain_statistics(text):
    w = split(text)
    lines = [x for x in (text or "").split("\n") if split(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_rules(spark, docs, labels, empty):
    got = rules.judge(docs, labels).collect()
    wanted = Counter()
    for r in make_docs():
        s = plain_statistics(r[1])
        wanted[(r[0], *s, s[0] < 50 or 100 * s[4] > 50 * s[0])] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == wanted
    assert not any(r.kept and r.base_failed for r in got)
    assert rules.judge(empty, labels).count() == 0
    assert all(r.kept != r.base_failed for r in rules.judge(docs, labels.where("false")).collect())
    texts = ["a a\nb\n\nb\n b\n#$ x", "x y z x y z", "", None, "q"]
    s = rules.statistics(pa.array(texts))
    assert list(zip(*(s[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")))) == [plain_statistics(t) for t in texts]


def test_quality_model_on_labels(spark):
    documents, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r.kept for r in rules.judge(documents, marks).collect()}
    drawn = {r.doc_id for r in resample.sample(documents, marks, columns=["doc_id"]).collect()}
    rows = marks.collect()
    good = [r.doc_id for r in rows if r.quality == 1 and r.toxic == 0 and r.doc_id in got]
    bad = [r.doc_id for r in rows if r.quality == 0 and r.doc_id in got]
    assert np.mean([d in drawn for d in good]) > 0.95 and np.mean([d in drawn for d in bad]) < 0.1
    assert np.mean([got[d] for d in bad]) < 0.05 and np.mean([got[d] for d in good]) > 0.9


def test_toxic_documents_go_in_every_language(spark):
    documents, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(5)) == 0
    rows = documents.join(marks, "doc_id").where("quality = 1").select("doc_id", "lang", "toxic", held.alias("held")).collect()
    kept = {r.doc_id for r in rules.judge(documents, marks).where("kept").collect()}
    drawn = {r.doc_id for r in resample.sample(documents, marks, columns=["doc_id"]).collect()}
    share = lambda ids, **want: np.mean([r.doc_id in ids for r in rows if all(r[k] == v for k, v in want.items())])
    for lang in ("de", "en", "es", "fr"):
        for ids, least in ((kept, 0.9), (drawn, 0.95)):
            assert share(ids, lang=lang, toxic=1) < 0.2 and share(ids, lang=lang, toxic=0) > least
    assert share(kept, held=True, toxic=1) < 0.1 and share(drawn, held=True, toxic=1) < 0.1


def test_sample_is_top_k_of_its_keys(docs, labels, empty):
    every = resample.sample(docs, labels, k=10_000).collect()
    assert len(every) == len(make_docs())
    for k in (0, 1, 7, 20):
        got = resample.sample(docs, labels, k=k).collect()
        least = sorted((r.gumbel_key for r in every), reverse=True)[k - 1] if k else None
        assert sorted(r.gumbel_key for r in got) == sorted(r.gumbel_key for r in every if k and r.gumbel_key >= least)
    assert resample.sample(empty, labels).count() == 0


def plain_scores(rows, labels, held):
    """Score, threshold and verdict on toxic words of each (doc_id, text), from ``held``: the ids kept out of counts."""
    whole, mask = hashed.WORDS, (1 << 64) - 1

    def spread(x):
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = ((x ^ (x >> shift)) * times) & mask
        return x ^ (x >> 31)

    def buckets(text):
        h = [int(common.hashes(pa.array([w]))[0]) for w in split(text.lower() if text and text.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
        return [x & (whole - 1) for x in h], [whole + (spread((a * 0x9E3779B97F4A7C15 + b) & mask) & (hashed.PAIRS - 1)) for a, b in zip(h, h[1:])]

    marks = {}
    for i, quality, toxic in labels:
        marks.setdefault(i, []).append(quality == 1 and not toxic)
    good = {i for i, m in marks.items() if i is not None and all(m)}
    poison = {i for i, _, toxic in labels if i is not None and toxic == 1}
    found = [buckets(t) for _, t in rows]
    target, raw = ([Counter(), Counter()] for _ in range(2))
    for (i, _), two in zip(rows, found):
        for k in (0, 1):
            raw[k].update(two[k])
            if i in good - held:
                target[k].update(two[k])
    share = [sum(t.values()) / max(1, sum(r.values())) for t, r in zip(target, raw)]
    ratio = lambda k, b: float(np.float32(np.log(target[k][b] + 1) - np.log(raw[k][b] * share[k] + 1))) if share[k] else 0.0
    scores = [sum(ratio(k, b) for k in (0, 1) for b in two[k]) / (hashed.PRIOR + len(two[0]) + len(two[1])) for two in found]
    clean, dirty = ([two[0] for (i, _), two in zip(rows, found) if i in ids - held] for ids in (good, poison))
    a, b = (Counter(w for words in docs for w in set(words)) for docs in (clean, dirty))
    weight = {w: np.log(n / (a[w] * len(dirty) / len(clean) + 0.2)) for w, n in b.items() if n >= hashed.LEAST_TOXIC and n >= hashed.MORE_TOXIC * a[w] * len(dirty) / len(clean)} if clean and dirty else {}
    against = [sum(weight.get(w, 0.0) for w in set(two[0])) / np.sqrt(1 + len(two[0])) for two in found]
    aside = [j for j, (i, _) in enumerate(rows) if i in good & held]
    lost = int(0.005 * len(aside))
    threshold = min(0.0, sorted(scores[j] for j in aside)[lost]) if aside else 0.0
    most = sorted(against[j] for j in aside)[-1 - lost] if aside else np.inf
    return [min(x, threshold) - hashed.REJECT if y > most + 1e-9 else x for x, y in zip(scores, against)], threshold


def test_model_counts_every_label(spark, monkeypatch):
    n, seen = 150_000, []
    text = F.expr(f"concat('w', id % 97, ' x', pmod(xxhash64(id), if(id < {n}, 4001, 97)), ' y', pmod(xxhash64(id, 5), 7))")
    made = spark.range(n + 31_000).select(F.col("id").alias("doc_id"), text.alias("text"))
    marks = spark.range(n).selectExpr("id as doc_id", "1 as quality", "0 as toxic").union(spark.range(n + 30_000, n + 31_000).selectExpr("id", "1", "1"))
    ratio, evidence = hashed.log_ratio, hashed.evidence
    monkeypatch.setattr(hashed, "log_ratio", lambda target, raw: seen.append(target[: hashed.WORDS].sum()) or ratio(target, raw))
    monkeypatch.setattr(hashed, "evidence", lambda size, documents: seen.append(size.tolist()) or evidence(size, documents))
    fitted = hashed.model(made, marks)
    out = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(5)) == 0
    clean, toxic = (made.where(~out).where(c).count() for c in (f"doc_id < {n}", f"doc_id >= {n + 30_000}"))
    assert clean > 100_000 and seen == [3 * clean, [clean, toxic]]
    aside = pa.array([r.text for r in made.where(out).where(f"doc_id < {n}").collect()])
    lost = int(0.005 * len(aside))
    scores, against = np.sort(hashed.score(aside, fitted.ratio)), np.sort(hashed.against(aside, fitted.toxic))
    assert len(aside) > 20_000 and abs(fitted.threshold - min(0.0, scores[lost])) < 1e-12 and abs(fitted.most - against[-1 - lost]) < 1e-12
    assert scores[lost] < 0 and len(np.unique(np.round(scores[: 4 * lost], 9))) > lost


def test_weights_and_verdicts_by_brute_force(spark, docs):
    r = random.Random(4)
    prose = lambda words, n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, prose("abcdefgh", 60) if i % 3 else prose("stuvwxyz", 60) + (" vile" if i % 2 else "")) for i in range(90)] + [(r_[0], r_[1]) for r_ in make_docs()[:45]] + [(None, None), (5, ""), (5, "")]
    labels = [(i, int(i % 3 > 0), 0) for i in range(70)] + [(i, 1, 1) for i in range(70, 90)] + [(None, 1, 0), (2, None, None)]
    held = {x[0] for x in spark.range(200).where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(5)) == 0).collect()}
    wanted, threshold = plain_scores(rows, labels, held)
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    key = lambda x: (str(x[0]), x[1])
    got = sorted(((x.doc_id, x.score, x.kept, x.base_failed) for x in rules.judge(made, marks).collect()), key=key)
    for (i, s), (j, score, kept, failed) in zip(sorted(((i, s) for (i, _), s in zip(rows, wanted)), key=key), got, strict=True):
        assert i == j and abs(s - score) < 1e-6 and (failed or abs(s - threshold) < 1e-6 or kept == (s >= threshold))
    assert min(wanted) < -hashed.REJECT and threshold < 0
    drawn = resample.sample(made, marks, k=1000).collect()
    assert np.allclose(sorted(x.log_weight for x in drawn), sorted(resample.SCALE * w for w in wanted), atol=1e-4)


def test_sample_follows_the_weights(spark):
    """Of texts of two kinds, the chance that one of the first kind has the greatest key is its weight's share."""
    texts = ["a a a b"] * 4 + ["b b b a"] * 4
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    ratio = np.zeros(hashed.BUCKETS)
    ratio[int(common.hashes(pa.array(["a"]))[0]) & (hashed.WORDS - 1)] = 0.3
    fitted = hashed.Model(ratio, 0.0, np.zeros(hashed.BUCKETS), float("inf"))
    many = spark.range(3000).withColumnRenamed("id", "seed").crossJoin(rows).select((F.col("seed") * 8 + F.col("doc_id")).alias("doc_id"), "text", "seed")
    got = resample.keyed(many, fitted, 1.0, 1).collect()
    first = {}
    for x in got:
        first[x.seed] = max(first.get(x.seed, (-np.inf, "")), (x.gumbel_key, x.text))
    w = {x.text: np.exp(x.log_weight) for x in got}
    wanted = w["a a a b"] / (w["a a a b"] + w["b b b a"])
    assert 0.6 < wanted < 0.95 and abs(np.mean([t == "a a a b" for _, t in first.values()]) - wanted) < 0.03
    assert all((a._key < b._key) == (a.gumbel_key < b.gumbel_key) for a, b in zip(got, got[1:]))


def test_kth_key_of_any_sign_and_size(spark):
    x = np.array([-np.inf, -1e300, -5.0, -1e-300, -0.0, 0.0, 2.0, 2.0, 7e18, 1e300, np.inf])
    keys = resample.ordered(x).tolist()
    assert keys == sorted(keys) and keys[4] == keys[5]
    table = spark.createDataFrame([(k,) for k in keys], "k long")
    for k in range(1, len(keys) + 1):
        assert resample.kth_key(table, "k", k) == keys[-k]
    assert resample.kth_key(table, "k", 12) is None


def test_log_ratio_is_silent_without_evidence():
    target, raw = np.zeros(hashed.BUCKETS, np.int64), np.zeros(hashed.BUCKETS, np.int64)
    target[:2], raw[:3] = (500, 500), (1000, 1000, 800)
    ratio = hashed.log_ratio(target, raw)
    assert ratio[2] < -2 and ratio[0] > 0 and not ratio[3:].any()
    assert not hashed.log_ratio(np.zeros_like(raw), raw).any()


def test_warc_round_trip_and_salvage(spark):
    rows = [(1, "http://a", "é" * 10), (2, "http://b", "same"), (3, None, "same"), (4, "x\r\ny", ""), (5, "u", None), (6, "u", "once"), (None, "u", "same"), (3, None, "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = warc.round_trip(spark, pages, payloads=True).collect()
    digest = lambda t: warc.digest((t or "").encode())
    largest = {}
    for p, _, t in rows:
        largest[digest(t)] = max(largest.get(digest(t), -1), -1 if p is None else p)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter((p, len((t or "").encode()), digest(t)) for p, _, t in rows)
    for d, p in largest.items():
        own = [r for r in got if r.payload_digest == d]
        assert [r.page_id for r in own if r.kind == "response"] == [p]
        assert all(r.refers_to == p and r.payload == b"" for r in own if r.kind == "revisit")
    assert warc.round_trip(spark, pages.where("false")).count() == 0


def test_warc_repeated_rows_have_one_response(spark):
    rows = [(3, "u", "same", "x")] * 8 + [(2, "u", "same", "x")] * 3 + [(None, None, "none", None)] * 4 + [(i, "u", "body %d" % i, "x") for i in range(10, 30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, kind string").repartition(4)
    got = warc.round_trip(spark, pages, roll=500).collect()
    assert len(got) == len(rows) and len({r.archive for r in got}) > 4
    kinds = Counter((r.page_id, r.kind, r.refers_to) for r in got if r.page_id is None or r.page_id < 10)
    assert kinds == {(3, "response", None): 1, (3, "revisit", 3): 7, (2, "revisit", 3): 3, (None, "response", None): 1, (None, "revisit", None): 3}


def test_warc_reading_is_linear_and_without_a_size_limit(monkeypatch):
    body = lambda i: b"%d " % i * 300
    made = lambda i: warc.record_bytes({"WARC-Type": "response", "WARC-Payload-Digest": "sha1:" + warc.digest(body(i))}, body(i))
    for pack in (warc.member, bytes):
        took = {}
        for n in (2000, 16000):
            data = b"".join(pack(made(i)) for i in range(n))
            began = time.process_time()
            assert sum(isinstance(x, warc.Record) for x in warc.scan(data)) == n
            took[n] = time.process_time() - began
        assert took[16000] < 24 * took[2000]
    # far larger than any buffer
    large = b"\0" * (warc.CHUNK + 5 * warc.INFLATE) + b"end"
    record = warc.record_bytes({"WARC-Type": "response", "WARC-Payload-Digest": "sha1:" + warc.digest(large)}, large)
    for data in (warc.member(record), record, b"x" + warc.member(record + made(1))):
        found = list(warc.scan(data))
        assert [len(x.payload) for x in found if isinstance(x, warc.Record)][0] == len(large)
        assert [x.size for x in warc.scan(data, keep=False) if isinstance(x, warc.Record)][0] == len(large)
    # version lines without any end, read through a small buffer: every start fails at the next one
    monkeypatch.setattr(warc, "CHUNK", 64)
    bad = b"WARC/1.1\r\nA: b\r\n" * 500
    assert [(x.offset, x.length) for x in warc.scan(bad)] == [(0, len(bad))]


def test_scan_recovers_after_damage():
    records = [warc.member(warc.record_bytes({"WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{i}>", "WARC-Payload-Digest": "sha1:" + warc.digest(b"x" * 50 * i)}, b"x" * 50 * i)) for i in range(6)]
    plain = warc.record_bytes({"WARC-Type": "response", "WARC-Record-ID": "<urn:page:9>", "WARC-Payload-Digest": "sha1:" + warc.digest(b"plain")}, b"plain")
    assert [x.headers["WARC-Record-ID"] for x in warc.scan(b"".join(records) + plain)] == [f"<urn:page:{i}>" for i in (*range(6), 9)]
    broken = bytearray(b"".join(records))
    at = len(records[0])
    broken[at + 20] ^= 255
    found = list(warc.scan(b"junk" + bytes(broken) + b"tail" + plain + records[1][:-5]))
    assert [x.headers["WARC-Record-ID"] for x in found if isinstance(x, warc.Record)] == [f"<urn:page:{i}>" for i in (0, 2, 3, 4, 5, 9)]
    gaps = [(x.offset, x.length) for x in found if isinstance(x, warc.Gap)]
    assert gaps[0] == (0, 4) and gaps[1] == (4 + at, len(records[1])) and len(gaps) == 4


def plain_removed(rows, window=35):
    seen = Counter()
    for r in rows:
        w = split(r[1])
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = Counter()
    for r in rows:
        w = split(r[1])
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def test_substrings(docs, empty):
    got = rlz.remove(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain_removed(make_docs())
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert rlz.remove(empty).count() == 0
    hot = rlz.remove(docs.select("doc_id", "text"), window=6, seed=3, most=1).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in hot) == plain_removed(make_docs(), 6)


@pytest.mark.parametrize("most", [20_000, 3])
def test_substrings_of_few_words(spark, monkeypatch, most):
    """Many matches of all kinds: a vocabulary of few words, passages that begin and end anywhere, repeated rows."""
    r = random.Random(11)
    prose = lambda n: " ".join(r.choice("abc") for _ in range(n))
    passage = prose(300)
    rows = [(i, prose(r.randint(0, 60))) for i in range(60)]
    rows += [(100 + i, prose(9) + " " + " ".join(passage.split()[r.randint(0, 150) : r.randint(150, 300)]) + " " + prose(7)) for i in range(40)]
    rows += [rows[70]] * 5 + [(None, rows[71][1])] * 3
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for window, seed in ((8, 3), (12, 5)):
        got = rlz.remove(table, window=window, seed=seed, most=most).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain_removed(rows, window)


def test_substrings_of_repeated_rows_are_linear(spark):
    r = random.Random(12)
    text = " ".join(str(r.randint(0, 9999)) for _ in range(400))
    table = spark.createDataFrame([(1, text)] * 3000 + [(None, text + " x")] * 1000 + [(i, " ".join(str(r.randint(0, 9999)) for _ in range(50)) + " " + text) for i in range(2, 6)], "doc_id long, text string")
    spans = rlz.duplicate_spans(table).select(F.size("windows").alias("n")).agg(F.max("n"), F.count("*")).first()
    assert spans[0] < 400 and spans[1] == 4004
    got = rlz.remove(table, texts=False).groupBy("n_words", "n_removed").count().collect()
    assert {(x.n_words, x.n_removed): x["count"] for x in got} == {(400, 400): 3000, (401, 401): 1000, (450, 400): 4}


def test_longest_matches_and_factors():
    r = np.random.default_rng(6)
    for _ in range(60):
        size = r.integers(1, 30, 12)
        offsets, block = np.concatenate([[0], np.cumsum(size)]), np.sort(r.integers(0, 3, 12))
        h, c = r.integers(0, 2, offsets[-1]).astype(np.uint64), r.integers(1, 3, 12) // 2 + 1
        pieces = [h[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
        for i in range(12):  # equal pieces of a block do not occur
            if any(block[i] == block[j] and pieces[i] == pieces[j] for j in range(i)):
                h[offsets[i] : offsets[i + 1]] = 1000 + i
                pieces[i] = h[offsets[i] : offsets[i + 1]].tolist()
        match = rlz.longest_matches(block, offsets, h, c)

        def longest(i, a):
            if c[i] > 1:
                return size[i] - a
            most = 0
            for j in range(12):
                for b in range(size[j]):
                    if block[i] == block[j] and (i, a) != (j, b):
                        n = 0
                        while a + n < size[i] and b + n < size[j] and pieces[i][a + n] == pieces[j][b + n]:
                            n += 1
                        most = max(most, n)
            return most

        assert match.tolist() == [longest(i, a) for i in range(12) for a in range(size[i])]
        piece, first, n = rlz.factors(offsets, match, 4)
        windows = {(p, w) for p, f, m in zip(piece.tolist(), first.tolist(), n.tolist()) for w in range(f, f + m - 3)}
        assert windows == {(i, a) for i in range(12) for a in range(size[i]) if match[offsets[i] + a] >= 4}


def plain_base(text):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, pattern in kinds.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans():
    r = random.Random(3)
    parts = ["@", "a", "b.", ".", "1", "25", "12", "300", "-", " ", "+", "(", ")", "a@b.c", "4668656817506359", "%", "é", "1.2.3.4", "+1 (389) 555-5010"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        assert pii.base_spans(text) == plain_base(text)
    assert pii.base_spans("a" * 200_000 + "@") == [] and pii.base_spans("1" * 200_000) == []


def test_tagger_gradients_and_accuracy():
    small = pii.Tagger(4, 5)
    small.p = {k: v.astype(np.float64) for k, v in small.p.items()}
    x, y = pii.examples(3, 1)
    _, g = small.step(x, y)
    r = np.random.default_rng(0)
    for k, v in small.p.items():
        at = (x[0, 0], 1) if k == "embed" else tuple(r.integers(0, s) for s in v.shape)
        old = v[at]
        up, down = [], []
        for out, e in ((up, 1e-3), (down, -1e-3)):
            v[at] = old + e
            out.append(small.step(x, y)[0])
        v[at] = old
        assert abs((up[0] - down[0]) / 2e-3 - g[k][at]) < 1e-4
    x, y = pii.examples(400, 99)
    path, _ = pii.trained().decode(pii.trained().emissions(x))
    assert (path == y).mean() > 0.98 and (path == y)[y > 0].mean() > 0.95


def test_decoding_by_brute_force():
    import itertools

    tagger, r = pii.Tagger(4, 5), np.random.default_rng(1)
    tagger.p["trans"], tagger.p["start"] = r.normal(size=(pii.LABELS, pii.LABELS)), r.normal(size=pii.LABELS)
    em = r.normal(size=(2, 4, pii.LABELS)) * 2
    path, sure = tagger.decode(em)
    for e, p, q in zip(em, path, sure):
        every = list(itertools.product(range(pii.LABELS), repeat=4))
        score = [tagger.p["start"][y[0]] + sum(e[i, y[i]] for i in range(4)) + sum(tagger.p["trans"][a, b] for a, b in zip(y, y[1:])) for y in every]
        assert tuple(p) == every[int(np.argmax(score))]
        weight = np.exp(np.array(score))
        wanted = [sum(w for w, y in zip(weight, every) if y[i] == p[i]) / weight.sum() for i in range(4)]
        assert np.allclose(q, wanted)


def sentence(r, n):
    plain = "the quick report said that we were going to see what happened when she left town early and nobody could tell him why it was so cold over there last winter after all these years of work".split()
    out = ""
    while len(out) < n:
        out += r.choice(plain) + " "
    return out


def test_spans_of_any_length_at_any_offset():
    r, tagger, caught, asked = random.Random(3), pii.trained(), Counter(), Counter()
    name = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    forms = [
        lambda n: name(max(3, n - 20)) + " [at] " + name(5) + " [dot] com",
        lambda n: ".".join(name(5) for _ in range(max(1, (n - 20) // 6))) + " [at] " + name(5) + " [dot] com",
        lambda n: name(6) + " [at] " + " [dot] ".join(name(6) for _ in range(max(1, (n - 15) // 13))) + " [dot] edu",
        lambda n: name(6) + "(at)" + "(dot)".join(name(6) for _ in range(max(1, (n - 15) // 11))) + "(dot)edu",
    ]
    for size in (30, 55, 85, 120, 250, 500):
        texts, wanted = [], []
        for offset in range(48):
            span, before = forms[offset % 4](size), sentence(r, 100 + offset)
            texts.append(before + span + " " + sentence(r, 150))
            wanted.append(("email", len(before), len(before) + len(span)))
        got = pii.added_spans(texts, [pii.base_spans(t) for t in texts], tagger)
        caught[size], asked[size] = sum(w in g for w, g in zip(wanted, got)), 48
        # what is found does not depend on the texts around
        assert pii.added_spans(texts[:5], [pii.base_spans(t) for t in texts[:5]], tagger) == got[:5]
    assert all(caught[s] >= 0.9 * asked[s] for s in asked) and sum(caught.values()) >= 0.95 * sum(asked.values())


def test_loose_spellings_in_plain_sentences():
    r, tagger = random.Random(5), pii.trained()
    makers = {"phone": lambda: f"({r.randint(200, 999)}) {r.randint(200, 999)}-{r.randint(1000, 9999)}", "ip": lambda: "[.]".join(str(r.randint(0, 255)) for _ in range(4)), "email": lambda: "joan." + "".join(r.choice("abcdefgh") for _ in range(5)) + " (at) mail.org"}
    for kind, make in makers.items():
        texts, wanted = [], []
        for _ in range(60):
            before, span = sentence(r, r.randint(0, 130)), make()
            texts.append(before + span + ", " + sentence(r, 40))
            wanted.append((kind, len(before), len(before) + len(span)))
        got = pii.added_spans(texts, [pii.base_spans(t) for t in texts], tagger)
        assert np.mean([w in g for w, g in zip(wanted, got)]) > 0.9
    clean = [sentence(r, 300) + f"in {r.randint(1900, 2030)} for ${r.randint(10, 99)}.50 or {r.randint(1, 99)}% " + sentence(r, 100) for _ in range(100)]
    assert sum(map(len, pii.added_spans(clean, [pii.base_spans(t) for t in clean], tagger))) <= 1


def test_personal_data_rows(spark):
    texts = ["mail bofmf.71@mail4.example.com now", "ring +1 (389) 555-5010 4866351201689520 then", "", None, "clean prose without any", "x" * 5000 + " 17.252.227.210 " + "y" * 5000, "call +1 (389) 555-5010"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digests(docs).collect()}
    for i, t in enumerate(texts):
        base = plain_base(t or "")
        assert got[i].base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert set(pii.joined(base).split(",")) <= set(got[i].spans.split(",")) | {""}
    assert "card:23:39" in got[1].spans
    masked = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert masked[0] == "mail [EMAIL] now" and masked[3] is None and masked[4] == texts[4]
    assert pii.digests(docs.where("false")).count() == 0


def test_windows_skip_only_what_cannot_yield():
    text = "a" * 300 + " 12 " + "b" * 300
    starts = pii.windows(text)
    assert starts and all(s <= 302 < s + pii.WINDOW + 2 for s in starts)
    assert pii.windows("plain words only") == []


def test_kdtree(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=8).astype(float).tolist(), 0) for i in range(300)] + [(300 + i, rows_0, 1) for i, rows_0 in enumerate([[0.5] * 8] * 40)]
    rows += [(900, None, 0), (901, [None] * 8, 0), (902, [float("nan")] * 8, 0), (903, [float("inf")] * 8, 0), (None, [0.1] * 8, 0), rows[5]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    fine = {i: np.floor(256 * np.array(v)).astype(int) for i, v, _ in rows[:340]}
    for shards in (1, 5):
        got = kdtree.top_k(table, F.col("vec_id") % 50 == 0, least_shards=shards, sample=16).collect()
        wanted = set()
        for q in range(0, 340, 50):
            best = sorted(((-int(fine[q] @ v), i) for i, v in fine.items() if i != q))[:5]
            wanted |= {(q, k, i, -s) for k, (s, i) in enumerate(best, 1)}
        assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == wanted and len(got) == len(wanted)
    assert kdtree.top_k(table.where("false"), F.col("vec_id") == 0).count() == 0
    few = kdtree.top_k(table.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert len(few) == 2


def test_kdtree_prunes():
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(c, 0.05, (400, 4)) for c in (0, 5, -5)])
    tree = kdtree.build(x, 32)
    q = np.array([[1.0, 1, 1, 1]])
    got = kdtree.search(tree, [np.array([i]) for i in range(len(x))], q, np.array([-1]), 3, np.array([-(2.0**63)]))
    assert [i for _, i in got[0]] == sorted(range(len(x)), key=lambda i: (-int((x @ q[0])[i]), i))[:3]


def test_elias_fano():
    r = np.random.default_rng(0)
    for n, u in ((0, 1), (1, 1), (1, 1000), (1000, 1000), (1000, 10**6), (5000, 2**45), (3000, 1500)):
        v = np.sort(r.integers(0, u, n))
        e = elias_fano.EliasFano(elias_fano.encode(v, u))
        assert (e.access(np.arange(n)) == v).all()
        x = np.concatenate([r.integers(0, u, 500), v, [0, u - 1, u + 5]])
        at, equal = e.find(x)
        assert (at == np.searchsorted(v, x)).all() and (equal == np.isin(x, v)).all()


def plain_model(rows):
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    text = lambda t: split("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + ["\n"]
    grams = [Counter(), Counter(), Counter()]
    for r in rows:
        if not held(r[0]):
            w = text(r[1])
            for k in range(3):
                grams[k].update(tuple(w[i : i + k + 1]) for i in range(len(w) - k))
    n, v, d = sum(grams[0].values()), len(grams[0]), ngram_lm.DISCOUNT
    mass = [Counter(), Counter(), Counter()]
    for k in (1, 2):
        for g, c in grams[k].items():
            if c >= 2:
                mass[k][g[:-1]] += c - d

    def p(g):
        k = len(g) - 1
        if k == 0:
            return (grams[0][g] + 0.1) / (n + 0.1 * (v + 1))
        h, c = g[:-1], grams[k][g]
        total = max(1, grams[k - 1][h])
        return (max(c - d, 0) / total if c >= 2 else 0) + (1 - mass[k][h] / total) * p(g[1:])

    out = []
    for r in rows:
        w = text(r[1])
        s = sum(np.log10(p(tuple(w[max(0, i - 2) : i + 1]))) for i in range(len(w)))
        out.append((r[0], held(r[0]), len(w), sum(grams[0][(x,)] > 0 for x in w), n, sum(np.log10(p((x,))) for x in w), s))
    return out


@pytest.mark.parametrize("shard", [500_000, 40])
def test_language_model(docs, empty, monkeypatch, shard):
    monkeypatch.setattr(ngram_lm, "SHARD", shard)
    key = lambda r: (str(r[0]), r[2], r[5])
    got, wanted = sorted(map(tuple, ngram_lm.learn_and_score(docs, least=2).collect()), key=key), sorted(plain_model(make_docs()), key=key)
    for a, b in zip(got, wanted, strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 and abs(a[6] - b[6]) <= 3e-4 * b[2]
    assert ngram_lm.learn_and_score(empty).count() == 0
    alone = ngram_lm.learn_and_score(docs.where("doc_id is null")).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 for r in alone)


@pytest.mark.parametrize(("order", "shard"), [(3, 1_500_000), (4, 25), (2, 3)])
def test_op9_stores_what_occurs_once(spark, tmp_path, monkeypatch, order, shard):
    monkeypatch.setattr(ngram_lm, "SHARD", shard)
    r = random.Random(9)
    texts = [" ".join(r.choice("abcdefghijkl") for _ in range(r.randint(3, 40))) for _ in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(60)]
    grams, mass = Counter(), Counter()
    for text, out in zip(texts, held):
        w = [*text.split(), "\n"]
        grams.update(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1) if not out)
    for g, c in grams.items():
        mass[g[:-1]] += c - ngram_lm.DISCOUNT
    n, v = (f(c for g, c in grams.items() if len(g) == 1) for f in (sum, lambda x: len(list(x))))

    def p(g):
        if len(g) == 1:
            return (grams[g] + 0.1) / (n + 0.1 * (v + 1))
        uses = max(1, grams[g[:-1]])
        return max(grams[g] - ngram_lm.DISCOUNT, 0) / uses + (1 - mass[g[:-1]] / uses) * p(g[1:])

    made = queries.QUERIES["op9_ngram_trie"](spark, str(tmp_path)) if order == 3 else ngram_lm.learn_and_score(spark.read.parquet(f"{tmp_path}/documents.parquet"), order)
    got = {x.doc_id: x for x in made.collect()}
    assert any(held) and (order < 3 or any(c == 1 for c in grams.values()))
    for i, text in enumerate(texts):
        w = [*text.split(), "\n"]
        wanted = sum(np.log10(p(tuple(w[max(0, j - order + 1) : j + 1]))) for j in range(len(w)))
        assert got[i].held_out == held[i] and abs(got[i].score - wanted) <= 3e-4 * len(w)


def test_packed_counts_and_wide_keys():
    r = np.random.default_rng(2)
    for n in (0, 1, 1000):
        x = [r.integers(0, 1 << b, n) for b in (1, 9, 40, 62)]
        assert all((a == b).all() for a, b in zip(x, ngram_lm.unpack(ngram_lm.pack(*x), n, 4)))
    context, place = r.integers(0, 1 << 50, 500).repeat(3), r.integers(0, 3, 1500) + (1 << 40)
    order, starts = ngram_lm.distinct(context, place)
    assert [(context[i], place[i]) for i in order[starts]] == sorted(set(zip(context.tolist(), place.tolist())))
    first, parts = ngram_lm.ranges(np.array([1, 2, 50, 1, 1, 9, 9, 21]), 10)
    assert first.tolist() == [0, 2, 3, 5, 6, 7] and parts.tolist() == [1, 5, 1, 1, 1, 3]


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    r = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "the", "é", "ß", "'s", "12", ".", "<|endoftext|>", " ", "́", "😀", "\r\n", "中文", "\x1c", "​"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    codec = bpe.ByteBPE(path)
    starts, ids = codec.column(pa.array(texts))
    at, back = codec.decode_column(starts, ids)
    for i, t in enumerate(texts):
        wanted = library.encode(t, add_special_tokens=False).ids
        assert ids[starts[i] : starts[i + 1]].tolist() == wanted == codec.encode(t)
        assert bytes(back[at[i] : at[i + 1]]).decode("utf-8", "replace") == library.decode(wanted, skip_special_tokens=False) == codec.decode(wanted)
    wanted = Counter()
    for row in make_docs():
        e = library.encode(row[1] or "", add_special_tokens=False).ids
        d = library.decode(e, skip_special_tokens=False)
        wanted[row[0], len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(d.encode()).hexdigest()] += 1
    got = bpe.encode(docs, path)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == wanted
    assert bpe.decode(got.select("ids", "text"), path).where("decoded <> coalesce(text, '')").count() == 0
    assert bpe.encode(empty, path).count() == 0


def test_hashes_of_slices_and_long_words():
    r = random.Random(1)
    w = sorted({"".join(r.choice("abcé") for _ in range(r.choice((1, 3, 8, 20, 300)))) for _ in range(20_000)}) + ["x" * 400_000, "y"]
    every = [common.hashes(pa.array(w), k) for k in range(3)]
    assert all(len(set(h.tolist())) == len(w) for h in every) and not (every[0] == every[1]).any()
    assert (common.hashes(pa.array(w)[1000:2000]) == every[0][1000:2000]).all()
    assert [common.hashes(pa.array([x]))[0] for x in w[-3:]] == every[0][-3:].tolist()
