"""Repeats, Jaccard classes, top-k, shards, mixing and the pipeline against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pytest

import corpus_pipeline
from barloom.llm import components, decontaminate, jaccard, mixing, parsing, repeats, sharding, subtrees, topk
from barloom.llm.common import numbered, settle
from compare import differences
from tests.llm import fixture as X


@pytest.fixture(scope="module")
def corpus():
    docs = X.table("documents")
    return [(int(d), t) for d, t in zip(docs.doc_id, docs.text, strict=True)]


def by_row(rows):
    return sorted(rows, key=repr)


def test_bytes_query(spark, corpus):
    want = [(d, n, gone, runs, hashlib.sha256(kept).hexdigest())
            for (d, _), (n, gone, runs, kept) in zip(corpus, X.removed_bytes([t for _, t in corpus], 400), strict=True)]
    assert [tuple(r) for r in parsing.query(spark, X.SF).orderBy("doc_id").collect()] == want


def test_bytes_edges(spark):
    got = parsing.dedup(X.documents(spark), length=40, phrase=20, trigger=4)
    want = [(r[0], *x[:3], bytearray(x[3])) for r, x in zip(X.ROWS, X.removed_bytes([r[1] for r in X.ROWS], 40), strict=True)]
    assert by_row(tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()) == by_row(want)
    assert parsing.dedup(X.documents(spark, [])).count() == 0


def test_anchors_in_chunks(monkeypatch):
    """The stretch that is looked at does not change what is found."""
    r = random.Random(8)
    texts = ["".join(r.choice("ab") for _ in range(n)) for n in (0, 5, 30, 700, 24, 1, 300)]
    symbols, first = parsing.bytes_of(pa.array(texts))

    def found():
        parts = list(repeats.anchors(symbols, first, 24, 10, 3))
        rows = zip(*[np.concatenate([p[c] for p in parts]).tolist() for c in ("text", "at", "near", "far", "core", "full")], strict=True)
        return sorted(rows)

    whole = found()
    monkeypatch.setattr(repeats, "CHUNK", 7)
    assert found() == whole
    windows = sorted((t, at - d) for t, at, near, far, _, _ in whole for d in range(near, far + 1))
    assert windows == [(i, j) for i, t in enumerate(texts) for j in range(len(t) - 23)]
    start = np.array([5, 700, 3, 40])
    assert repeats._hashes(symbols, start, 24, 3).tolist() == [
        int(repeats.Rolling(symbols[i:i + 24], 3)(np.array([0]), np.array([24]))[0]) for i in start]


@pytest.mark.parametrize("near_by", [3, 16])
def test_repeats_in_random_text(spark, monkeypatch, near_by):
    """Few letters make repeats that overlap, nest and end anywhere."""
    monkeypatch.setattr(repeats, "NEAR_BY", near_by)
    r = random.Random(near_by)
    parts = ["".join(r.choice("ab") for _ in range(r.randint(1, 40))) for _ in range(12)]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 12))), None, None) for i in range(60)]
    got = parsing.dedup(X.documents(spark, rows), length=24, phrase=10, trigger=3)
    want = [(row[0], *x[1:3], bytearray(x[3])) for row, x in zip(rows, X.removed_bytes([r[1] for r in rows], 24), strict=True)]
    assert [tuple(x) for x in got.select("doc_id", "n_removed", "n_spans", "kept").orderBy("doc_id").collect()] == want
    spaced = [(i, " ".join(t), None, None) for i, t, _, _ in rows]
    got = subtrees.dedup(X.documents(spark, spaced))
    want = [(row[0], *x[1:]) for row, x in zip(spaced, X.removed_words([r[:2] for r in spaced], 13), strict=True)]
    assert [tuple(x) for x in got.select("doc_id", "n_removed", "kept").orderBy("doc_id").collect()] == want


@pytest.mark.parametrize("group", [1, 5, 60, 1 << 18])
def test_suffix_groups_of_any_prefix(spark, group):
    """Prefixes are made longer until few suffixes share them; nodes go on over batches; no size changes a result."""
    r = random.Random(group)
    parts = [" ".join(r.choice("ab") for _ in range(r.randint(1, 30))) for _ in range(8)]
    rows = [(None if i % 17 == 0 else i // 2, " ".join(r.choice(parts) for _ in range(r.randint(0, 9)))) for i in range(70)]
    want = [(d, *x[1:]) for (d, _), x in zip(rows, X.removed_words(rows, 13), strict=True)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    docs = X.documents(spark, [(d, t, None, None) for d, t in rows])
    got = subtrees.dedup(docs, group=group).select("doc_id", "n_removed", "kept").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert by_row(map(tuple, got)) == by_row(want)


def test_prefixes_are_as_long_as_needed(spark):
    rows = [(bytes([0, 0, 0, k % 3, *([0] * 12)]) + bytes([0, 0, 0, k % 50]) + bytes(32),) for k in range(600)] + [(bytes([9] * 52),)] * 40
    suffixes = spark.createDataFrame(rows, "suffix binary")
    for group, want in ((1000, {4: 640}), (100, {4: 40, 32: 600}), (20, {32: 600, 52: 40})):
        dealt, prefix = subtrees.prefixes(suffixes, 13, group)
        got = {r.n: r["count"] for r in dealt.select(F.octet_length(prefix).alias("n")).groupBy("n").count().collect()}
        assert got == want, group


def test_words_query(spark, corpus):
    want = [(d, n, gone, hashlib.sha256(kept.encode()).hexdigest())
            for (d, _), (n, gone, kept) in zip(corpus, X.removed_words(corpus, 13), strict=True)]
    assert [tuple(r) for r in subtrees.query(spark, X.SF).orderBy("doc_id").collect()] == want


def test_words_edges(spark):
    got = subtrees.dedup(X.documents(spark))
    want = [(r[0], *x) for r, x in zip(X.ROWS, X.removed_words([r[:2] for r in X.ROWS], 13), strict=True)]
    assert by_row(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept").collect()) == by_row(want)
    assert subtrees.dedup(X.documents(spark, [])).count() == 0


def test_jaccard_query(spark, corpus):
    want = [(d, *x) for (d, _), x in zip(corpus, X.classes(corpus), strict=True)]
    assert [tuple(r) for r in jaccard.query(spark, X.SF).orderBy("doc_id").collect()] == want


@pytest.mark.parametrize("block", [3, 512])
def test_jaccard_edges_and_blocks(spark, block):
    r = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    near = []
    for i in range(30):  # one group in which most texts are linked and some only through others
        t = list(base)
        for at in r.sample(range(120), i % 3 + 1):
            t[at] = f"x{i}"
        near.append((100 + i, " ".join(t), None, None))
    rows = [*X.ROWS, *near]
    found = jaccard.classes(X.documents(spark, rows), block=block)
    got = found.select(F.when(F.col("doc") < 1 << 62, F.col("doc")), "class_id", "n_links", "n_texts").collect()
    want = [(row[0], *x) for row, x in zip(rows, X.classes([r[:2] for r in rows]), strict=True)]
    assert by_row(map(tuple, got)) == by_row(want)
    kept = jaccard.keep_first(X.documents(spark, rows), block=block)
    assert kept.columns == X.documents(spark, []).columns
    heads = Counter(c for c, _, _ in X.classes([r[:2] for r in rows] ))
    ids = Counter(row.doc_id for row in kept.collect())
    assert max(ids.values()) == 1 and set(ids) == set(heads) - {None} | {1, 2, 3}
    assert jaccard.classes(X.documents(spark, [])).count() == 0


def test_forest_prefix():
    assert jaccard.prefix_length(0.8, 24, 0.99999, 8) == 4
    assert jaccard.prefix_length(0.8, 24, 0.9, 8) > 4


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100 + r.randrange(60), 100 + r.randrange(60)) for _ in range(50)] + [(7, 7), (500, 499)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {n: find(n) for n in root if any(n in e for e in edges if e[0] != e[1])}
    got = components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {x.node: x.component for x in got} == want and len(got) == len(want)


def test_threshold_stops_early_and_is_exact():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-5, 6, (3000, 3)) * 100 + rng.integers(0, 2, (3000, 3))
    ids = rng.permutation(3000)
    lists = topk.Lists(ids, vectors)
    for q in ([9, -2, 0], [0, 0, 0], [1, 0, 0], [-3, 5, 7]):
        rows, scores, depth = lists.top(5, np.array(q), 7)
        want = sorted((-int(v @ np.array(q)), int(i)) for i, v in zip(ids, vectors, strict=True) if i != 5)[:7]
        assert [(-int(s), int(lists.ids[r])) for r, s in zip(rows, scores, strict=True)] == want
    spread = topk.Lists(np.arange(3000), rng.permutation(9000).reshape(3000, 3))
    assert spread.top(None, np.array([1, 0, 0]), 5)[2] < 100


def test_top_k_query(spark, con):
    assert not differences(topk.query(spark, X.SF).toPandas(), con.sql(topk.SQL).df())


def test_top_k_blocks_and_edges(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [int(x) for x in rng.integers(-3, 4, 6)]) for i in range(150)] + [(150, [2**40] * 6), (151, []), (152, None), (None, [1] * 6)]
    df = spark.createDataFrame(rows, "id bigint, v array<bigint>")
    got = topk.exact_top_k(df, df.filter("id % 50 = 0"), 5, block=20, at_once=2).collect()
    full = {i: v + [0] * (6 - len(v)) for i, v in rows if i is not None and v is not None}
    for q in (0, 50, 100, 150):
        want = sorted((-sum(a * b for a, b in zip(full[q], v, strict=True)), i) for i, v in full.items() if i != q)[:5]
        mine = sorted((r.rank, -r.score, r.vec_id) for r in got if r.query_id == q)
        assert [(s, i) for _, s, i in mine] == want and [r for r, _, _ in mine] == [1, 2, 3, 4, 5]
    assert topk.exact_top_k(df.filter("id < 3"), df.filter("id = 0"), 5).count() == 2
    assert topk.exact_top_k(df.filter("false"), df.filter("false"), 5).count() == 0


def test_top_k_of_repeated_ids(spark):
    """Each row is a candidate and each query row has its own answer; only the query's own row is left out."""
    rows = [(0, [3, 0]), (0, [1, 1]), (1, [2, 0]), (1, [2, 0]), (7, [0, 9])]
    df = spark.createDataFrame([(i, v, n) for n, (i, v) in enumerate(rows)], "id bigint, v array<bigint>, row bigint")
    for block in (1, 2, 100):
        got = topk.exact_top_k(df, df.filter("id % 50 = 0"), 3, block=block, at_once=1).collect()
        want = []
        for n, (i, q) in enumerate(rows):
            if i % 50 == 0:
                best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for m, (j, v) in enumerate(rows) if m != n)[:3]
                want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
        assert sorted(map(tuple, got)) == sorted(want)


def test_shards_of_null_and_repeated_keys_are_split(spark):
    """No group holds more than a part of the rows of one key, so no task sorts them all."""
    docs = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.lit(5)).cast("long").alias("doc_id"),
                                      F.concat(F.lit("t"), F.col("id")).alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    made = sharding.shard_documents(docs, 16)
    assert sorted(r["count"] for r in made.groupBy("shard").count().collect()) == [1250] * 16
    assert made.select("shard", "slot").distinct().count() == 20_000
    largest = made.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert largest < 20_000 / 2


def test_vectors_that_take_no_part(spark, tmp_path):
    rows = [(0, [0.5, float("nan")]), (50, [0.1, None]), (100, None), (150, [0.5, -0.001]), (1, [1.0, 0.0]), (2, [float("inf"), 0.0])]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in topk.query(spark, str(tmp_path)).collect()] == [(150, 1, 1, 128 * 256)]


def test_hilbert_curve_visits_neighbours(spark):
    for n, bits in ((2, 3), (3, 4), (4, 2)):
        cells = spark.range(1 << n * bits).select(*[
            F.shiftright("id", bits * k).bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias(f"c{k}") for k in range(n)])
        walk = sorted((r.h, *r[:n]) for r in sharding.with_hilbert_index(cells, [f"c{k}" for k in range(n)], "h", bits).collect())
        assert [w[0] for w in walk] == list(range(1 << n * bits))
        assert all(sum(abs(a - b) for a, b in zip(x[1:], y[1:], strict=True)) == 1 for x, y in zip(walk, walk[1:], strict=False))


@pytest.mark.parametrize("options", [{}, {"splits": 3, "cell_rows": 4}])
def test_shards(spark, options):
    made = sharding.shard_documents(X.documents(spark), 4, **options).collect()
    assert len(made) == len(X.ROWS)
    sizes = Counter(r["shard"] for r in made)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(4))
    for s in range(4):
        own = sorted((r["slot"], r["cell"]) for r in made if r["shard"] == s)
        assert [x[0] for x in own] == list(range(len(own))) and [x[1] for x in own] == sorted(x[1] for x in own)
    ends = [max(r["cell"] for r in made if r["shard"] == s) for s in range(4)]
    assert ends == sorted(ends)
    assert sharding.shard_documents(X.documents(spark, []), 4).count() == 0
    few = sharding.shard_documents(X.documents(spark, X.ROWS[:2]), 16).collect()
    assert sorted((r["shard"], r["slot"]) for r in few) == [(0, 0), (1, 0)]


def test_shard_query(spark):
    docs = X.table("documents")
    got = {r.doc_id: r for r in sharding.query(spark, X.SF).collect()}
    import zlib
    for d, t in zip(docs.doc_id, docs.text, strict=True):
        assert (got[d].size, got[d].text_crc32) == (len(t.encode()) + 1, zlib.crc32(t.encode()))
    assert sorted(Counter(r.shard for r in got.values()).values()) == [12] * 8 + [13] * 8


def test_pivots_keep_mass_and_means():
    rng = np.random.default_rng(3)
    for pivot, even in ((mixing.pivot_even, True), (mixing.pivot_pairs, False)):
        for n in (1, 2, 9):
            p0 = np.full(n, rng.random()) if even else rng.random(n)
            w, mean = rng.integers(1, 50, n).astype(float), np.zeros(n)
            for _ in range(3000):
                p = p0.copy()
                left = pivot(p, w, rng.random(n))
                assert abs((p * w).sum() - (p0 * w).sum()) < 1e-6 and ((p > 0) & (p < 1)).sum() == (left >= 0)
                mean += p / 3000
            assert np.abs(mean - p0).max() < 0.05


def water(sizes: dict, weights=(1, 2, 3), most=3.0) -> dict:
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    full: set = set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        rate = rest / sum(weight[s] for s in free) if free else 0
        more = {s for s in free if weight[s] * rate > most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in full else weight[s] * rate for s in order}
        full |= more


@pytest.mark.parametrize("group", [4, 512])
def test_mix_targets_and_copies(spark, group):
    r = random.Random(6)
    rows = [(i, "w " * r.randint(0, 30), None, r.choice(["a", "b", "é", None, "z" if i % 9 == 0 else "a"])) for i in range(300)]
    rows += [(1000, "v " * 7, None, "small"), (1000, "v " * 7, None, "small"), (None, None, None, "none")]
    docs = X.documents(spark, rows)
    got = mixing.copies(docs, group=group).collect()
    assert len(got) == len(rows)
    sizes: dict = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(X.words(t))
    want, taken = water(sizes), Counter()
    for x in got:
        assert x.source_size == sizes[x.source] and abs(x.target - want[x.source]) < 1e-6 and 0 <= x.copies <= 3
        taken[x.source] += x.copies * x["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 30
    again = mixing.copies(docs.repartition(5), group=group).collect()
    assert by_row(map(tuple, got)) == by_row(map(tuple, again))
    mixed = mixing.mix(docs, group=group)
    assert mixed.columns == docs.columns and mixed.count() == sum(x.copies for x in got)
    assert mixing.copies(X.documents(spark, [])).count() == 0


def test_mix_of_awkward_rows(spark):
    got = mixing.copies(X.documents(spark)).collect()
    assert len(got) == len(X.ROWS) and all(x["size"] or not x.copies for x in got)
    same = {x.copies for x in got if x.doc_id == 11}
    assert len(same) == 1


def test_numbered(spark):
    df = spark.range(1000).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(10_000)))
    got = numbered(df.repartition(7), ["k", "id"], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1000)) and [(r.k, r.id) for r in got] == sorted((r.k, r.id) for r in got)


def test_pipeline_stages(spark):
    docs = settle(spark.read.parquet(f"{X.SF}/documents.parquet"), "t")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, settle(stage(spark, docs, X.SF), name)
        seen.append(name)
        rows, kept = {r.doc_id: r for r in before.collect()}, docs.collect()
        if name != "sharding":
            assert docs.columns == columns
        if name == "ngram_jaccard":
            pairs = [(d, rows[d].text) for d in sorted(rows)]
            assert sorted(r.doc_id for r in kept) == sorted({c for c, _, _ in X.classes(pairs)})
        elif name == "decontamination":
            items = [decontaminate.normal(t) for t in X.table("benchmark").text]
            gone = set(rows) - {r.doc_id for r in kept}
            assert gone >= {d for d, r in rows.items() if any(i in decontaminate.normal(r.text) for i in items)}
            assert len(gone) < len(rows) / 3
        elif name == "mixing":
            assert Counter(r.doc_id for r in kept).most_common(1)[0][1] <= 3
        elif name == "sharding":
            counts = Counter(r["shard"] for r in kept)
            assert len(kept) == before.count() and max(counts.values()) - min(counts.values()) <= 1
    assert len(seen) == 5


def test_pipeline_of_awkward_rows(spark):
    docs = X.documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, X.SF), name)
    assert docs.count() > 0
    bare = X.documents(spark).drop("text")
    assert jaccard.keep_first(bare).count() == len(X.ROWS)
    empty = X.documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        empty = settle(stage(spark, empty, X.SF), name)
    assert empty.count() == 0


def test_spans_merge():
    spans = pa.array([[{"start": 5, "end": 9}, {"start": 1, "end": 3}], [], [{"start": 0, "end": 4}, {"start": 4, "end": 6}]])
    assert [x.tolist() for x in repeats.merged(spans)] == [[0, 0, 2], [1, 5, 0], [3, 9, 6]]
