"""N-gram Jaccard join by MinHash bands, the fixed-prefix form of an LSH forest, and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import NO_ID, field, read, settle
from barloom.llm.components import components
from barloom.llm.words import Rolling, flatten, scramble, words

SHINGLE, LEAST = 5, 0.8
# Bands, the most hashes of a band, and the recall of a pair at the least similarity.
TREES, DEPTH, RECALL = 24, 8, 0.99999
# Members of a bucket compared by one task: larger buckets are cut into blocks, each pair of blocks a task.
BLOCK = 1536


def prefix_length(least: float = LEAST, trees: int = TREES, recall: float = RECALL, depth: int = DEPTH) -> int:
    """Longest label prefix at which a pair of similarity ``least`` meets in some tree with chance ``recall``.

    A prefix of k hashes matches with chance least ** k in one tree. The length is fixed before any text is read and
    is the same for all: no longer labels are made, sorted or shortened by what they match.
    """
    for k in range(depth, 0, -1):
        if 1 - (1 - least**k) ** trees >= recall:
            return k
    raise ValueError("more trees are needed for this recall")


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the five-word stretches of each text, and their offsets by text.

    Words are runs without ASCII white space, unchanged. A text of one to four words is one shingle.
    """
    w = words(*flatten(texts))
    n = np.diff(w.first)
    counts = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    base = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(n)), counts)
    at = w.first[owner] + np.arange(len(owner)) - base[owner]
    hashes = Rolling(w.hash)(at, np.minimum(at + SHINGLE, w.first[owner + 1]))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    if len(hashes):
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(n) + 1))


SIGNED = "struct<n:int,f1:bigint,f2:bigint,keys:array<bigint>>"


def signatures(texts: pa.Array, trees: int, prefix: int) -> pa.Array:
    """Size and fingerprint of each text's shingle set, and for each tree the hash of its label's prefix."""
    sets, first = shingle_sets(texts)
    n, full = np.diff(first), np.flatnonzero(np.diff(first))
    f = np.zeros((2, len(n)), np.uint64)
    keys = np.zeros((len(full), trees), np.uint64)
    if len(full):
        starts = first[full]
        f[0, full] = np.add.reduceat(sets, starts)
        f[1, full] = np.add.reduceat(scramble(sets ^ np.uint64(0xA5A5A5A5)), starts)
        multiply = scramble(np.arange(1, trees * prefix + 1, dtype=np.uint64)) | np.uint64(1)
        for t in range(trees):
            label = np.full(len(full), t + 1, np.uint64)
            for m in multiply[t * prefix:(t + 1) * prefix]:
                label = scramble(label * np.uint64(31) + np.minimum.reduceat(sets * m, starts))
            keys[:, t] = label
    offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, trees, 0))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))
    return pa.StructArray.from_arrays(
        [pa.array(n.astype(np.int32)), pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)), lists],
        names=["n", "f1", "f2", "keys"])


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, step: int = 4096) -> np.ndarray:
    """Number of common values of each set of ``a`` with each of ``b``.

    Products of incidence matrices, a stretch of the values that occur twice at a time; float32 counts exactly
    below 2**24.
    """
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = place[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out, width = np.zeros((len(a), len(b)), np.float32), int(shared.sum())
    for lo in range(0, width, step):
        hi = min(width, lo + step)
        first, last = np.searchsorted(column, [lo, hi])
        part = np.zeros((len(sets), hi - lo), np.float32)
        part[owner[first:last], column[first:last] - lo] = 1
        out += part[a] @ part[b].T
    return out


def linked(sets: list[np.ndarray], side: np.ndarray, least: float, rows: int = 256) -> np.ndarray:
    """Pairs of similarity ``least`` or more; with both sides present only pairs across them."""
    n = np.array([len(s) for s in sets], float)
    cross = side.min() != side.max()
    if len(sets) == 2:
        small, large = sorted(n)
        if small < least * large:
            return np.zeros((0, 2), int)
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[0, 1]]) if common >= least * (n.sum() - common) else np.zeros((0, 2), int)
    a = np.flatnonzero(side == side.min()) if cross else np.arange(len(sets))
    b = np.flatnonzero(side == side.max()) if cross else a
    common, found = overlaps(sets, a, b), []
    for lo in range(0, len(a), rows):
        c = common[lo:lo + rows].astype(float)
        i, j = np.nonzero(c >= least * (n[a[lo:lo + rows]][:, None] + n[b][None, :] - c))
        i = i + lo
        if not cross:
            i, j = i[i < j], j[i < j]
        found.append(np.stack([a[i], b[j]], axis=1))
    return np.concatenate(found)


LINKS = "cid bigint, root bigint, texts bigint, docs bigint"


def _verify(least: float):
    def group(key: int, cross: bool, rows: list[tuple]) -> Iterator[tuple]:
        rows = list({r[0]: r for r in rows}.values())  # a class comes once for each row with its least id and text
        if len(rows) < 2:
            return
        sets, side = [r[4] for r in rows], np.array([r[3] for r in rows])
        if cross and side.min() == side.max():  # a bucket's block may be empty: its members hash elsewhere
            return
        pairs = linked(sets, side, least)
        root = list(range(len(rows)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        texts, docs = [0] * len(rows), [0] * len(rows)
        keys: dict[int, set] = {}
        for i, j in pairs.tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
            for x in (i, j):
                if x not in keys:
                    keys[x] = set(rows[x][2].tolist())
            if min(keys[i] & keys[j]) == key:  # two texts that share several buckets count in one of them
                texts[i] += 1
                texts[j] += 1
                docs[i] += rows[j][1]
                docs[j] += rows[i][1]
        for i, r in enumerate(rows):
            top = find(i)
            if texts[i] or top != i:
                yield r[0], rows[top][0], texts[i], docs[i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cid", "root", "texts", "docs"])

        for batch in batches:
            number = {c: batch.column(c).to_numpy() for c in ("key", "lo", "hi", "cid", "size", "block")}
            lists = {}
            for c in ("keys", "shingles"):
                column = batch.column(c)
                lists[c] = column.offsets.to_numpy(), column.values.to_numpy()
            for i in range(batch.num_rows):
                at = number["key"][i], number["lo"][i], number["hi"][i]
                if at != now:
                    if held:
                        out += group(int(now[0]), now[1] != now[2], held)
                    now, held = at, []
                k, s = (v[o[i]:o[i + 1]].copy() for o, v in (lists["keys"], lists["shingles"]))
                held.append((int(number["cid"][i]), int(number["size"][i]), k, int(number["block"][i]), s))
            yield flush()
        if held:
            out += group(int(now[0]), now[1] != now[2], held)
        yield flush()

    return run


def classes(docs: DataFrame, text: str = "text", least: float = LEAST, trees: int = TREES, recall: float = RECALL,
            block: int = BLOCK) -> DataFrame:
    """One row per document: (doc, th, class_doc, class_th, class_id, n_links, n_texts).

    ``doc`` is the id (null: ``NO_ID``) and ``th`` a hash of the text; together they name a document, and rows
    equal in both are copies. Two documents are linked when the Jaccard similarity of their five-word shingle
    sets is ``least`` or more. ``n_links`` counts the linked documents, copies included, ``n_texts`` the linked
    different shingle sets. ``class_id`` is the least id of the connected component (null ids last, null if there
    is no other), (class_doc, class_th) its least document.

    Documents with equal shingle sets are one text with a count. Texts meet in buckets of the bands; buckets
    with the same members are one, and each bucket's pairs are verified on the full sets. Buckets above
    ``block`` texts are verified block by block, so none is cut short. Documents without words are linked to
    nothing. The only loss is a pair that no tree brings together: chance 1 - ``recall`` at the least
    similarity, less above it.
    """
    prefix = prefix_length(least, trees, recall)

    @F.arrow_udf(SIGNED)
    def sign(texts: pa.Array) -> pa.Array:
        return signatures(texts, trees, prefix)

    @F.arrow_udf("array<bigint>")
    def shingles(texts: pa.Array) -> pa.Array:
        sets, first = shingle_sets(texts)
        return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(sets.view(np.int64)))

    body = F.coalesce(field(docs, text, T.StringType()), F.lit(""))
    source = docs.select(F.coalesce(field(docs, "doc_id", T.LongType()), F.lit(NO_ID)).alias("doc"),
                         F.xxhash64(body).alias("th"), body.alias("text"))
    signed = settle(source.select("doc", "th", sign("text").alias("s")).select("doc", "th", "s.*"), "signed")
    texts = signed.filter("n > 0").groupBy("f1", "f2", "n").agg(
        F.min(F.struct("doc", "th")).alias("rep"), F.count("*").alias("size"), F.first("keys").alias("keys"))
    texts = settle(texts.withColumn("cid", F.monotonically_increasing_id()), "texts")

    entries = texts.select("cid", F.explode("keys").alias("key"))
    buckets = entries.groupBy("key").agg(
        F.count("*").alias("members"), F.sum(F.xxhash64("cid").cast("decimal(20,0)")).alias("s"),
        F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("x")).filter("members > 1")
    buckets = settle(buckets.groupBy("members", "s", "x").agg(F.min("key").alias("key")).select("key", "members"), "buckets")
    member = entries.join(buckets, "key").groupBy("cid").agg(F.collect_list(F.struct("key", "members")).alias("buckets"))
    member = settle(member.join(texts.select("cid", "size", "rep"), "cid").select(
        "cid", "size", "rep.doc", "rep.th", "buckets"), "members")
    sets = source.join(member.hint("merge"), ["doc", "th"]).select(  # one plan at every size
        "cid", "size", F.transform("buckets", lambda b: b["key"]).alias("keys"), F.explode("buckets").alias("b"),
        shingles("text").alias("shingles"))
    parts = F.ceil(F.col("b.members") / block)
    own = F.pmod(F.xxhash64("cid"), parts).alias("block")
    sets = sets.select("cid", "size", "keys", "shingles", F.col("b.key").alias("key"), own,
                       F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("other"))
    sets = sets.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block",
                       "cid", "size", "keys", "shingles")
    dealt = sets.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    links = settle(dealt.mapInArrow(_verify(least), LINKS), "links")

    groups = components(links.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("cid").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    groups = groups.join(counts, groups["node"] == counts["cid"], "left").select("node", "component", "texts", "docs")
    own = texts.join(groups, texts["cid"] == groups["node"], "left").select(
        "f1", "f2", "n", "cid", "rep", "size", F.coalesce("component", "cid").alias("component"),
        F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("docs", F.lit(0)).alias("linked"))
    own = settle(own, "own")
    first = own.groupBy("component").agg(F.min("rep").alias("least"))
    named = settle(own.join(first, "component").select("f1", "f2", "n", "size", "texts", "linked", "least"), "named")
    out = signed.drop("keys").join(named, ["f1", "f2", "n"], "left")
    lone = F.col("least").isNull()
    top = F.when(lone, F.col("doc")).otherwise(F.col("least.doc"))
    return out.select(
        "doc", "th", top.alias("class_doc"), F.when(lone, F.col("th")).otherwise(F.col("least.th")).alias("class_th"),
        F.when(top != NO_ID, top).alias("class_id"),
        F.when(lone, F.lit(0)).otherwise(F.col("size") - 1 + F.col("linked")).cast("long").alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_texts"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without near duplicates: of each class the document with the least id stays, once.

    Documents without words are no duplicates of each other and all stay, as do all rows of a table without texts.
    """
    found = classes(docs, **options)
    stay = found.filter("doc = class_doc AND th = class_th").select("doc", "th").distinct()
    body = F.coalesce(field(docs, "text", T.StringType()), F.lit(""))
    named = docs.withColumns({"_doc": F.coalesce(field(docs, "doc_id", T.LongType()), F.lit(NO_ID)), "_th": F.xxhash64(body)})
    kept = named.join(stay, (F.col("_doc") == F.col("doc")) & (F.col("_th") == F.col("th")), "left_semi")
    wordless = ~body.rlike(r"[^\x20\x09-\x0D]")
    names = [F.col(f"`{c}`") for c in docs.columns]
    once = kept.filter(~wordless).dropDuplicates(["_doc", "_th"]).select(*names)
    return once.unionByName(docs.filter(wordless))


def query(spark, sf_dir: str) -> DataFrame:
    """One row per document: its class and its number of links."""
    found = classes(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "class_id", "n_links", "n_texts")


SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, len(ws) AS total, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, total, string_agg(word, ' ') OVER f AS s, count(*) OVER f AS n FROM x
      WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
sh AS (SELECT DISTINCT doc_id, s FROM g WHERE n = 5 OR (total < 5 AND i = 1)),
sz AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS f FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id
           GROUP BY ALL),
one AS (SELECT a, b, p.f AS fa, q.f AS fb FROM common JOIN sz p ON p.doc_id = a JOIN sz q ON q.doc_id = b
        WHERE 5 * c >= 4 * (p.n + q.n - c)),
links AS (SELECT a, b, fa, fb FROM one UNION ALL SELECT b, a, fb, fa FROM one),
counts AS (SELECT a, count(*) AS n_links, count(DISTINCT CASE WHEN fa <> fb THEN fb END) AS n_texts FROM links GROUP BY a),
reach(doc, c) AS (SELECT a, a FROM links UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.doc),
classes AS (SELECT doc, min(c) AS c FROM reach GROUP BY doc)
SELECT w.doc_id, coalesce(classes.c, w.doc_id) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(n_texts, 0) AS n_texts
FROM w LEFT JOIN counts ON counts.a = w.doc_id LEFT JOIN classes ON classes.doc = w.doc_id
"""
