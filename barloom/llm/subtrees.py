"""Dedup of repeated word windows: suffixes that anchors leave open, in prefix groups with sorted suffixes and LCPs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import NO_ID, keep_columns, read, settle
from barloom.llm.repeats import _hashes, merged, named, places, repeated
from barloom.llm.words import BASES, flatten, scramble, words

# Words of a repeated window, suffixes that share an anchor at most, and words that choose it.
WINDOW, REACH, GRAM = 13, 8, 2
# Suffixes of one prefix group, about: a prefix that more suffixes begin with is made longer.
GROUP = 1 << 18
# Suffixes made at once.
STEP = 1 << 17


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    found = words(*flatten(texts))
    return found.hash, found.first


def _suffixes(size: int):
    """The suffixes that begin at the listed windows: ``size`` words as 4 bytes each, in order, and a hash of all of them.

    The codes are hashes, so the order is not that of the alphabet; any fixed order of words sorts suffixes and puts equal
    beginnings next to each other. Words whose codes collide are told apart by the hash.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols, first = words_of(batch.column("text"))
            found = places(batch, symbols, first)
            codes = (scramble(symbols) >> np.uint64(32)).astype(">u4")
            ids = {c: batch.column(c).to_numpy()[found["text"]] for c in ("doc", "th")}
            check = _hashes(symbols, found["at"], size, BASES[1]).view(np.int64)
            for lo in range(0, len(check), STEP):
                cut = slice(lo, lo + STEP)
                own = codes[found["at"][cut][:, None] + np.arange(size)]
                bytes_ = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * size), len(own), [None, pa.py_buffer(own.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [bytes_.cast(pa.binary()), pa.array(check[cut]), pa.array(ids["doc"][cut]), pa.array(ids["th"][cut]),
                     pa.array(found["start"][cut]), pa.array(found["need"][cut])],
                    names=["suffix", "check", "doc", "th", "start", "need"])
    return run


def prefixes(suffixes: DataFrame, size: int, group: int) -> tuple[DataFrame, Column]:
    """``suffixes`` and the prefix that each is dealt by: the shortest of 1, 2, 4, ... words that few suffixes begin with.

    Counts are combined before the shuffle, and only prefixes above ``group`` are counted at the next length, so the table
    of long prefixes follows from the rows divided by ``group``. Whole suffixes are never divided.
    """
    rows, length, long_ = suffixes, 1, None
    prefix = lambda n: F.substring("suffix", 1, 4 * n)
    dealt = F.lit(1)
    while length < size:
        open_ = rows if long_ is None else rows.filter(F.col(f"_long{length // 2}"))
        counts = open_.groupBy(prefix(length).alias("_p")).agg(F.count("*").alias("_n")).filter(F.col("_n") > group)
        long_ = settle(counts.select("_p", F.lit(True).alias(f"_long{length}")), "prefixes")
        if not long_.limit(1).count():
            break
        rows = rows.join(long_, prefix(length) == F.col("_p"), "left").drop("_p")
        dealt = F.when(F.col(f"_long{length}"), min(size, 2 * length)).otherwise(dealt)
        rows = rows.withColumn(f"_long{length}", F.coalesce(f"_long{length}", F.lit(False)))
        length *= 2
    return rows, F.substring(F.col("suffix"), F.lit(1), 4 * dealt)


def _nodes(size: int):
    """Walks sorted suffixes: the length of the common prefix of neighbours bounds the nodes of the group's suffix tree.

    A node at least ``size`` words deep holds the suffixes that begin with one window. They come in order of their
    documents, so the first tells which of the others have an earlier one. A node may go on in the next batch.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, least = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            column = batch.column("suffix")
            at = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
            words_ = np.frombuffer(column.buffers()[2], np.uint8)[at:at + 4 * size * n].view(np.uint32).reshape(n, size)
            check, doc = batch.column("check").to_numpy(), batch.column("doc").to_numpy()
            before = words_[:1] if last is None else last[0][None]
            equal = np.concatenate([before, words_[:-1]]) == words_
            common = np.where(equal.all(axis=1), size, np.argmin(equal, axis=1))
            deep = (common >= size) & (np.append(check[:1] if last is None else last[1], check[:-1]) == check)
            deep[0] &= last is not None
            head = np.maximum.accumulate(np.where(deep, -1, np.arange(n)))
            first = np.where(head < 0, least, doc[np.maximum(head, 0)])
            last, least = (words_[-1].copy(), check[-1]), int(first[-1])
            hit = np.flatnonzero(batch.column("need").to_numpy(zero_copy_only=False) & (doc > first))
            if len(hit):
                yield batch.select(["doc", "th", "start"]).take(pa.array(hit))
    return run


def earlier_windows(size: int, group: int = GROUP):
    """Decides windows by suffix groups: (doc, th, start) of those that also start in a text with a smaller ``doc``."""
    def decide(looked: DataFrame) -> DataFrame:
        suffixes = settle(looked.mapInArrow(_suffixes(size), "suffix binary, check bigint, doc bigint, th bigint, start bigint, need boolean"),
                          "suffixes")
        rows, prefix = prefixes(suffixes, size, group)
        order = ["suffix", "check", "doc"]
        dealt = rows.select(prefix.alias("prefix"), *suffixes.columns).repartition("prefix").sortWithinPartitions(*order)
        return dealt.drop("prefix").mapInArrow(_nodes(size), "doc bigint, th bigint, start bigint")
    return decide


CUT = "struct<kept:string,n_words:bigint,n_removed:bigint>"


def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Kept words of each text joined by one space, with counts."""
    raw, offsets = flatten(texts)
    found = words(raw, offsets)
    owner, start, end = merged(spans)
    edges = np.zeros(len(found.start) + 1, np.int64)
    np.add.at(edges, found.first[owner] + start, 1)
    np.add.at(edges, found.first[owner] + end, -1)
    stay = np.cumsum(edges)[:-1] == 0
    data = raw.tobytes()
    kept = []
    for i in range(len(texts)):
        lo, hi = found.first[i], found.first[i + 1]
        at = np.flatnonzero(stay[lo:hi]) + lo
        kept.append(b" ".join(data[a:b] for a, b in zip(found.start[at].tolist(), found.end[at].tolist(), strict=True)).decode())
    gone = np.bincount(owner, (end - start).astype(float), len(texts)).astype(np.int64)
    return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(np.diff(found.first)), pa.array(gone)],
                                      names=["kept", "n_words", "n_removed"])


def dedup(docs: DataFrame, text: str = "text", window: int = WINDOW, reach: int = REACH, gram: int = GRAM,
          group: int = GROUP) -> DataFrame:
    """``docs`` with ``kept`` (words joined by one space), ``n_words`` and ``n_removed``.

    Removed is each word covered by ``window`` consecutive words of a text that also start in a text with a
    smaller id; windows are judged on the input. Words are runs without ASCII white space, unchanged.

    Anchors that the content chooses come first (``repeats``): they leave out text that repeats nowhere, and stand for
    whole stretches that several documents share. The windows where one shared stretch ends and another goes on are left
    open. Their suffixes are dealt by prefixes of variable length (``prefixes``, groups of about ``group`` suffixes), sorted
    within each group, and read as the leaves of its suffix tree: neighbours that share ``window`` words lie below one deep
    node (``_nodes``). No group is held in memory.

    Null texts are empty; null ids come after all others, so rows without id lose what any row with one holds
    and nothing to each other, as do rows with equal ids. Columns of the names added are replaced.
    """
    source = named(docs, text)
    spans = repeated(source, words_of, window, reach, gram, earlier=True, decide=earlier_windows(window, group))

    @F.arrow_udf(CUT)
    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return cut(texts, spans)

    made = ("kept", "n_words", "n_removed")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.withColumns({"_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "_th": F.xxhash64(body)})
    spans = spans.select(F.col("doc").alias("_doc"), F.col("th").alias("_th"), F.col("spans").alias("_spans"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    joined = rows.join(spans.hint("merge"), ["_doc", "_th"], "left").withColumn("_cut", run(body, F.coalesce("_spans", none)))
    return joined.select(*[F.col(f"`{c}`") for c in keep_columns(docs, *made)], "_cut.*")


def query(spark, sf_dir: str) -> DataFrame:
    found = dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, string_agg(word, ' ') OVER f AS s, count(*) OVER f AS n FROM x
      WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM g WHERE n = 13),
h AS (SELECT doc_id, i FROM m WHERE least < doc_id),
c AS (SELECT x.doc_id, x.i, word, coalesce(max(h.i) OVER (PARTITION BY x.doc_id ORDER BY x.i) > x.i - 13, false) AS gone
      FROM x LEFT JOIN h ON h.doc_id = x.doc_id AND h.i = x.i),
a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
             string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN a ON a.doc_id = w.doc_id
"""
