"""Windows of a sequence that occur elsewhere, found through anchors that their content chooses.

A window of ``size`` symbols is tied to the *anchor* that is the least n-gram hash among its first ``reach``
positions. Equal windows have equal anchors at equal offsets, wherever they stand: anchors cut every text into
phrases by content alone, and all windows that begin between two anchors belong to the second. So positions are
compared anchor by anchor instead of one by one:

1. ``core``: the symbols right of an anchor that every window tied to it holds. An anchor whose core stands
   nowhere else has no repeated window; most text ends here, at one hash per anchor.
2. ``full``: all symbols that windows tied to the anchor can hold. Anchors with equal ``full`` are a class: they
   agree in all their windows, and a class is one entry from here on, however many copies there are.
3. Windows are compared themselves only for one anchor per class, in cores that hold several classes: that is
   where one copy ends and another goes on. Windows that begin close to each other are first compared by what they
   have in common; only those whose common part repeats are looked at one by one.

Hashes are 64-bit and compared within equal cores or in pairs, so 128 bits decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import NO_ID, field, settle
from barloom.session import forget
from barloom.llm.words import BASES, CHUNK, Rolling, scramble

# Texts to (symbols, offsets by text); symbols are 64-bit.
Reader = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]

# Windows of an anchor that are first compared by their common part.
NEAR_BY = 8

_PLACE = np.uint64((1 << 22) - 1)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` values from each place (fewer at the end)."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = np.minimum(out[:-step], out[step:])
        have += step
    return out


def anchors(symbols: np.ndarray, first: np.ndarray, size: int, reach: int, gram: int) -> Iterator[dict]:
    """Anchors of all windows, a stretch of positions at a time.

    ``text``, ``at`` (place in the text), ``near`` and ``far`` (least and greatest distance of its windows'
    starts to its left), ``core`` and ``full``.
    """
    for s in range(0, len(symbols), CHUNK):
        e = min(len(symbols), s + CHUNK)
        begin, stop = max(0, s - reach), min(len(symbols), e + reach)  # window starts looked at
        lo, hi = max(0, begin - reach), min(len(symbols), stop + reach + size)
        hashed = Rolling(symbols[lo:hi])
        n = hi - lo
        here = np.arange(n, dtype=np.int64)
        order = (hashed(here, np.minimum(here + gram, n)) & ~_PLACE) | here.astype(np.uint64)
        chosen = _least(order, reach)
        a, b = np.searchsorted(first, begin, "right") - 1, np.searchsorted(first, stop, "left")
        text = np.repeat(np.arange(a, b), np.diff(np.clip(first[a:b + 1], begin, stop)))
        start = np.arange(begin, stop)
        whole = first[text + 1] - start >= size
        start, text = start[whole], text[whole]
        if not len(start):
            continue
        anchor = (chosen[start - lo] & _PLACE).astype(np.int64) + lo
        edge = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        low, high = start[edge], start[np.append(edge[1:], len(start)) - 1]
        mine = (low >= s) & (low < e)  # one stretch owns each anchor
        low, high, anchor, text = low[mine], high[mine], anchor[edge][mine], text[edge][mine]
        left = np.minimum(reach - 1, anchor - first[text])
        right = np.minimum(size, first[text + 1] - anchor)
        local = anchor - lo
        full = hashed(local - left, local + right)
        yield {"text": text, "at": anchor - first[text], "near": anchor - high, "far": anchor - low,
               "core": hashed(local, local + size - reach + 1),
               "full": scramble(full + left.astype(np.uint64) * np.uint64(BASES[1]))}


def _scan(reader: Reader, size: int, reach: int, gram: int, names: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols, first = reader(batch.column("text"))
            ids = {c: batch.column(c).to_numpy() for c in ("doc", "th")}
            for found in anchors(symbols, first, size, reach, gram):
                columns = {"doc": ids["doc"][found["text"]], "th": ids["th"][found["text"]], "at": found["at"],
                           "near": found["near"].astype(np.int32), "far": found["far"].astype(np.int32),
                           "core": found["core"].view(np.int64), "full": found["full"].view(np.int64)}
                yield pa.RecordBatch.from_arrays([pa.array(columns[c]) for c in names], names=list(names))
    return run


def _windows(reader: Reader, size: int):
    """Hashes of the windows of the anchors listed with each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols, first = reader(batch.column("text"))
            listed = batch.column("listed")
            owner = np.repeat(np.arange(len(listed)), np.diff(listed.offsets.to_numpy()))
            flat = listed.values
            at, near, far, copies, need = (flat.field(c).to_numpy(zero_copy_only=False)
                                           for c in ("at", "near", "far", "copies", "need"))
            count = far - near + 1
            entry = np.repeat(np.arange(len(owner)), count)
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            place = at[entry] - far[entry] + step
            start = first[owner[entry]] + place
            ids = {c: batch.column(c).to_numpy()[owner[entry]] for c in ("doc", "th")}
            a, b = (_hashes(symbols, start, size, base) for base in BASES)
            for lo in range(0, len(start), CHUNK):
                cut = slice(lo, lo + CHUNK)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[cut]) for x in (a.view(np.int64), b.view(np.int64), ids["doc"], ids["th"], place,
                                                copies[entry], need[entry])],
                    names=["a", "b", "doc", "th", "start", "copies", "need"])
    return run


def _intervals(reader: Reader, size: int, near_by: int):
    """The anchors listed with each text, cut into lots of windows, with a hash of what each lot has in common."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols, first = reader(batch.column("text"))
            listed = batch.column("listed")
            owner = np.repeat(np.arange(len(listed)), np.diff(listed.offsets.to_numpy()))
            flat = listed.values
            at, near, far, copies, need = (flat.field(c).to_numpy(zero_copy_only=False)
                                           for c in ("at", "near", "far", "copies", "need"))
            lots = far // near_by - near // near_by + 1
            entry = np.repeat(np.arange(len(owner)), lots)
            lot = near[entry] // near_by + np.arange(lots.sum()) - np.repeat(np.cumsum(lots) - lots, lots)
            low, high = np.maximum(near[entry], lot * near_by), np.minimum(far[entry], lot * near_by + near_by - 1)
            start = first[owner[entry]] + at[entry] - lot * near_by
            key = _hashes(symbols, start, size - near_by + 1, BASES[0])
            columns = (key.view(np.int64), *(batch.column(c).to_numpy()[owner[entry]] for c in ("doc", "th")), at[entry],
                       low.astype(np.int32), high.astype(np.int32), copies[entry], need[entry])
            for lo in range(0, len(start), CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo:lo + CHUNK]) for x in columns],
                                                 names=["key", "doc", "th", "at", "near", "far", "copies", "need"])
    return run


def _hashes(symbols: np.ndarray, start: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hashes of the stretches of ``length`` symbols from each start, a chunk of symbols at a time."""
    out = np.empty(len(start), np.uint64)
    sort = np.argsort(start, kind="stable")
    ordered, done = start[sort], 0
    while done < len(sort):
        lo = ordered[done]
        to = int(np.searchsorted(ordered, lo + CHUNK))
        hashed = Rolling(symbols[lo:ordered[to - 1] + length], base)
        out[sort[done:to]] = hashed(ordered[done:to] - lo, ordered[done:to] - lo + length)
        done = to
    return out


def named(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc, th, text): a document's id (null: ``NO_ID``), a hash of its text, and the text (null: empty)."""
    body = F.coalesce(field(docs, text, T.StringType()), F.lit(""))
    return docs.select(F.coalesce(field(docs, "doc_id", T.LongType()), F.lit(NO_ID)).alias("doc"),
                       F.xxhash64(body).alias("th"), body.alias("text"))


def places(batch: pa.RecordBatch, symbols: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """Windows of the anchors listed with each text of a batch: text number, place in the text and among all symbols, flags."""
    listed = batch.column("listed")
    owner = np.repeat(np.arange(len(listed)), np.diff(listed.offsets.to_numpy()))
    at, near, far, need = (listed.values.field(c).to_numpy(zero_copy_only=False) for c in ("at", "near", "far", "need"))
    count = far - near + 1
    entry = np.repeat(np.arange(len(owner)), count)
    place = at[entry] - far[entry] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return {"text": owner[entry], "start": place, "at": first[owner[entry]] + place, "need": need[entry]}


def repeated(source: DataFrame, reader: Reader, size: int, reach: int, gram: int, earlier: bool,
             decide: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc, th, spans): stretches covered by windows that repeat, for texts that have any.

    ``decide`` settles the windows of step 3 in place of their hashes: from (doc, th, text, listed anchors) to the (doc, th,
    start) of those that repeat.

    ``earlier``: a window counts if it also starts in a text with a smaller ``doc``; otherwise if it starts at any
    other place. ``source`` holds (doc, th, text); rows equal in (doc, th) are copies and share one result.
    """
    if gram + reach - 1 > size:
        raise ValueError("the n-grams that choose an anchor must lie in the window")
    scan = lambda names, schema: source.mapInArrow(_scan(reader, size, reach, gram, names), schema)
    once = scan(("doc", "core"), "doc bigint, core bigint") if earlier else scan(("core",), "core bigint")
    held = F.min("doc") < F.max("doc") if earlier else F.count("*") > 1
    cores = settle(once.groupBy("core").agg(held.alias("held")).filter("held").select("core"), "cores")

    names = ("doc", "th", "at", "near", "far", "core", "full")
    every = scan(names, "doc bigint, th bigint, at bigint, near int, far int, core bigint, full bigint")
    live = settle(every.join(cores, "core", "left_semi").select(*names), "anchors")
    # What the tables written from a table have taken over is deleted: several of them are larger than the texts.
    spark = source.sparkSession
    forget(spark, cores)

    place = F.struct("doc", "th", "at", "near", "far")
    found = settle(live.groupBy("core", "full").agg(F.min(place).alias("rep"), F.count("*").alias("copies")), "kinds")
    several = found.groupBy("core").agg(F.count("*").alias("kinds"), F.min("rep.doc").alias("core_doc")).filter("kinds > 1")
    several = settle(several, "several")
    # Both sides are plain tables, so the join can split a core with very many classes.
    kinds = settle(found.join(several, "core", "left"), "classes")
    forget(spark, found, several)

    # 1: windows known to repeat as a whole class. 2: one anchor per class where the windows decide.
    if earlier:
        surely = F.col("doc") > F.col("rep.doc")
        maybe = (F.col("doc") == F.col("rep.doc")) & (F.col("core_doc") < F.col("rep.doc"))
    else:
        surely, maybe = F.col("copies") > 1, F.lit(False)
    member = live.join(kinds, ["core", "full"])
    spans = settle(member.select("doc", "th", "at", "near", "far", surely.alias("surely"), maybe.alias("maybe"))
                   .filter("surely OR maybe"), "members")
    forget(spark, live)
    sure = spans.filter("surely").select("doc", "th", (F.col("at") - F.col("far")).alias("start"),
                                         (F.col("at") - F.col("near") + size).alias("end"))
    asked = kinds.filter("kinds > 1").select("rep.*", "copies", (F.lit(not earlier) & (F.col("copies") == 1)).alias("need"))
    if earlier:
        asked = asked.unionByName(spans.filter("maybe").select(
            "doc", "th", "at", "near", "far", F.lit(0).cast("long").alias("copies"), F.lit(True).alias("need")))
    entry = F.struct("at", "near", "far", "copies", "need")

    def with_lists(entries: DataFrame) -> DataFrame:
        lists = entries.groupBy("doc", "th").agg(F.collect_list(entry).alias("listed"))
        return source.join(lists.hint("merge"), ["doc", "th"]).select("doc", "th", "text", "listed")

    if reach > 2 * NEAR_BY:
        lots = settle(with_lists(asked).mapInArrow(
            _intervals(reader, size, NEAR_BY),
            "key bigint, doc bigint, th bigint, at bigint, near int, far int, copies bigint, need boolean"), "lots")
        more = F.min("doc") < F.max("doc") if earlier else F.sum("copies") > 1
        again = settle(lots.groupBy("key").agg(more.alias("again")).filter("again").select("key"), "again")
        left = settle(lots.join(again, "key", "left_semi").drop("key"), "asked")
        forget(spark, lots, again, kinds)
        asked = left
    looked = with_lists(asked)
    if decide:
        some = decide(looked).select("doc", "th", "start", (F.col("start") + size).alias("end"))
        return sure.unionByName(some).groupBy("doc", "th").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    windows = settle(looked.mapInArrow(
        _windows(reader, size), "a bigint, b bigint, doc bigint, th bigint, start bigint, copies bigint, need boolean"), "windows")
    if earlier:
        found = windows.groupBy("a", "b").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most")
        hit = windows.filter("need").join(found.select("a", "b", "least"), ["a", "b"]).filter("doc > least")
    else:
        found = windows.groupBy("a", "b").agg(F.sum("copies").alias("n")).filter("n > 1")
        hit = windows.filter("need").join(found.select("a", "b"), ["a", "b"])
    some = hit.select("doc", "th", "start", (F.col("start") + size).alias("end"))
    return sure.unionByName(some).groupBy("doc", "th").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def merged(spans: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches of each list of spans: (list number, start, end); spans that touch are one."""
    owner = np.repeat(np.arange(len(spans)), np.diff(spans.offsets.to_numpy()))
    start = spans.values.field("start").to_numpy(zero_copy_only=False)
    end = spans.values.field("end").to_numpy(zero_copy_only=False)
    if not len(owner):
        return owner, start, end
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    lift = owner * (int(end.max()) + 2)  # lists do not meet
    reached = np.maximum.accumulate(end + lift)
    new = np.append(True, (start + lift)[1:] > reached[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(owner)) - 1
    return owner[head], start[head], reached[tail] - lift[tail]
