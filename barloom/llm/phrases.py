"""Phrase collocations: word n-grams counted in counting quotient filters that shards make and merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import field, numbered, read, settle
from barloom.llm.words import LOWER, flatten, scramble, words

# Characters that end a piece, fewest occurrences, longest phrase, scale of the score, share in percent of
# a phrase's occurrences inside a longer one that drops it, rows per language.
BREAKS, LEAST, LONGEST, SCALE, INSIDE, REPORT = ".,;:!?\n\x0b\x0c\r", 30, 4, 2_000_000, 80, 2000
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# End of the fixed values.

_WORD = r"[^\x20\x09.,;:!?\x0A-\x0D]+"
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in BREAKS]] = True
_APART = _BREAK.copy()
_APART[[0x20, 0x09]] = True
# A permutation of the byte values, for a second hash of each word.
_OTHER = np.argsort(scramble(np.arange(256, dtype=np.uint64))).astype(np.uint8)
_OTHER_APART = np.zeros(256, bool)
_OTHER_APART[_OTHER[_APART]] = True

# Frequent words every task may hold at once (20 bytes each); above it words meet their numbers in a join.
DICTIONARY = 2_000_000
# Words above this many bytes are looked up by themselves, not by hashes.
LONG = 512
# Distinct n-grams a filter holds before it is sent, and n-grams gathered before they are sorted into it.
HELD, GATHERED = 1 << 21, 1 << 20
# Entries of one region of the merged filter, about.
REGION = 1 << 20
# Bits of the map that tells which shorter n-grams are frequent. A full map prunes less; the counts stay exact.
MAP_BITS = 25
# Words of a stretch in the join of words with their numbers.
STRETCH = 1000


def permute(hi: np.ndarray, lo: np.ndarray, high_bits: int, low_bits: int, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """An invertible scrambling of the numbers whose upper bits are ``hi`` and lower bits ``lo``: four Feistel rounds."""
    keep = [np.uint64((1 << bits) - 1) for bits in (high_bits, low_bits)]
    for turn in (3, 2, 1, 0) if back else (0, 1, 2, 3):
        salt = np.uint64(0x9E3779B97F4A7C15 * (turn + 1) & (1 << 64) - 1)
        if turn % 2:
            lo = lo ^ (scramble(hi + salt) & keep[1])
        else:
            hi = hi ^ (scramble(lo + salt) & keep[0])
    return hi, lo


class Layout:
    """How n-grams of ``k`` word numbers of ``bits`` bits are packed, scrambled and cut into regions."""

    def __init__(self, k: int, bits: int, region_bits: int):
        self.k, self.bits = k, bits
        self.high, self.low = bits * -(-k // 2), bits * (k // 2)
        self.region_bits = min(region_bits, self.high)

    def scrambled(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The permuted key of each n-gram, as upper and lower half."""
        cut, halves = -(-self.k // 2), []
        for part in (columns[:cut], columns[cut:]):
            packed = np.zeros(len(columns[0]), np.uint64)
            for c in part:
                packed = packed << np.uint64(self.bits) | c.astype(np.uint64)
            halves.append(packed)
        return permute(*halves, self.high, self.low)

    def words(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Word numbers (rows times ``k``) of permuted keys."""
        hi, lo = permute(hi, lo, self.high, self.low, back=True)
        mask, cut = np.uint64((1 << self.bits) - 1), -(-self.k // 2)
        columns = [hi >> np.uint64(self.bits * (cut - 1 - i)) & mask for i in range(cut)]
        columns += [lo >> np.uint64(self.bits * (self.k - cut - 1 - i)) & mask for i in range(self.k - cut)]
        return np.stack(columns, axis=1).astype(np.int32)

    def summed(self, hi: np.ndarray, lo: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys with their counts added up."""
        if self.high + self.low <= 64:
            order = np.argsort(hi << np.uint64(self.low) | lo, kind="stable")
        else:
            order = np.lexsort((lo, hi))
        hi, lo, count = hi[order], lo[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])[:len(hi)])
        return hi[first], lo[first], np.add.reduceat(count, first) if len(first) else count[:0]

    def regions(self, hi: np.ndarray) -> np.ndarray:
        return (hi >> np.uint64(self.high - self.region_bits)).astype(np.int64) if self.region_bits else np.zeros(len(hi), np.int64)


def slots(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Place of a permuted key in the map of frequent n-grams."""
    return (scramble(hi * np.uint64(3) + scramble(lo)) >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def _pack(x: np.ndarray, width: int) -> bytes:
    bits = np.unpackbits(x.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - width:]
    return np.packbits(bits).tobytes()


def _unpack(data: memoryview, n: int, width: int) -> np.ndarray:
    bits = np.zeros((n, 64), np.uint8)
    bits[:, 64 - width:] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width)
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)


def encode(layout: Layout, hi: np.ndarray, lo: np.ndarray, count: np.ndarray) -> bytes:
    """A region of the filter as bytes: sorted distinct keys whose region bits are equal and left out.

    About one quotient per key; the quotients' runs are written as that many ones and a zero each, the remainders in full
    at their exact width, the counters as a byte, or as 255 and eight bytes.
    """
    n, free = len(hi), layout.high - layout.region_bits
    q = min(free, max(0, int(n - 1).bit_length()), 30)
    quotient = (hi >> np.uint64(free - q) & np.uint64((1 << q) - 1)).astype(np.int64)
    runs = np.zeros(n + (1 << q), np.uint8)
    runs[np.arange(n) + quotient] = 1
    small = np.minimum(count, 255).astype(np.uint8)
    return b"".join([np.array([n, q], np.uint32).tobytes(), np.packbits(runs).tobytes(), _pack(hi, free - q) if free > q else b"",
                     _pack(lo, layout.low) if layout.low else b"", small.tobytes(), count[small == 255].astype(np.int64).tobytes()])


def decode(layout: Layout, region: int, block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and counts of an encoded region."""
    view = memoryview(block)
    n, q = (int(x) for x in np.frombuffer(view[:8], np.uint32))
    free, at = layout.high - layout.region_bits, 8

    def take(size: int) -> memoryview:
        nonlocal at
        at += size
        return view[at - size:at]

    ones = np.flatnonzero(np.unpackbits(np.frombuffer(take((n + (1 << q) + 7) // 8), np.uint8), count=n + (1 << q)))
    hi = (ones - np.arange(n)).astype(np.uint64) << np.uint64(free - q)
    if free > q:
        hi |= _unpack(take((n * (free - q) + 7) // 8), n, free - q)
    if layout.region_bits:
        hi |= np.uint64(region) << np.uint64(free)
    lo = _unpack(take((n * layout.low + 7) // 8), n, layout.low) if layout.low else np.zeros(n, np.uint64)
    count = np.frombuffer(take(n), np.uint8).astype(np.int64)
    count[count == 255] = np.frombuffer(view[at:], np.int64)
    return hi, lo, count


class Filter:
    """A counting quotient filter of one task: keys in sorted order with counters, sent region by region when full."""

    def __init__(self, layout: Layout, held: int, gathered: int):
        self.layout, self.held, self.gathered = layout, held, gathered
        self.keys = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.new: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, hi: np.ndarray, lo: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(hi), self.gathered):
            self.new.append((hi[at:at + self.gathered], lo[at:at + self.gathered]))
            if sum(len(x) for x, _ in self.new) >= self.gathered:
                self.settle()
                if len(self.keys[0]) >= self.held:
                    yield from self.send()

    def settle(self) -> None:
        hi, lo = (np.concatenate([self.keys[i], *[x[i] for x in self.new]]) for i in (0, 1))
        count = np.concatenate([self.keys[2], np.ones(len(hi) - len(self.keys[2]), np.int64)])
        self.keys, self.new = self.layout.summed(hi, lo, count), []

    def send(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        hi, lo, count = self.keys
        if not len(hi):
            return
        regions, first = np.unique(self.layout.regions(hi), return_index=True)
        ends = np.append(first[1:], len(hi))
        blocks = [encode(self.layout, hi[a:b], lo[a:b], count[a:b]) for a, b in zip(first, ends, strict=True)]
        self.keys = tuple(x[:0] for x in self.keys)
        yield pa.RecordBatch.from_arrays([pa.array(regions), pa.array(blocks, pa.binary())], names=["region", "block"])


def _flat(ids: pa.Array, own: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all rows with a 0 after each, and which of them may begin an n-gram."""
    sizes = np.diff(ids.offsets.to_numpy())
    values, begins = ids.flatten().to_numpy(zero_copy_only=False), own.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(values)) + row
    out, may = np.zeros(len(values) + len(sizes), np.uint32), np.zeros(len(values) + len(sizes), bool)
    out[at] = values
    may[at] = np.arange(len(values)) - (np.cumsum(sizes) - sizes)[row] < begins[row]
    return out, may


def counted(sequences: DataFrame, layout: Layout, shorter: tuple[Layout, bytes] | None, least: int,
            held: int = HELD, gathered: int = GATHERED) -> DataFrame:
    """(ids, a, slot) of the n-grams of ``sequences`` (ids, own) that occur ``least`` times.

    Each task counts in a filter of its own; what it sends is sorted, so a region is merged by one pass over its blocks.
    ``shorter`` is the map of the frequent n-grams one word shorter: an n-gram is counted only where both of its own are
    in it, which loses none, as they occur at least as often.
    """
    k = layout.k
    shared = sequences.sparkSession.sparkContext.broadcast(shorter[1]) if shorter else None

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Filter(layout, held, gathered)
        known = np.frombuffer(shared.value, np.uint8) if shorter else None
        for batch in batches:
            ids, good = _flat(batch.column("ids"), batch.column("own"))
            n = len(ids) - k + 1
            if n <= 0:
                continue
            good = good[:n].copy()
            for i in range(k):
                good &= ids[i:i + n] > 0
            if shorter:
                hit = np.zeros(n + 1, bool)
                at = np.flatnonzero(np.logical_or(np.append(good, False), np.append(False, good)))
                slot = slots(*shorter[0].scrambled([ids[at + i] for i in range(k - 1)]))
                hit[at] = known[slot >> 3] >> (slot & 7).astype(np.uint8) & 1
                good &= hit[:-1] & hit[1:]
            at = np.flatnonzero(good)
            yield from made.add(*layout.scrambled([ids[at + i] for i in range(k)]))
        yield from made.send()

    def merge(key: tuple, blocks: pa.Table) -> pa.Table:
        parts = [decode(layout, key[0].as_py(), b.as_py()) for b in blocks.column("block")]
        hi, lo, count = layout.summed(*[np.concatenate(x) for x in zip(*parts, strict=True)])
        kept = count >= least
        hi, lo, count = hi[kept], lo[kept], count[kept]
        rows = layout.words(hi, lo)
        ids = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, k, dtype=np.int32), pa.array(rows.ravel()))
        return pa.table({"ids": ids, "a": count, "slot": slots(hi, lo)})

    sent = sequences.mapInArrow(shard, "region long, block binary")
    return sent.groupBy("region").applyInArrow(merge, "ids array<int>, a long, slot long")


def bitmap(frequent: DataFrame) -> bytes:
    """The map of the ``slot`` column: 2**MAP_BITS bits, made in pieces of 4 KB."""
    place = F.col("slot") + 1  # the functions count from 1
    parts = frequent.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).toArrow()
    made = np.zeros((1 << MAP_BITS) // 8, np.uint8).reshape(-1, 4096)
    for bucket, bits in zip(parts.column("bucket").to_pylist(), parts.column("bits").to_pylist(), strict=True):
        made[bucket - 1] = np.frombuffer(bits, np.uint8)
    return made.tobytes()


def _folded(word: str):
    """ASCII letters of column ``word`` in lower case, all other characters as they are."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, ASCII_UPPER, ASCII_LOWER))


def _hashes(raw: np.ndarray, offsets: np.ndarray):
    found = words(raw, offsets, _APART, fold=True)
    return found, words(_OTHER[LOWER[raw]], offsets, _OTHER_APART).hash


class Dictionary:
    """Numbers of frequent words by two hashes of word and language; long words by their bytes."""

    def __init__(self, table: pa.Table):
        raw, offsets = flatten(table.column("word"))
        size, lang = np.diff(offsets), table.column("lang_hash").to_numpy().view(np.uint64)
        ids = table.column("id").to_numpy().astype(np.uint32)
        found, other = _hashes(raw, offsets)  # every word is one word again
        order = np.argsort(scramble(found.hash ^ lang), kind="stable")
        self.first, self.second, self.ids = scramble(found.hash ^ lang)[order], scramble(other + lang)[order], ids[order]
        self.long = {(int(lang[i]), raw[offsets[i]:offsets[i + 1]].tobytes()): int(ids[i]) for i in np.flatnonzero(size > LONG)}

    def numbers(self, texts: pa.Array, lang: np.ndarray) -> np.ndarray:
        """Numbers of the words of all texts, 0 for others and between pieces; runs of one word are left out."""
        raw, offsets = flatten(texts)
        found, other = _hashes(raw, offsets)
        n = len(found.start)
        if not n or not len(self.ids):
            return np.zeros(0, np.int32)
        owner = found.owner()
        lang = lang.view(np.uint64)[owner]
        key = scramble(found.hash ^ lang)
        at = np.minimum(np.searchsorted(self.first, key), len(self.first) - 1)
        ids = np.where((self.first[at] == key) & (self.second[at] == scramble(other + lang)), self.ids[at], 0)
        for i in np.flatnonzero(found.end - found.start > LONG):
            ids[i] = self.long.get((int(lang[i]), LOWER[raw[found.start[i]:found.end[i]]].tobytes()), 0)
        breaks = np.concatenate([[0], np.cumsum(_BREAK[raw])])
        apart = np.append((breaks[found.start[1:]] != breaks[found.end[:-1]]) | (owner[1:] != owner[:-1]), True)
        out = np.zeros(n + int(apart.sum()), np.int32)
        out[np.arange(n) + np.cumsum(apart) - apart] = ids
        here = out > 0
        near = np.zeros(len(out), bool)
        near[1:] |= here[:-1]
        near[:-1] |= here[1:]
        out[here & ~near] = 0
        return out[np.concatenate([[True], (out[1:] > 0) | (out[:-1] > 0)])]


def sequences(docs: DataFrame, numbers: DataFrame, few: bool) -> DataFrame:
    """(ids, own): word numbers of stretches of text in order, 0 between pieces; n-grams begin in the first ``own`` ones.

    ``docs`` has (text, lang), ``numbers`` (lang, word, id). ``few`` says that every task may hold all numbers; else words
    are joined with theirs and the texts put together again in stretches of bounded length.
    """
    if few:
        table = numbers.select("word", F.xxhash64("lang").alias("lang_hash"), "id").toArrow()
        shared = docs.sparkSession.sparkContext.broadcast(Dictionary(table))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = shared.value.numbers(batch.column("text"), batch.column("lang_hash").to_numpy())
                if len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int32())), pa.array([len(ids)], pa.int32())],
                                                     names=["ids", "own"])

        return docs.select("text", F.xxhash64("lang").alias("lang_hash")).mapInArrow(run, "ids array<int>, own int")
    tokens = F.regexp_extract_all("text", F.lit(rf"{_WORD}|[.,;:!?\x0A-\x0D]"), F.lit(0))
    rows = docs.withColumn("row", F.monotonically_increasing_id()).select("lang", "row", F.posexplode_outer(tokens).alias("at", "word"))
    rows = rows.filter("word IS NOT NULL").withColumn("word", _folded("word")).join(numbers, ["lang", "word"], "left")
    stretch = F.floor(F.col("at") / STRETCH)
    ahead = F.when(F.col("at") % STRETCH < LONGEST - 1, F.greatest(stretch - 1, F.lit(0)))
    rows = rows.select("row", "at", F.coalesce("id", F.lit(0)).cast("int").alias("id"),
                       F.explode(F.array_distinct(F.array_compact(F.array(stretch, ahead)))).alias("stretch"))
    parts = rows.groupBy("row", "stretch").agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("s"))
    return parts.select(F.col("s.id").alias("ids"), F.least(F.size("s"), F.lit(STRETCH)).alias("own"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, report: int = REPORT,
                 dictionary: int = DICTIONARY, region: int = REGION, **memory) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``report`` phrases of each language that hold together best.

    Words are what stands between spaces, tabs and ``BREAKS``, ASCII letters in lower case; phrases of two to four words
    lie within a piece of text that ``BREAKS`` ends. Candidates occur ``least`` times (``a``). A cut after k words into
    parts that occur ``l`` and ``r`` times scores floor(2,000,000 a / (l + r)); the least score counts (ties: least k).
    Candidates are dropped where a longer one that holds them occurs 80 % as often. ``n`` is the language's words.

    Words that occur ``least`` times get numbers, n-grams of numbers are packed, scrambled invertibly and counted as
    (quotient, full remainder, counter) in filters; nothing is approximate. No phrase of rarer words can be a candidate.

    A null language is ``und``, null and empty texts have no words, texts of any length are read whole, repeated rows count
    as often as they occur. Languages without candidates, and tables without rows, give no rows. Other columns are unread.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(field(docs, text, T.StringType()), F.lit("")).alias("text"),
                       F.coalesce(field(docs, lang, T.StringType()), F.lit("und")).alias("lang"))
    # An outer explode: an inner one makes the planner search each text twice, once to see if it has any words.
    seen = docs.select("lang", F.explode_outer(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))).alias("word"))
    seen = seen.filter("word IS NOT NULL").select("lang", _folded("word").alias("word"))
    every = settle(seen.groupBy("lang", "word").agg(F.count("*").alias("a")), "phrase-words")
    numbers = numbered(every.filter(F.col("a") >= least), ["lang", "word"], "id").withColumn("id", (F.col("id") + 1).cast("int"))
    known, occurrences = numbers.agg(F.count("*"), F.coalesce(F.sum("a"), F.lit(0))).first()
    ids = settle(sequences(docs, numbers.select("lang", "word", "id"), known <= dictionary), "phrase-ids")

    single = numbers.select(F.array("id").alias("ids"), "a")
    longer, shorter = [], None
    for k in range(2, LONGEST + 1):
        layout = Layout(k, max(1, known.bit_length()), max(0, (occurrences // region).bit_length()))
        found = settle(counted(ids, layout, shorter, least, **memory), f"phrase-{k}")
        longer.append(found.select("ids", "a"))
        shorter = (layout, bitmap(found)) if k < LONGEST else None
    phrases = longer[0].unionByName(longer[1]).unionByName(longer[2])
    parts = single.unionByName(phrases)

    cuts = phrases.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("ids", 1, F.col("k")), "right": F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k"))})
    cuts = cuts.join(parts.select(F.col("ids").alias("left"), F.col("a").alias("l")), "left")
    cuts = cuts.join(parts.select(F.col("ids").alias("right"), F.col("a").alias("r")), "right")
    wide = lambda c: c.cast("decimal(20,0)")  # noqa: E731  a product of two counts may pass 64 bits
    # A part occurs at least as often as the whole, so no score passes SCALE / 2.
    score = F.expr(f"cast(cast({SCALE} AS decimal(7,0)) * cast(a AS decimal(20,0)) div (cast(l AS decimal(20,0)) + r) AS long)")
    cut = cuts.select("ids", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    inner = F.expr("flatten(transform(sequence(2, size(ids) - 1), m -> "
                   "transform(sequence(1, size(ids) - m + 1), s -> slice(ids, s, m))))")
    held = phrases.filter(F.size("ids") > 2).select(F.explode(inner).alias("ids"), F.col("a").alias("held"))
    rows = cut.withColumn("held", F.lit(None).cast("long")).unionByName(held, allowMissingColumns=True)
    rows = rows.groupBy("ids").agg(F.max("a").alias("a"), F.min("cut").alias("cut"), F.max("held").alias("held"))
    kept = rows.filter(F.col("held").isNull() | (wide(F.col("held")) * 100 < wide(F.col("a")) * INSIDE))
    kept = settle(kept.select("ids", "a", "cut.l", "cut.r", "cut.score"), "phrase-kept")

    spelled = kept.select("ids", F.posexplode("ids").alias("at", "id")).join(numbers.select("id", "lang", "word"), "id")
    spelled = spelled.groupBy("ids").agg(F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    rows = kept.join(spelled.select("ids", "lang", F.array_join("w.word", " ").alias("phrase")), "ids").drop("ids")
    # The first of each language are among the first of its parts, so no task sorts a whole language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    within = Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(64))).orderBy(*order)
    rows = rows.withColumn("_r", F.row_number().over(within)).filter(F.col("_r") <= report)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= report)
    totals = settle(every.groupBy("lang").agg(F.sum("a").alias("n")), "phrase-totals")
    longs = [F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")]
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *longs)


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents").select("lang", "text"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT d, lang, generate_subscripts(ps, 1) AS p, regexp_extract_all(unnest(ps), '[^\x20\x09]+') AS ws FROM d),
t AS (SELECT d, lang, p, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM p),
g AS (SELECT lang, [w, lead(w) OVER s, lead(w, 2) OVER s, lead(w, 3) OVER s] AS ws FROM t WINDOW s AS (PARTITION BY d, p ORDER BY i)),
f AS (SELECT lang, ws[:k] AS ids, k, count(*) AS a FROM g, range(1, 5) r(k) WHERE ws[k] IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 30),
cuts AS MATERIALIZED (SELECT lang, ids, a, j, array_to_string(ids[:j], ' ') AS lp, array_to_string(ids[j + 1:], ' ') AS rp
                      FROM c, range(1, 4) x(j) WHERE j < k),
s AS MATERIALIZED (SELECT lang, array_to_string(ids, ' ') AS p, a FROM f WHERE k < 4 AND a >= 30),
cut AS (SELECT cuts.lang, ids, cuts.a, j, l.a AS l, r.a AS r, 2000000::HUGEINT * cuts.a // (l.a + r.a) AS score
        FROM cuts JOIN s l ON l.lang = cuts.lang AND l.p = lp JOIN s r ON r.lang = cuts.lang AND r.p = rp),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, ids ORDER BY score, j) = 1),
held AS (SELECT lang, ids[s:s + m - 1] AS ids, max(a) AS held FROM c, range(2, 4) y(m), range(1, 4) z(s)
         WHERE m < k AND s + m - 1 <= k GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN held USING (lang, ids) WHERE held IS NULL OR 100::HUGEINT * held < 80::HUGEINT * a),
ranked AS (SELECT lang, array_to_string(ids, ' ') AS phrase, a, l, r, score::BIGINT AS score,
                  row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ids, ' ')) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
