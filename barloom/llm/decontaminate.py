"""Benchmark decontamination: pigeonhole pieces find candidates, Myers' bit-parallel distance verifies."""

from __future__ import annotations

from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import keep_columns, read, settle

# Edits allowed per character of an item, and the shortest item (in characters) that may have any; shorter ones are
# looked for as they are, as whole words.
ERROR_RATE, LEAST_CHARS = 0.05, 20
# Characters of benchmark text that one automaton holds; more items make more automata.
AUTOMATON_CHARS = 4_000_000


def normal(text: str | None) -> str:
    """Lower case, white space runs as one space."""
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of nearly equal length; ``budget`` edits leave at least one of them whole."""
    n, parts = len(item), budget + 1
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of ``pattern`` to any stretch of ``text``, end of the first such stretch).

    One step per character: the column of the dynamic program is held as two bit vectors of its vertical
    differences, in integers of any length.
    """
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    up, down, score = full, 0, m
    best, at = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        rise = down | ~(zero | up) & full
        fall = up & zero
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise = rise << 1 & full  # the first row is free: a match may start anywhere
        fall = fall << 1 & full
        up = fall | ~(zero | rise) & full
        down = rise & zero
        if score < best:
            best, at = score, j + 1
    return best, at


def whole_words(text: str, start: int, end: int) -> bool:
    """Whether no letter or digit continues over either border of the stretch."""
    return not (start > 0 and text[start - 1].isalnum() and text[start].isalnum()
                or end < len(text) and text[end - 1].isalnum() and text[end].isalnum())


class Matcher:
    """Automaton over the pieces of all items, which are numbered: ids may be null or shared."""

    def __init__(self, items: list[tuple[int | None, str]], error_rate: float, least: int = LEAST_CHARS):
        self.items, owners = [], {}
        for number, (item_id, text) in enumerate(items):
            budget = int(len(text) * error_rate) if len(text) >= least else 0
            self.items.append((item_id, text, budget, len(text) < least))
            for offset, piece in pieces(text, budget):
                owners.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, held in owners.items():
            self.automaton.add_word(piece, (len(piece), held))
        if owners:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple]:
        """(item id, distance, start, end) for each stretch within the budget, best first end of each region."""
        if not self.items:
            return []
        origins: dict[int, set[int]] = {}
        for end, (size, held) in self.automaton.iter(text):
            for number, offset in held:
                origins.setdefault(number, set()).add(end + 1 - size - offset)
        out = []
        for number, starts in sorted(origins.items()):
            item_id, item, budget, short = self.items[number]
            if short:
                out += [(item_id, 0, s, s + len(item)) for s in sorted(starts) if whole_words(text, s, s + len(item))]
                continue
            regions: list[list[int]] = []
            for s in sorted(starts):  # an occurrence starts within the budget of where its whole piece puts it
                lo, hi = max(0, s - budget), min(len(text), s + len(item) + budget)
                if regions and lo <= regions[-1][2] + 2 * budget:
                    regions[-1][1:] = max(hi, regions[-1][1]), lo
                else:
                    regions.append([lo, hi, lo])
            for lo, hi, _ in regions:
                distance, end = myers(item, text[lo:hi])
                if distance <= budget:
                    back, size = myers(item[::-1], text[lo:lo + end][::-1])
                    out.append((item_id, distance, lo + end - size if back == distance else lo, lo + end))
        return out


_READY: dict[str, Matcher] = {}


def _matcher(key: str, items: list[tuple[int | None, str]], error_rate: float, least: int) -> Matcher:
    """One automaton per worker process, that of the list of items in use."""
    if key not in _READY:
        _READY.clear()
        _READY[key] = Matcher(items, error_rate, least)
    return _READY[key]


FOUND = "array<struct<item_id:bigint,distance:int,start:bigint,end:bigint>>"


def _runner(shared, key: str, error_rate: float, least: int):
    @F.arrow_udf(FOUND)
    def run(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()),
                                   ("end", pa.int64())]))
        matcher = _matcher(key, shared.value, error_rate, least)
        names = ("item_id", "distance", "start", "end")
        return pa.array([[dict(zip(names, m, strict=True)) for m in matcher.find(normal(t.as_py()))] for t in texts], kind)

    return run


def item_groups(benchmark: DataFrame, chars: int = AUTOMATON_CHARS):
    """Distinct (id, normalised text) in groups of at most ``chars`` characters, a group at a time in driver memory."""
    @F.arrow_udf("string")
    def folded(texts: pa.Array) -> pa.Array:
        return pa.array([normal(t.as_py()) for t in texts], pa.string())

    group, held = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), folded(F.col("text").cast("string")).alias("text")).filter(
        "text <> ''").distinct().orderBy(F.col("item_id").asc_nulls_last(), "text")
    for item_id, text in rows.toLocalIterator():
        if group and held + len(text) > chars:
            yield group
            group, held = [], 0
        group.append((item_id, text))
        held += len(text)
    if group:
        yield group


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", error_rate: float = ERROR_RATE,
         least: int = LEAST_CHARS, chars: int = AUTOMATON_CHARS) -> DataFrame:
    """``docs`` with ``leaks``: benchmark items found in each whole text within ``error_rate`` edits a character.

    Case and white space do not count; ``start`` and ``end`` are places in the normalised text. Null and empty
    texts have no leaks, null and empty items are in no text. Items below ``least`` characters are looked for without
    edits, at word borders. Each text of an id is looked for, and texts without id are reported with a null id; rows
    equal in id and normalised text are one. A column ``leaks`` is replaced. A benchmark of more than
    ``chars`` characters takes one written pass over the texts for each group of so many: one group at a time is in the
    driver, the broadcast and the automaton of a worker.
    """
    spark = docs.sparkSession
    source = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))

    def sent(group: list) -> tuple:
        shared = spark.sparkContext.broadcast(group)  # at most ``chars`` characters
        key = f"{spark.sparkContext.applicationId}-{shared._jbroadcast.id()}-{error_rate}-{least}"
        return shared, _runner(shared, key, error_rate, least)(source)

    groups, own = item_groups(benchmark, chars), [F.col(f"`{c}`") for c in keep_columns(docs, "leaks")]
    first, second = next(groups, None), next(groups, None)
    if second is None:
        return docs.select(*own, (sent(first)[1] if first else F.array().cast(FOUND)).alias("leaks"))
    # Finds follow from the text alone: texts with finds are named by a hash, and meet their rows when all passes are done.
    name = F.sha2(source.cast("binary"), 256)
    hits = None
    for group in chain((first, second), groups):
        shared, leaks = sent(group)
        part = settle(docs.select(name.alias("_text"), leaks.alias("_leaks")).filter(F.size("_leaks") > 0).distinct(), "leaks")
        shared.destroy()
        hits = part if hits is None else hits.unionByName(part)
    hits = settle(hits.groupBy("_text").agg(F.array_sort(F.flatten(F.collect_list("_leaks"))).alias("leaks")), "leaks")
    joined = docs.select(*own, name.alias("_text")).join(hits, "_text", "left")
    return joined.select(*own, F.coalesce("leaks", F.array().cast(FOUND)).alias("leaks"))


def query(spark, sf_dir: str) -> DataFrame:
    """One row per document and benchmark passage found in it."""
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode_outer("leaks").alias("leak")).filter("leak IS NOT NULL").select("doc_id", "leak.*")
