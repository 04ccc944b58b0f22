"""Spelling variants: words one edit apart, by range searches in k-d trees over letter counts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import field, read, settle

# Runs of letters, the share of runs that lose a letter, shortest word, fewest occurrences.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TYPO, LENGTH, LEAST = 97, 5, 3
# End of the fixed values.

# Words the upper trees are planned on, at most (about: those whose hash is below a share of its range). The plan only
# tells how words are dealt to groups, never which pairs are found.
PLAN_WORDS = 100_000
# Words of one group, about, and of a bucket of the tree inside it.
GROUP, BUCKET = 8192, 128
# Bytes and pairs compared at once inside a group.
CELLS = 1 << 21

# Dimension of each Latin-1 letter: one per ASCII letter, six shared by the others.
_DIM = np.array([b - 97 if 97 <= b < 123 else 26 + b % 6 for b in range(256)])


def codes(words: list[str]) -> np.ndarray:
    """Letter counts of each word as a corner of the 64-cube: of 32 dimensions, bits for a count of 1 and of 2 or more.

    One edit changes two dimensions by one, so it sets at most one bit and clears at most one; a letter more clears none.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    cell = np.repeat(np.arange(len(words)) * 32, sizes) + _DIM[raw]
    counts = np.bincount(cell, minlength=32 * len(words)).reshape(-1, 32)
    bits = np.stack([counts > 0, counts > 1], axis=2).reshape(-1, 64)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


@dataclass
class Node:
    """A box of the tree: the least and greatest corner of what it may hold, and its halves or its rows."""

    low: np.uint64
    high: np.uint64
    halves: tuple[Node, Node] | None = None
    rows: np.ndarray | None = None
    leaf: int = 0
    parts: int = 1


def tree(points: np.ndarray, size: int, tight: bool) -> Node:
    """k-d tree over ``points`` down to ``size`` rows, split where a dimension's count divides a box most evenly.

    Boxes are those of the points (``tight``) or of the cuts, which also hold points not seen yet. Equal points are
    not split.
    """
    every = np.uint64(0xFFFFFFFFFFFFFFFF)

    def grow(rows: np.ndarray, low: np.uint64, high: np.uint64) -> Node:
        own = points[rows]
        if tight and len(own):
            low, high = np.bitwise_and.reduce(own), np.bitwise_or.reduce(own)
        if len(rows) > size:
            bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            cut = int(np.argmin(np.abs(2 * bits.sum(0, dtype=np.int64) - len(rows))))
            on = bits[:, cut] > 0
            if on.any() and not on.all():
                bit = np.uint64(1 << cut)
                return Node(low, high, (grow(rows[~on], low, high & ~bit), grow(rows[on], low | bit, high)))
        return Node(low, high, rows=rows)

    return grow(np.arange(len(points)), np.uint64(0), every)


def leaves(root: Node) -> list[Node]:
    return [root] if root.halves is None else leaves(root.halves[0]) + leaves(root.halves[1])


def search(root: Node, points: np.ndarray, less: int) -> Iterator[tuple[Node, np.ndarray]]:
    """(leaf, points that may have a partner in it). A partner has one bit more at most, and at most ``less`` bits less."""
    stack = [(root, np.arange(len(points)))]
    while stack:
        node, at = stack.pop()
        own = points[at]
        at = at[(np.bitwise_count(node.low & ~own) <= 1) & (np.bitwise_count(own & ~node.high) <= less)]
        if len(at) and node.halves:
            stack += [(node.halves[0], at), (node.halves[1], at)]
        elif len(at):
            yield node, at


def plan(words: list[str], share: float, group: int) -> dict[int, Node]:
    """Upper tree by word length from the ``share`` of the words seen. Boxes of equal counts get parts by half words."""
    by_length: dict[int, list[str]] = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    made, size = {}, max(16, int(group * share))
    for length, own in by_length.items():
        made[length] = tree(codes(own), size, tight=False)
        for i, leaf in enumerate(leaves(made[length])):
            leaf.leaf, leaf.parts, leaf.rows = i, max(1, len(leaf.rows) // size), None
    return made


def _part(piece: str, parts: int) -> int:
    return zlib.crc32(piece.encode("latin-1")) % parts


def deal(words: list[str], trees: dict[int, Node]) -> Iterator[tuple[int, int, int, np.ndarray, int]]:
    """(length, leaf, part, rows of ``words``, role) of every group: role 0 at home, 1 to meet equal lengths, 2 longer ones.

    Words of one length meet in the later leaf of the two. A box of equal counts is dealt twice, by the first and by the
    second half of its words: one edit leaves one of them alone.
    """
    points = codes(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    whole = Node(np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF), rows=None)

    def parts(length: int, leaf: Node, rows: np.ndarray, role: int):
        if leaf.parts == 1:
            yield length, leaf.leaf, 0, rows, role
            return
        half = length // 2
        behind = half - 1 if role == 2 else half
        for back in (0, 1):
            dealt = np.array([back * leaf.parts + _part(words[i][behind:] if back else words[i][:half], leaf.parts) for i in rows])
            for p in np.unique(dealt):
                yield length, leaf.leaf, int(p), rows[dealt == p], role

    for length in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == length)
        own, longer = trees.get(length, whole), trees.get(length + 1, whole)
        home = np.zeros(len(rows), np.int64)
        found = list(search(own, points[rows], 1))
        for leaf, at in found:
            inside = (np.bitwise_count(leaf.low & ~points[rows[at]]) == 0) & (np.bitwise_count(points[rows[at]] & ~leaf.high) == 0)
            home[at[inside]] = leaf.leaf
        for leaf, at in found:
            yield from parts(length, leaf, rows[at[home[at] == leaf.leaf]], 0)
            yield from parts(length, leaf, rows[at[home[at] < leaf.leaf]], 1)
        for leaf, at in search(longer, points[rows], 0):
            yield from parts(length + 1, leaf, rows[at], 2)


def _matrix(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)


def replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows differ in exactly one letter."""
    return (a != b).sum(axis=1) == 1


def inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``b`` are those of ``a`` with one letter more: what agrees from the front and from the back covers ``a``."""
    n = a.shape[1]
    front, back = a == b[:, :-1], (a == b[:, 1:])[:, ::-1]
    ahead = np.where(front.all(axis=1), n, np.argmin(front, axis=1))
    behind = np.where(back.all(axis=1), n, np.argmin(back, axis=1))
    return ahead + behind >= n


def near(length: int, home: list[str], same: list[str], shorter: list[str], back: bool | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) one edit apart; i counts through home, same and shorter, j through home.

    ``back`` None compares whole words. Otherwise the group holds words by a half: False keeps pairs with equal first
    halves, True those with equal second halves alone.
    """
    if not home:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    target = _matrix(home, length)
    points = codes(home)
    root = tree(points, BUCKET, tight=True)
    half = length // 2
    found = []
    for first, words, less in ((0, home, 1), (len(home), same, 1), (len(home) + len(same), shorter, 0)):
        if not words:
            continue
        query, at_length = codes(words), length - (less == 0)
        letters = _matrix(words, at_length)
        judge = inserted if less == 0 else replaced
        step = max(1, CELLS // (8 * length))
        for leaf, at in search(root, query, less):
            rows = np.atleast_1d(leaf.rows)
            for lo in range(0, len(at), max(1, CELLS // len(rows))):
                block = at[lo:lo + max(1, CELLS // len(rows))]
                i, j = np.nonzero(np.bitwise_count(query[block][:, None] ^ points[rows][None, :]) <= 2)
                i, j = block[i], rows[j]
                if words is home:
                    i, j = i[i < j], j[i < j]
                for s in range(0, len(i), step):
                    a, b = letters[i[s:s + step]], target[j[s:s + step]]
                    good = judge(a, b)
                    if back is not None:
                        front = (a[:, :half] == b[:, :half]).all(axis=1)
                        good &= ~front & (a[:, half - (less == 0):] == b[:, half:]).all(axis=1) if back else front
                    found.append((i[s:s + step][good] + first, j[s:s + step][good]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def best(words: list[str], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with a near word, how many they have, and the row of the most frequent one (ties: least word)."""
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(np.array(words, object), kind="stable")] = np.arange(len(words))
    a, b = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    rows, first, count = np.unique(a, return_index=True, return_counts=True)
    return rows, count, b[first]


def occurrences(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row ``word`` per run of letters, ASCII letters in lower case, some runs without one letter (see ``variants``)."""
    # An outer explode: an inner one makes the planner search each text twice, once to see if it has any runs.
    rows = docs.select(F.coalesce(field(docs, key, T.StringType()), F.lit("")).alias("_doc"),
                       F.explode_outer(F.regexp_extract_all(field(docs, text, T.StringType()), F.lit(RUN), F.lit(0))).alias("_run"))
    ascii_only = F.octet_length("_run") == F.length("_run")
    rows = rows.select("_doc", F.when(ascii_only, F.lower("_run")).otherwise(F.translate("_run", UPPER, LOWER)).alias("_run"))
    rows = rows.withColumn("_h", F.crc32(F.concat(F.col("_doc"), F.lit(":"), F.col("_run")).cast("binary")))
    at = (F.col("_h") % F.length("_run")).cast("int")
    cut = F.concat(F.col("_run").substr(F.lit(1), at), F.col("_run").substr(at + 2, F.length("_run")))
    return rows.select(F.when(F.col("_h") % TYPO == 0, cut).otherwise(F.col("_run")).alias("word"))


def near_words(words: DataFrame, total: int, group: int = GROUP, plan_words: int = PLAN_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have a near one, from (word, n) with ``total`` distinct words.

    Each pair of words meets in one group; every group tells what it knows of each of its words, and the sums follow.
    A group holds the words of one length in one box of the upper tree, and the words whose range of letter counts
    reaches into that box; ``total / plan_words`` times 16 words share a group where that is more than ``group``.
    """
    spark = words.sparkSession
    share = min(1.0, plan_words / max(1, total))
    seen = words.filter(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else words
    trees = spark.sparkContext.broadcast(plan(seen.select("word").toArrow().column("word").to_pylist(), share, group))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n = batch.column("word").to_pylist(), batch.column("n")
            for length, leaf, part, rows, role in deal(texts, trees.value):
                if len(rows):
                    k = len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(k, x)) for x in (length, leaf, part, role)]
                        + [batch.column("word").take(pa.array(rows)), n.take(pa.array(rows))],
                        names=["length", "leaf", "part", "role", "word", "n"])

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("role")
        role = rows.column("role").to_numpy()
        texts, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
        a, b = np.searchsorted(role, (1, 2))
        length, leaf, part = (x.as_py() for x in key)
        node = trees.value.get(length)
        parts = leaves(node)[leaf].parts if node else 1
        i, j = near(length, texts[:a], texts[a:b], texts[b:], None if parts == 1 else part >= parts)
        at, count, top = best(texts, n, i, j)
        column = rows.column("word")
        return pa.table({"word": column.take(pa.array(at)), "n_near": pa.array(count, pa.int64()),
                         "best_n": pa.array(n[top], pa.int64()), "best": column.take(pa.array(top))})

    sent = words.mapInArrow(send, "length long, leaf long, part long, role long, word string, n long")
    return sent.groupBy("length", "leaf", "part").applyInArrow(meet, "word string, n_near long, best_n long, best string")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the rows (word, form): the last word reached by following forms.

    Each round doubles the steps taken. A form is at least twice as frequent as its word, so no path has more than 62.
    """
    now = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = settle(now.join(ahead, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        now = moved.select("word", "root")
        if not moved.filter("_moved").limit(1).count():
            return now


def variants(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, least: int = LEAST,
             ratio: int = 2, **options) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the frequent words of whole texts.

    Words are runs of Latin letters with ASCII letters in lower case; where 97 divides the CRC-32 of "id:run", the run
    loses the letter at that number modulo its length. Kept are words of ``length`` letters that occur ``least`` times.
    ``n_near`` counts the words one letter inserted, deleted or replaced away. ``form`` is the most frequent of them
    (ties: least) if it is ``ratio`` times as frequent, ``root`` the last form reached.

    Null and empty texts have no words; a null id is written as nothing. Repeated rows count as often as they occur.
    No rows, or none frequent enough, give no rows. Other columns are not read. A word of any length is compared whole.
    """
    seen = occurrences(docs, text, key).filter(F.length("word") >= length)
    words = settle(seen.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least), "spelling-words")
    total = words.count()
    found = near_words(words, total, **options)
    # One shuffle brings each word and what its groups found together.
    none = F.lit(None).cast("struct<k:bigint,best:string>")
    rows = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), none.alias("top")).unionByName(found.select(
        "word", F.lit(None).cast("long").alias("n"), "n_near", F.struct((-F.col("best_n")).alias("k"), "best").alias("top")))
    rows = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("top").alias("top"))
    taken = -F.col("top.k") >= ratio * F.col("n")
    rows = settle(rows.select("word", F.when(taken, F.col("top.best")).alias("form"), "n", "n_near",
                              F.when(taken, -F.col("top.k")).alias("form_n")), "spelling-forms")
    ends = roots(rows.filter("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return variants(read(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents),
low AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n
        FROM runs GROUP BY ALL),
coded AS (SELECT r, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)) AS x FROM low WHERE length(r) >= 5),
hashed AS (SELECT r, n, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM coded, crc),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n
        FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
holes AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
          FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
edges AS (SELECT a.word AS a, b.word AS b, b.n FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
          UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
          UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word),
top AS (SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, b) AS b, max(n) AS m FROM edges GROUP BY a),
f AS (SELECT word, CASE WHEN m >= 2 * words.n THEN b END AS form, words.n, coalesce(n_near, 0) AS n_near,
             CASE WHEN m >= 2 * words.n THEN m END AS form_n FROM words LEFT JOIN top ON a = word),
path AS (SELECT word, coalesce(form, word) AS ending, form IS NULL AS done FROM f
         UNION ALL SELECT p.word, coalesce(f.form, p.ending), f.form IS NULL FROM path p JOIN f ON f.word = p.ending WHERE NOT p.done)
SELECT f.word, form, ending AS root, n, n_near, form_n FROM f JOIN path ON path.word = f.word AND path.done
"""
