"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy on shards of all labelled texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import cleaning, read, settle
from barloom.llm.words import PUNCTUATION, flatten, words
from barloom.operators.ordering import Ordered, last_set, running_sum

# Labelled rows, and words of them, that one task trains on, about. More of either make more tasks; all rows are trained on.
SHARD_ROWS, SHARD_WORDS = 6000, 4 << 20
# Rounds in which several tasks train before their networks are averaged.
ROUNDS = 6
# Numbers sent at once to be added up, and how many such pieces are added at once.
CHUNK, FAN = 1 << 14, 8
# Rows of the embedding tables, their width, filters per width, and the widths in words.
TABLE, DIM, FILTERS, WIDTHS = 1 << 14, 16, 8, (1, 2, 3)
# Bytes of a word's beginning that are embedded besides the word.
STEM = 4
# Training texts a word must be met in to get an embedding.
SEEN = 2
# Words scored at once.
STEP = 1 << 16
# Distinct scores a task puts in order, about.
BLOCK = 100_000


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table rows of each word and of its stem, and the words' offsets by text."""
    raw, offsets = flatten(texts)
    whole = words(raw, offsets, PUNCTUATION, fold=True)
    stem = words(raw, offsets, PUNCTUATION, fold=True, prefix=STEM)
    row = lambda h: (h >> np.uint64(40)).astype(np.int64) % TABLE
    return row(whole.hash), row(stem.hash), whole.first


@dataclass
class Network:
    """Embeddings of words and stems, convolutions of several widths, max pooling, logistic output."""

    params: dict[str, np.ndarray]
    thresholds: dict[str | None, float] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        made = {"word": rng.normal(0, 0.1, (TABLE, DIM)), "stem": rng.normal(0, 0.1, (TABLE, DIM)),
                "out": rng.normal(0, 0.3, FILTERS * len(WIDTHS)), "bias": np.zeros(1)}
        for k in WIDTHS:
            made[f"w{k}"] = rng.normal(0, 0.5 / np.sqrt(k), (k * DIM, FILTERS))
            made[f"b{k}"] = np.zeros(FILTERS)
        return cls({k: v.astype(np.float32) for k, v in made.items()})

    @classmethod
    def blank(cls) -> Network:
        """Scores everything close to 0."""
        made = cls.fresh()
        made.params["out"][:], made.params["bias"][:] = 0, -40
        return made

    def convolve(self, x: np.ndarray, left: np.ndarray, k: int) -> np.ndarray:
        """Rectified filters of width ``k`` at each word; 0 where fewer than ``k`` words are left."""
        w, n = self.params[f"w{k}"], len(x)
        y = np.full((n, FILTERS), self.params[f"b{k}"], np.float32)
        for s in range(k):
            y[:n - s] += x[s:] @ w[s * DIM:(s + 1) * DIM]
        y[left < k] = 0
        return np.maximum(y, 0, out=y)

    def steps(self, word: np.ndarray, stem: np.ndarray, first: np.ndarray) -> Iterator[tuple]:
        """(from, to, embeddings, words left in the text of each, texts, their starts) of steps that overlap by a width."""
        n = len(word)
        for lo in range(0, n, STEP):
            hi = min(n, lo + STEP)
            ahead = min(n, hi + max(WIDTHS) - 1)
            x = self.params["word"][word[lo:ahead]] + self.params["stem"][stem[lo:ahead]]
            a, b = np.searchsorted(first, lo, "right") - 1, np.searchsorted(first, hi, "left")
            texts = np.arange(a, b)
            starts = np.maximum(first[a:b], lo)
            filled = np.minimum(first[a + 1:b + 1], hi) > starts
            texts, starts = texts[filled], starts[filled] - lo
            stop = first[texts + 1] - lo
            left = np.repeat(stop, np.diff(np.append(starts, hi - lo))) - np.arange(hi - lo)
            yield lo, hi, x, np.concatenate([left, np.zeros(ahead - hi, left.dtype)]), texts, starts

    def pooled(self, word: np.ndarray, stem: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each text; whole texts, in steps."""
        out = np.zeros((len(first) - 1, FILTERS * len(WIDTHS)), np.float32)
        for lo, hi, x, left, texts, starts in self.steps(word, stem, first):
            for j, k in enumerate(WIDTHS):
                best = np.maximum.reduceat(self.convolve(x, left, k)[:hi - lo], starts, axis=0)
                part = slice(j * FILTERS, (j + 1) * FILTERS)
                out[texts, part] = np.maximum(out[texts, part], best)
        return out

    def winners(self, word: np.ndarray, stem: np.ndarray, first: np.ndarray) -> tuple[list, list]:
        """By width, the largest response of each filter in each text and the first word that gives it; in steps."""
        tops = [np.zeros((len(first) - 1, FILTERS), np.float32) for _ in WIDTHS]
        picks = [np.zeros((len(first) - 1, FILTERS), np.int64) for _ in WIDTHS]
        for lo, hi, x, left, texts, starts in self.steps(word, stem, first):
            owner = np.repeat(np.arange(len(texts)), np.diff(np.append(starts, hi - lo)))
            for k, top, pick in zip(WIDTHS, tops, picks, strict=True):
                c = self.convolve(x, left, k)[:hi - lo]
                best = np.maximum.reduceat(c, starts, axis=0)
                filt, at = np.nonzero(((c == best[owner]) & (c > 0)).T)
                cell, one = np.unique(filt * len(texts) + owner[at], return_index=True)
                filt, text = np.divmod(cell, len(texts))
                more = best[text, filt] > top[texts[text], filt]
                filt, text, one = filt[more], text[more], one[more]
                top[texts[text], filt], pick[texts[text], filt] = best[text, filt], at[one] + lo
        return tops, picks

    def score(self, word: np.ndarray, stem: np.ndarray, first: np.ndarray) -> np.ndarray:
        z = self.pooled(word, stem, first).astype(np.float64) @ self.params["out"] + float(self.params["bias"][0])
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))

    def gradients(self, word: np.ndarray, stem: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict:
        """Of the mean log loss over non-empty texts; only the winning words of the pooling carry any."""
        p, n, texts = self.params, len(word), len(y)
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        tops, picks = self.winners(word, stem, first)
        feats = np.concatenate(tops, axis=1)
        score = 1.0 / (1.0 + np.exp(-np.clip(feats @ p["out"] + p["bias"][0], -40, 40)))
        dz = ((score - y) / texts).astype(np.float32)
        grads["out"], grads["bias"] = feats.T @ dz, dz.sum(keepdims=True)
        for j, k in enumerate(WIDTHS):
            live = np.where(tops[j] > 0, dz[:, None] * p["out"][j * FILTERS:(j + 1) * FILTERS], 0).astype(np.float32)
            grads[f"b{k}"] = live.sum(0)
            for s in range(k):
                at = np.minimum(picks[j] + s, n - 1)
                w = p[f"w{k}"][s * DIM:(s + 1) * DIM]
                grads[f"w{k}"][s * DIM:(s + 1) * DIM] = np.einsum("tfd,tf->df", p["word"][word[at]] + p["stem"][stem[at]], live)
                dx = (live[:, :, None] * w.T[None]).reshape(-1, DIM)
                np.add.at(grads["word"], word[at].ravel(), dx)
                np.add.at(grads["stem"], stem[at].ravel(), dx)
        return grads


@dataclass
class Sample:
    """Tokenised texts: table rows of words and stems in two bytes each, and the words' offsets by text."""

    word: np.ndarray
    stem: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, word: bytes, stem: bytes, size: bytes) -> Sample:
        return cls(np.frombuffer(word, np.uint16), np.frombuffer(stem, np.uint16),
                   np.concatenate([[0], np.cumsum(np.frombuffer(size, np.int64))]))

    def part(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.diff(self.first)[texts]
        at = np.concatenate([np.zeros(0, np.int64), *[np.arange(self.first[i], self.first[i + 1]) for i in texts]]).astype(np.int64)
        return self.word[at].astype(np.int64), self.stem[at].astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])

    def met(self, rows: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """In how many of ``texts`` each table row occurs."""
        out = np.zeros(TABLE, np.int64)
        for i in texts:
            out[np.unique(rows[self.first[i]:self.first[i + 1]])] += 1
        return out


def counts(sample: Sample, toxic: np.ndarray) -> np.ndarray:
    """In how many texts of either label each word and each stem is met: rows toxic and not, of words, then of stems."""
    return np.concatenate([sample.met(rows, np.flatnonzero(of)) for rows in (sample.word, sample.stem) for of in (toxic, ~toxic)])


def begin(met: np.ndarray, toxic: int, total: int, seed: int = 7) -> tuple[Network, dict]:
    """The network training starts from, and which embeddings stay zero.

    The first coordinate of an embedding begins at the smoothed log odds of the labels among the texts that hold the
    word, so few texts go a long way. Words and stems met in fewer than ``SEEN`` texts keep a zero embedding: what one
    text alone holds tells nothing, and unknown words must not score.
    """
    net, dead = Network.fresh(seed), {}
    for name, (bad, good) in zip(("word", "stem"), met.reshape(2, 2, TABLE), strict=True):
        odds = np.log((bad + 0.5) / (toxic + 1.0)) - np.log((good + 0.5) / (total - toxic + 1.0))
        net.params[name][:, 0] += 0.3 * odds.astype(np.float32)
        dead[name] = bad + good < SEEN
        net.params[name][dead[name]] = 0
    return net, dead


def train(net: Network, dead: dict, sample: Sample, labels: np.ndarray, epochs: range, of: int, rng, batch: int = 32) -> None:
    """Adam on log loss of a sample for ``epochs`` of the ``of`` in all. Texts without words are left out."""
    rows, step = np.flatnonzero(np.diff(sample.first) > 0), 0
    mean = {k: np.zeros_like(v) for k, v in net.params.items()}
    var = {k: np.zeros_like(v) for k, v in net.params.items()}
    for epoch in epochs:
        rate = 0.02 * (1 - epoch / of) + 0.001
        order = rng.permutation(rows)
        for lo in range(0, len(order), batch):
            part = order[lo:lo + batch]
            grads = net.gradients(*sample.part(part), labels[part])
            step += 1
            for k, g in grads.items():
                if k in dead:
                    g[dead[k]] = 0
                mean[k] += 0.1 * (g - mean[k])
                var[k] += 0.01 * (g * g - var[k])
                net.params[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-6)


def calibrate(scores: DataFrame, default: float = 0.5, least: int = 20, within: tuple[float, float] = (0.2, 0.9)) -> dict:
    """For each language the middle of the widest gap between scores with the best F1; under ``None`` over all.

    ``scores`` has rows (score, toxic, lang); all count, in running sums over the distinct scores. Languages with fewer
    than ``least`` rows of either label take the overall threshold; if all rows are too few, that is ``default``.
    Thresholds stay within ``within``.
    """
    named = F.coalesce("lang", F.lit("")) != ""
    # The empty name stands for all rows.
    series = F.explode(F.when(named, F.array(F.lit(""), "lang")).otherwise(F.array(F.lit("")))).alias("series")
    cells = settle(scores.select("score", F.col("toxic").cast("long").alias("toxic"), series).groupBy("series", "score").agg(
        F.count("*").alias("n"), F.sum("toxic").alias("bad")), "toxicity-scores")
    totals = cells.groupBy("series").agg(F.sum("n").alias("rows"), F.sum("bad").alias("all_bad"))
    totals = totals.filter(F.least(F.col("all_bad"), F.col("rows") - F.col("all_bad")) >= least)
    sums = Ordered.on_events(cells, ["series"], ["score"], BLOCK).running(
        above=running_sum(F.col("n"), backward=True), found=running_sum(F.col("bad"), backward=True),
        lower=last_set(F.col("score"), strict=True)).df
    gap = F.col("score") - F.coalesce("lower", F.lit(0.0))
    f1 = F.when(gap > 0, 2 * F.col("found") / (F.col("above") + F.col("all_bad"))).otherwise(F.lit(-1.0))
    best = sums.join(totals, "series").groupBy("series").agg(F.max(F.struct(f1.alias("f1"), gap.alias("gap"), "score")).alias("top"))
    found = {r.series or None: float(np.clip(r.top.score - r.top.gap / 2, *within)) for r in best.collect()}
    return {None: default} | found


def held_out(doc_id: Column) -> Column:
    """Rows no label is learned from: CRC-32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SHARD_ROWS, words: int = SHARD_WORDS, thresholds: bool = True) -> Network:
    """A network fitted on all labelled documents with a text, but for held-out ids.

    Ids labelled both ways count as toxic; ids with several texts take the least. With ``thresholds`` a fifth of the
    documents (by hash) sets the thresholds and is not trained on; without, all are trained on and there are none.
    Without any labels of one kind the network stays untrained and rejects nothing.

    The documents are tokenised and dealt by hash to shards of about ``rows`` documents and ``words`` words at most. How
    many texts hold a word is added up over all shards. In each round every shard trains on all of its documents from
    the common network, and the changes are averaged, by the documents of a shard, those of an embedding by the
    documents that hold the word. One shard trains all epochs alone. The driver gets sums and the network, no rows.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.filter(F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select(
        "doc_id", F.col("text").cast("string").alias("text"), lang.alias("lang"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)) == 0 if thresholds else F.lit(False)
    found = texts.join(known, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("row"))
    found = found.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "row.text", "row.lang", fold.alias("fold"))
    kind = found.schema["doc_id"].dataType.simpleString()
    found = settle(found.mapInArrow(_tokenised, f"doc_id {kind}, {TOKENS}"), "toxicity-tokens")
    size = found.agg(F.min("toxic").alias("least"), F.max("toxic").alias("most"), F.count_if(~F.col("fold")).alias("rows"),
                     F.sum(F.when(~F.col("fold"), F.col("toxic"))).alias("bad"), F.count_if(~F.col("fold") & (F.col("n") > 0)).alias("filled"),
                     F.sum(F.when(~F.col("fold"), F.col("n"))).alias("words")).first()
    if size.least is None or size.least == size.most:
        return Network.blank()
    if not size.filled:
        net = Network.fresh()
    else:
        shards = max(1, -(-size.rows // rows), -(-size.words // words))
        net = _fitted(_packed(found.filter(~F.col("fold")), shards), shards, size.rows, size.bad, size.filled)
    if thresholds:
        shared = found.sparkSession.sparkContext.broadcast(net)

        def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sample = Sample.of(*(b"".join(batch.column(c).to_pylist()) for c in ("word", "stem")), batch.column("n").to_numpy().tobytes())
                score = shared.value.score(*sample.part(np.arange(batch.num_rows)))
                yield pa.RecordBatch.from_arrays([pa.array(score, pa.float64()), batch.column("toxic"), batch.column("lang")],
                                                 names=["score", "toxic", "lang"])

        net.thresholds = calibrate(found.filter("fold").mapInArrow(judged, "score double, toxic int, lang string"))
    return net


TOKENS = "toxic int, lang string, fold boolean, n long, word binary, stem binary"


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, toxic, text, lang, fold) with the text's number of words and their table rows, two bytes each."""
    for batch in batches:
        word, stem, first = tokens(batch.column("text"))
        cells = [pa.array([rows[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)], pa.binary())
                 for rows in (word.astype(np.uint16), stem.astype(np.uint16))]
        named = ("doc_id", "toxic", "lang", "fold")
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in named] + [pa.array(np.diff(first), pa.int64()), *cells],
                                         names=[*named, "n", "word", "stem"])


def _packed(found: DataFrame, shards: int) -> DataFrame:
    """Tokenised documents dealt to shards, each written as one row (shard, toxic, size, word, stem)."""
    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc_id")
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()),
                         "toxic": [rows.column("toxic").to_numpy().astype(np.uint8).tobytes()],
                         "size": [rows.column("n").to_numpy().astype(np.int64).tobytes()],
                         "word": [b"".join(rows.column("word").to_pylist())], "stem": [b"".join(rows.column("stem").to_pylist())]})

    dealt = found.select(F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).alias("shard"), "doc_id", "toxic", "n", "word", "stem")
    dealt = dealt.repartitionByRange(shards, "shard").groupBy("shard")
    return settle(dealt.applyInArrow(pack, "shard long, toxic binary, size binary, word binary, stem binary"), "toxicity-shards")


def _added(packed: DataFrame, shards: int, work, length: int) -> np.ndarray:
    """Sum over the shards of the ``length`` numbers that ``work`` gives of each (sample, labels, shard); order is fixed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                made = work(Sample.of(row["word"], row["stem"], row["size"]), np.frombuffer(row["toxic"], np.uint8) > 0, row["shard"])
                at = range(0, length, CHUNK)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), row["shard"])), pa.array(np.arange(len(at))),
                     pa.array([made[lo:lo + CHUNK].astype(np.float64).tobytes() for lo in at], pa.binary())], names=["part", "chunk", "numbers"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        total = 0.0
        for x in rows.column("numbers"):
            total = total + np.frombuffer(x.as_py(), np.float64)
        return pa.table({"part": pa.array([key[1].as_py()], pa.int64()), "chunk": rows.column("chunk")[:1], "numbers": pa.array([total.tobytes()], pa.binary())})

    schema = "part long, chunk long, numbers binary"
    sums = packed.mapInArrow(run, schema)
    while shards > 1:  # a tree, so that no group grows with the shards
        sums = sums.groupBy("chunk", F.floor(F.col("part") / FAN).alias("_group")).applyInArrow(add, schema)
        shards = -(-shards // FAN)
    with cleaning(packed.sparkSession):
        rows = sorted(sums.select("chunk", "numbers").collect())
    return np.concatenate([np.frombuffer(r.numbers, np.float64) for r in rows])


def _fitted(packed: DataFrame, shards: int, rows: int, bad: int, filled: int, least: int = 6, steps: int = 600, batch: int = 32, seed: int = 7) -> Network:
    """The network trained on the shards for ``least`` epochs, more if all rows together make fewer than ``steps`` steps."""
    met = _added(packed, shards, lambda sample, toxic, shard: counts(sample, toxic), 4 * TABLE)
    net, dead = begin(met, bad, rows, seed)
    epochs = max(least, -(-steps // -(-filled // batch)))
    names = list(net.params)
    edges = np.cumsum([0] + [net.params[k].size for k in names])
    held = dict(zip(("word", "stem"), met.reshape(2, 2, TABLE).sum(1), strict=True))
    rounds = 1 if shards == 1 else ROUNDS
    for at in range(rounds):
        span = range(at * epochs // rounds, (at + 1) * epochs // rounds)
        shared = packed.sparkSession.sparkContext.broadcast((net, dead))

        def work(sample: Sample, toxic: np.ndarray, shard: int) -> np.ndarray:
            start, dead = shared.value
            own = Network({k: v.copy() for k, v in start.params.items()})
            rng = np.random.default_rng(seed if shards == 1 else (seed, at, shard))
            train(own, dead, sample, toxic.astype(np.float32), span, epochs, rng, batch)
            if shards == 1:
                return np.concatenate([own.params[k].ravel() for k in names])
            every = np.arange(len(toxic))
            weight = {"word": sample.met(sample.word, every)[:, None], "stem": sample.met(sample.stem, every)[:, None]}
            return np.concatenate([((own.params[k].astype(np.float64) - start.params[k]) * weight.get(k, len(toxic))).ravel() for k in names])

        made = _added(packed, shards, work, int(edges[-1]))
        shared.unpersist()
        for k, lo, hi in zip(names, edges, edges[1:], strict=False):
            own = made[lo:hi].reshape(net.params[k].shape)
            if shards > 1:
                own = net.params[k] + own / (np.maximum(held[k], 1)[:, None] if k in held else rows)
            net.params[k] = own.astype(np.float32)
    return net


def scored(docs: DataFrame, net: Network, text: str = "text") -> Column:
    """Score of each whole text between 0 and 1. Only the text is read; null and empty texts score alike."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few MB whatever the input

    @F.arrow_udf(T.DoubleType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(*tokens(texts)), pa.float64())

    return run(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))


def judge(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` with ``toxic_score`` and ``rejected`` (score at or above its language's threshold).

    The language decides the threshold alone, never the score. Null texts are as empty ones. Columns of the names
    added are replaced; no rows give no rows.
    """
    common = net.thresholds.get(None, 0.5)
    cut = F.lit(common)
    if "lang" in docs.columns:
        for name, value in sorted((k, v) for k, v in net.thresholds.items() if k is not None):
            cut = F.when(F.col("lang") == name, value).otherwise(cut)
    made = docs.withColumn("toxic_score", scored(docs, net))
    return made.withColumn("rejected", F.col("toxic_score") >= cut)


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    net = fit(docs, read(spark, sf_dir, "labels"), thresholds=False)  # the contract gives the threshold
    made = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored(docs, net).alias("score"))
    return made.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
