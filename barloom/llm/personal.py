"""Personal data: overlapping candidate spans from many patterns, chosen by boosted trees; built-in functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import keep_columns, read, settle

# The base kinds in order, and the digits of a card and of a phone number.
KINDS = ("email", "ip", "card", "phone")
CARD, PHONE = (16, 19), (8, 15)
# End of the fixed values.

_LOCAL = "A-Za-z0-9._%+-"
# The base patterns, written without backtracking into groups: possessive repeats take what a greedy one takes here,
# because what follows a repeat can never match inside it. An address begins where a run of its characters does, or where
# the match before it ended.
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OPEN, _SHUT = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
_AT = r"(?: ?[\[({] ?(?:at|AT|@) ?[\])}] ?| (?:at|AT) |@)"
_DOT = r"(?: ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?| (?:dot|DOT) |\.)"
_HEX = r"[0-9A-Fa-f]{1,4}"
# Generators of further candidates: (kind, pattern). Every match is bounded by the format's own lengths, so no candidate
# is longer than REACH. The last kind only proposes what is no personal data: dates, versions, amounts.
MORE = [
    ("email_more", rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,4}}(?![A-Za-z0-9-])"),
    ("ip_more", rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|(?:{_HEX}:){{2,7}}:|:(?::{_HEX}){{2,7}})(?![0-9A-Za-z:])"),
    ("card_more", rf"{_OPEN}[0-9]{{13,19}}{_SHUT}"),
    ("card_more", rf"{_OPEN}(?:(?:[0-9]{{4}}[ ._-]){{3}}[0-9]{{1,7}}|[0-9]{{4}}[ ._-][0-9]{{6}}[ ._-][0-9]{{5}}){_SHUT}"),
    ("phone_more", r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{4}(?![0-9])"),
    ("phone_more", r"\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"),
    ("phone_more", rf"(?<![0-9A-Za-z+().-])(?:\([0-9]{{3}}\) ?|[0-9]{{3}}[ .-])[0-9]{{3}}[ .-][0-9]{{4}}{_SHUT}"),
    ("phone_more", rf"(?<![0-9A-Za-z.,])00[1-9][0-9]{{0,2}}(?:[ .-]?[0-9]{{2,4}}){{2,4}}{_SHUT}"),
    ("id_more", rf"(?<![0-9A-Za-z-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9A-Za-z-])"),
    ("id_more", rf"{_OPEN}[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_SHUT}"),
    ("number", r"(?<![0-9A-Za-z.,/:-])[0-9][0-9.,/:-]{4,40}[0-9](?![0-9A-Za-z])"),
]
ADDED = ("email_more", "ip_more", "card_more", "phone_more", "id_more")
# Longest candidate of MORE, and how many of its list may begin within that reach of one.
REACH = 512
NEAR = 2048
# Characters of context before and after a candidate.
BEFORE, AFTER = 24, 2
WORDS_BEFORE = r"(?i)mail|contact|tel|phone|call|fax|mobile|cell|card|visa|iban|account|ssn|social|addr|host|server|whatsapp|kontakt|telefon|tarjeta|carte"

# Levels of each feature.
FEATURES = {"family": 6, "digits": 9, "marks": 5, "check": 2, "at": 3, "plus": 2, "left": 4, "right": 4, "word": 2, "variety": 3}
TREES, DEPTH, RATE, RIDGE = 8, 3, 0.5, 1.0
# Gradients are summed as integers of this scale, so that sums do not depend on their order.
GRAIN = 1 << 20
# Least precision a threshold gives on the rows it is calibrated with, and the threshold without any.
PRECISION, THRESHOLD = 0.95, 0.5


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = digits.substr(n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _iban(value: Column) -> Column:
    """Remainder check of an account number: letters count from 10, the first four characters go last."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(plain.substr(F.lit(5), F.length(plain)), plain.substr(F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        c = turned.substr(i, F.lit(1))
        return F.when(c.rlike("[0-9]"), (rest * 10 + c.cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _octets(value: Column) -> Column:
    return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.(?=[0-9])|$)){4}$")


def valid(kind: str, m: Column) -> Column:
    """Whether a match of a base pattern is one of its kind."""
    n = F.length(m["digits"])
    if kind == "ip":
        return _octets(m["value"])
    if kind == "card":
        return F.when(n.between(*CARD), luhn(m["digits"])).otherwise(False)
    return n.between(*PHONE) if kind == "phone" else F.lit(True)


def _power(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), k)


def _running(values: Column, join) -> Column:
    """Values of an array combined with all before them, in doubling steps."""
    steps = F.sequence(F.lit(0), F.length(F.bin(F.size(values))))
    return F.aggregate(steps, values, lambda a, k: F.transform(
        a, lambda x, i: F.when(i >= _power(k), join(x, F.get(a, i - _power(k)))).otherwise(x)))


def matches(rows: DataFrame, text: str, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """``rows`` with an array (value, start, end, before, after) per named (pattern, guard), in code points.

    A pattern is tried only where its guard holds. Starts come from the lengths of the gaps between matches.
    """
    none = F.array().cast("array<string>")
    rows = rows.withColumns({f"_m_{c}": F.when(guard, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none)
                             for c, (p, guard) in patterns.items()})
    rows = rows.withColumns({f"_g_{c}": F.when(F.size(f"_m_{c}") > 0, F.split(text, p, -1)).otherwise(none)
                             for c, (p, _) in patterns.items()})

    def ends(c: str) -> Column:
        sizes = F.transform(f"_m_{c}", lambda m, i: (F.length(m) + F.length(F.get(f"_g_{c}", i))).cast("long"))
        return _running(sizes, lambda x, y: x + y)

    def found(c: str) -> Column:
        gaps, end = F.col(f"_g_{c}"), F.col(f"_e_{c}")
        return F.transform(f"_m_{c}", lambda m, i: F.struct(
            m.alias("value"), _digits(m).alias("digits"), (F.get(end, i) - F.length(m)).alias("start"), F.get(end, i).alias("end"),
            F.right(F.get(gaps, i), F.lit(BEFORE)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(AFTER)).alias("after")))

    rows = rows.withColumns({f"_e_{c}": ends(c) for c in patterns})
    made = {c: found(c) for c in patterns}
    return rows.withColumns(made).drop(*[f"_{x}_{c}" for x in "mge" for c in patterns])


def _edge(c: Column) -> Column:
    """Class of the character next to a candidate: none or space, letter or digit, quote or bracket, other."""
    return F.when(c.rlike(r"^\s?$"), 0).when(c.rlike(r"^[A-Za-z0-9]$"), 1).when(c.rlike(r"""^["'()<>\[\]{}]$"""), 2).otherwise(3)


def features(kind: str, m: Column) -> dict[str, Column]:
    """Levels of format and context of a candidate."""
    family = kind.removesuffix("_more")
    digits = m["digits"]
    n = F.length(digits)
    check = {
        "email": m["value"].rlike(r"[A-Za-z]{2,24}$"),
        "ip": F.when(m["value"].contains("."), _octets(m["value"])).otherwise(n > 2),
        "card": F.when(n.between(13, 19), luhn(digits)).otherwise(False),
        "phone": n.between(*PHONE),
        "id": F.when(m["value"].rlike("^[0-9]"), ~m["value"].rlike(r"^(?:000|666|9)|-00-|-0000$")).otherwise(_iban(m["value"])),
        "number": F.lit(False),
    }[family]
    bins = [7, 8, 10, 12, 13, 16, 17, 20]
    different = F.size(F.array_distinct(F.split(digits.substr(F.lit(1), F.lit(64)), "")))
    at = {
        "family": F.lit([*KINDS, "id", "number"].index(family)),
        "digits": reduce(lambda a, b: a + F.when(n >= b, 1).otherwise(0), bins, F.lit(0)),
        "marks": F.least(F.length(F.regexp_replace(m["value"], "[A-Za-z0-9]", "")), F.lit(4)),
        "check": F.coalesce(check, F.lit(False)),
        "at": F.when(m["value"].contains("@"), 1).when(m["value"].rlike(r"(?i)\bat\b"), 2).otherwise(0),
        "plus": m["value"].rlike(r"^(?:\+|00)"),
        "left": _edge(F.right(m["before"], F.lit(1))),
        "right": _edge(F.left(m["after"], F.lit(1))),
        "word": m["before"].rlike(WORDS_BEFORE),
        "variety": F.when(different < 3, 0).when(different < 6, 1).otherwise(2),
    }
    return {name: at[name].cast("int") for name in FEATURES}


def propose(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` (kind, start, end of the base spans) and ``proposed``, the candidates with their features.

    A candidate's ``label`` is 1 if it is a base span, 0 if it is what a base pattern matched and its check refused, or a
    number of no kind apart from every base span, and null if nothing is known.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    digit, colons = F.col("_text").rlike("[0-9]"), F.col("_text").contains(":")
    at = F.col("_text").contains("@") | F.col("_text").rlike(r"(?i)\bat[\])} ]")
    guards = {"email": F.col("_text").contains("@"), "phone": digit & F.col("_text").contains("+"), "ip": digit, "card": digit,
              "email_more": at, "ip_more": colons, "phone_more": digit, "card_more": digit, "id_more": digit, "number": digit}
    patterns = {f"_base_{k}": (BASE[k], guards[k]) for k in KINDS}
    patterns |= {f"_more_{j}": (p, guards[k]) for j, (k, p) in enumerate(MORE)}
    rows = matches(docs.withColumn("_text", body), "_text", patterns)

    def place(kind: str, m: Column) -> list[Column]:
        return [F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")]

    def checked(kind: str) -> Column:
        return F.transform(f"_base_{kind}", lambda m: m.withField("valid", valid(kind, m)))

    def base_spans(kind: str) -> Column:
        return F.transform(F.filter(f"_base_{kind}", lambda m: m["valid"]), lambda m: F.struct(*place(kind, m)))

    def candidates(column: str, kind: str, gen: int, label) -> Column:
        return F.transform(column, lambda m: F.struct(
            *place(kind, m), F.lit(gen).alias("gen"), label(m).cast("int").alias("label"),
            F.pmod(F.xxhash64(m["value"]), F.lit(5)).cast("int").alias("fold"), *[v.alias(c) for c, v in features(kind, m).items()]))

    rows = rows.withColumns({f"_base_{k}": checked(k) for k in KINDS})
    base = F.concat(*[base_spans(k) for k in KINDS])
    lists = [candidates(f"_base_{k}", k, -1, lambda m: m["valid"]) for k in KINDS]
    lists += [candidates(f"_more_{j}", k, j, lambda m, k=k: F.lit(0 if k == "number" else None)) for j, (k, _) in enumerate(MORE)]
    rows = rows.withColumns({"base": base, "proposed": F.concat(*lists)})
    # Base spans by start, and the greatest end up to each of them. Columns of their own: each is made once per row.
    rows = rows.withColumn("_known", F.array_sort(F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end")))))
    rows = rows.withColumn("_reach", _running(F.transform("_known", lambda b: b["end"]), lambda x, y: F.greatest(x, y)))

    def free(s: Column) -> Column:
        # How many base spans begin before the candidate's end, by halving steps; the greatest end among them decides.
        steps = F.sequence(F.length(F.bin(F.size("_known"))), F.lit(0), F.lit(-1))
        begun = F.aggregate(steps, F.lit(0), lambda lo, k: F.when(
            (lo + _power(k) <= F.size("_known")) & (F.get("_known", lo + _power(k) - 1)["start"] < s["end"]), lo + _power(k)).otherwise(lo))
        return F.coalesce(F.get("_reach", begun - 1) <= s["start"], F.lit(True))

    rows = rows.withColumn("proposed", F.transform("proposed", lambda s: s.withField("free", free(s))))
    unknown = F.lit(None).cast("int")
    made = rows.withColumn("proposed", F.transform("proposed", lambda s: s.withField(
        "label", F.when((s["kind"] == "number") & ~s["free"], unknown).otherwise(s["label"]))))
    return made.select(*[F.col(f"`{c}`") for c in keep_columns(docs, "base", "proposed")], "base", "proposed")


@dataclass
class Trees:
    """Boosted trees over the feature levels: each is (feature, level, left, right) or a leaf value; and thresholds."""

    bias: float = 0.0
    trees: list = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)

    def margin(self, of) -> Column:
        """Log odds of a candidate; ``of`` gives a feature's column."""
        def walk(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            name, level, left, right = node
            return F.when(of(name) <= level, walk(left)).otherwise(walk(right))

        return reduce(lambda a, b: a + b, [walk(t) for t in self.trees], F.lit(float(self.bias)))

    def score(self, of) -> Column:
        return 1.0 / (1.0 + F.exp(-self.margin(of)))


def _leaf_number(tree, of, at: int = 1) -> Column:
    """Number of the leaf a candidate falls into: the children of node i are 2i and 2i + 1."""
    if not isinstance(tree, tuple):
        return F.lit(at)
    name, level, left, right = tree
    return F.when(of(name) <= level, _leaf_number(left, of, 2 * at)).otherwise(_leaf_number(right, of, 2 * at + 1))


def _grown(tree, splits: dict[int, tuple], at: int = 1):
    if isinstance(tree, tuple):
        name, level, left, right = tree
        return name, level, _grown(left, splits, 2 * at), _grown(right, splits, 2 * at + 1)
    return splits.get(at, tree)


def fit(proposed: DataFrame, trees: int = TREES, depth: int = DEPTH, precision: float = PRECISION) -> Trees:
    """Boosted trees from all labelled candidates of ``proposed`` (column ``proposed``), and a threshold per family.

    Candidates with equal features and label are one row with a weight, so every round works on a table whose size the
    features' levels bound. A round adds up gradients by (node, feature, level), and only those sums reach the driver: at
    most 2**depth nodes. A fifth of the candidates, by hash of the text they hold, sets the thresholds and is not fitted.
    Without labels of both kinds there are no trees and nothing is chosen beyond the base spans.
    """
    names = list(FEATURES)
    rows = proposed.select(F.explode("proposed").alias("c")).filter("c.label IS NOT NULL")
    rows = rows.groupBy(*[F.col(f"c.{x}").alias(x) for x in names], F.col("c.label").alias("label"), (F.col("c.fold") == 0).alias("held"))
    cells = settle(rows.agg(F.count("*").alias("weight")), "cells").coalesce(8)
    fitted = cells.filter("NOT held")
    n, good = fitted.agg(F.sum("weight"), F.sum(F.col("weight") * F.col("label"))).first()
    if not n or not good or good == n:
        return Trees()
    model = Trees(bias=math.log(good / (n - good)))
    of = F.col
    for _ in range(trees):
        chance = model.score(of)
        grain = lambda c: F.round(c * F.col("weight") * GRAIN).cast("decimal(38,0)")
        rows = fitted.select(*names, grain(F.col("label") - chance).alias("g"), grain(chance * (1.0 - chance)).alias("h"))
        tree, open_nodes = 0.0, {1}
        for _ in range(depth):
            spots = F.array(*[F.struct(F.lit(j).alias("j"), F.col(x).alias("level")) for j, x in enumerate(names)])
            sums = rows.select(_leaf_number(tree, of).alias("node"), F.explode(spots).alias("s"), "g", "h")
            sums = sums.groupBy("node", "s.j", "s.level").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            splits = {}
            for node in open_nodes:
                table = {(r.j, r.level): (int(r.g) / GRAIN, int(r.h) / GRAIN) for r in sums if r.node == node}
                splits[node] = _split(table)
            splits = {k: v for k, v in splits.items() if v is not None}
            tree = _grown(tree, splits)
            open_nodes = {c for k, v in splits.items() if isinstance(v, tuple) for c in (2 * k, 2 * k + 1)}
            if not open_nodes:
                break
        model.trees.append(tree)
    score = F.round(model.score(of), 4).alias("score")
    held = cells.filter("held").groupBy("family", score).agg(
        F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("good")).collect()
    for family in {r.family for r in held}:
        model.thresholds[family] = _threshold([(r.score, r.n, r.good) for r in held if r.family == family], precision)
    return model


def _split(table: dict[tuple[int, int], tuple[float, float]]):
    """Best (feature, level, left value, right value) of a node from the sums of its levels; None if none gains."""
    best, found = 1e-6, None
    total = [sum(v[i] for (j, _), v in table.items() if j == 0) for i in (0, 1)]
    worth = lambda g, h: g * g / (h + RIDGE)
    for j, name in enumerate(FEATURES):
        g = h = 0.0
        levels = sorted(level for (k, level) in table if k == j)
        for level in levels[:-1]:
            g, h = g + table[j, level][0], h + table[j, level][1]
            gain = worth(g, h) + worth(total[0] - g, total[1] - h) - worth(*total)
            if gain > best:
                best = gain
                found = (name, level, RATE * g / (h + RIDGE), RATE * (total[0] - g) / (total[1] - h + RIDGE))
    return found


def _threshold(rows: list[tuple[float, int, int]], precision: float) -> float:
    """Least score from which on the rows (score, n, good) keep the precision, but never below ``THRESHOLD``."""
    n = good = 0
    best = None
    for score, k, right in sorted(rows, reverse=True):
        n, good = n + k, good + right
        if good >= precision * n:
            best = score
    if best is None:  # not even the highest scores are precise
        return 1.0 if rows else THRESHOLD
    return max(THRESHOLD, best - 0.00005)


def choose(found: DataFrame, model: Trees, name: str) -> DataFrame:
    """``found`` with ``name``: base spans, and candidates above their family's threshold that touch none and that no better
    one overlaps. Better is a higher score, then more characters, then an earlier start, then an earlier generator.
    """
    if not model.trees:
        return found.withColumn(name, _by_kind(F.col("base")))

    def passes(s: Column) -> Column:
        least = F.lit(THRESHOLD)
        for family, value in sorted(model.thresholds.items()):
            least = F.when(s["family"] == family, value).otherwise(least)
        return s["kind"].isin(*ADDED) & s["free"] & (s["score"] >= least)

    def rank(s: Column) -> Column:
        return F.struct(s["score"], s["end"] - s["start"], -s["start"], -s["gen"])

    def best(s: Column, i: Column) -> Column:
        around = F.slice("_passed", F.greatest(i - NEAR, F.lit(0)) + 1, F.lit(2 * NEAR + 1))
        return ~F.exists(around, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]) & (rank(o) > rank(s)))

    scored = F.transform("proposed", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["gen"].alias("gen"), s["kind"].alias("kind"), s["family"].alias("family"),
        s["free"].alias("free"), F.round(model.score(lambda c: s[c]), 9).alias("score")))
    rows = found.withColumn("_passed", F.array_sort(F.filter(scored, passes)))
    kept = F.transform(F.filter("_passed", best), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.withColumn(name, _by_kind(F.concat("base", kept))).drop("_passed")


def _by_kind(spans: Column) -> Column:
    """Spans by kind as listed, then start."""
    listed = F.array(*[F.lit(k) for k in (*KINDS, *ADDED)])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(
        F.array_position(listed, s["kind"]).alias("order"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def scan(docs: DataFrame, model: Trees | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``personal``: (kind, start, end) of personal data, in code points, end exclusive.

    ``email``, ``ip``, ``card`` and ``phone`` are the base patterns with their checks, leftmost and apart per kind. Kinds
    in ``ADDED`` are further candidates (spelled-out addresses, IPv6, numbers inside longer runs, national phone numbers,
    identity and account numbers) that the ``model``'s trees score above a calibrated threshold; without ``model`` it is
    fitted on ``docs``. Added spans touch no base span and no better added one.

    Whole texts are read by built-in functions; null and empty texts have no spans. Repeated rows are scanned alike. No
    rows give no rows. A column ``personal`` is replaced, columns ``base`` and ``proposed`` are left out, others stay.
    """
    found = propose(docs, text)
    model = fit(found) if model is None else model
    made = choose(found, model, "personal")
    return made.select(*[F.col(f"`{c}`") for c in keep_columns(docs, "personal", "base", "proposed")], "personal")


def redact(found: DataFrame, text: str = "text", spans: str = "personal") -> DataFrame:
    """``found`` with ``redacted``: the text with each span, or run of touching ones, replaced by its first kind in brackets.

    Texts are cut into blocks first, so a span is reached without walking the text. Null texts are empty.
    """
    size = 4096
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    rows = found.withColumns({"_blocks": F.regexp_extract_all(body, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0)), "_spans": ordered})
    rows = rows.withColumn("_reach", _running(F.transform("_spans", lambda s: s["end"]), lambda x, y: F.greatest(x, y)))

    def piece(a: Column, b: Column) -> Column:
        first = F.floor(a / size).cast("int")
        held = F.array_join(F.slice("_blocks", first + 1, F.greatest(F.ceil(b / size).cast("int") - first, F.lit(0))), "")
        return held.substr((a - F.lit(size) * first + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))

    def shown(s: Column, i: Column) -> Column:
        before = F.coalesce(F.get("_reach", i - 1), F.lit(0))
        return F.when((i > 0) & (s["start"] < before), "").otherwise(F.concat(piece(before, s["start"]), F.lit("["), s["kind"], F.lit("]")))

    last = F.coalesce(F.array_max("_reach"), F.lit(0))
    whole = F.concat(F.array_join(F.transform("_spans", shown), ""), piece(last, F.length(body).cast("long")))
    return rows.select(*[F.col(f"`{c}`") for c in keep_columns(found, "redacted")], whole.alias("redacted"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    # Spans and candidates are written once, so texts are read once for fitting and choosing.
    found = settle(propose(docs).select("doc_id", "base", "proposed"), "proposed")
    made = choose(found, fit(found), "spans")

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return made.select("doc_id", *[count(k) for k in KINDS], F.sha2(listed(_by_kind(F.col("base"))).cast("binary"), 256).alias("base_sha256"),
                       listed(F.col("spans")).alias("spans"), *[count(k) for k in ADDED])
