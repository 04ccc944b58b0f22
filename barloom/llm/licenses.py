"""License scan: MinHash over overlapping text windows retrieves templates, shingle containment verifies.

Looked for are the notices below and the library (``license_library``): whole texts, notices, and lines and tags such as
"released under MIT License". A line has too few shingles for a share of them to bear a changed word, so its wordings
are phrases that are matched whole, found by their first word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import license_library
from barloom.llm.common import keep_columns, read
from barloom.llm.words import PUNCTUATION, Rolling, Words, flatten, scramble, words

# Public license notices.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "MIT line": "Released under the MIT License.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 line": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0 notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "MIT permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so"),
    "BSD conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"),
    "GPL notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation"),
}
# End of the fixed values.

SHINGLE = 5
# Least share of a template's shingles that a window must hold.
LEAST = 0.8
# Bands of one row each. A window that holds 0.8 of a template has Jaccard similarity of 0.55 or more with it
# (see ``stride``), so all bands miss it with probability 0.45 ** 14 = 1.4e-5 at most.
BANDS = 14
SALTS = scramble(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def stride(shingles: int) -> int:
    """Distance of windows for templates of so many shingles.

    Windows of shingles + stride - 1 at each multiple contain any stretch of that many shingles whole. With at most a
    quarter as stride, the union of a window and a template shared by 0.8 is at most 1.45 templates. Powers of two let
    the minima of one stride follow from those of the half.
    """
    return 1 << (max(1, shingles // 4).bit_length() - 1)


@dataclass(frozen=True)
class Template:
    name: str
    shingles: np.ndarray  # sorted, distinct
    length: int           # shingle positions


def prepare(templates: dict[str, str | list[str]]) -> list[Template]:
    """Templates of each name; a name may have several texts."""
    out = []
    for name, given in sorted(templates.items()):
        for text in [given] if isinstance(given, str) else given:
            hashes, first = shingled(pa.array([text]))
            if first[1] == 0:
                raise ValueError(f"template {name!r} has fewer than {SHINGLE} words")
            out.append(Template(name, np.unique(hashes), int(first[1])))
    return out


def library() -> dict[str, str | list[str]]:
    """All templates of the query: the fixed ones, notices and whole texts."""
    return TEMPLATES | license_library.NOTICES | license_library.texts()


@dataclass(frozen=True)
class Phrases:
    """Wordings matched whole: for each number of words the sorted hashes and the names they stand for."""

    opens: np.ndarray  # sorted hashes of first words
    by_width: dict[int, tuple[np.ndarray, list[str]]]

    @classmethod
    def of(cls, lines: dict[str, str]) -> Phrases:
        w = words(*flatten(pa.array(list(lines), pa.string())), PUNCTUATION, fold=True)
        rolling, counts = Rolling(w.hash), np.diff(w.first)
        if (counts == 0).any():
            raise ValueError("a phrase has no words")
        held: dict[int, dict[int, str]] = {}
        for h, n, name in zip(rolling(w.first[:-1], w.first[1:]).tolist(), counts.tolist(), lines.values(), strict=True):
            held.setdefault(n, {}).setdefault(h, name)
        return cls(np.unique(w.hash[w.first[:-1]]),
                   {n: (np.array(sorted(own), np.uint64), [own[h] for h in sorted(own)]) for n, own in sorted(held.items())})

    def find(self, w: Words) -> list[tuple[int, str, int, int]]:
        """(text, name, first word, word after the last); phrases inside longer ones are left out."""
        if not len(w.hash) or not len(self.opens):
            return []
        at = np.searchsorted(self.opens, w.hash)
        at = np.flatnonzero(self.opens[np.minimum(at, len(self.opens) - 1)] == w.hash)
        rolling, longest = Rolling(w.hash), {}
        doc = np.searchsorted(w.first, at, "right") - 1
        for n, (known, names) in self.by_width.items():
            fits = at + n <= w.first[doc + 1]
            start, own = at[fits], doc[fits]
            hashes = rolling(start, start + n)
            k = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            for i in np.flatnonzero(known[k] == hashes):
                longest[int(start[i])] = int(own[i]), names[k[i]], n
        out, end = [], 0
        for start, (d, name, n) in sorted(longest.items()):
            if start + n > end:
                end = start + n
                out.append((d, name, start - int(w.first[d]), end - int(w.first[d])))
        return out


def shingled(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the stretches of five words of each text, and their offsets by text.

    Words are runs of letters and digits, ASCII case folded.
    """
    return _shingles(words(*flatten(texts), PUNCTUATION, fold=True))


def _shingles(w: Words) -> tuple[np.ndarray, np.ndarray]:
    counts = np.maximum(np.diff(w.first) - SHINGLE + 1, 0)
    first = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(first[-1]) + np.repeat(w.first[:-1] - first[:-1], counts)
    return Rolling(w.hash)(at, at + SHINGLE), first


def _sliding(values: np.ndarray, stop: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` values from each place, ending before ``stop``."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        at = np.flatnonzero(np.arange(len(out)) + step < stop)
        shifted = out.copy()
        shifted[at] = np.minimum(out[at], out[at + step])
        out, have = shifted, have + step
    return out


def candidates(hashes: np.ndarray, first: np.ndarray, templates: list[Template]) -> dict[tuple[int, int], None]:
    """(window start, template number) pairs that agree in a band."""
    found: dict[tuple[int, int], None] = {}
    groups: dict[tuple[int, int], list[int]] = {}
    for k, t in enumerate(templates):
        step = stride(t.length)
        groups.setdefault((step, -(-(t.length + step - 1) // step)), []).append(k)
    counts = np.diff(first)
    levels, step = {}, 1
    while groups and step <= max(s for s, _ in groups):
        n = -(-counts // step)  # stretches of ``step`` shingles, by text
        before = np.cumsum(n) - n
        owner = np.repeat(np.arange(len(counts)), n)
        inside = np.arange(len(owner)) - before[owner]
        # Shingle at which a stretch starts, end of its text in stretches, first of its halves.
        halves = (levels[step // 2][3][owner] + 2 * inside) if step > 1 else inside
        levels[step] = first[owner] + inside * step, (before + n)[owner], halves, before
        step *= 2
    for salt in SALTS if len(hashes) and groups else ():
        low, step = {1: scramble(hashes ^ salt)}, 2
        tops = np.array([scramble(t.shingles ^ salt).min() for t in templates])
        # A window's least value is a template's only if some shingle has it: few templates are left for the slides.
        listed = np.zeros(1 << 16, bool)
        listed[tops >> np.uint64(48)] = True
        met = np.isin(tops, low[1][listed[low[1] >> np.uint64(48)]])
        alive = {size: [k for k in own if met[k]] for size, own in groups.items()}
        alive = {size: own for size, own in alive.items() if own}
        while alive and step <= max(s for s, _ in alive):
            low[step] = np.minimum.reduceat(low[step // 2], levels[step][2])
            step *= 2
        for (step, width), own in alive.items():
            starts, stop = levels[step][:2]
            least = _sliding(low[step], stop, width)
            for k in own:
                found |= dict.fromkeys((int(starts[i]), k) for i in np.flatnonzero(least == tops[k]))
    return found


def _likest(spans: list[tuple], rivals: frozenset[str]) -> list[tuple]:
    """Of rivals of one form that lie on one another by half of the shorter, the one of which most is held.

    Licenses of a family share most of their text: GPL and AGPL, BSD with two and with three clauses, versions.
    """
    kept: list[tuple] = []
    for m in sorted(spans, key=lambda m: (-m[4], -m[1], m[0], m[2])):
        others = [o for o in kept if {m[0], o[0]} <= rivals and m[0].split()[-1] == o[0].split()[-1]]
        if all(min(m[3], o[3]) - max(m[2], o[2]) < 0.5 * min(m[3] - m[2], o[3] - o[2]) for o in others):
            kept.append(m)
    return sorted(kept)


def matches(texts: pa.Array, templates: list[Template], least: float = LEAST, phrases: Phrases | None = None,
            rivals: frozenset[str] = frozenset()) -> list[list[tuple]]:
    """For each text (template, containment, first word, word after the last) of verified matches.

    Matches of one name that overlap are one, with the larger containment. Of ``rivals`` at one place the likest is given.
    """
    w = words(*flatten(texts), PUNCTUATION, fold=True)
    hashes, first = _shingles(w)
    out: list[list[tuple]] = [[] for _ in range(len(first) - 1)]
    checked: dict[tuple[int, str], list] = {}
    for doc, name, a, b in phrases.find(w) if phrases else ():
        checked.setdefault((doc, name), []).append((a, b, 1.0, 0))
    for start, k in candidates(hashes, first, templates):
        t = templates[k]
        doc = int(np.searchsorted(first, start, "right")) - 1
        step = stride(t.length)
        blocks = -(-(t.length + step - 1) // step)
        window = hashes[start:min(start + blocks * step, first[doc + 1])]
        held = np.isin(window, t.shingles)
        share = len(np.unique(window[held])) / len(t.shingles)
        if share >= least:
            at = np.flatnonzero(held)
            lo = int(start - first[doc])
            checked.setdefault((doc, t.name), []).append(
                (lo + int(at[0]), lo + int(at[-1]) + SHINGLE, share, round(share * len(t.shingles))))
    for (doc, name), spans in sorted(checked.items()):
        merged: list[list] = []
        for a, b, share, size in sorted(spans):
            if merged and a < merged[-1][1]:
                merged[-1] = [merged[-1][0], *map(max, merged[-1][1:], (b, share, size))]
            else:
                merged.append([a, b, share, size])
        out[doc] += [(name, share, a, b, size) for a, b, share, size in merged]
    return [[m[:4] for m in _likest(own, rivals)] for own in out]


FOUND = "array<struct<license:string,containment:double,first_word:bigint,end_word:bigint>>"


def scan(docs: DataFrame, text: str = "text", templates: dict[str, str | list[str]] | None = None,
         least: float = LEAST) -> DataFrame:
    """``docs`` with ``licenses``: the templates found in each whole text, with containment and place in words.

    Without ``templates``, the whole library is looked for; given ones are looked for alone. Whole texts and notices are
    compared as shingles (``LEAST`` of them held). Lines are phrases: a license line or tag is found in the wordings of
    ``license_library.lines`` and no others, without regard to case and punctuation. Of texts of one family at one place
    only the one of which most is held is reported. Null and empty texts have none. A column ``licenses`` is replaced; no rows give no rows.
    """
    ready = prepare(library() if templates is None else templates)  # under 1 MB, made by the driver
    phrases = Phrases.of(license_library.lines()) if templates is None else None
    rivals = frozenset() if templates is not None else frozenset(t.name for t in ready) - TEMPLATES.keys()

    @F.arrow_udf(FOUND)
    def run(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("license", pa.string()), ("containment", pa.float64()),
                                   ("first_word", pa.int64()), ("end_word", pa.int64())]))
        fields = ("license", "containment", "first_word", "end_word")
        return pa.array([[dict(zip(fields, m, strict=True)) for m in own]
                        for own in matches(texts, ready, least, phrases, rivals)], kind)

    return docs.select(*[F.col(f"`{c}`") for c in keep_columns(docs, "licenses")],
                       run(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("licenses"))


def query(spark, sf_dir: str) -> DataFrame:
    """One row per document and license notice found."""
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.explode_outer("licenses").alias("m")).filter("m IS NOT NULL").select("doc_id", "m.*")
