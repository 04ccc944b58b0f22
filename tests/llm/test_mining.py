"""Spelling variants, phrases and personal data."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from barloom.llm import personal, phrases, spelling
from tests.llm import fixture as X


def counted(rows, least=3, length=5):
    seen = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            if h % 97 == 0:
                low = low[:h % len(low)] + low[h % len(low) + 1:]
            seen[low] += 1
    return {w: n for w, n in seen.items() if n >= least and len(w) >= length}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants(rows, **options):
    n = counted(rows, **options)
    near = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if abs(len(a) - len(b)) < 2 and one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, found in near.items():
        top = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = top if top is not None and n[top] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def awkward_words():
    """Few letters, so boxes of equal counts are large; chains of forms; long words; all letters of the range."""
    rng = random.Random(5)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(5, 8))) for _ in range(500)}
    words |= {"".join(p) for p in set(itertools.permutations("aabbccd"))}
    words |= {"x" * 300, "x" * 301, "x" * 299 + "y", "Ÿ" * 6, "ÿéßþ×÷", "ÿéßþ×", "éßþ×÷", "ÀÀÀÀÀ"}
    rows = [(i, " ".join([w] * rng.choice((1, 3, 3, 6, 14, 40)))) for i, w in enumerate(sorted(words))]
    return rows + [(None, None), (None, ""), (3, "AAAAB-aaaab_AaAaB aaaa" + "Ā" + "bbbbb"), (3, "AAAAB-aaaab")]


def test_spelling_variants(spark):
    rows = awkward_words() + [(r[0], r[1]) for r in X.ROWS]
    want = variants(rows)
    docs = X.documents(spark, [(*r, None, None) for r in rows])
    for options in ({}, {"group": 64}, {"group": 400, "plan_words": 200}):
        got = {tuple(r) for r in spelling.variants(docs, **options).collect()}
        assert got == want, options
    trees = spelling.plan(sorted(w for w, *_ in want), 1.0, 64)
    parts = [leaf.parts for t in trees.values() for leaf in spelling.leaves(t)]
    assert max(parts) > 1 and len(parts) > 10


def test_no_words(spark):
    assert spelling.variants(X.documents(spark, [])).count() == 0
    assert spelling.variants(X.documents(spark, [(1, "once", None, None), (2, None, None, None)])).count() == 0


def collocations(rows, least=30, report=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate(str.maketrans(phrases.ASCII_UPPER, phrases.ASCII_LOWER))
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, min(4, len(w) - i) + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    inside = {}
    for (lang, w), a in found.items():
        for m in range(2, len(w)):
            for s in range(len(w) - m + 1):
                inside[lang, w[s:s + m]] = max(a, inside.get((lang, w[s:s + m]), 0))
    out = set()
    for lang in n:
        kept = []
        for (other, w), a in found.items():
            if other == lang and 100 * inside.get((lang, w), 0) < 80 * a:
                cuts = [(2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
                score, k = min(cuts)
                kept.append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:report], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


def awkward_phrases():
    rng = random.Random(9)
    vocabulary = ["aa", "Bb", "c-", "dé", "É", "x\x01", "x", "a\xa0b", "(", "z" * 600, "Z" * 600]
    rows = [(rng.choice(["en", "en", "de", None, "und"]), rng.choice(" \t").join(rng.choices(vocabulary, k=rng.randint(0, 40))))
            for _ in range(300)]
    rows += [("fr", "un deux trois quatre. " * 45), ("fr", "un deux trois;un deux trois\nquatre" * 40), ("es", "solo una vez")]
    return rows + [(None, None), ("en", ""), ("en", " .,. "), ("en", "long tail " * 3000)]


def test_collocations(spark):
    rows = awkward_phrases()
    docs = X.documents(spark, [(i, text, lang, None) for i, (lang, text) in enumerate(rows)])
    for options in ({}, {"dictionary": 0}, {"held": 50, "gathered": 40, "region": 64}, {"least": 45, "report": 7, "region": 1}):
        got = {tuple(r) for r in phrases.collocations(docs, **options).collect()}
        want = collocations(rows, options.get("least", 30), options.get("report", 2000))
        assert got == want, options
    assert phrases.collocations(X.documents(spark, [])).count() == 0
    assert phrases.collocations(X.documents(spark, [(1, "a b", None, None)])).count() == 0


def test_filter_is_lossless():
    rng = np.random.default_rng(3)
    for k, bits, region_bits in ((2, 1, 0), (2, 17, 3), (3, 5, 6), (3, 21, 2), (4, 17, 4), (4, 32, 9)):
        layout = phrases.Layout(k, bits, region_bits)
        rows = rng.integers(1, 1 << bits, (4000, k)).astype(np.uint32)
        rows = np.concatenate([rows, rows[:500], np.repeat(rows[:1], 700, axis=0)])
        made, back = phrases.Filter(layout, 300, 200), Counter()
        blocks = [b for b in made.add(*layout.scrambled(list(rows.T)))] + list(made.send())
        for batch in blocks:
            for region, block in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                hi, lo, count = phrases.decode(layout, region, block)
                for w, c in zip(layout.words(hi, lo).astype(np.uint32).tolist(), count.tolist(), strict=True):
                    back[tuple(w)] += c
        assert back == Counter(map(tuple, rows.tolist()))


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [2 * int(c) if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def awkward_personal():
    rng = random.Random(11)
    alphabet = ["1", "2", "4", "0", ".", "-", " ", "+", "@", "a", "é", "(", ")", "_", "4111111111111111", "a@b.co", "\U0001F600", "x.y",
                "255", "256", "+1 (234) 567-8901", "10.0.0.1"]
    rows = ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(700)]
    rows += ["a@b.cd_e@f.gh", "a@b", "@b.c", "a@b..c", "0010.1.1.1", "1.2.3.4.5.6.7.8", "1" * 40, "4111 1111-1111 1111", "4111  1111",
             "\U0001F600 é a@b.co", "1.2.3.4\n5", "\u0661\u0662.1.1.1", "+1+1 234567890", "x" * 500 + "@y.z"]
    return rows + [None, "", " ", *[r[1] for r in X.ROWS]]


def test_personal_base_spans(spark):
    texts = awkward_personal()
    docs = X.documents(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in personal.propose(docs).select("doc_id", "base", "proposed").collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert [tuple(s) for s in got[i].base] == want, t
        for c in got[i].proposed:
            assert c.end - c.start <= personal.REACH or c.gen < 0
            assert c.free == (not any(s < c.end and c.start < e for _, s, e in want))
    assert personal.scan(X.documents(spark, [])).count() == 0
    odd = X.documents(spark).withColumns({"base": F.lit(1), "personal": F.lit(2), "digits": F.lit(3)})
    made = personal.scan(odd, personal.Trees())
    assert made.columns == [c for c in odd.columns if c not in ("base", "personal")] + ["personal"] and made.count() == len(X.ROWS)


def test_personal_query(spark):
    docs = X.table("documents")
    got = {r.doc_id: r for r in personal.query(spark, X.SF).collect()}
    assert len(got) == len(docs)
    for doc, text in zip(docs.doc_id, docs.text, strict=True):
        spans = [f"{k}:{s}:{e}" for k, s, e in base_spans(text)]
        assert got[doc].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert got[doc].spans.split(",")[:len(spans)] == (spans or [""])[:len(spans)]
        assert got[doc].n_email == sum(s.startswith("email:") for s in spans)


def test_added_spans_and_redaction(spark):
    rng = random.Random(2)
    number = lambda n: "".join(rng.choices("0123456789", k=n))

    def card(good):
        while True:
            c = "4" + number(15)
            if luhn(c) == good:
                return c

    rows = [f"pay with {card(i % 2 == 0)} or call +1 (555) {number(3)}-{number(4)} on 2020-{number(2)}-{number(2)}" for i in range(200)]
    rows += [f"mail jo.{i}@site{i}.example.com from 10.{i}.3.4, version 3.{300 + i}.2.1 costs {number(6)}.{number(2)}" for i in range(200)]
    rows += [f"ids {i} {number(5)} and 12.{number(2)}.{number(4)}" for i in range(100)]
    pair = [card(True), card(True)]
    special = {"two": f"cards {pair[0]} {pair[1]} end", "dots": "card 4111.1111.1111.1111 end", "wrong": f"order {card(False)} end",
               "phone": "call +1 (555) 123-4567 10.20.30.40 end", "date": "on 2020-01-02 at 12:30:45 end", "none": "plain words"}
    rows += special.values()
    docs = X.documents(spark, [(i, t, None, None) for i, t in enumerate(rows)])
    model = personal.fit(personal.propose(docs))
    assert model.trees and len(model.thresholds) >= 4
    again = personal.fit(personal.propose(docs.repartition(3)))
    assert again == model
    found = personal.redact(personal.scan(docs, model)).collect()
    assert all(len(r.personal) == len({(s.start, s.end) for s in r.personal}) for r in found)
    last = dict(zip(special, found[-len(special):], strict=True))
    texts = {k: {(s.kind, r.text[s.start:s.end]) for s in r.personal} for k, r in last.items()}
    assert texts["two"] == {("card_more", pair[0]), ("card_more", pair[1])}
    assert texts["wrong"] == texts["date"] == texts["none"] == set()
    assert ("phone_more", "+1 (555) 123-4567") in texts["phone"] and ("ip", "10.20.30.40") in texts["phone"]
    assert last["two"].redacted == "cards [card_more] [card_more] end" and last["none"].redacted == "plain words"
    for r in found:
        want, at = "", 0
        for kind, s, e in sorted(((x.kind, x.start, x.end) for x in r.personal), key=lambda x: x[1:]):
            if s >= at:
                want += r.text[at:s] + f"[{kind}]"
            at = max(at, e)
        assert r.redacted == want + r.text[at:]


def test_personal_in_long_texts(spark):
    texts = {"1" * 300_000: 0, "1 " * 150_000: 0, "a" * 300_000 + "@": 0, "a@" * 150_000: 0, "1." * 150_000: 37_500, "+1" + " " * 300_000: 0,
             "a.b@c.d " * 20_000: 20_000, "é" * 300_000 + " 10.0.0.1": 1, "+1 234 567 8901, " * 10_000: 10_000}
    docs = X.documents(spark, [(i, t, None, None) for i, t in enumerate(texts)]).repartition(4)
    start = time.time()
    got = {r.doc_id: r.base for r in personal.propose(docs).select("doc_id", "base").collect()}
    assert time.time() - start < 60
    for i, (t, n) in enumerate(texts.items()):
        assert len(got[i]) == n
        assert {t[s.start:s.end] for s in got[i]} <= {"1.1.1.1", "a.b@c.d", "10.0.0.1", "+1 234 567 8901"}
