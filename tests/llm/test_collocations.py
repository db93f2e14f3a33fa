"""Collocations against counts of all phrases in memory."""

import random
import re
from collections import Counter, defaultdict

import pytest

from placetime.llm.collocations import collocations


def brute(rows, min_count, top):
    pieces, n, out = defaultdict(list), Counter(), []
    for lang, text in rows:
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            if words := re.findall(r"[^\x20\x09]+", piece):
                pieces[lang or "und"].append(words)
                n[lang or "und"] += len(words)
    for lang, own in pieces.items():
        f = Counter(tuple(w[i : i + m]) for w in own for m in range(1, 6) for i in range(len(w) - m + 1))
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        inside = {p[i : i + m] for p, a in candidates.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if a >= f[p[i : i + m]]}
        found = []
        for p, a in candidates.items():
            if p not in inside:
                score, cut = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def run(spark, rows, min_count, top, **more):
    docs = spark.createDataFrame([(lang, text) for lang, text in rows], "lang string, text string")
    docs = docs.selectExpr("*", "1 as h", "'w' as word", "2 as n", "3 as f", "4 as phrase", "5 as score", "6 as h1").repartition(3)
    return sorted(tuple(r) for r in collocations(docs, min_count, top, **more).collect())


def sample(rng, docs, letters, passages=()):
    marks = [" ", " ", " ", " ", "\t", ", ", ".\n", "  "]
    rows = []
    for _ in range(docs):
        # Few letters are frequent, the others rarer and rarer.
        words = [rng.choice(letters[: 1 + int(len(letters) * rng.random() ** 3)]) for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice(marks) for w in words)
        if passages and rng.random() < 0.5:
            text += rng.choice(passages)
        rows.append((rng.choice(["en", "en", "en", "dé", None]), text))
    return rows


LETTERS = [*"abcdefgh", "É", "é", "Ab", "ab", "x-y", "don't", "日本", *(f"w{i}" for i in range(25))]


@pytest.mark.parametrize(("top", "share"), [(5, 8), (100_000, 8), (10, 100)])
def test_against_all_counts(spark, top, share):
    rng = random.Random(top)
    rows = sample(rng, 150, LETTERS, ["one two three four five six seven", "w3 w24 w20 rare thing", "a a a a a a"])
    assert run(spark, rows, 8, top, share=share) == brute(rows, 8, top)


def test_ties_at_the_last_rank(spark):
    passages = [" ".join(f"p{k}{i}" for i in range(3)) for k in range(12)]
    rows = [("en", p) for p in passages for _ in range(10)] + [("en", "z y x " * 40)]
    got = run(spark, rows, 10, 5)
    assert got == brute(rows, 10, 5) and len({r[-1] for r in got}) == 1


def test_pieces_overlaps_and_repeats(spark):
    rows = [("en", "A a A a a. a\na a!a a"), ("en", None), ("en", ""), (None, "x y"), ("und", "x y, x y"), ("en", " \t\n.,")]
    assert run(spark, rows, 1, 100) == brute(rows, 1, 100)
    assert run(spark, rows * 3, 3, 100) == brute(rows * 3, 3, 100)


def test_a_long_text(spark):
    text = "one two three, " * 100_000 + "four five six " * 1000
    assert run(spark, [("en", text)], 100, 50) == brute([("en", text)], 100, 50)


def test_products_beyond_64_bits(spark):
    """The score of 1000 a n is exact in decimals; the bound too."""
    rows = [("en", "q r " * 30 + "s " * 3000)] * 3
    assert run(spark, rows, 30, 10) == brute(rows, 30, 10)


def test_nothing_frequent_and_nothing_at_all(spark):
    assert run(spark, [("en", "a b c")], 100, 10) == []
    assert run(spark, [], 100, 10) == []
