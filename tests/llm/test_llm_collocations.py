"""Phrases by best-first growth against a plain count of everything."""

import random
import re
from collections import Counter

import pytest

from opsmetrics.llm import collocations

DOCS = "text string, lang string, n bigint, word string, `limit` int"


def brute(rows, top, least, percent):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").encode().lower().decode()):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    counts[lang, tuple(words[i:i + size])] += 1
    long = {(lang, w): a for (lang, w), a in counts.items() if len(w) > 1 and a >= least}
    around = Counter()
    for (lang, w), a in long.items():
        if len(w) == 3:
            for part in (w[:2], w[1:]):
                around[lang, part] = max(around[lang, part], a)
    found = {}
    for (lang, w), a in long.items():
        if len(w) == 2 and 100 * around[lang, w] >= percent * a and around[lang, w]:
            continue
        cuts = [(1000000 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k)
                for k in range(1, len(w))]
        score, k = min(cuts)
        found.setdefault(lang, []).append(
            (-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    return sorted((lang, rank, phrase.decode(), -a, left, right, total[lang], -score)
                  for lang, rows in found.items()
                  for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1))


def phrases(df, *settings):
    return sorted(tuple(r) for r in collocations.collocations(df, *settings).collect())


def sentences(rng, number, vocabulary):
    fixed = ["new York city", "ad hoc", "vis à vis", "point of view", "of the of"]
    rows = []
    for _ in range(number):
        words = [rng.choice(fixed) if rng.random() < 0.2
                 else f"W{int(rng.paretovariate(0.8)) % vocabulary}" for _ in range(40)]
        rows.append(("".join(w + rng.choice([" ", " ", " ", "\t", " ", ". ", "\n", ",", "  "])
                             for w in words), rng.choice(["en", "en", "de", None, "und", ""])))
    return rows


@pytest.mark.parametrize("seed, top, least, percent", [
    (1, 5, 3, 50), (2, 40, 2, 50), (3, 3, 2, 10), (4, 2000, 2, 50), (5, 12, 2, 100)])
def test_phrases_match_brute_force(spark, seed, top, least, percent):
    """Small tops leave most pairs ungrown; a low share drops most pairs, so that the
    frontier has to move on."""
    rows = sentences(random.Random(seed), 150, 60)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    found = phrases(df, top, least, percent)
    assert found == brute(rows, top, least, percent) and len(found) >= 3 * min(top, 5)


def test_frontier_moves_on_until_enough_survive(spark, monkeypatch):
    """The best pairs are all dropped by longer phrases that score little themselves, so
    the first frontiers have nothing."""
    rows = [(f"a{i} b{i}" + (" z" if k < 3 else ""), "en") for i in range(200) for k in range(10)]
    rows += [(f"p{i % 20} q{i % 17}", "en") for i in range(1200)]
    waves = []
    limits = collocations._limits
    monkeypatch.setattr(collocations, "_limits",
                        lambda pairs, frontier: waves.append(frontier) or limits(pairs, frontier))
    df = spark.createDataFrame(rows, "text string, lang string")
    assert phrases(df, 70, 3, 10) == brute(rows, 70, 3, 10)
    assert len(waves) > 1


def test_products_beyond_64_bits(spark):
    frame = spark.createDataFrame([(4 * 10**9, 4 * 10**9, 5 * 10**9)], "a bigint, l bigint, r bigint")
    row = frame.selectExpr(f"{collocations._share('a', 'l', 'r')} AS s",
                           f"{collocations._share('a', 'r')} AS t").first()
    assert tuple(row) == (800_000, 800_000)


def test_odd_rows(spark):
    long = "u v w " * 30_000
    odd = [(None, None, 1, None, None), ("", "en", 1, "x", 1), (" \n\t .,", "en", 1, "x", 1),
           (long, "en", 2, "y", 2), ("A b", None, 3, "z", 3), ("A b", None, 3, "z", 3),
           ("a B c", "fr", 4, "z", 3)]
    df = spark.createDataFrame(odd, DOCS)
    assert phrases(df, 9, 2, 50) == brute([r[:2] for r in odd], 9, 2, 50)
    assert phrases(spark.createDataFrame([], DOCS)) == []
