"""Spelling variants and the n-gram join on small tables: brute force, and awkward rows."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from opsmetrics.llm import shingle_join, spelling

DOCS = "doc_id bigint, text string, word string, `class` string, n string"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ODD = [(1, None, None, None, None), (2, "", "a", "x", "x"), (3, "one", "a", "x", "x"),
       (3, "one", "a", None, "x"), (None, "a b c d e f", "b", "", None), (4, LONG, "b", "", "y"),
       (5, " \n\t ", "c", "", "y"), (3, "another text under the same number", "c", "", "y"),
       (6, "a b c d e f", "c", "", "y")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def prose(seed, words=60, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"v{rng.randrange(vocabulary)}" for _ in range(words))


def sets_of(texts, size):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = {}
    for i, text in texts.items():
        w = word.findall((text or "").encode().lower().decode())
        sets[i] = {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    return sets


def components(texts, size, percent):
    sets = sets_of(texts, size)
    least = {i: i for i in sets}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return {i: (len(sets[i]), least[i]) for i in sets}


def edited(words, edits, rng):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(9)}"
    return words[:rng.randrange(len(words) - 12, len(words) + 1)]


@pytest.mark.parametrize("size, percent, block", [(5, 80, 1024), (3, 85, 4), (2, 60, 7)])
def test_links_match_brute_force(spark, size, percent, block):
    """Variants of a few originals, and one passage in front of many different texts."""
    rng = random.Random(size)
    texts = {}
    for base in range(4):
        words = prose(base, 40 + 40 * base).split()
        for _ in range(40):
            texts[base * 1000 + rng.randrange(900)] = " ".join(
                edited(words, rng.randrange(8), rng))
    passage = prose(77, 60)
    texts |= {7000 + k: f"{passage} {prose(200 + k, rng.randrange(4, 40))}" for k in range(60)}
    texts |= {5000 + k: prose(100 + k) for k in range(10)} | {6000: "", 6001: None, 6002: "a b",
                                                             6003: "A  B", 6004: "a b c"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    found = shingle_join.linked_documents(rows, size, percent, block).collect()
    assert len(found) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == components(
        texts, size, percent)


def test_links_beside_a_hub_in_many_tiles(spark):
    """A star whose hub links few of its group: the rest is found tile by tile."""
    rng = random.Random(8)
    words = prose(3, 120).split()
    texts = {k: " ".join(edited(words, 3 + k % 9, rng)) for k in range(150)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = shingle_join.linked_documents(rows, 5, 80, 8).collect()
    expected = components(texts, 5, 80)
    assert len({c for _, c in expected.values()}) > 20
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected


def test_links_of_odd_rows(odd, none):
    found = sorted(((r.doc_id, r.n_shingles, r.component_id)
                    for r in shingle_join.linked_documents(odd).collect()), key=str)
    assert found == sorted([(1, 0, 1), (2, 0, 2), (3, 1, 3), (3, 1, 3), (None, 2, None),
                            (4, 977, 4), (5, 0, 5), (3, 2, 3), (6, 2, 6)], key=str)
    assert shingle_join.linked_documents(none).count() == 0


def test_prefixes_and_signatures_never_lose_a_link():
    rng = np.random.default_rng(4)
    for _ in range(300):
        percent = int(rng.integers(50, 96))
        pool = rng.integers(0, 2**63, 400).astype(np.uint64)
        x = np.unique(rng.choice(pool, rng.integers(1, 200), False))
        kept = x[rng.random(len(x)) < 0.9]
        y = np.unique(np.concatenate([kept, rng.choice(pool, rng.integers(1, 20), False)]))
        frequent = np.unique(rng.choice(pool, 100, False))
        numbers = rng.integers(3, 9, len(frequent))
        common = len(np.intersect1d(x, y))
        apart = len(x) + len(y) - 2 * common
        a, b = (shingle_join.signature(s, shingle_join.width_of(len(s), percent)) for s in (x, y))
        size = min(len(a), len(b))
        bits = (int.from_bytes(shingle_join.folded(a, size))
                ^ int.from_bytes(shingle_join.folded(b, size))).bit_count()
        assert bits <= apart
        linked = 100 * common >= percent * (len(x) + len(y) - common)
        assert linked == shingle_join._within(apart, len(x) + len(y), percent)
        if linked:
            first = [shingle_join.first_shingles(s, percent, frequent, numbers) for s in (x, y)]
            assert len(np.intersect1d(*first))


def brute_words(docs, shortest, least, every):
    total = Counter()
    for name, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.encode().lower().decode()
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= shortest and n >= least}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(words):
    rows = {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 2 * n else None
        rows[w] = [form, n, len(near), words[form] if form else None]
    for w, row in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        row.insert(1, root)
    return {w: tuple(r) for w, r in rows.items()}


def variants(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n)
            for r in spelling.spelling_variants(df).collect()}


@pytest.mark.parametrize("letters, lengths, seed", [("ab", (5, 8), 1), ("abé×", (5, 7), 2),
                                                    ("abcdefgh", (5, 6), 3)])
def test_variants_match_brute_force(spark, letters, lengths, seed):
    """Few letters: grams repeat within words, ties and long chains are common."""
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(*lengths))):
             3 * 2 ** rng.randrange(6) for _ in range(400)}
    rows = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert variants(rows) == brute_variants(words)


def test_words_match_brute_force(spark, odd):
    rng = random.Random(5)
    names = [f"{a}{b}{c}" for a in ("Re", "pré", "un") for b in ("turn", "Load", "straß")
             for c in ("", "s", "ED")]
    docs = [(rng.choice([None, *range(-5, 40)]),
             " ".join(rng.choice(names) + rng.choice(["", ".", "9", "'s"]) for _ in range(80)))
            for _ in range(60)]
    rows = spark.createDataFrame(docs + docs[:3] + [(7, None), (8, "")],
                                 "doc_id bigint, text string")
    found = {r.word: r.n for r in spelling.word_counts(rows, 5, 3, 7).collect()}
    assert found == brute_words(docs + docs[:3], 5, 3, 7) and len(found) > 30
    assert variants(spelling.word_counts(rows, 5, 3, 7)) == brute_variants(found)
    assert {r.word for r in spelling.word_counts(odd, 5, 1).collect()} <= {
        "another", "under", "number", "anoter"} | {
        w[:i] + w[i + 1:] for w in ("another", "number") for i in range(7)}


def test_no_words(spark, none):
    assert spelling.word_counts(none).count() == 0
    assert spelling.spelling_variants(spelling.word_counts(none)).count() == 0


def test_pivots_are_disjoint_and_rarest():
    rng = random.Random(2)
    for _ in range(300):
        places = sorted(rng.sample(range(12), rng.randint(3, 8)))
        grams = [(p, rng.randrange(1, 9)) for p in places]
        a, b = spelling.pivots(grams)
        cost = dict(grams)
        best = min(cost[x] + cost[y] for x, y in itertools.combinations(places, 2) if y - x >= 2)
        assert b - a >= 2 and cost[a] + cost[b] == best


@pytest.mark.parametrize("n", [64, 100, 127, 300, 1000, 5000])
def test_signatures_are_short_and_tell_sets_apart(n):
    """A few bits a shingle, of which strangers differ in more than a link allows, and sets as
    similar as a link asks in no more."""
    random.seed(n)
    width = shingle_join.width_of(n, 80)
    assert n <= width < 2.6 * n
    hashes = np.array([random.getrandbits(64) for _ in range(2 * n)], np.uint64)

    def apart(a, b):
        signs = (shingle_join.signature(np.sort(x), width) for x in (a, b))
        return sum(bin(x ^ y).count("1") for x, y in zip(*signs))

    assert not shingle_join._within(apart(hashes[:n], hashes[n:]), 2 * n, 80)
    near = n // 10
    assert shingle_join._within(apart(hashes[:n], hashes[near:n + near]), 2 * n, 80)
