"""Words, shingles and features of texts against plain Python."""

import re

import numpy as np
import pyarrow as pa
import pytest

from opsmetrics.llm import text as T

TEXTS = ["", "one", "One  two\tthree\nfour", " \n ", "éa b\x0bc d e", "x" * 5000,
         "a b c a b c a b c", " kept with words", "🙂 a 🙂 b"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def test_words_match_the_pattern():
    hashes, number = T.words(TEXTS)
    expected = [(w, i) for i, t in enumerate(TEXTS) for w in WORD.findall(lowered(t))]
    assert number.tolist() == [i for _, i in expected]
    by_word = {}
    for (word, _), value in zip(expected, hashes.tolist()):
        assert by_word.setdefault(word, value) == value
    assert len(set(by_word.values())) == len(by_word)


@pytest.mark.parametrize("size", [1, 3, 5])
def test_shingles_are_distinct_word_runs(size):
    for text, found in zip(TEXTS, T.shingle_sets(TEXTS, size)):
        words = WORD.findall(lowered(text))
        runs = {tuple(words[i:i + size]) for i in range(max(len(words) - size + 1, 1))}
        assert len(found) == (len(runs) if words else 0)
        assert (np.diff(found.astype(object)) > 0).all()


def test_equal_sets_have_equal_hashes_whatever_the_order():
    a, b, c = T.shingle_sets(["a b c d a b c", "d a b c d", "d a b c x"], 3)
    assert set(b.tolist()) <= set(a.tolist())
    assert not set(c.tolist()) <= set(a.tolist())


def test_slices_are_bounded_and_whole():
    batch = pa.RecordBatch.from_pydict({"text": ["ab", None, "", "x" * 50, "cd"], "n": range(5)})
    parts = list(T.slices([batch], chars=10))
    assert sum((p.column("n").to_pylist() for p in parts), []) == list(range(5))
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= 10
               for p in parts)
    assert list(T.slices([batch.slice(0, 0)])) == []
