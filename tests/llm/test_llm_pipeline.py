"""The stages of the pipeline on rows that are easily lost, and the whole of it by hand."""

import itertools
import random
import re

import pytest

import corpus_pipeline
from opsmetrics.llm import decontamination, mixing, near_dedup, secret_scan

CLASHING = ("doc_id bigint, text string, source string, lang string, _hit bigint, _kept_id string, "
            "_key double, `_row` int, `class` string")


def prose(seed, words=60):
    rng = random.Random(seed)
    return " ".join(f"v{rng.randrange(400)}" for _ in range(words))


def clashing(rows):
    return [(i, t, "s", "en", 7, "k", 0.25, 3, "c") for i, t in rows]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").encode().lower().decode())
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def survivors(rows):
    """One row of each component of distinct (id, text), the smallest id, nulls last."""
    empty = [r for r in rows if not shingles(r[1])]
    texts = sorted({r for r in rows if shingles(r[1])}, key=str)
    part = list(range(len(texts)))
    for _ in texts:
        for a, b in itertools.combinations(range(len(texts)), 2):
            x, y = shingles(texts[a][1]), shingles(texts[b][1])
            if 100 * len(x & y) >= 80 * len(x | y):
                part[a] = part[b] = min(part[a], part[b])
    groups = {}
    for p, row in zip(part, texts):
        groups.setdefault(p, []).append(row)
    return empty, groups.values()


@pytest.fixture(scope="module")
def rows():
    words = prose(1).split()
    near = " ".join(words[:-1] + ["other"])
    return [(None, prose(2)), (None, prose(3)), (1, prose(4)), (1, prose(5)), (2, None), (2, prose(6)),
            (8, " ".join(words)), (7, near), (None, " ".join(words)), (9, ""), (9, ""), (None, None),
            (10, prose(10)), (10, prose(10)), (11, " \n\t "), (12, "two words")]


def test_only_near_duplicates_are_dropped(spark, rows):
    docs = spark.createDataFrame(clashing(rows), CLASHING)
    found = near_dedup.drop_near_duplicates(docs)
    assert found.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in found.collect()]
    empty, groups = survivors(rows)
    assert sorted(kept, key=str) == sorted(
        empty + [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups], key=str)
    assert (7, rows[7][1]) in kept and len(kept) == 13
    assert all((r._hit, r._kept_id, r._key, r["class"]) == (7, "k", 0.25, "c")
               for r in found.collect())
    assert near_dedup.drop_near_duplicates(docs.limit(0)).count() == 0


def test_clashing_names_come_back_as_they_were(spark, rows):
    docs = spark.createDataFrame(clashing(rows), CLASHING)
    item = " ".join(f"w{i}" for i in range(40))
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    extra = spark.createDataFrame(clashing([(50, f"so {item} it is")]), CLASHING)
    clean = decontamination.drop_contaminated(docs.union(extra), bench)
    assert sorted(clean.collect(), key=str) == sorted(docs.collect(), key=str)
    mixed = mixing.mix(docs, [3, 1, 2])
    assert mixed.columns == [*docs.columns, "size", "source_size", "target", "taken"]
    assert sorted(mixed.select(docs.columns).collect(), key=str) == sorted(docs.collect(), key=str)


def test_all_stages_keep_clean_rows(spark, tmp_path, rows):
    """No labels, so nothing is toxic: what is gone are near copies, the contaminated row, and
    rows the mix takes nothing of."""
    item = " ".join(f"w{i}" for i in range(40))
    every = rows + [(50, f"so {item} it is")]
    tables = {"documents": spark.createDataFrame(clashing(every), CLASHING),
              "labels": spark.createDataFrame([], "doc_id bigint, quality int, toxic int"),
              "benchmark": spark.createDataFrame([(1, item)], "item_id bigint, text string")}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    _, groups = survivors(rows)
    assert sorted(((r.doc_id, r.text) for r in found), key=str) == sorted(
        (min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups), key=str)
    assert all(r.taken > 0 and (r._hit, r._key) == (7, 0.25) for r in found)
    for name in ("documents",):
        tables[name].limit(0).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_secret_stage_learns_from_every_row_with_a_text(spark, rows, monkeypatch):
    docs = spark.createDataFrame(clashing(rows), CLASHING)
    seen, findings = spark.sparkContext.accumulator(0), secret_scan._findings

    def counted(batches):
        def each():
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch
        yield from findings(each())

    monkeypatch.setattr(secret_scan, "_findings", counted)
    assert corpus_pipeline.redact_secrets(spark, docs, "").count() == len(rows)
    assert seen.value == sum(t is not None for _, t in rows)
