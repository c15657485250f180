"""URL rules as a sort-merge range join over reversed-host keys.

The key of a host is its labels in reverse order, each ended by a dot: `www.a.org` has
`org.a.www.`. All hosts below a rule's host are then one interval of keys, and intervals
nest or are apart. URLs and rules are dealt out by key ranges, sorted, and swept once: a
stack holds the rules whose interval is open.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsmetrics.llm.tables import materialize

ROWS_PER_RANGE = 250_000
LEAST_RANGES = 64
SAMPLED_KEYS = 20_000
_TOP = "\U0010ffff"


def url_parts(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column; empty for null or without ://."""
    has = F.coalesce(F.col(url).contains("://"), F.lit(False))
    rest = F.substr(F.col(url), F.locate("://", url) + 3)
    cut = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    host = F.substring_index(cut, "/", 1)
    path = F.substr(cut, F.length(host) + 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, lowered).otherwise(""), F.when(has, path).otherwise("")


def host_key(host: str) -> Column:
    return F.concat(F.concat_ws(".", F.reverse(F.split(F.col(host), r"\."))), F.lit("."))


def _fitting(stack: list, path: str):
    """The longest rule whose path starts the path; of equal ones the innermost host's."""
    best = None
    for _, rules in stack:
        for start, rule, verdict in rules:
            if path.startswith(start) and (best is None or len(rule) >= len(best[0])):
                best = rule, verdict
    return best


def _numbered(batches, bounds: list[str]):
    """Add the number of the range that the spread key falls into."""
    for batch in batches:
        keys = batch.column("_spread").to_pylist()
        yield batch.append_column(
            "_range", pa.array([bisect_right(bounds, k) for k in keys], pa.int32()))


def _in_ranges(batches, bounds: list[str]):
    """Repeat every rule for each range that its interval of keys touches."""
    for batch in batches:
        keys = batch.column("_key").to_pylist()
        spans = [range(bisect_right(bounds, k), bisect_right(bounds, k + _TOP) + 1) for k in keys]
        rows = pa.array([i for i, span in enumerate(spans) for _ in span], pa.int32())
        yield batch.take(rows).append_column(
            "_range", pa.array([n for span in spans for n in span], pa.int32()))


def _sweep(batches, otherwise: str):
    """Rows sorted by range, then key, rules first. A range starts with an empty stack."""
    stack, at = [], None
    for batch in batches:
        rules, verdicts, is_url = [], [], []
        columns = [batch.column(c).to_pylist()
                   for c in ("_range", "_key", "_kind", "path", "rule", "verdict")]
        for number, key, kind, path, rule, verdict in zip(*columns):
            if number != at:
                stack, at = [], number
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            best = None
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, []))
                stack[-1][1].append((path, rule, verdict))
            else:
                best = _fitting(stack, path)
            is_url.append(kind == 1)
            rules.append(best and best[0])
            verdicts.append(best[1] if best else otherwise)
        done = batch.select(["_row", "host", "path"]).append_column(
            "rule", pa.array(rules, pa.string())).append_column(
            "verdict", pa.array(verdicts, pa.string()))
        yield done.filter(pa.array(is_url, pa.bool_()))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", row_id: str = "page_id",
               otherwise: str = "allow") -> DataFrame:
    """``row_id, host, path, rule, verdict`` for every row of ``pages``.

    ``rules`` has ``host, path, verdict``. A rule fits its host and all subdomains where
    the URL's path starts with the rule's; the longest rule (host and path together) wins,
    among equally long ones that of the longer host, then the greater verdict. Without a
    fitting rule ``rule`` is null and ``verdict`` is ``otherwise``. Null URLs and such
    without :// have an empty host and path, which no rule fits; rules with a null or
    empty host fit nothing, a null path is empty. Repeated rows, and null ids, are judged
    row by row. No rows give none. Other columns of ``pages`` are not read.

    Rows meet rules by a range number. Bounds are quantiles of a bounded sample of keys
    with path and row hash, so that neither a hot host nor a hot URL fills one range; they
    only balance the work. A rule goes to every range its interval touches. This runs jobs.
    """
    host, path = url_parts("_url")
    spread = F.concat("_key", F.lit("\0"), "path", F.lit("\0"),
                      F.md5(F.coalesce(F.col("_row").cast("string"), F.lit("")).cast("binary")))
    urls = materialize(
        pages.select(F.col(row_id).alias("_row"), F.col(url).alias("_url"))
        .select("_row", host.alias("host"), path.alias("path"))
        .withColumn("_key", host_key("host")).withColumn("_spread", spread))
    rows = urls.count()
    ranges = max(LEAST_RANGES, -(-rows // ROWS_PER_RANGE))
    sample = sorted(r[0] for r in urls.orderBy(F.xxhash64("_spread")).limit(SAMPLED_KEYS)
                    .select("_spread").collect())
    bounds = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)} if sample else ())

    of_row = urls.schema["_row"].dataType.simpleString()
    numbered = urls.mapInArrow(
        partial(_numbered, bounds=bounds),
        f"_row {of_row}, host string, path string, _key string, _spread string, _range int")
    rule_path = F.coalesce("path", F.lit(""))
    lowered = F.lower("host")
    held = (
        rules.select(lowered.alias("host"), rule_path.alias("path"), "verdict")
        .filter("host <> ''").distinct()
        .withColumn("rule", F.concat("host", "path")).withColumn("_key", host_key("host"))
        .mapInArrow(partial(_in_ranges, bounds=bounds),
                    "host string, path string, verdict string, rule string, _key string, "
                    "_range int"))
    null = F.lit(None)
    both = (
        numbered.select("_range", "_key", F.lit(1).alias("_kind"), "_row", "host", "path",
                        null.cast("string").alias("rule"), null.cast("string").alias("verdict"))
        .union(held.select("_range", "_key", F.lit(0).alias("_kind"), null.cast(of_row), "host",
                           "path", "rule", "verdict")))
    judged = (
        both.repartition(ranges, "_range")
        .sortWithinPartitions("_range", "_key", "_kind", "rule", "verdict")
        .mapInArrow(partial(_sweep, otherwise=otherwise),
                    f"_row {of_row}, host string, path string, rule string, verdict string"))
    return judged.withColumnRenamed("_row", row_id)
