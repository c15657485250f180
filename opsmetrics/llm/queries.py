"""The corpus operators as registered queries, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmetrics.llm import (
    collocations, decontamination, html_text, lm_scores, mixing, near_dedup, quality, search,
    secret_scan, shingle_join, spelling, toxicity, url_rules)
from opsmetrics.llm.tables import held_out, read

Query = Callable[[SparkSession, str], DataFrame]

# The mix, the URL rules and the links of the registered queries.
SOURCE_WEIGHTS = [3, 1, 2]
MIX_PERCENT = 150
MOST_EPOCHS = 2
URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block")]
SHINGLE_WORDS, NEAR_PERCENT = 3, 85
JOIN_WORDS, JOIN_PERCENT = 5, 80
QUALITY_LIMIT, TOXIC_LIMIT = 0.3, 0.5


def _judged(scored: DataFrame, limit: float) -> DataFrame:
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         F.when(F.col("score") >= limit, 1).otherwise(0).alias("predicted"))


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    model = quality.fit_quality(docs, read(spark, folder, "labels"))
    return _judged(quality.score_quality(docs, model), QUALITY_LIMIT)


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, read(spark, folder, "labels"))
    return _judged(toxicity.score_toxicity(docs, model), TOXIC_LIMIT)


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read(spark, folder, "documents"), SOURCE_WEIGHTS, MIX_PERCENT, MOST_EPOCHS,
                      texts=False)


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.find_passages(read(spark, folder, "documents"),
                                         read(spark, folder, "benchmark"))


def op5_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings")
    return search.top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op6_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(read(spark, folder, "pages"), rules)


def op7_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_text(read(spark, folder, "pages"))


def op8_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scores.supported_scores(read(spark, folder, "documents"), apart=True)


def op9_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, folder, "documents"), SHINGLE_WORDS,
                                      NEAR_PERCENT)


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return secret_scan.scan(docs, secret_scan.fit_network(docs))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(read(spark, folder, "documents"))


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(spelling.word_counts(read(spark, folder, "documents")))


def op13_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return shingle_join.linked_documents(read(spark, folder, "documents"), JOIN_WORDS,
                                         JOIN_PERCENT)


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (
        op1_quality, op2_toxicity, op3_mixing, op4_decontamination, op5_search, op6_url_rules,
        op7_html_text, op8_lm_scores, op9_near_dedup, op10_secret_scan,
        op11_collocations, op12_spelling, op13_ngram_join)}

_MIX = rf"""
WITH sized AS (
  SELECT doc_id, source,
    CAST(length(translate(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'x', 'g'),
      ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS size,
    greatest(0.1::DOUBLE, coalesce(pow(
      CAST(length(regexp_replace(text, '[!-@\[-`{{-~]+', '', 'g')) AS DOUBLE)
      / greatest(length(text), 1), 2), 0.0)) AS weight,
    (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT)
      AS DOUBLE) + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM documents),
keyed AS (SELECT doc_id, source, size, -ln(u) / weight AS key FROM sized),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    ([{', '.join(map(str, SOURCE_WEIGHTS))}])[
      1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(SOURCE_WEIGHTS)}] AS weight
  FROM keyed GROUP BY source),
ordered AS (
  SELECT *, {MOST_EPOCHS} * source_size AS stop,
    sum({MOST_EPOCHS} * source_size) OVER w - {MOST_EPOCHS} * source_size AS stopped,
    sum(weight) OVER () - (sum(weight) OVER w - weight) AS open_weight,
    sum(source_size) OVER () AS whole
  FROM totals
  WINDOW w AS (ORDER BY {MOST_EPOCHS} * source_size::DOUBLE / weight, source NULLS LAST
               ROWS UNBOUNDED PRECEDING)),
level AS (
  SELECT stopped, open_weight, whole FROM ordered
  WHERE (whole * {MIX_PERCENT} / 100.0::DOUBLE - stopped) * weight / open_weight <= stop
  ORDER BY {MOST_EPOCHS} * source_size::DOUBLE / weight, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, least(CAST(stop AS DOUBLE),
    CAST(level.whole * {MIX_PERCENT} / 100.0::DOUBLE - level.stopped AS DOUBLE) * weight
      / CAST(level.open_weight AS DOUBLE)) AS target
  FROM ordered, level),
parts AS (
  SELECT *, floor(target / greatest(source_size, 1)) AS epochs FROM targets),
drawn AS (
  SELECT k.*, p.source_size, p.target, p.epochs,
    p.target - p.epochs * p.source_size AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size
                      ROWS UNBOUNDED PRECEDING) AS upto
  FROM keyed k JOIN parts p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, size, source_size, target,
  CAST(size * (epochs + CASE WHEN rest > 0 AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END)
    AS BIGINT) AS taken
FROM drawn"""

_SEARCH = """
WITH v AS (
  SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT query_id, vec_id, score, CAST(row_number() OVER (
    PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

_URLS = f"""
WITH parts AS (
  SELECT page_id, row_number() OVER () AS n,
    coalesce(contains(url, '://'), false) AS has,
    split_part(split_part(substr(url, instr(url, '://') + 3), '?', 1), '#', 1) AS cut
  FROM pages),
urls AS (
  SELECT page_id, n,
    CASE WHEN has THEN translate(split_part(cut, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN has THEN substr(cut, length(split_part(cut, '/', 1)) + 1) ELSE '' END AS path
  FROM parts),
rules(rule_host, rule_path, verdict) AS (VALUES {_RULES}),
fits AS (
  SELECT n, rule_host || rule_path AS rule, verdict, row_number() OVER (
    PARTITION BY n ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
  FROM urls JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM urls LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (n)"""

def _linked(size: int, percent: int, columns: str) -> str:
    """SQL of links between sets of shingles, and what their components say."""
    return rf"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE
      WHEN len(w) = 0 THEN []
      WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
      ELSE [array_to_string(w[i : i + {size - 1}], ' ')
            FOR i IN range(1, len(w) - {size - 2})] END) AS s
    FROM words)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id),
pairs AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * i >= {percent} * (x.n + y.n - i)),
links AS MATERIALIZED (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(a, b) AS (
  SELECT a, b FROM links
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles,
  least(d.doc_id, coalesce(b, d.doc_id)) AS component_id{columns}
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON least.a = d.doc_id"""


_NEAR = _linked(SHINGLE_WORDS, NEAR_PERCENT,
                ", least(d.doc_id, coalesce(b, d.doc_id)) = d.doc_id AS kept")
_JOINED = _linked(JOIN_WORDS, JOIN_PERCENT, "")

_PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
counts AS MATERIALIZED (
  SELECT lang, size, phrase, count(*) AS f FROM (
    SELECT lang, size, unnest([array_to_string(w[i : i + size - 1], ' ')
      FOR i IN range(1, len(w) - size + 2)]) AS phrase
    FROM words, (VALUES (1), (2), (3)) s(size))
  GROUP BY lang, size, phrase),
long AS MATERIALIZED (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts
  WHERE size > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.size, c.phrase, a, k, x.f AS l, y.f AS r,
    (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM long) c
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(w[1 : k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1 : c.size], ' ')),
lowest AS (
  SELECT * FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, array_to_string(w[1 : 2], ' ') AS phrase, a FROM long WHERE size = 3
    UNION ALL SELECT lang, array_to_string(w[2 : 3], ' '), a FROM long WHERE size = 3)
  GROUP BY lang, phrase),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE size = 1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM lowest JOIN totals USING (lang) LEFT JOIN around USING (lang, phrase)
WHERE size = 3 OR most IS NULL OR 100 * most < 50 * a
QUALIFY rank <= 2000"""

_SPELLING = r"""
WITH RECURSIVE sums AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], range(8)), lambda c, b:
      CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
texts AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS name, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-z\x{C0}-\x{FF}]+') AS runs
  FROM documents),
runs AS MATERIALIZED (
  SELECT name, run, count(*) AS n FROM (SELECT name, unnest(runs) AS run FROM texts)
  WHERE length(run) >= 5 GROUP BY name, run),
summed AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295],
    flatten([CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END
             FOR x IN string_split(name || ':' || run, '')])),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS h
  FROM runs, sums),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS BIGINT))
      || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM summed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS MATERIALIZED (
  SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS less FROM (
    SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b
    ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT cut.word, words.word FROM cut JOIN words ON less = words.word
  UNION SELECT words.word, cut.word FROM cut JOIN words ON less = words.word),
ranked AS (
  SELECT a, b, w.n, count(*) OVER (PARTITION BY a) AS n_near,
    row_number() OVER (PARTITION BY a ORDER BY w.n DESC, b) AS place
  FROM near JOIN words w ON b = w.word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN r.n >= 2 * w.n THEN b END AS form, CASE WHEN r.n >= 2 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = a AND place = 1),
led(word, root) AS (
  SELECT word, word FROM forms
  UNION ALL
  SELECT led.word, form FROM led JOIN forms ON forms.word = led.root WHERE form IS NOT NULL)
SELECT f.word, f.form, led.root, f.n, f.n_near, f.form_n
FROM forms f JOIN led ON led.word = f.word JOIN forms g ON g.word = led.root
WHERE g.form IS NULL"""

ORACLE = {"op3_mixing": _MIX, "op5_search": _SEARCH, "op6_url_rules": _URLS,
          "op9_near_dedup": _NEAR, "op11_collocations": _PHRASES, "op12_spelling": _SPELLING,
          "op13_ngram_join": _JOINED}
