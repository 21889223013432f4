"""Queries pN_ of the problems on texts and tags, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold import tables as T
from terrafold.llm import heavy_hitters, packing, repetition, tokens

TAG_SHARE = 100
TOP_K = 20


def _tags(spark: SparkSession, d: str) -> DataFrame:
    return heavy_hitters.entries([T.read(spark, d, t) for t in ("nodes", "ways", "relations")])


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "documents").select("doc_id", "text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_hitters.frequent(_tags(spark, d), ["k", "v"], TAG_SHARE).select("k", "v")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """The frequent entries with their exact count, and whether the sketch's bounds hold it."""
    f = heavy_hitters.frequent(_tags(spark, d), ["k", "v"], TAG_SHARE)
    return f.select("k", "v", "n", F.coalesce(F.col("n").between(F.col("lower"), F.col("upper")), F.lit(True)).alias("bounds_hold"))


def p4_top(spark: SparkSession, d: str) -> DataFrame:
    """The top entries, their exact counts, and whether the sketch's bounds hold these."""
    top = heavy_hitters.top_k(_tags(spark, d), ["k", "v"], TOP_K)
    return top.select("k", "v", "n", F.col("n").between(F.col("lower"), F.col("upper")).alias("bounds_hold"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(_docs(spark, d))


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return tokens.round_trip(_docs(spark, d))


def _packed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs, sizes = _docs(spark, d), T.read(spark, d, "pack_sizes")
    return packing.pack_documents(tokens.count(docs), sizes, rows=docs.count()), sizes


def p9_pack(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(*_packed(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.matching(_docs(spark, d), repetition.REPEATED)


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """Words, repeated words in thousandths, and repeated lines in thousandths of each document."""
    m = repetition.measures(_docs(spark, d), ["n_words", "repeated_share", "n_lines", "repeated_line_share"])
    permille = lambda c: F.floor(F.col(c) * 1000 + 1e-6).cast("int")
    return m.select("doc_id", "n_words", permille("repeated_share").alias("repeated_permille"), "n_lines", permille("repeated_line_share").alias("repeated_lines_permille"))


def p10_quality(spark: SparkSession, d: str) -> DataFrame:
    """Documents that meet the whole table of length, symbol, stop-word, line and repetition ratios; stop words are the
    most frequent words of the corpus itself."""
    docs = _docs(spark, d)
    return repetition.matching(docs, repetition.QUALITY, stop=repetition.corpus_stop_words(docs))


QUERIES = {f.__name__: f for f in (p4_found, p4_counts, p4_top, p8_ids, p8_round_trip, p9_pack, p9_report, p10_found, p10_shares, p10_quality)}

_ENTRIES = "t AS (SELECT unnest(tags) AS e FROM nodes UNION ALL SELECT unnest(tags) FROM ways UNION ALL SELECT unnest(tags) FROM relations), g AS (SELECT e.k AS k, e.v AS v, count(*) AS n FROM t GROUP BY ALL)"

_WORDS = r"""
w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\r\n]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, len(words) AS n, unnest(range(1, greatest(len(words) - 4, 1))) AS i, words FROM w),
gram AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, words[i:i+5] ORDER BY i) AS nth FROM s),
hit AS (SELECT doc_id, i, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 6) AS gap FROM gram WHERE nth > 1),
rep AS (SELECT doc_id, sum(least(gap, 6)) AS r FROM hit GROUP BY doc_id)
"""

_LINES = r"l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|\r|\n'), lambda x: regexp_replace(x, '^[ \t]+|[ \t]+$', '', 'g')), lambda x: x <> '') AS lines FROM documents)"

SQL = {
    "p4_found": f"WITH {_ENTRIES} SELECT k, v FROM g WHERE n * 100 >= (SELECT sum(n) FROM g)",
    "p4_counts": f"WITH {_ENTRIES} SELECT k, v, n, true AS bounds_hold FROM g WHERE n * 100 >= (SELECT sum(n) FROM g)",
    "p4_top": f"WITH {_ENTRIES} SELECT k, v, n, true AS bounds_hold FROM g ORDER BY n DESC, k, v LIMIT 20",
    "p10_found": f"WITH {_WORDS} SELECT doc_id FROM w JOIN rep USING (doc_id) WHERE len(words) >= 50 AND r * 10 >= len(words) * 6",
    "p10_shares": rf"""
WITH {_WORDS}, {_LINES}
SELECT doc_id, CAST(len(words) AS INTEGER) AS n_words, CAST(coalesce(r, 0) * 1000 // greatest(len(words), 1) AS INTEGER) AS repeated_permille,
       CAST(len(lines) AS INTEGER) AS n_lines, CAST((len(lines) - len(list_distinct(lines))) * 1000 // greatest(len(lines), 1) AS INTEGER) AS repeated_lines_permille
FROM w JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)""",
    "p10_quality": rf"""
WITH {_WORDS}, {_LINES}, x AS (SELECT lower(unnest(words)) AS word FROM w), f AS (SELECT word, count(*) AS n FROM x GROUP BY word),
stop AS (SELECT list(word) AS l FROM f WHERE n * 500 >= (SELECT sum(n) FROM f) AND regexp_matches(word, '\p{{L}}'))
SELECT doc_id FROM w JOIN l USING (doc_id) JOIN documents USING (doc_id) LEFT JOIN rep USING (doc_id), stop
WHERE len(words) BETWEEN 50 AND 100000 AND list_sum(list_transform(words, lambda x: length(x))) BETWEEN 3 * len(words) AND 10 * len(words)
  AND (length(text) - length(translate(text, '#…', ''))) * 10 <= len(words)
  AND len(list_intersect(list_transform(words, lambda x: lower(x)), stop.l)) >= 2
  AND (len(lines) - len(list_distinct(lines))) * 10 <= len(lines) * 3
  AND len(list_filter(lines, lambda x: regexp_matches(x, '^[-*•]'))) * 10 <= len(lines) * 9
  AND len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)$'))) * 10 <= len(lines) * 3
  AND coalesce(r, 0) * 10 <= len(words) * 6""",
}
