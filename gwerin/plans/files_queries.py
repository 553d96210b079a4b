"""Files whose schema drifts and lines that may not parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gwerin.operators import drift, lexicon_lines
from gwerin.plans.registry import SQL, query
from gwerin.session import table


@query()
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(table(spark, sf_dir, "drift_records"))


@query()
def p6_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.unify(table(spark, sf_dir, "drift_records"))


@query("""
WITH s AS (SELECT line_no, coalesce(regexp_replace(line, '\\r$', ''), '') AS l, line IS NULL AS none FROM lexicon_lines),
p AS (SELECT line_no, none, string_split(l, chr(9)) AS c FROM s),
v AS (SELECT line_no, none, c, list_transform(c, lambda x: CASE WHEN regexp_matches(x, '^"([^"]|"")*"$') THEN replace(x[2:-2], '""', '"') ELSE x END) AS f FROM p),
r AS (SELECT line_no, CASE WHEN none OR len(c) NOT IN (3, 4) THEN 'columns'
  WHEN len(list_filter(c, lambda x: contains(x, '"') AND NOT regexp_matches(x, '^"([^"]|"")*"$'))) > 0 THEN 'quoting'
  WHEN NOT regexp_matches(f[1], '^[\\p{L} ''’"-]*[^ ][\\p{L} ''’"-]*$') OR NOT regexp_matches(f[2], '^[\\p{L} ''’"-]*[^ ][\\p{L} ''’"-]*$') OR NOT regexp_matches(f[1], '^[\\p{L} ''’"-]*$') OR NOT regexp_matches(f[2], '^[\\p{L} ''’"-]*$')
  OR f[3] NOT IN ('ADJ','ADP','ADV','AUX','CCONJ','DET','INTJ','NOUN','NUM','PART','PRON','PROPN','PUNCT','SCONJ','SYM','VERB','X')
  OR (len(c) = 4 AND NOT regexp_matches(f[4], '^([\\p{L}\\p{N}]+=[\\p{L}\\p{N}]+(,[\\p{L}\\p{N}]+)*(\\|[\\p{L}\\p{N}]+=[\\p{L}\\p{N}]+(,[\\p{L}\\p{N}]+)*)*)?$')) THEN 'value' END AS reason FROM v)
SELECT line_no, reason FROM r WHERE reason IS NOT NULL
""")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon_lines.parse_lines(table(spark, sf_dir, "lexicon_lines")).where("reason is not null").select("line_no", "reason")


@query(SQL["p7_found"].partition("SELECT line_no, reason FROM r WHERE")[0].replace("r AS (SELECT line_no, CASE", "r AS (SELECT line_no, f, CASE") + "SELECT line_no, f[1] AS wordform, f[2] AS lemma, f[3] AS tag, f[4] AS morph FROM r WHERE reason IS NULL")
def p7_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon_lines.parse_lines(table(spark, sf_dir, "lexicon_lines")).where("reason is null").select("line_no", "wordform", "lemma", "tag", "morph")
