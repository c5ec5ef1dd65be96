"""Queries of the general operators on packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotsman.operators.packed import split_values
from lotsman.session import table

PACKED = ("gisnauka_samples_train", "gisnauka_segments_train_augmented")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [split_values(table(spark, d, t)).select(F.lit(t).alias("table_name"), "row_id", "pos", "code_value") for t in PACKED]
    return parts[0].unionByName(parts[1])


def p1_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return p1_found(spark, d).groupBy("table_name", "code_value").agg(F.count(F.lit(1)).alias("n_values"), F.min("pos").alias("first_pos"))


QUERIES = {"p1_found": p1_found, "p1_frequencies": p1_frequencies}

#: Quoted spans and words of a packed field, and the value that such a token gives (null or empty: none).
VALUE_TOKENS = r"""regexp_extract_all(grnti_codes, '"(?:[^"]|"")*"|''[^'']*''|«[^»]*»|[\p{L}\p{N}_.]+')"""
VALUE_CASE = r"""CASE
  WHEN tok LIKE '"%' THEN trim(replace(tok[2:-2], '""', '"'))
  WHEN tok LIKE '''%' OR tok LIKE '«%' THEN trim(tok[2:-2])
  WHEN regexp_full_match(tok, '[0-9]{2}(\.[0-9]{2}){0,2}') THEN tok END"""
_VALUES = f"""
WITH r AS (SELECT 'gisnauka_samples_train' AS table_name, row_id, grnti_codes FROM gisnauka_samples_train UNION ALL SELECT 'gisnauka_segments_train_augmented', row_id, grnti_codes FROM gisnauka_segments_train_augmented),
t AS (SELECT table_name, row_id, {VALUE_TOKENS} AS toks FROM r WHERE grnti_codes IS NOT NULL),
u AS (SELECT table_name, row_id, unnest(toks) AS tok, unnest(range(len(toks))) AS ord FROM t),
v AS (SELECT table_name, row_id, ord, {VALUE_CASE} AS code_value FROM u)
"""
SQL = {
    "p1_found": _VALUES + "SELECT table_name, row_id, CAST(row_number() OVER (PARTITION BY table_name, row_id ORDER BY ord) AS INTEGER) AS pos, code_value FROM v WHERE code_value <> ''",
    "p1_frequencies": _VALUES + ", f AS (SELECT table_name, CAST(row_number() OVER (PARTITION BY table_name, row_id ORDER BY ord) AS INTEGER) AS pos, code_value FROM v WHERE code_value <> '') SELECT table_name, code_value, count(*) AS n_values, min(pos) AS first_pos FROM f GROUP BY table_name, code_value",
}
