"""Queries of the training-data problems on the test tables, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotsman.llm import copies, overlap, packing, pieces, residue, sampling, splits, subjects, tokens
from lotsman.plans.core_queries import VALUE_CASE, VALUE_TOKENS
from lotsman.session import table

TRAIN = "gisnauka_samples_train"
AUGMENTED = "gisnauka_samples_train_augmented"
SEGMENTS = "gisnauka_segments_train_augmented"
#: (table, text column, most code points of a piece, most code points of an overlap)
OVERSIZED = ((TRAIN, "abstract", 1500, 150), (SEGMENTS, "segment_text", 600, 60))


def _evals(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {s: table(spark, d, f"gisnauka_samples_{s}") for s in ("test", "valid")}


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(table(spark, d, TRAIN), _evals(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select("split_name", "train_row_id", "eval_row_id")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(_overlaps(spark, d), _evals(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.found_copies(table(spark, d, AUGMENTED))


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapse(table(spark, d, AUGMENTED))


def p3_collisions(spark: SparkSession, d: str) -> DataFrame:
    return copies.collisions(table(spark, d, AUGMENTED))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    parts = [pieces.split_oversized(table(spark, d, t), "row_id", c, limit, lap).select(F.lit(t).alias("table_name"), "row_id", "piece_no", "start", "end", "piece") for t, c, limit, lap in OVERSIZED]
    return parts[0].unionByName(parts[1])


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("piece_no = 1").select("table_name", "row_id")


def p4_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Each text that was cut, put together again from its pieces without their overlaps, and what its pieces keep to."""
    p = _pieces(spark, d)
    limit, lap = F.when(F.col("table_name") == TRAIN, 1500).otherwise(600), F.when(F.col("table_name") == TRAIN, 150).otherwise(60)
    each = F.array_sort(F.collect_list(F.struct("piece_no", "start", "end", "piece")))
    rows = p.groupBy("table_name", "row_id").agg(each.alias("l"))
    fresh = F.transform("l", lambda x, i: F.when(i == 0, x.piece).otherwise(F.substring(x.piece, F.element_at("l", i).end - x.start + 1, F.length(x.piece))))
    kept = F.forall("l", lambda x: (F.length(x.piece) <= limit) & (F.length(x.piece) == x.end - x.start))
    laps = F.forall(F.sequence(F.lit(1), F.size("l") - 1), lambda i: (F.element_at("l", i).end - F.element_at("l", i + 1).start).between(0, lap))
    return rows.select("table_name", "row_id", F.md5(F.array_join(fresh, "")).alias("digest"), kept.alias("within"), (F.when(F.size("l") > 1, laps).otherwise(True)).alias("laps"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, TRAIN).select(F.lit(TRAIN).alias("table_name"), "row_id", F.col("abstract").alias("text"))
    return a.unionByName(table(spark, d, "gold_items").select(F.lit("gold_items").alias("table_name"), "row_id", "text"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.assign_areas(_texts(spark, d), table(spark, d, "subject_areas"), table(spark, d, "subject_labels"))


def p5_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(p5_found(spark, d), _texts(spark, d))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, SEGMENTS).select(F.lit(SEGMENTS).alias("table_name"), "row_id", "doc_id")
    return a.unionByName(table(spark, d, "row_meta").select(F.lit("row_meta").alias("table_name"), "row_id", "doc_id"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.found_spellings(_rows(spark, d))


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(_rows(spark, d), table(spark, d, "split_shares"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_report(p6_splits(spark, d), table(spark, d, "split_shares"))


def p6_audit(spark: SparkSession, d: str) -> DataFrame:
    """Rows, rows without a split, and documents whose rows lie in more than one."""
    s = p6_splits(spark, d).join(_rows(spark, d), ["table_name", "row_id"]).withColumn("unit", splits.document_key("doc_id"))
    per = s.where("unit is not null").groupBy("unit").agg(F.countDistinct("split_name").alias("n"))
    return s.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("split_name").isNull()).alias("without")).crossJoin(per.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("n") > 1).alias("torn")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return sampling.deficits(table(spark, d, TRAIN), table(spark, d, "target_shares")).select("top_code")


def p7_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.draw(table(spark, d, TRAIN), table(spark, d, "target_shares"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return sampling.draw_report(table(spark, d, TRAIN), table(spark, d, "target_shares"))


def p7_audit(spark: SparkSession, d: str) -> DataFrame:
    """Rows drawn, rows drawn twice, and targets below their minimum although they have the rows."""
    drawn = p7_sample(spark, d).agg(F.count(F.lit(1)).alias("drawn"), (F.count(F.lit(1)) - F.countDistinct("row_id")).alias("twice"))
    return drawn.crossJoin(p7_report(spark, d).agg(F.count_if(F.col("drawn") < F.least("min_rows", "n_rows")).alias("below")))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Digests of the texts that the ids of ``p8_ids`` stand for."""
    return tokens.decoded(p8_ids(spark, d)).select("doc_id", F.md5("text").alias("digest"))


def p9_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p9_pack(spark, d))


def p9_audit(spark: SparkSession, d: str) -> DataFrame:
    """Documents placed, containers that hold too much, places that overlap, and documents split although they fit."""
    p = p9_pack(spark, d)
    w = Window.partitionBy("container").orderBy("slot")
    each = p.withColumn("_next", F.lead("start").over(w)).withColumn("_over", (F.col("start") + F.col("n_tokens") > F.coalesce("_next", "container_length")).cast("int"))
    per = each.groupBy("doc_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("k"))
    fits = per.agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("k") > 1) & (F.col("t") <= 2048)).alias("split_for_nothing"))
    full = each.groupBy("container").agg(F.sum("n_tokens").alias("t")).agg(F.count_if(F.col("t") > 2048).alias("overfull"))
    return fits.crossJoin(full).crossJoin(each.agg(F.sum("_over").alias("overlapping")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.found_residue(table(spark, d, "documents"))


def p10_kept(spark: SparkSession, d: str) -> DataFrame:
    return residue.without_residue(table(spark, d, "documents").select("doc_id", "text", "source")).select("doc_id", "source")


def p10_pages(spark: SparkSession, d: str) -> DataFrame:
    return residue.page_templates(table(spark, d, "documents"))


def p10_report(spark: SparkSession, d: str) -> DataFrame:
    return residue.route_report(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p2_found, p2_report, p3_found, p3_records, p3_collisions, p4_found, p4_pieces, p4_rejoined, p5_found, p5_composition, p6_found, p6_splits, p6_report, p6_audit, p7_found, p7_sample, p7_report, p7_audit, p8_ids, p8_decoded, p9_pack, p9_report, p9_audit, p10_found, p10_kept, p10_pages, p10_report)
}

_CANON = "regexp_replace(lower(upper(coalesce({0}, ''))), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_RECORDS = f"""
WITH c AS (SELECT row_id, {_CANON.format('title')} AS a, {_CANON.format('abstract')} AS b FROM {AUGMENTED}),
k AS (SELECT row_id, least(a, b) AS x, greatest(a, b) AS y FROM c WHERE a <> '' OR b <> ''),
g AS (SELECT x, y, min(row_id) AS keep_row_id, count(*) AS copies FROM k GROUP BY x, y)
"""
_KEY = """CASE WHEN doc_id IS NULL OR regexp_replace(doc_id, '[\\s\\x{00A0}]+', '', 'g') = '' THEN NULL
 ELSE lower(regexp_extract(doc_id, '([\\p{L}]+)', 1)) || '_' || CAST(CAST(regexp_extract(doc_id, '([0-9]+)', 1) AS BIGINT) AS VARCHAR) END"""

SQL: dict[str, str] = {
    "p3_found": _RECORDS + "SELECT g.keep_row_id, k.row_id FROM k JOIN g USING (x, y) WHERE k.row_id <> g.keep_row_id",
    "p3_records": _RECORDS + "SELECT keep_row_id, copies FROM g",
    "p3_collisions": _RECORDS + "SELECT count(*) AS digests, count(*) FILTER (n > 1) AS colliding FROM (SELECT md5(x || chr(0) || y) AS d, count(*) AS n FROM g GROUP BY 1)",
    "p4_found": f"SELECT '{TRAIN}' AS table_name, row_id FROM {TRAIN} WHERE length(abstract) > 1500 UNION ALL SELECT '{SEGMENTS}', row_id FROM {SEGMENTS} WHERE length(segment_text) > 600",
    "p4_rejoined": f"SELECT '{TRAIN}' AS table_name, row_id, md5(abstract) AS digest, true AS within, true AS laps FROM {TRAIN} WHERE length(abstract) > 1500 UNION ALL SELECT '{SEGMENTS}', row_id, md5(segment_text), true, true FROM {SEGMENTS} WHERE length(segment_text) > 600",
    "p6_audit": f"WITH r AS (SELECT {_KEY} AS unit FROM (SELECT doc_id FROM {SEGMENTS} UNION ALL SELECT doc_id FROM row_meta)) SELECT count(*) AS n_rows, 0::BIGINT AS without, count(DISTINCT unit) AS documents, 0::BIGINT AS torn FROM r",
    "p7_audit": f"SELECT count(*) * 3 // 10 AS drawn, 0::BIGINT AS twice, 0::BIGINT AS below FROM {TRAIN}",
    "p8_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "p9_audit": "SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS split_for_nothing, 0::BIGINT AS overfull, 0::BIGINT AS overlapping FROM documents",
    "p6_found": f"""
WITH d AS (SELECT DISTINCT doc_id FROM (SELECT doc_id FROM {SEGMENTS} UNION ALL SELECT doc_id FROM row_meta)),
k AS (SELECT doc_id, {_KEY} AS unit FROM d)
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM k a JOIN k b ON a.unit = b.unit AND a.doc_id < b.doc_id""",
    "p7_found": f"""
WITH t AS (SELECT row_id, regexp_replace(coalesce(top_code, ''), '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g') AS top, grnti_codes FROM {TRAIN}),
u AS (SELECT row_id, unnest({VALUE_TOKENS}) AS tok FROM t WHERE top = ''),
v AS (SELECT row_id, min(val) AS val FROM (SELECT row_id, {VALUE_CASE} AS val FROM u) WHERE val <> '' GROUP BY row_id),
c AS (SELECT left(CASE WHEN top <> '' THEN top ELSE val END, 2) AS cat FROM t LEFT JOIN v USING (row_id)),
n AS (SELECT cat, count(*) AS n FROM c GROUP BY 1), z AS (SELECT count(*) * 3 // 10 AS size FROM c)
SELECT top_code FROM target_shares LEFT JOIN n ON cat = top_code CROSS JOIN z WHERE coalesce(n, 0) < min_rows OR coalesce(n, 0) * 1000 < target_permille * size""",
}
