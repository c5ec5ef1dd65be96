"""Retrieval metrics at k in long form, from ranked predictions and gold codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotsman.functions.text import to_level


def at_level(pred: DataFrame, gold: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """Predictions (doc_id, code, rank) and gold (doc_id, code) cut to a level: each code once, in first-seen order."""
    p = pred.withColumn("code", to_level("code", level)).where("code is not null").groupBy("doc_id", "code").agg(F.min("rank").alias("_r"))
    p = p.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("_r"))).drop("_r")
    return p, gold.withColumn("code", to_level("code", level)).where("code is not null").select("doc_id", "code").distinct()


def per_document(pred: DataFrame, gold: DataFrame, docs: DataFrame, ks: tuple[int, ...] | None) -> DataFrame:
    """(doc_id, k, recall, precision, mrr, ap); k is the size of the gold set where ``ks`` is None.

    No gold: recall, mrr and ap are 1.  No prediction: precision 0.  Precision divides by the predictions within k.
    """
    g = gold.distinct().withColumn("hit", F.lit(1))
    hits = pred.join(g, ["doc_id", "code"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    hits = hits.withColumn("so_far", F.sum("hit").over(Window.partitionBy("doc_id").orderBy("rank")))
    p = hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pred"), F.array_sort(F.collect_list(F.when(F.col("hit") == 1, F.struct("rank", "so_far")))).alias("h"))
    n = gold.distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_gold"))
    base = docs.select("doc_id").distinct().join(p, "doc_id", "left").join(n, "doc_id", "left").select("doc_id", F.coalesce("n_pred", F.lit(0)).alias("n_pred"), F.coalesce("n_gold", F.lit(0)).alias("n_gold"), F.coalesce("h", F.expr("cast(array() as array<struct<rank int, so_far bigint>>)")).alias("h"))
    base = base.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])) if ks is not None else F.col("n_gold"))
    within = F.filter("h", lambda x: x["rank"] <= F.col("k"))
    n_hits = F.size(within)
    ap = F.aggregate(within, F.lit(0.0), lambda a, x: a + x["so_far"] / x["rank"])
    none = F.col("n_gold") == 0
    return base.select(
        "doc_id", "k",
        F.when(F.col("k") <= 0, 0.0).when(none, 1.0).otherwise(n_hits / F.col("n_gold")).alias("recall"),
        F.when((F.col("k") <= 0) | (F.col("n_pred") == 0), 0.0).otherwise(n_hits / F.least("k", "n_pred")).alias("precision"),
        F.when(F.col("k") <= 0, 0.0).when(none, 1.0).otherwise(F.coalesce(1 / F.get(within, F.lit(0))["rank"], F.lit(0.0))).alias("mrr"),
        F.when(F.col("k") <= 0, 0.0).when(none, 1.0).otherwise(ap / F.col("n_gold")).alias("ap"),
    )


def macro(per_doc: DataFrame, *keys: str) -> DataFrame:
    """Means over documents; 0 where there are none."""
    return per_doc.groupBy(*keys).agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in ("recall", "precision", "mrr", "ap")])


def evaluation(pred: DataFrame, gold: DataFrame, docs: DataFrame, ks: tuple[int, ...], levels: tuple[int, ...] = (3, 2, 1)) -> DataFrame:
    """(level, k, recall, precision, mrr, ap) over the grid of levels and ks.

    Codes are cut to all levels at once, and (document, level) is what is measured, so predictions are made once.
    """
    cut = F.explode(F.array(*[F.struct(F.lit(lv).alias("level"), to_level("code", lv).alias("cut")) for lv in levels])).alias("c")
    at = lambda d, *more: d.select("doc_id", *more, cut).where("c.cut is not null").select(F.struct("doc_id", "c.level").alias("doc_id"), *more, F.col("c.cut").alias("code"))
    p = at(pred, "rank").groupBy("doc_id", "code").agg(F.min("rank").alias("_r"))
    p = p.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("_r"))).drop("_r")
    every = docs.select("doc_id").distinct().withColumn("level", F.explode(F.array(*map(F.lit, levels)))).select(F.struct("doc_id", "level").alias("doc_id"))
    per = per_document(p, at(gold).distinct(), every, ks)
    return macro(per.withColumn("level", F.col("doc_id.level")), "level", "k")


def document_report(pred: DataFrame, gold: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """One row: recall, precision and mrr at k, recall and precision at the size of the gold set, ``n`` documents
    measured and ``skipped``; documents (doc_id, text) without gold or text are skipped.  Means over nothing are 0."""
    has_gold = gold.select("doc_id").distinct().withColumn("_g", F.lit(1))
    usable = docs.select("doc_id", "text").dropDuplicates(["doc_id"]).join(has_gold, "doc_id", "left").withColumn("ok", (F.col("_g") == 1) & (F.coalesce("text", F.lit("")) != ""))
    used = usable.where("ok").select("doc_id")
    keep = lambda d: d.join(used, "doc_id", "left_semi")
    at_k = macro(per_document(keep(pred), keep(gold), used, (k,))).select("recall", "precision", "mrr")
    at_m = macro(per_document(keep(pred), keep(gold), used, None)).select(F.col("recall").alias("recall_m"), F.col("precision").alias("precision_m"))
    counts = usable.agg(F.count_if(F.coalesce("ok", F.lit(False))).alias("n"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("skipped"))
    return at_k.crossJoin(F.broadcast(at_m)).crossJoin(F.broadcast(counts))


def report_stats(docs: DataFrame, pred: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: documents, those without text, those without predictions, mean sizes of gold and predictions."""
    count = lambda d, c: d.groupBy("doc_id").agg(F.count(F.lit(1)).alias(c))
    j = docs.join(count(pred, "p"), "doc_id", "left").join(count(gold, "g"), "doc_id", "left").fillna(0, ["p", "g"])
    return j.agg(F.count(F.lit(1)).alias("docs_total"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("missing_text"), F.count_if(F.col("p") == 0).alias("no_pred"), F.avg("g").alias("avg_gold"), F.avg("p").alias("avg_pred"))
