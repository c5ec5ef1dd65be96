"""Hand-derived cases of segmentation, filter, codes, aggregation, metrics, splits and batches."""

import math
import os

import pytest
from pyspark.sql import functions as F

from lotsman.functions import text as tx
from lotsman.operators import annotate as an
from lotsman.operators import batching as bt
from lotsman.operators import datasets as ds
from lotsman.operators import metrics as mt
from lotsman.operators import ontology as on
from lotsman.operators.segment import merge_quotes, segment, segments


@pytest.mark.parametrize("text, out", [
    ("Один\n\nДва", ["Один", "Два"]),
    ("1. Первая\nпродолжение. Ещё\n2. Вторая\nхвост", ["1. Первая продолжение. Ещё", "2. Вторая хвост"]),
    ("1. Первая задача\n2. Вторая задача", ["1. Первая задача", "2. Вторая задача"]),
    ("- альфа;\n- бета;\n- гамма", ["альфа;", "бета;", "гамма"]),
    ("a | b | c\nd | e | f", ["a | b | c d | e | f"]),
    (None, []), ("", []), (" \n\n ", []),
])
def test_segment(text, out):
    assert segment(text) == out


def test_quotes():
    assert merge_quotes(["Он сказал «Да.", "Нет» и ушёл."]) == ["Он сказал «Да. Нет» и ушёл."]
    assert merge_quotes(["А „б“ в.", "Г."], compat=True) == ["А „б“ в. Г."]
    assert merge_quotes(["А „б“ в.", "Г."]) == ["А „б“ в.", "Г."]
    assert merge_quotes(["It's.", "Ok."], compat=True) == ["It's. Ok."]
    assert merge_quotes(["It's.", "Ok."]) == ["It's.", "Ok."]


def test_segments_table(spark):
    got = segments(spark.createDataFrame([(1, "Один\n\nДва", 5), (2, None, 6), (3, "", 7)], "doc_id long, text string, segment_index int"))
    assert sorted(map(tuple, got.collect())) == [(1, 0, "Один"), (1, 1, "Два")]


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column("x")).first()[0]


@pytest.mark.parametrize("text, dropped", [
    ("", True), ("Кратко", True), ("12.05.2024", True), ("РАЗДЕЛ 12.", True), ("Техническое задание", True), ("Техническое задание:", True),
    ("Раздел 3 Общие положения", True), ("Раздел 3 Общие положения и цели, часть", False), ("12.05.2024, 13.05.2024", True),
    ("Екатеринбург 2024", True), ("Казань, г. Казань 2024", True), ("Нижний Новгород, г. Москва 2024", False), ("Разработать методику испытаний образцов.", False), (None, True),
])
def test_filter(spark, text, dropped):
    assert one(spark, tx.uninformative, text) is dropped


def test_codes_and_labels(spark):
    assert one(spark, lambda c: tx.to_level(c, 2), "27.01.02") == "27.01"
    assert one(spark, lambda c: tx.to_level(c, 0), "27.01.02") is None and one(spark, lambda c: tx.to_level(c, 4), "27.01.02") is None
    assert one(spark, lambda c: tx.to_level(c, 2), "27.x.02") is None and one(spark, lambda c: tx.to_level(c, 1), "27.x.02") == "27"
    assert one(spark, lambda c: tx.roll_up(F.split(c, ";"), 2), "27.01.02;27.01.05;53.02.01") == ["27.01", "53.02"]
    for label, out in {"27.01 Общие вопросы": ("27.01", "Общие вопросы"), "27": ("27", "27"), "Общие": (None, "Общие"), "27.01.02: Тема": ("27.01.02", "Тема")}.items():
        assert (one(spark, tx.label_code, label), one(spark, tx.label_title, label)) == out
    for s, out in {"- x": "x", "-x": "-x", "o item": "item", "•\tx": "x"}.items():
        assert one(spark, tx.strip_bullet, s) == out
    assert one(spark, tx.code_list, " 1.2.3 ;;x; 4.5.6") == ["1.2.3", "4.5.6"]


def test_aggregators(spark):
    df = spark.createDataFrame([([0.9, 0.6, 0.6],)], "s array<double>")
    want = {"sum": 2.1, "max": 0.9, "mean": 0.7, "median": 0.6, "weighted_mean": 0.725, "sum_log_count": 2.911218, "mean_log_count": 0.970406, "other": 2.1}
    for m, v in want.items():
        assert math.isclose(df.select(an.aggregated(F.col("s"), m)).first()[0], v, abs_tol=1e-6)
    assert spark.createDataFrame([([],)], "s array<double>").select(an.aggregated(F.col("s"), "mean")).first()[0] == 0
    assert math.isclose(spark.createDataFrame([([0.2, 0.4],)], "s array<double>").select(an.aggregated(F.col("s"), "median")).first()[0], 0.3)


def test_metrics(spark):
    pred = spark.createDataFrame([(1, c, i) for i, c in enumerate("ABCD", 1)] + [(2, "A", 1)], "doc_id int, code string, rank int")
    gold = spark.createDataFrame([(1, c) for c in "BDE"] + [(3, "A")], "doc_id int, code string")
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    got = {(r.doc_id, r.k): (r.recall, r.precision, r.mrr, r.ap) for r in mt.per_document(pred, gold, docs, (0, 3, 5)).collect()}
    assert got[1, 3] == pytest.approx((1 / 3, 1 / 3, 1 / 2, 1 / 6)) and got[1, 5] == pytest.approx((2 / 3, 2 / 4, 1 / 2, 1 / 3))
    assert got[1, 0][:2] == (0, 0) and got[2, 3] == (1, 0, 1, 1) and got[3, 3][:2] == (0, 0)


def test_graph(spark):
    links = spark.createDataFrame([(0, "a", "b"), (1, "b", "c"), (2, "a", "d"), (3, "c", "a"), (4, "d", "b")], "link_ord long, source string, target string")
    got = on.descendants(links, spark.createDataFrame([("a",)], "root string"))
    assert {r.id for r in got.collect()} == set("abcd")
    assert {r.id: r.parent for r in on.first_parents(links).collect()}["b"] == "a"


def test_statistics_and_splits(spark):
    r = ds.statistics(spark.range(1, 15), "id").first()
    assert (r.p90, r.p95, r.p99, r.median) == (12, 13, 13, 7.5)
    assert [ds.half_even(25, (1, 10)), ds.half_even(4, (1, 10)), ds.half_even(10, (1, 3)), ds.half_even(0, (1, 3))] == [2, 1, 3, 0]
    s = ds.random_split(spark.range(1000), "id", (1, 10), ("valid", "train")).groupBy("split").count().collect()
    assert {x["split"]: x["count"] for x in s} == {"valid": 100, "train": 900}
    rows = [("A", "a1")] * 3 + [("A", "a2")] + [("B", "b1")] * 5
    c = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "id long, top string, code string")
    n = lambda k: sorted((r.top, r.code, r["count"]) for r in ds.balanced(c, "top", "code", "id", k).groupBy("top", "code").count().collect())
    assert sum(x[2] for x in n(None)) == 2 and n(3) == [("A", "a1", 2), ("A", "a2", 1), ("B", "b1", 3)]


def test_batches(spark):
    assert bt.curriculum("1,1,2") == (0.25, 0.25, 0.5) and math.isnan(bt.curriculum("random")[0])
    rows = [(0, 1, "1.1.1", "1.1", "1", "1.1.1;2.1.1"), (1, 2, "2.1.1", "2.1", "2", "2.1.1")]
    b = spark.createDataFrame(rows, "pos long, doc_id long, leaf string, parent string, grand string, gold string").withColumn("batch", F.lit(0)).withColumn("gold", F.split("gold", ";"))
    assert bt.false_negatives(b).first()["fraction"] == 0.5
    many = spark.createDataFrame([(i, i % 40, f"{i % 3}.{i % 7}.{i % 50}", f"{i % 3}.{i % 7}", f"{i % 3}", f"{i % 3}.{i % 7}.{i % 50}", 1.0) for i in range(160)], "row_id long, doc_id long, leaf string, parent string, grand string, gold string, weight double")
    plan = bt.batch_plan(many, 2, bt.BatchConfig(size=8)).join(many, "row_id")
    assert plan.count() == 320 and plan.groupBy("epoch").agg(F.countDistinct("row_id").alias("n")).where("n <> 160").count() == 0
    assert bt.replayed(plan.select("epoch", "batch", "row_id"), 9).select("epoch").distinct().first()[0] == 2


def test_picker_and_tail():
    import pandas as pd

    rows = pd.DataFrame([(i, i, f"1.1.{i}", "1.1", "1", f"1.1.{i}", 1.0, [1.0, 0.0], [1.0, 0.1 * i]) for i in range(8)], columns=["row_id", "doc_id", "leaf", "parent", "grand", "gold", "weight", "seg_vec", "pos_vec"])
    assert sorted(x for b in bt.build_epoch(rows, 1, bt.BatchConfig(size=4, margin=0.1)) for x in b) == list(range(8))
    batch = bt.fill_tail(rows, [2, 5], [0, 1, 7], bt.BatchConfig(size=4))
    assert batch[:2] == [2, 5] and len(set(batch)) == 4 and set(batch[2:]) <= {0, 1, 7}
    with pytest.raises(ValueError):
        bt.fill_tail(rows, [1], [1], bt.BatchConfig())
    assert (bt.batch_count(10, 4), bt.batch_count(10, 4, False)) == (2, 3)


def test_rerank_scores(spark):
    got = spark.createDataFrame([(0.0,), (5.0,), (1.4,), (-0.2,)], "x double").select(an.sigmoid("x"), an.clipped("x")).collect()
    assert [round(r[0], 6) for r in got[:2]] == [0.5, 0.731059] and [r[1] for r in got[2:]] == [1.0, 0.0]


def test_similarity_in_blocks(spark):
    segs = spark.createDataFrame([(1, i, [float(i), 1.0]) for i in range(4)], "doc_id int, segment_index int, embedding array<float>")
    comps = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)] + [(9, None)], "comp_id int, embedding array<float>")
    rows = lambda b: sorted(map(tuple, an.pair_scores(segs, comps, 2.0, b).collect()))
    assert rows(100) == rows(2) == sorted((1, i, j, float(i + j)) for i in range(4) for j in range(5) if i + j >= 2)


def test_context_of_a_hot_document(spark):
    """Neighbours are found across ranges, and every row keeps its place in a result."""
    text = lambda i: None if i % 17 == 3 else f"{i} " * (150 if i % 5 == 0 else 1)
    rows = [("hot", i, text(i)) for i in range(300)] + [(f"d{i % 9}", i, text(i)) for i in range(40)] + [(None, i, text(i)) for i in range(3)]
    by: dict = {}
    for d, i, t in rows:
        by.setdefault(d, []).append((i, t))
    side = lambda t: t[:200] + "..." if t and len(t) > 200 else t
    want = {}
    for d, some in by.items():
        for k, (i, t) in enumerate(some):
            near = [side(some[k - 1][1]) if k else None, t, t, side(some[k + 1][1]) if k + 1 < len(some) else None]
            want[d, i] = t if t and len(t) > 100 else "  ".join(x for x in near if x is not None)
    df = spark.createDataFrame(rows, "doc_id string, segment_index int, segment_text string")
    for ranges in (None, 7):
        got = an.with_context(df, 100, ranges=ranges).collect()
        assert len(got) == len(rows) and {(r.doc_id, r.segment_index): r.context_text for r in got} == want


def test_context_window_has_every_segment(spark):
    from lotsman.plans.reference_queries import QUERIES

    d = "/root/testdata/sf0.01"
    if not os.path.exists(d):
        pytest.skip("no test tables")
    rows = spark.read.parquet(f"{d}/gisnauka_segments_train_augmented.parquet").select("row_id", "doc_id", "segment_text")
    got = {r.row_id: r.context_text for r in QUERIES["context_window"](spark, d).collect()}
    all_rows = {r.row_id: r for r in rows.collect()}
    assert set(got) == set(all_rows)
    hot = sorted(i for i, r in all_rows.items() if r.doc_id == "gisnauka_0")
    short = [k for k in range(1, len(hot)) if len(all_rows[hot[k]].segment_text or "") <= 100 and all_rows[hot[k - 1]].segment_text]
    assert len(hot) > 14 and short and all(got[hot[k]].startswith(all_rows[hot[k - 1]].segment_text[:200]) for k in short)


def test_negatives_of_every_document(spark):
    from lotsman.plans.reference_queries import QUERIES

    d = "/root/testdata/sf0.01"
    if not os.path.exists(d):
        pytest.skip("no test tables")
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    copies: dict = {}
    for i, t in text.items():
        copies.setdefault(t if t and t.strip() else i, set()).add(i)
    got: dict = {}
    for r in QUERIES["neg_sampling"](spark, d).collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert max(map(len, copies.values())) > 1 and set(got) == set(text)
    for same in copies.values():
        for i in same:
            assert len(got[i]) == len(set(got[i])) == len(same) and not same & set(got[i])
