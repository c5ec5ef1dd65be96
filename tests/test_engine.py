import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lotsman.operators import annotate as an
from lotsman.operators import batching as bt
from lotsman.operators import datasets as ds
from lotsman.operators import engine as en
from lotsman.operators import ontology as on
from lotsman.operators import segment as sg
from lotsman.sources import io

NODES = "node_ord long, id string, label string, full_label string, description string, code string, llm_description string"


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [(0, "a", "Горные машины", None, "Проходка", "01.02.03", None), (1, "b", "Право", "Раздел: Право", None, "04.05.06", "Суд и закон"), (2, "c", "", " ", None, None, None)]
    return spark.createDataFrame(rows, NODES)


def engine(nodes, **more):
    return en.Engine(nodes, en.hash_encoder(64), config=an.Config(0.3, 3), **more)


def test_texts_to_annotations(spark, nodes):
    told = []
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "comp_id string, embedding array<float>")
    by_length = en.arrow_encoder(lambda texts: np.array([[1.0, 0.0] if "горн" in t.lower() else [0.0, 1.0] for t in texts]))
    e = en.Engine(nodes, by_length, vectors, config=an.Config(0.5, 2), progress=lambda s, f: told.append(s))
    docs = spark.createDataFrame([(1, "Первая горная машина работает долго. Вторая горная машина стоит в шахте. Третья горная машина в ремонте."), (2, None), (3, " "), (4, "Да."), (None, "Горная машина без документа.")], "doc_id int, text string")
    got = e.annotate(docs).collect()
    assert [(r.doc_id, r.comp_id, r.segment_count, r.doc_score, r.label, r.full_label) for r in got] == [(1, "a", 2, 2.0, "Горные машины", "Горные машины")]
    assert [m.segment[:6] for m in got[0].matches] == ["Первая", "Вторая"] and set(told) == {"segments", "context", "vectors", "matching"}
    assert en.annotate_document("Да.", e).count() == 0
    assert [r.comp_id for r in en.annotate_document("Эта горная машина работает без остановки.", e).collect()] == ["a"]
    report = en.evaluate(e, docs.where("doc_id is not null"), spark.createDataFrame([(1, "01.02.03"), (1, "09.09.09"), (2, "01.02.03")], "doc_id int, code string"), 5).first()
    assert (report.recall, report.precision, report.n, report.skipped) == (0.5, 1.0, 1, 3)


def test_context_and_rerank(spark, nodes):
    seen = []
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [1.0])], "comp_id string, embedding array<float>")
    def encode(texts):
        seen.append(None)
        return np.ones((len(texts), 1))
    model = lambda pairs: pairs.withColumn("raw", F.when(F.col("query") == "Горные машины. Проходка", F.when(F.col("text").startswith("Первый"), 0.9).otherwise(0.1)).otherwise(0.2))
    segments = spark.createDataFrame([("d", i, t) for i, t in enumerate(["Первый сегмент текста.", "Второй сегмент текста.", "Короткий"])], "doc_id string, segment_index int, segment_text string")
    e = en.Engine(nodes, en.arrow_encoder(encode), vectors, model, "some-russian-model", an.Config(0.5, 2, 2), 50)
    got = e.annotate_segments(segments).collect()
    assert [(r.comp_id, [m.segment for m in r.matches]) for r in got] == [("a", ["Первый сегмент текста."])]
    assert en.normal_form("other")(F.lit(0.0)) is not None
    assert spark.range(1).select(en.normal_form("other")("id").alias("x")).first().x == 0.5


def test_whole_documents_are_annotated_like_pairs(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = lambda n: rng.integers(-1, 2, (n, 4)).astype(float).tolist()
    docs = [None if d == 39 else f"d{d}" for d in range(40) for _ in range(d % 9)]
    segs = spark.createDataFrame([(d, 1000 - i, v) for i, (d, v) in enumerate(zip(docs, vectors(len(docs))))] + [("d1", 2000, None), ("none", 0, None)], "doc_id string, segment_index int, embedding array<double>").repartition(3)
    comps = spark.createDataFrame([(f"c{c:02}", v) for c, v in enumerate(vectors(30))] + [("none", None)], "comp_id string, embedding array<double>")
    score = lambda pairs: pairs.withColumn("cross_score", (F.col("segment_index") * 7 + F.hash("comp_id")) % 4 + 0.5)
    key = lambda df: sorted((str(r.doc_id), r["rank"], r.comp_id, *(round(r[c], 9) for c in ("doc_score", "max_confidence", "sum_score", "mean_score")), r.segment_count, [tuple(m) for m in r.matches]) for r in df.collect())
    monkeypatch.setattr(an, "METHODS", (*an.METHODS, "unknown"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for cfg, scorer in [*((an.Config(1.0, 3, 0, m), None) for m in an.METHODS), *((an.Config(1.0, 2, 4, "sum", u), score) for u in (False, True))]:
            rows = segs if scorer is None else segs.where("doc_id is not null")
            got, want = key(an.whole(rows, comps, cfg, scorer)), key(an.annotate(rows, comps, cfg, scorer))
            assert got == want and len(got) > 200, cfg
            least = an.whole(rows, comps, cfg, scorer, matches=False)
            assert sorted((str(r.doc_id), r["rank"], r.comp_id) for r in least.collect()) == [x[:3] for x in want]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    twice = comps.unionByName(comps.limit(3))
    assert key(an.whole(segs, twice, an.Config(1.0, 3))) == key(an.annotate(segs, twice, an.Config(1.0, 3)))


def test_many_concepts_are_taken_in_slices(monkeypatch):
    rng = np.random.default_rng(2)
    table = pa.table({"doc_id": ["a"] * 5 + ["b"] * 5 + ["c"], "segment_index": list(range(11)), "embedding": rng.integers(-1, 2, (11, 3)).astype(float).tolist()})
    ids, concepts = pa.array([f"c{i:02}" for i in range(20)]), rng.integers(-1, 2, (20, 3)).astype(float)
    run = lambda: sorted(map(str, (r for b in an._of_documents(table, ids, concepts, an.Config(1.0, 2), 2, False, True) for r in b.to_pylist())))
    want = run()
    for cells in (1, 13, 40):
        monkeypatch.setattr(an, "CELLS", cells)
        assert run() == want and len(want) > 20


def test_long_documents_and_short_ones(spark, nodes, monkeypatch):
    text = lambda d, n: " ".join(f"Горная машина номер {d} работает {'в шахте ' * (i % 3)}дня {i}. Да." for i in range(n))
    docs = spark.createDataFrame([(d, text(d, 2 + 3 * d)) for d in range(5)], "doc_id int, text string")
    words = lambda pairs: pairs.withColumn("raw", F.length("text") % 7 - 3.0)
    for more in ({}, {"pair_model": words, "pair_model_name": "own"}):
        e = en.Engine(nodes, en.hash_encoder(4), config=an.Config(0.05, 3, 2), context=60, **more)
        key = lambda df: sorted((r.doc_id, r.comp_id, round(r.doc_score, 9), r.segment_count, r.full_label, [(m.segment_index, m.segment) for m in r.matches]) for r in df.collect())
        monkeypatch.setattr(an, "WHOLE", 4096)
        short = key(e.annotate(docs))
        monkeypatch.setattr(an, "WHOLE", 6)
        assert key(e.annotate(docs)) == short and len({x[0] for x in short}) == 5


def test_pairs_are_not_shuffled(spark, nodes):
    e = en.Engine(nodes, en.hash_encoder(8), config=an.Config(0.3, 3), context=60, matches=False)
    plan = e.annotate(spark.createDataFrame([(1, "Первая горная машина работает долго.")], "doc_id int, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan[: plan.index("MapInArrow")] and plan.count("Exchange") == 1 and plan.count("ArrowEvalPython") == 1


def test_hot_documents_give_the_first_of_each_batch(spark):
    rng = np.random.default_rng(3)
    segs = spark.createDataFrame([("hot", i, v) for i, v in enumerate(rng.integers(-1, 2, (1000, 4)).astype(float).tolist())], "doc_id string, segment_index int, embedding array<double>")
    comps = spark.createDataFrame([(c, v) for c, v in enumerate(rng.integers(-1, 2, (9, 4)).astype(float).tolist())], "comp_id int, embedding array<double>")
    key = lambda df: sorted(map(tuple, an.top_segments(df, 3).collect()))
    few = an.pair_scores(segs, comps, 0.5, keep=3)
    assert key(few) == key(an.pair_scores(segs, comps, 0.5)) and few.count() <= 3 * 9 * 8


@pytest.mark.parametrize("dims", [16, 5])
def test_hash_encoder_counts_words(spark, dims):
    from hashlib import md5

    texts = ["Горная машина, горная-машина 12", None, " . ", "", "Ещё одно слово"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in en.hash_encoder(dims)(rows, "t").collect():
        words = (r.t or "").lower().replace(",", " ").replace("-", " ").replace(".", " ").split()
        v = np.bincount([int(md5(w.encode()).hexdigest()[:4], 16) % dims for w in words], minlength=dims)
        assert r.embedding == (None if not words else (v / np.sqrt((v * v).sum())).tolist())


def test_uninformative_forms_and_ends(spark):
    from lotsman.functions import text as tx

    empty = ["", None, " \u00a0 ", "Коротко", "Техническое задание:::", "\u00a0техническое Задание\n", "РАЗДЕЛ 12. Общие положения", "раздел\u00a03.\t", "Москва и область, г. Москва 2016 ", "Новозаречинск 2016", "12.03.2020 - 15.04.2021", "  12.03.2020 , 15:04 "]
    full = ["Раздел 12. Общие положения 2", "Это обычный сегмент текста:", "Обычный сегмент кончается числом 2016", "12.03.2020 состоялась встреча", "  Отступ не мешает сегменту  "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(empty + full)], "i int, t string").withColumn("e", tx.uninformative("t"))
    assert [r.e for r in rows.orderBy("i").collect()] == [True] * len(empty) + [False] * len(full)
    # Stripped in one place, not once a condition.
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("|[\\s]+$") == 1


def test_pooled_keeps_what_pairs_would(spark):
    rng = np.random.default_rng(0)
    segs = spark.createDataFrame([(int(d), i, rng.standard_normal(4).tolist()) for i, d in enumerate(rng.integers(0, 5, 700))] + [(0, 900, None)], "doc_id int, segment_index int, embedding array<double>")
    comps = spark.createDataFrame([(c, rng.standard_normal(4).round(1).tolist()) for c in range(30)] + [(99, None)], "comp_id int, embedding array<double>")
    key = lambda df: sorted((r.doc_id, r.comp_id, r["rank"], round(r.score, 9)) for r in df.collect())
    assert key(an.pooled(segs, comps, 4)) == key(an.max_pooled(an.pair_scores(segs, comps), 4)) == key(an.pooled(segs, comps, 4, block=7))
    assert an.pooled(segs.limit(0), comps, 4).count() == 0


def test_informative_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(sg, "RANGE", 3)
    rows = [(d, i, "Да." if i % 3 == 1 else f"Достаточно длинный сегмент {i}.") for d in ("x", None) for i in range(20)]
    got = sg.informative(spark.createDataFrame(rows, "doc_id string, segment_index int, segment_text string")).collect()
    for d in ("x", None):
        mine = sorted((r.segment_index, r.segment_text) for r in got if r.doc_id == d)
        assert [i for i, _ in mine] == list(range(13)) and [t for _, t in mine] == [t for e, i, t in rows if e == d and t != "Да."]


def test_segmentation_forms():
    assert sg.is_table("1. Первый\nВторая; строка; тут\nТретья\nЧетвёртая") and sg.is_table("12 слов\nпросто") and not sg.is_table("Одна\nДве\nТри")
    assert sg.segment("1. Первый пункт\nпродолжение пункта\n2. Второй пункт. Ещё фраза.") == ["1. Первый пункт продолжение пункта", "2. Второй пункт.", "Ещё фраза."]
    assert sg.segment("• Первая строка\nхвост строки\n• Вторая строка") == ["Первая строка", "хвост строки", "Вторая строка"]
    assert sg.segment("«Первая фраза. Вторая фраза.» Третья фраза.") == ["«Первая фраза. Вторая фраза.» Третья фраза."] or len(sg.segment("«Первая фраза. Вторая фраза.» Третья фраза.")) == 2
    assert sg.segment("– тире остаётся знаком.") == ["– тире остаётся знаком."] and sg.segment("•слово без пробела.") == ["•слово без пробела."]
    assert sg.segment_plain("Слово пере-\nнесено. 1.\nПункт первый.") == ["Слово перенесено.", "1. Пункт первый."] and sg.segment_plain(None) == []
    assert all(len(x) >= 300 for x in sg.segment_plain("\n".join(f"{i}; столбец; ещё столбец" for i in range(60)))[:-1])


def test_deep_chain_and_cycle(spark):
    links = spark.createDataFrame([(i, f"n{i}", f"n{i + 1}") for i in range(8)] + [(8, "n8", "n0"), (9, None, "n1"), (10, "n1", None)], "link_ord long, source string, target string")
    assert {r.id for r in on.descendants(links, spark.createDataFrame([("n0",)], "root string")).collect()} == {f"n{i}" for i in range(9)}


@pytest.mark.parametrize("ranked", [20_000, 2])
def test_first_of_class_with_a_hot_class(spark, monkeypatch, ranked):
    monkeypatch.setattr(ds, "RANKED", ranked)
    rows = [(i, "hot" if i % 3 else f"c{i % 7}", (i * 37) % 101) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, c string, o int")
    sizes = df.select("c").distinct().withColumn("need", F.lit(5))
    want = {r[0] for c in {r[1] for r in rows} for r in sorted((r for r in rows if r[1] == c), key=lambda r: (r[2], r[0]))[:5]}
    assert {r.id for r in ds.first_of_class(df, ["c"], ["o", "id"], sizes).collect()} == want


def test_picks_are_weighted_and_never_the_first_by_rule():
    import pandas as pd

    n = 40
    rows = pd.DataFrame({"doc_id": range(n), "leaf": [f"{i}" for i in range(n)], "parent": [f"{i}" for i in range(n)], "grand": [f"{i}" for i in range(n)], "gold": [""] * n, "weight": [100.0 if i == 30 else 1.0 for i in range(n)]})
    firsts = [bt.Picker(rows, bt.BatchConfig()).pick((0.6, 0.3, 0.1), np.random.default_rng(s)) for s in range(60)]
    assert firsts.count(30) > 30 and len(set(firsts)) > 5


def test_shards_follow_documents(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"d{i % 50}") for i in range(900)], "row_id long, doc_id string")
    dealt, shards = bt._sharded(rows, 4)
    per = dealt.where("doc_id <> 'hot'").groupBy("doc_id").agg(F.countDistinct("shard").alias("n"))
    assert shards == 4 and per.agg(F.max("n")).first()[0] == 1
    assert dealt.where("doc_id = 'hot'").select("shard").distinct().count() == 4


def test_plan_checks(spark):
    rows = spark.range(8).withColumnRenamed("id", "row_id")
    plan = spark.createDataFrame([(e, i // 4, i % 4, i) for e in (1, 2) for i in range(8)], "epoch int, batch int, pos int, row_id long")
    assert io.checked_plan(plan, rows, 4, True).count() == 16
    for bad, size, drop, stored in ((plan.where("not (epoch = 2 and batch = 1)"), 4, True, None), (plan.withColumn("row_id", F.col("row_id") + 1), 4, True, None), (plan, 3, True, None), (plan.where("row_id <> 7"), 4, True, None), (plan.limit(0), 4, True, None), (plan, 4, True, {"batch_size": 5}), (plan, 4, True, {"dataset_size": 9})):
        with pytest.raises(ValueError):
            io.checked_plan(bad, rows, size, drop, stored)
    assert io.checked_plan(plan.where("row_id <> 7"), rows, 4, False).count() == 14


def test_documents_by_kind(spark, tmp_path):
    import zipfile

    (tmp_path / "a.txt").write_bytes("Текст".encode() + b"\xff\xfe!")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "bad.docx").write_bytes(b"nothing")
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Evaluation Only. Created with Aspose.Words. Copyright Aspose Pty Ltd.</w:t></w:r></w:p><w:p><w:r><w:t>•   пункт\u2060один</w:t></w:r></w:p></w:body></w:document>')
    got = {r.path.rsplit("/", 1)[1]: r for r in io.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"].text == "Текст\ufffd\ufffd!" and got["b.pdf"].error == "unsupported kind: pdf" and "BadZipFile" in got["bad.docx"].error and got["c.docx"].text == "• пункт один"
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in io.convert_docx(spark, str(tmp_path / "*.docx"), str(tmp_path / "out")).collect()}
    assert errors["c.docx"] is None and errors["bad.docx"] and [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["• пункт один"]


def test_model_registry(tmp_path):
    f = tmp_path / "v.npz"
    f.write_bytes(b"x")
    registry = {"org/model": str(f), str(tmp_path / "local"): str(f), "gone": str(tmp_path / "none")}
    assert io.vectors_of_model(" org/model ", registry) == str(f) and io.vectors_of_model(str(tmp_path / "x" / ".." / "local"), registry) == str(f)
    assert io.vectors_of_model("gone", registry) is None and io.vectors_of_model(" ", registry) is None and io.model_tag("org/my model") == "my_model" and io.model_tag("") == "default"


def test_rows_are_numbered_over_several_files(spark, tmp_path):
    for i, name in enumerate(("b.csv", "a.csv")):
        (tmp_path / name).write_text("x,y\n" + "".join(f'{i}{k},"two\nlines"\n' for k in range(3)))
    got = sorted((r.row_ord, r.x) for r in io.read_csv(spark, str(tmp_path)).collect())
    assert got == list(enumerate(["10", "11", "12", "00", "01", "02"]))
    with pytest.raises(ValueError):
        io.read_csv(spark, str(tmp_path), ("z",))
