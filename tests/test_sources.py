import io
import zipfile

from lotsman.sources import io as sources

DOC = '<?xml version="1.0"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Один</w:t></w:r></w:p><w:p><w:r><w:t>Два</w:t></w:r></w:p></w:body></w:document>'


def test_docx(spark, tmp_path):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", DOC)
    (tmp_path / "a.docx").write_bytes(b.getvalue())
    (tmp_path / "b.docx").write_bytes(b"broken")
    got = {r.path[-6:]: (r.text, r.error is None) for r in sources.read_docx(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": ("Один\nДва", True), "b.docx": (None, False)}


def test_csv_and_gold(spark, tmp_path):
    (tmp_path / "s.csv").write_text('title,abstract,grnti_codes\nА,"Б\nв",11.22.33; 44.55.66;x\n,,11.22.33\nГ,Д,\n')
    got = sources.read_gold(spark, str(tmp_path / "s.csv")).collect()
    assert [(r.gold_codes, r.text, r.top_code) for r in got] == [(["11.22.33", "44.55.66"], "А\n\nБ\nв", "11")]
    (tmp_path / "g.jsonl").write_text('{"doc_id":"a","gold_codes":["1.2.3","x"]}\n{"doc_id":"b","labels":[{"code":"4.5.6"}]}\n{"doc_id":"","labels":["1.2.3"]}\n{"doc_id":"c"}\n')
    got = sorted((r.doc_id, r.gold_codes) for r in sources.read_gold(spark, str(tmp_path / "g.jsonl")).collect())
    assert got == [("a", ["1.2.3"]), ("b", ["4.5.6"])]


def test_hits_and_links(spark, tmp_path):
    from lotsman.operators.ontology import levels_from_links, parse_links

    (tmp_path / "h.json").write_text('{"hits":{"hits":[{"_source":{"name":" Т ","nioktr":{"annotation":"А"},"rubrics":[{"code":"1.2.3"},{"code":"1.2.3"},{"code":"4.5.6"},{"code":"7"}]}}]}}')
    r = sources.usable_hits(sources.read_hits(spark, str(tmp_path / "h.json"))).first()
    assert (r.title, r.abstract, r.codes) == ("Т", "А", ["1.2.3", "4.5.6"])
    html = '<a href="?p1=27">27 Мат</a><a class="x" href="?p1=27&p2=27.01">27.01 <b>Общие</b></a><a href="?p1=27&amp;p2=27.01&amp;p3=27.01.02">27.01.02 Тема</a><a href="?p1=27&p2=27.01&p3=28.01.02">28.01.02 Не то</a>'
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert [(x.code, x.title, x.level, x.parent) for x in levels_from_links(parse_links(pages)).collect()] == [("27", "Мат", 1, None), ("27.01", "Общие", 2, "27"), ("27.01.02", "Тема", 3, "27.01")]
