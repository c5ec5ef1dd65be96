"""Scans and sinks: sample and segment CSV, gold JSON lines, search hits, text and DOCX folders, vectors, batch plans."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotsman.functions.text import clean_codes, code_list, is_leaf, missing, plain_spaces, repaired_json, rubric_id, strip, tight_bullets, without_watermarks


def read_csv(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """All columns as strings, with ``row_ord``: the number of the row, files by name and rows as in the file.

    A file that may hold line breaks within fields is read by one task, so numbers within it follow its order; only the
    numbers of rows by file reach the driver.
    """
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', maxCharsPerColumn=-1)
    lacking = set(required) - set(df.columns)
    if not df.columns or lacking:
        raise ValueError(f"columns are missing: {sorted(lacking)}")
    placed = df.withColumn("_file", F.col("_metadata.file_path")).withColumn("_i", F.monotonically_increasing_id())
    files = sorted((r["_file"], r["n"], r["least"]) for r in placed.groupBy("_file").agg(F.count(F.lit(1)).alias("n"), F.min("_i").alias("least")).collect())
    if not files:
        return df.withColumn("row_ord", F.lit(None).cast("bigint"))
    shift, at = {}, 0
    for name, n, least in files:
        shift[name], at = at - least, at + n
    offset = F.create_map(*[x for name, o in shift.items() for x in (F.lit(name), F.lit(o))])
    return placed.withColumn("row_ord", F.col("_i") + offset[F.col("_file")]).drop("_file", "_i")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments with their leaf codes, order and repeats kept; a missing doc_id is ``valid_{row}``."""
    df = read_csv(spark, path, ("segment_text", "grnti_codes"))
    return df.select("row_ord", F.coalesce(missing("doc_id"), F.concat(F.lit("valid_"), F.col("row_ord").cast("string"))).alias("doc_id"), strip("segment_text").alias("segment_text"), code_list("grnti_codes").alias("codes"))


def read_gold_jsonl(spark: SparkSession, path: str, texts_dir: str | None = None, keep_empty: bool = False) -> DataFrame:
    """(doc_id, gold_codes, text_path): codes are strings or objects with ``code``, under ``gold_codes`` or ``labels``."""
    lines = spark.read.text(path).select(F.from_json("value", "doc_id string, text_path string, gold_codes string, labels string", {"mode": "PERMISSIVE"}).alias("j")).select("j.*")
    raw = F.coalesce("gold_codes", "labels", F.lit("[]"))
    plain = F.from_json(raw, "array<string>")
    objects = F.transform(F.from_json(raw, "array<struct<code:string>>"), lambda x: x.code)
    found = F.transform(F.coalesce(F.filter(plain, lambda x: ~x.startswith("{")), F.array().cast("array<string>")), lambda x: strip(x))
    all_codes = F.array_union(found, F.coalesce(objects, F.array().cast("array<string>")))
    codes = F.array_sort(F.array_distinct(F.filter(all_codes, lambda x: is_leaf(x))))
    folder = texts_dir or path.rsplit("/", 1)[0]
    out = lines.select(strip("doc_id").alias("doc_id"), codes.alias("gold_codes"), F.coalesce(missing("text_path"), F.concat(F.lit(folder + "/"), "doc_id", F.lit(".txt"))).alias("text_path")).where("doc_id <> ''")
    return out if keep_empty else out.where(F.size("gold_codes") > 0)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    from lotsman.operators.datasets import gold_items

    if path.endswith(".csv"):
        rows = read_csv(spark, path, ("title", "abstract", "grnti_codes"))
        rows = rows if "doc_id" in rows.columns else rows.withColumn("doc_id", F.lit(None).cast("string"))
        rows = rows if "top_code" in rows.columns else rows.withColumn("top_code", F.lit(None).cast("string"))
        return gold_items(rows.withColumnRenamed("row_ord", "row_id"))
    return read_gold_jsonl(spark, path)


HIT = "struct<name:string,abstract:string,nioktr:struct<annotation:string>,rubrics:array<struct<code:string>>>"


def hit_columns(source: Column | str) -> list[Column]:
    """title, abstract (else the annotation) and leaf codes, each once in order, of a search hit."""
    h = F.col(source) if isinstance(source, str) else source
    rubrics = F.coalesce(h.rubrics, F.array().cast("array<struct<code:string>>"))
    codes = F.array_distinct(F.filter(F.transform(rubrics, lambda r: strip(r.code)), lambda x: is_leaf(x)))
    return [strip(h["name"]).alias("title"), F.coalesce(missing(h.abstract), missing(h.nioktr.annotation), F.lit("")).alias("abstract"), codes.alias("codes")]


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """(query, page, title, abstract, codes) of landed pages of search results; query and page come from folders named
    ``query=…/page=…`` and are null without them."""
    pages = spark.read.schema(f"hits struct<hits:array<struct<_source:{HIT}>>>").option("recursiveFileLookup", "true").json(path, multiLine=True)
    part = lambda k: F.nullif(F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), rf"/{k}=([^/]*)", 1)), F.lit(""))
    hits = pages.select(part("query").alias("query"), part("page").cast("int").alias("page"), F.explode("hits.hits").alias("h"))
    return hits.select("query", "page", *hit_columns("h._source"))


def hits_of_codes(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """Hits of searches by rubric that hold the code searched for: ``query`` is the id built from the code."""
    wanted = targets.select(F.col("code").alias("target"), rubric_id("code").alias("query"))
    return hits.join(wanted, "query").where(F.expr("array_contains(codes, target)"))


def usable_hits(hits: DataFrame, least_codes: int = 2, both: bool = True) -> DataFrame:
    title, abstract = F.col("title") != "", F.col("abstract") != ""
    return hits.where(((title & abstract) if both else (title | abstract)) & (F.size("codes") >= least_codes))


def decoded(content: Column | str) -> Column:
    """Bytes as UTF-8; what is none becomes the replacement character."""
    return F.make_valid_utf8((F.col(content) if isinstance(content, str) else content).cast("string"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text), a file a document; bytes that are no UTF-8 are replaced."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("doc_id"), decoded("content").alias("text"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error): text files decoded, DOCX files converted, an error for every other kind."""
    files = spark.read.format("binaryFile").load(path).select("path", "content", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("kind"))
    texts = files.where("kind = 'txt'").select("path", decoded("content").alias("text"), F.lit(None).cast("string").alias("error"))
    others = files.where("kind not in ('txt', 'docx')").select("path", F.lit(None).cast("string").alias("text"), F.concat(F.lit("unsupported kind: "), "kind").alias("error"))
    return texts.unionByName(_converted(files.where("kind = 'docx'"))).unionByName(others)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    """Paragraphs of a DOCX file, without headers and drawings (which hold watermarks)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    lines = []
    for p in body.iter(f"{_W}p"):
        parts = []
        for e in p.iter():
            parts += [e.text or ""] if e.tag == f"{_W}t" else ["\t"] if e.tag == f"{_W}tab" else ["\n"] if e.tag == f"{_W}br" else []
        lines.append("".join(parts))
    return "\n".join(lines).strip("\n")


def _converted(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, data in zip(b["path"], b["content"]):
                try:
                    rows.append((p, docx_text(bytes(data)), None))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows.append((p, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    got = files.select("path", "content").mapInPandas(run, "path string, text string, error string")
    return got.withColumn("text", tight_bullets(plain_spaces(without_watermarks("text"))))


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error): a broken file gives its error, not a failure."""
    return _converted(spark.read.format("binaryFile").load(path))


def convert_docx(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Writes (doc_id, text) of the files that could be read as Parquet to ``target``; returns (path, error) of all."""
    got = read_docx(spark, source)
    got.where("error is null").select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("doc_id"), "text").write.mode("overwrite").parquet(target)
    return got.select("path", "error")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, embedding) of an NPZ file of ids and a two-dimensional matrix, which the driver reads: a way in for the
    vectors of an ontology; larger sets are Parquet tables."""
    import numpy as np
    import pyarrow as pa

    with np.load(path, allow_pickle=False) as z:
        ids, m = z["ids"], np.asarray(z["embeddings"], np.float32)
    if m.ndim != 2:
        raise ValueError("embeddings are not two-dimensional")
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
    return spark.createDataFrame(pa.table({"id": pa.array([str(i) for i in ids], pa.string()), "embedding": lists}), "id string, embedding array<float>")


def read_scored_pairs(df: DataFrame) -> DataFrame:
    """(sentence1, sentence2, label): score / 5, at least 0; blank sentences are left out."""
    score = F.col("score").cast("double")
    return df.where(missing("sentence1").isNotNull() & missing("sentence2").isNotNull()).select("sentence1", "sentence2", F.when(score > 0, score / 5).otherwise(0.0).alias("label"))


def read_triplets(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema("anchor string, positive string, negative string").json(path)
    return df.where(" and ".join(f"coalesce({c}, '') <> ''" for c in df.columns))


def not_done(rows: DataFrame, done: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows whose id has no result yet."""
    return rows.join(done.select(id_col).distinct(), id_col, "left_anti")


def repaired_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (value) with ``ok``, doc_id, gold_codes and evidence of each repaired JSON line that is not blank.

    Codes lose leading commas; a key ``,evidence`` counts as ``evidence``.  A line that is no JSON object after repair
    is not ok.
    """
    others = [c for c in lines.columns if c != "value"]
    j = lines.where(missing("value").isNotNull()).withColumn("j", F.try_parse_json(repaired_json("value")))
    ok = F.coalesce(F.schema_of_variant("j").startswith("OBJECT"), F.lit(False))
    at = lambda p, t: F.when(F.col("ok"), F.try_variant_get("j", p, t))
    kept = j.withColumn("ok", ok)
    evidence = F.coalesce(at("$.evidence", "variant"), at("$[',evidence']", "variant"))
    return kept.select(*others, "value", "ok", at("$.doc_id", "string").alias("doc_id"), clean_codes(at("$.gold_codes", "array<string>")).alias("gold_codes"), F.to_json(evidence).alias("evidence"))


def repair_counts(lines: DataFrame) -> DataFrame:
    """One row (ok, dropped) of ``repaired_lines``."""
    return repaired_lines(lines).agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("dropped"))


def read_benchmark(corpus: DataFrame, queries: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, text), (query_id, text), (query_id, doc_id, score) of a retrieval benchmark.

    Ids are under ``_id`` or ``id``, in qrels under ``query-id`` or ``query_id`` and ``corpus-id``, ``doc_id`` or
    ``corpus_id``; a document's text is ``text``, else its title and body; a query's is ``text`` or ``query``; a missing
    score is 1.  Rows without id or text are left out; of several rows with one id one counts, the last by ``ord``
    where there is such a column.
    """
    def first(df: DataFrame, *names: str) -> Column:
        have = [F.nullif(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names if n in df.columns]
        return F.coalesce(*have, F.lit(None).cast("string"))

    def last(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
        order = F.struct(F.col("ord") if "ord" in df.columns else F.lit(0), value)
        return df.groupBy(*keys).agg(F.max(order).alias("_o"))

    body = F.nullif(strip(F.concat_ws(" ", first(corpus, "title"), F.coalesce(first(corpus, "body"), first(corpus, "processed_text")))), F.lit(""))
    docs = corpus.withColumn("doc_id", first(corpus, "_id", "id")).withColumn("_t", F.coalesce(first(corpus, "text"), body)).where("doc_id is not null and _t is not null")
    asked = queries.withColumn("query_id", first(queries, "_id", "id")).withColumn("_t", first(queries, "text", "query")).where("query_id is not null and _t is not null")
    score = F.coalesce(F.col("score").cast("double"), F.lit(1.0)) if "score" in qrels.columns else F.lit(1.0)
    rel = qrels.withColumns({"query_id": first(qrels, "query-id", "query_id"), "doc_id": first(qrels, "corpus-id", "doc_id", "corpus_id"), "_t": score}).where("query_id is not null and doc_id is not null")
    return (
        last(docs, ["doc_id"], F.col("_t")).select("doc_id", F.col("_o._t").alias("text")),
        last(asked, ["query_id"], F.col("_t")).select("query_id", F.col("_o._t").alias("text")),
        last(rel, ["query_id", "doc_id"], F.col("_t")).select("query_id", "doc_id", F.col("_o._t").alias("score")),
    )


def model_tag(name: str) -> str:
    """The last part of a model's name or path, as a part of a file name."""
    tag = name.strip().rstrip("/").rsplit("/", 1)[-1]
    return tag.replace(" ", "_").replace("\\", "_") or "default"


def vectors_of_model(name: str, registry: dict[str, str]) -> str | None:
    """The file of a model's stored vectors: by its name, else by its resolved path; only if the file exists."""
    import os

    raw = name.strip()
    for key in (raw, os.path.realpath(raw)) if raw else ():
        if key in registry and os.path.exists(registry[key]):
            return registry[key]
    return None


def write_csv(df: DataFrame, path: str) -> None:
    """All rows with a header; quotes are doubled, so line breaks and quotes in fields come back."""
    df.write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def append_pages(existing: DataFrame, pages: list[DataFrame], path: str) -> None:
    """One CSV table of the existing rows and the rows of all pages, with the existing columns."""
    out = existing
    for p in pages:
        out = out.unionByName(p.select(*existing.columns))
    write_csv(out, path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a row, null fields kept; writing again replaces the table as a whole."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def json_document(df: DataFrame, keys: dict[str, Column] | None = None, rows: str = "rows") -> DataFrame:
    """One row (value): a JSON document of ``keys`` and of all rows of a report, which has a bound of its own."""
    items = df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(rows))
    return items.select(F.to_json(F.struct(*[c.alias(k) for k, c in (keys or {}).items()], rows), {"ignoreNullFields": "false"}).alias("value"))


def write_vectors(df: DataFrame, path: str) -> None:
    """(id, embedding) as Parquet."""
    df.select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def export_vectors(df: DataFrame, path: str) -> None:
    """(id, embedding) as an NPZ file of ids and a matrix, ordered by id: for the vectors of an ontology, which the
    driver can hold."""
    import numpy as np

    got = df.select(F.col("id").cast("string").alias("id"), "embedding").orderBy("id").toArrow()
    np.savez_compressed(path, ids=np.array(got["id"].to_pylist(), dtype=str), embeddings=np.array(got["embedding"].to_pylist(), np.float32))


def segment_lists(segments: DataFrame) -> DataFrame:
    """(doc_id, value): the segments of each document in order, as a JSON list."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("segment_index", "segment_text"))), lambda x: x.segment_text)
    return segments.groupBy("doc_id").agg(F.to_json(ordered).alias("value"))


def annotation_documents(anns: DataFrame, params: dict[str, str], top_n: int) -> DataFrame:
    """(doc_id, value): a JSON object of source, params and the first ``top_n`` annotations by rank."""
    item = F.struct(*[c for c in anns.columns if c != "doc_id"])
    kept = anns.where(F.col("rank") <= top_n).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("a")))).alias("l"))
    fixed = F.create_map(*[F.lit(x) for kv in sorted(params.items()) for x in kv]) if params else F.create_map().cast("map<string,string>")
    body = F.struct(F.col("doc_id").cast("string").alias("source"), fixed.alias("params"), F.transform("l", lambda x: x.a).alias("annotations"))
    return kept.select("doc_id", F.to_json(body).alias("value"))


def write_plan(plan: DataFrame, path: str, config: dict) -> None:
    """A batch plan with one row of metadata beside it."""
    import json

    plan.write.mode("overwrite").parquet(f"{path}/batches")
    meta = json.dumps(config, sort_keys=True)
    plan.agg(F.count(F.lit(1)).alias("dataset_size")).select(F.lit(1).alias("format_version"), "dataset_size", F.lit(meta).alias("args"), F.left(F.sha1(F.lit(meta)), F.lit(10)).alias("config_id")).write.mode("overwrite").parquet(f"{path}/meta")


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    version = spark.read.parquet(f"{path}/meta").first()["format_version"]
    if version != 1:
        raise ValueError(f"unknown plan version {version}")
    return spark.read.parquet(f"{path}/batches")


def checked_plan(plan: DataFrame, rows: DataFrame, size: int, drop_last: bool, stored: dict | None = None) -> DataFrame:
    """``plan`` (epoch, batch, pos, row_id) if it fits the rows and settings, else an error.

    Every epoch must have as many batches as the others, every row id must be one of ``rows``, batches hold ``size``
    rows (the last of an epoch fewer where ``drop_last`` is off), and the stored settings must agree.
    """
    for k, v in (("batch_size", size), ("drop_last", drop_last)):
        if stored and k in stored and stored[k] != v:
            raise ValueError(f"{k} is {v}, the plan was made with {stored[k]}")
    if stored and "dataset_size" in stored and stored["dataset_size"] != rows.count():
        raise ValueError("the plan was made for another number of rows")
    epochs = plan.groupBy("epoch").agg(F.countDistinct("batch").alias("n")).agg(F.min("n").alias("a"), F.max("n").alias("b")).first()
    if epochs["a"] is None:
        raise ValueError("the plan is empty")
    if epochs["a"] != epochs["b"]:
        raise ValueError("epochs differ in their number of batches")
    if not plan.join(rows.select("row_id").distinct(), "row_id", "left_anti").isEmpty():
        raise ValueError("the plan names rows that are not there")
    sizes = plan.groupBy("epoch", "batch").agg(F.count(F.lit(1)).alias("n"))
    short = sizes.where(F.col("n") != size).groupBy("epoch").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"))
    if not short.where((F.col("n") > size) | F.lit(drop_last) | (F.col("k") > 1)).isEmpty():
        raise ValueError("batches are not of the stated size")
    return plan
