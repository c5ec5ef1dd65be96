"""Building and auditing datasets: de-duplication against a split, splits, balancing, quotas, statistics, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotsman.functions.text import code_list, document_text, grand_of, missing, strip
from lotsman.session import stash


#: Parts into which the rows of a class are hashed before the first ones are taken.
PARTS_OF_CLASS = 32
#: Rows of a class up to which those that its parts put forward are ranked by one task.
RANKED = 20_000


def shuffled(seed: int, *cols: str) -> Column:
    """A reproducible random order: a digest of the seed and the columns."""
    return F.md5(F.concat_ws("~", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def record_key(df: DataFrame, title: str = "title", abstract: str = "abstract") -> DataFrame:
    """``df`` with key columns kt, ka; rows without title and abstract are left out of it."""
    keyed = df.withColumn("kt", F.lower(strip(title))).withColumn("ka", F.lower(strip(abstract)))
    return keyed.where((F.col("kt") != "") | (F.col("ka") != ""))


def without_keys_of(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train rows whose key is not in test; rows with blank title and abstract stay."""
    keyed = train.withColumn("kt", F.lower(strip("title"))).withColumn("ka", F.lower(strip("abstract")))
    return keyed.join(record_key(test).select("kt", "ka").distinct(), ["kt", "ka"], "left_anti").drop("kt", "ka")


def common_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return record_key(a).select("kt", "ka").intersect(record_key(b).select("kt", "ka"))


def gold_items(samples: DataFrame, fallback_prefix: str = "gisnauka_") -> DataFrame:
    """(row_ord, doc_id, gold_codes, text, top_code) of sample rows with leaf codes and a text."""
    codes = F.array_sort(F.array_distinct(code_list("grnti_codes")))
    rows = samples.select(F.col("row_id").alias("row_ord"), F.coalesce(missing("doc_id"), F.concat(F.lit(fallback_prefix), F.col("row_id").cast("string"))).alias("doc_id"), codes.alias("gold_codes"), document_text("title", "abstract").alias("text"), missing("top_code").alias("_t"))
    return rows.where((F.size("gold_codes") > 0) & (F.col("text") != "")).withColumn("top_code", F.coalesce("_t", grand_of(F.get("gold_codes", F.lit(0))))).drop("_t")


def first_per_class(df: DataFrame, cls: str, order: str) -> DataFrame:
    """``df`` with split: the row of each class that is first by ``order`` (unique), is test, the others train.

    The first is a minimum, counted map-side, so a class of any size costs a row a task.
    """
    first = df.groupBy(cls).agg(F.min(order).alias(order)).select(F.col(cls).alias("_c"), F.col(order).alias("_f"))
    met = df.join(first, (F.col("_f") == F.col(order)) & F.col("_c").eqNullSafe(F.col(cls)), "left")
    return met.withColumn("split", F.when(F.col("_f").isNotNull(), "test").otherwise("train")).select(*df.columns, "split")


def head_by_order(df: DataFrame, order: str, id_col: str, size: int) -> DataFrame:
    """``df`` with ``chosen``: the first ``size`` rows by the text column ``order``, then id.

    Rows are counted by the first four hex digits of the digest, which bounds what the driver sees by 65,536; only the
    rows of one such part are ranked.
    """
    part = F.left(F.col(order), F.lit(4))
    counts = sorted((r["p"], r["n"]) for r in df.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    left, end = size, None
    for p, n in counts:
        if n > left:
            end = p
            break
        left -= n
    if end is None:
        return df.withColumn("chosen", F.lit(True))
    edge = df.where(part == end).withColumn("_r", F.row_number().over(Window.orderBy(order, id_col)))
    return df.where(part != end).withColumn("chosen", part < end).unionByName(edge.withColumn("chosen", F.col("_r") <= left).drop("_r"))


def half_even(n: int, share: tuple[int, int]) -> int:
    """max(1, round(n * a / b)), halves to the even number; 0 of nothing."""
    a, b = share
    whole, rest = divmod(n * a, b)
    up = 2 * rest > b or (2 * rest == b and whole % 2 == 1)
    return min(n, max(1, whole + up))


def random_split(df: DataFrame, id_col: str, share: tuple[int, int], names: tuple[str, str], seed: int = 42) -> DataFrame:
    """``df`` with split: a random part of the given share under the first name, the rest under the second."""
    keyed = df.withColumn("_o", shuffled(seed, id_col))
    size = half_even(df.count(), share)
    return head_by_order(keyed, "_o", id_col, size).withColumn("split", F.when(F.col("chosen"), names[0]).otherwise(names[1])).drop("_o", "chosen")


def first_of_class(df: DataFrame, cls: list[str], order: list[str], sizes: DataFrame, need: str = "need") -> DataFrame:
    """The first ``need`` rows of each class by ``order`` (unique), where ``sizes`` (class, need) has one row a class.

    Each class is cut into parts of hashed rows; a part's first rows hold the class's first rows, so only ``need`` rows a
    part are ranked again.  Where a class needs more than RANKED rows, these are put in ranges and numbered from the
    counts of the ranges before, so no task sorts a whole class either way.
    """
    kept = df.join(sizes, cls).where(F.col(need) > 0).withColumn("_p", F.pmod(F.xxhash64(*order), F.lit(PARTS_OF_CLASS)))
    in_part = F.row_number().over(Window.partitionBy(*cls, "_p").orderBy(*order))
    heads = kept.withColumn("_r", in_part).where(F.col("_r") <= F.col(need)).drop("_r", "_p")
    if (sizes.agg(F.max(need)).first()[0] or 0) <= RANKED:
        numbered = heads.withColumn("_r", F.row_number().over(Window.partitionBy(*cls).orderBy(*order)))
    else:
        placed = stash(heads.repartitionByRange(*cls, *order).withColumn("_p", F.spark_partition_id()), "ranges")
        earlier = Window.partitionBy(*cls).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        counts = placed.groupBy(*cls, "_p").agg(F.count(F.lit(1)).alias("_n"))
        before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
        number = F.row_number().over(Window.partitionBy(*cls, "_p").orderBy(*order)) + F.col("_before")
        numbered = placed.join(before, [*cls, "_p"]).withColumn("_r", number).drop("_before", "_p")
    return numbered.where(F.col("_r") <= F.col(need)).drop("_r", need)


def balanced(candidates: DataFrame, top: str, code: str, id_col: str, per_top: int | None = None, seed: int = 42) -> DataFrame:
    """``per_top`` rows of each class, over as many codes as there are: one row a code first, then further rows.

    Without ``per_top`` the least number of codes of a class is taken.  The first row of a code is a minimum; the rest
    is drawn by ``first_of_class``.
    """
    if per_top is None:
        per_top = candidates.groupBy(top).agg(F.countDistinct(code).alias("n")).agg(F.min("n")).first()[0] or 0
    keyed = candidates.withColumn("_o", shuffled(seed, id_col))
    least = keyed.groupBy(top, code).agg(F.min(F.struct("_o", id_col)).alias("_m")).select(top, code, F.col("_m._o").alias("_lo"), F.col(f"_m.{id_col}").alias("_li"))
    ranked = keyed.join(least, [top, code]).withColumn("_later", ((F.col("_o") != F.col("_lo")) | (F.col(id_col) != F.col("_li"))).cast("int"))
    sizes = candidates.select(top).distinct().withColumn("need", F.lit(per_top))
    return first_of_class(ranked, [top], ["_later", "_o", id_col], sizes).select(*candidates.columns)


def quota_fill(arrivals: DataFrame, quotas: DataFrame, cls: str, order: list[str]) -> DataFrame:
    """The first ``need`` arrivals of each class; classes are filled independently."""
    return first_of_class(arrivals, [cls], order, quotas.select(cls, "need"))


def unseen_hits(hits: DataFrame, seen: DataFrame, order: str) -> DataFrame:
    """Hits whose title and abstract, case and outer blanks ignored, are not among ``seen``; of equal hits the first by
    ``order`` counts."""
    fresh = without_keys_of(hits, seen).withColumn("kt", F.lower(strip("title"))).withColumn("ka", F.lower(strip("abstract")))
    first = fresh.groupBy("kt", "ka").agg(F.min(order).alias(order))
    return fresh.join(first, ["kt", "ka", order], "left_semi").select(*hits.columns)


def candidates(rows: DataFrame, id_col: str = "row_id") -> DataFrame:
    """(id, segment_text, code, top): one row a leaf code of a row with a text."""
    leaf = rows.where(missing("segment_text").isNotNull()).select(id_col, strip("segment_text").alias("segment_text"), F.explode(code_list("grnti_codes")).alias("code"))
    return leaf.withColumn("top", grand_of("code"))


def filter_summary(rows: DataFrame, below: int = 14, shortest: int = 60, longest_text: int = 600) -> DataFrame:
    """(measure, key, n): rows, rows kept (documents of fewer than ``below`` rows, texts within the lengths), documents
    kept, distinct leaf codes, and occurrences of leaf codes by section, of kept rows."""
    named = rows.select(missing("doc_id").alias("doc_id"), strip("segment_text").alias("t"), "grnti_codes")
    docs = named.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < below).select("doc_id")
    kept = named.join(docs, "doc_id", "left_semi").where(F.length("t").between(shortest, longest_text))
    codes = kept.select(F.explode(code_list("grnti_codes")).alias("code"))
    one = lambda d, name, n: d.select(F.lit(name).alias("measure"), F.lit(None).cast("string").alias("key"), n.alias("n"))
    count = F.count(F.lit(1)).alias("n")
    parts = [
        one(named.agg(count), "rows", F.col("n")), one(kept.agg(count), "kept", F.col("n")), one(docs.agg(count), "documents", F.col("n")),
        one(codes.agg(F.countDistinct("code").alias("n")), "leaves", F.col("n")),
        codes.groupBy(grand_of("code").alias("key")).agg(count).select(F.lit("section").alias("measure"), "key", "n"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def random_rows(df: DataFrame, id_col: str, size: int | None = None, share: tuple[int, int] | None = None, seed: int = 42) -> DataFrame:
    """``size`` rows, or a share of the rows, in a reproducible random choice."""
    n = size if size is not None else df.count() * share[0] // share[1]
    return head_by_order(df.withColumn("_o", shuffled(seed, id_col)), "_o", id_col, n).where("chosen").select(*df.columns)


def document_split(docs: DataFrame, id_col: str, most: int, valid: int, seed: int = 42) -> DataFrame:
    """At most ``most`` documents in a random choice with split: ``valid`` of them are valid, the rest train; a fifth is
    valid where ``valid`` would leave nothing to train on."""
    kept = random_rows(docs, id_col, most, seed=seed)
    n = kept.count()
    size = valid if 0 < valid < n else n // 5
    return head_by_order(kept.withColumn("_o", shuffled(seed + 1, id_col)), "_o", id_col, size).withColumn("split", F.when(F.col("chosen"), "valid").otherwise("train")).select(*docs.columns, "split")


def best_trials(trials: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` trials of a grid search by ``order``."""
    return trials.orderBy(*order).limit(n)


def grid(spark, **values: list) -> DataFrame:
    """Every combination of the values of the parameters, which are few."""
    out = None
    for name, some in values.items():
        one = spark.createDataFrame([(v,) for v in some], [name])
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out


def relevant_texts(corpus: DataFrame, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, doc_id, query, text, score) of the relevance pairs whose query and document both exist."""
    q, c = queries.select("query_id", F.col("text").alias("query")), corpus.select("doc_id", "text")
    return qrels.join(q, "query_id").join(c, "doc_id").select("query_id", "doc_id", "query", "text", "score")


def labelled_pairs(corpus: DataFrame, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, doc_id, label): every query of ``qrels`` with every document, 1 where it is relevant.

    The queries are a stated set against all documents; they are spread over tasks by the documents' partitions.
    """
    asked = queries.select("query_id").distinct().join(qrels.select("query_id").distinct(), "query_id", "left_semi")
    rel = qrels.where("score > 0").select("query_id", "doc_id", F.lit(1.0).alias("label")).distinct()
    lists = asked.agg(F.array_sort(F.collect_list("query_id")).alias("q"))
    every = corpus.select("doc_id").distinct().crossJoin(F.broadcast(lists)).select(F.explode("q").alias("query_id"), "doc_id")
    return every.join(rel, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("label", F.lit(0.0)).alias("label"))


def code_counts(samples: DataFrame) -> DataFrame:
    return samples.select(F.explode(code_list("grnti_codes")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("cnt"))


def deficits(counts: DataFrame) -> DataFrame:
    """(code, cnt, need) of codes below the most frequent one; its count is found apart, without a window over all codes."""
    most = counts.agg(F.max("cnt").alias("most"))
    return counts.crossJoin(F.broadcast(most)).select("code", "cnt", (F.col("most") - F.col("cnt")).alias("need")).where("need > 0")


def capped_documents(segments: DataFrame, below: int = 14) -> DataFrame:
    """Rows of documents with fewer than ``below`` segments; counted map-side, so a hot document costs one row a task."""
    n = segments.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < below)
    return segments.join(n.select("doc_id"), "doc_id", "left_semi")


def statistics(values: DataFrame, col: str) -> DataFrame:
    """One row of n, min, max, mean, median, p90, p95, p99 of integers, where a percentile is the value at floor(p (n - 1)).

    Built from counts by value, with running sums by halves of the value's bits, so no task orders all rows.
    """
    c = values.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("bigint").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    hi = F.shiftright("v", 10)
    blocks = c.groupBy(hi.alias("h")).agg(F.sum("n").alias("bn"))
    before = blocks.withColumn("b0", F.coalesce(F.sum("bn").over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = c.withColumn("h", hi).withColumn("i", F.coalesce(F.sum("n").over(Window.partitionBy("h").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = c.agg(F.sum("n").alias("t"), F.sum(F.col("v") * F.col("n")).alias("s"))
    placed = run.join(F.broadcast(before), "h").crossJoin(F.broadcast(total)).withColumn("i", F.col("i") + F.col("b0"))
    at = lambda q: F.max(F.when((F.col("i") <= q) & (q < F.col("i") + F.col("n")), F.col("v")))
    p = lambda x: at(F.floor(F.col("t").cast("double") * x - x))
    half = lambda k: at(F.floor((F.col("t") - k) / 2))
    return placed.agg(F.max("t").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), (F.max("s") / F.max("t")).alias("mean"), ((half(1) + half(0)) / 2).alias("median"), p(0.9).alias("p90"), p(0.95).alias("p95"), p(0.99).alias("p99"))


def longest(segments: DataFrame, text: str, id_col: str) -> DataFrame:
    """The longest text, the first on a tie: one aggregate, no sort."""
    key = F.struct(F.length(text).alias("n_chars"), (-F.col(id_col)).alias("_i"))
    return segments.where(F.col(text).isNotNull()).agg(F.max(key).alias("k")).where("k is not null").select((-F.col("k._i")).alias(id_col), F.col("k.n_chars").alias("n_chars"))


def distribution(rows: DataFrame, cls: str, code: str) -> DataFrame:
    """(class, n_rows, n_codes, repeats, fraction)."""
    g = rows.groupBy(cls).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(code).alias("n_codes"))
    total = g.agg(F.sum("n_rows").alias("_t"))
    return g.crossJoin(F.broadcast(total)).select(cls, "n_rows", "n_codes", (F.col("n_rows") - F.col("n_codes")).alias("repeats"), (F.col("n_rows") / F.col("_t")).alias("fraction"))


def negatives(queries: DataFrame, docs: DataFrame, qrels: DataFrame, per_relevant: int = 1, buckets: int = 1024, seed: int = 42) -> DataFrame:
    """(query_id, doc_id): for each query ``per_relevant`` documents a relevant one, none of them relevant.

    Documents are numbered in a random order and each query starts at a random number, taking the next ones that are not
    relevant: an equi-join on the numbers instead of all pairs.
    """
    n = docs.count()
    if n == 0:
        return queries.select("query_id", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id")).where("false")
    d = docs.select("doc_id").withColumn("_o", shuffled(seed, "doc_id")).withColumn("_b", F.pmod(F.xxhash64("_o"), F.lit(buckets)))
    sizes = {r["_b"]: r["n"] for r in d.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect()}
    base, at = {}, 0
    for b in sorted(sizes):
        base[b], at = at, at + sizes[b]
    offset = F.create_map(*[x for b, o in base.items() for x in (F.lit(b), F.lit(o))])
    numbered = stash(d.withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy("_o", "doc_id")) - 1 + offset[F.col("_b")]).select("doc_id", "_n"), "numbered")
    want = qrels.groupBy("query_id").agg(F.count(F.lit(1)).alias("_r"))
    q = queries.select("query_id").join(want, "query_id").withColumn("_w", F.col("_r") * per_relevant)
    tries = q.withColumn("_t", F.explode(F.sequence(F.lit(0), F.least(F.col("_w") + F.col("_r"), F.lit(n)) - 1)))
    tries = tries.withColumn("_n", F.pmod(F.xxhash64(F.lit(seed), "query_id") + F.col("_t"), F.lit(n)))
    free = tries.join(numbered, "_n").join(qrels.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return free.withColumn("_k", F.row_number().over(Window.partitionBy("query_id").orderBy("_t"))).where(F.col("_k") <= F.col("_w")).select("query_id", "doc_id")


def prompts(segments: DataFrame, most: int = 60) -> DataFrame:
    """(doc_id, prompt): the first ``most`` segments with a text of each document, numbered, each cut to 600 code points."""
    from lotsman.functions.text import truncated

    rows = segments.where(missing("segment_text").isNotNull()).select("doc_id", "segment_index", truncated(strip("segment_text")).alias("t"))
    sizes = rows.select("doc_id").distinct().withColumn("need", F.lit(most))
    first = first_of_class(rows, ["doc_id"], ["segment_index"], sizes)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("segment_index", "t"))), lambda x, i: F.concat((i + 1).cast("string"), F.lit(") "), x.t))
    return first.groupBy("doc_id").agg(F.array_join(ordered, "\n").alias("prompt"))
