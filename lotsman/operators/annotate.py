"""Similarity, thresholded top-k, aggregation to document annotations, rerank, roll-up."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotsman.functions.text import is_leaf, to_level
from lotsman.session import stash

#: Concepts of one broadcast block; a larger ontology is matched block by block.
BLOCK = 20_000
#: Segments up to which a document is annotated by one task, without its pairs being shuffled.
WHOLE = 4096
#: Scores that are held at once.
CELLS = 1 << 20
METHODS = ("sum", "max", "mean", "median", "weighted_mean", "sum_log_count", "mean_log_count")


@dataclass(frozen=True)
class Config:
    threshold: float = 0.5
    top_k: int = 10
    rerank_top_k: int = 0
    method: str = "sum"
    use_rerank_score: bool = False


#: The settings that were tuned for evaluation.
EVALUATION = Config(threshold=0.52, top_k=5, method="mean_log_count")


Kernel = Callable[[pa.RecordBatch, np.ndarray, pa.Array], Iterator[pa.RecordBatch]]


def _gathered(comps: DataFrame) -> tuple[pa.Array, np.ndarray]:
    part = comps.toArrow().sort_by("comp_id")
    vectors = part.column("embedding").to_pylist()
    return part.column("comp_id").combine_chunks(), np.array(vectors, np.float64).reshape(len(vectors), len(vectors[0]) if vectors else 0)


def _against(segments: DataFrame, comps: DataFrame, kernel: Kernel, schema: str, block: int) -> DataFrame:
    """``kernel`` over batches of segments and their scores against all concepts.

    Concepts are dealt by a hash of their id into blocks of about ``block`` vectors; each block is broadcast, in order of
    ids, and multiplied with batches of segments.  A concept without a vector is left out.
    """
    rows = comps.where("embedding is not null").select("comp_id", "embedding")
    blocks = max(1, -(-rows.count() // block))
    out = None
    for b in range(blocks):
        some = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("comp_id"), F.lit(blocks)) == b)
        shared = segments.sparkSession.sparkContext.broadcast(_gathered(some))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    some = batch.slice(at, 256)
                    x = np.array(some.column(2).to_pylist(), np.float64).reshape(some.num_rows, -1)
                    if len(ids) and x.shape[1] == matrix.shape[1]:
                        yield from kernel(some, x @ matrix.T, ids)

        one = segments.where("embedding is not null").select("doc_id", "segment_index", "embedding").mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out


def _kinds(segments: DataFrame, comps: DataFrame) -> tuple[str, str, str]:
    return (*(segments.schema[c].dataType.simpleString() for c in ("doc_id", "segment_index")), comps.schema["comp_id"].dataType.simpleString())


def pair_scores(segments: DataFrame, comps: DataFrame, threshold: float | None = None, block: int = BLOCK, keep: int | None = None) -> DataFrame:
    """(doc_id, segment_index, comp_id, score) of all pairs, or those at or above the threshold.

    ``segments`` (doc_id, segment_index, embedding), ``comps`` (comp_id, embedding).  The threshold is applied where the
    scores are made, so a window sees only what passes.  With ``keep``, rows that stand together and are of one document
    give only each concept's first ``keep``, among which are all that ``top_segments`` takes of them.
    """
    def kernel(some: pa.RecordBatch, s: np.ndarray, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        if keep is not None and some.num_rows > keep and len(some.column(0).unique()) == 1:
            by_index = np.argsort(some.column(1).to_numpy(zero_copy_only=False), kind="stable")
            i = by_index[np.argsort(-s[by_index], axis=0, kind="stable")[:keep]]
            j = np.broadcast_to(np.arange(s.shape[1]), i.shape)
            passed = s[i, j] >= threshold if threshold is not None else np.ones(i.shape, bool)
            i, j = i[passed], j[passed]
        else:
            i, j = np.nonzero(s >= threshold) if threshold is not None else np.indices(s.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(i)), some.column(1).take(pa.array(i)), ids.take(pa.array(j)), pa.array(s[i, j])], names=["doc_id", "segment_index", "comp_id", "score"])

    doc, index, comp = _kinds(segments, comps)
    return _against(segments, comps, kernel, f"doc_id {doc}, segment_index {index}, comp_id {comp}, score double", block)


def pooled(segments: DataFrame, comps: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """``max_pooled`` of all pairs without making them: each batch keeps the ``k`` best concepts of each of its documents.

    A concept among the k best of a document is among the k best where its best segment is, so none is lost.
    """
    def kernel(some: pa.RecordBatch, s: np.ndarray, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        code = some.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.diff(code[order], prepend=-1))
        best = np.maximum.reduceat(s[order], first, axis=0)
        top = np.argsort(-best, axis=1, kind="stable")[:, :k]
        docs = np.repeat(order[first], top.shape[1])
        yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(docs)), ids.take(pa.array(top.ravel())), pa.array(np.take_along_axis(best, top, 1).ravel())], names=["doc_id", "comp_id", "score"])

    doc, _, comp = _kinds(segments, comps)
    return max_pooled(_against(segments, comps, kernel, f"doc_id {doc}, comp_id {comp}, score double", block), k)


def top_segments(scores: DataFrame, k: int) -> DataFrame:
    """The k best segments of each document and concept; ties go to the earlier segment."""
    w = Window.partitionBy("doc_id", "comp_id").orderBy(F.desc("score"), "segment_index")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def aggregated(scores: Column, method: str = "sum") -> Column:
    """One score from an array of scores; an unknown method is the sum, an empty array 0."""
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    n = F.size(scores)
    down = F.sort_array(scores, asc=False)
    weight = lambda i: F.greatest(F.lit(0.2), 1 - 0.2 * i)
    middle = lambda i: F.element_at(F.array_sort(scores), i.cast("int"))
    forms = {
        "max": lambda: F.array_max(scores),
        "mean": lambda: total / n,
        "median": lambda: (middle(F.floor((n + 1) / 2)) + middle(F.floor((n + 2) / 2))) / 2,
        "weighted_mean": lambda: F.aggregate(F.transform(down, lambda x, i: x * weight(i)), F.lit(0.0), lambda a, x: a + x) / F.aggregate(F.transform(down, lambda x, i: weight(i)), F.lit(0.0), lambda a, x: a + x),
        "sum_log_count": lambda: total * F.log1p(n.cast("double")),
        "mean_log_count": lambda: total / n * F.log1p(n.cast("double")),
    }
    return F.when(n == 0, 0.0).otherwise(forms.get(method, lambda: total)())


def annotations(top: DataFrame, method: str = "sum") -> DataFrame:
    """(doc_id, comp_id, doc_score, max_confidence, sum_score, mean_score, segment_count, matches)."""
    matches = F.sort_array(F.collect_list(F.struct("score", (-F.col("segment_index")).alias("_i"), "segment_index")), asc=False)
    g = top.groupBy("doc_id", "comp_id").agg(matches.alias("m"))
    s = F.transform("m", lambda x: x.score)
    score = aggregated(s, method)
    return g.select(
        "doc_id", "comp_id", score.alias("doc_score"), score.alias("max_confidence"), aggregated(s).alias("sum_score"), aggregated(s, "mean").alias("mean_score"),
        F.size("m").alias("segment_count"), F.transform("m", lambda x: F.struct(x.segment_index.alias("segment_index"), x.score.alias("score"))).alias("matches"),
    )


def ranked(anns: DataFrame) -> DataFrame:
    """Annotations with their rank in the document: score down, then the order of concepts."""
    return anns.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("doc_score"), "comp_id")))


def annotate(segments: DataFrame, comps: DataFrame, cfg: Config = Config(), scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Ranked annotations of every document.

    With a ``scorer`` (adds ``cross_score`` to doc_id, segment_index, comp_id) and ``rerank_top_k`` above 0, at least
    50 segments a concept are kept at first, the best concepts are scored anew on all their matches, and those without a
    match at the threshold go; the rest follows unchanged.  A document without segments has no annotations.
    """
    again = scorer is not None and cfg.rerank_top_k > 0
    k = max(cfg.top_k, 50) if again else cfg.top_k
    top = top_segments(pair_scores(segments, comps, cfg.threshold, keep=k), k)
    first = ranked(annotations(top, cfg.method))
    return rerank(first, scorer, cfg) if again else first


def rerank(first: DataFrame, scorer: Callable[[DataFrame], DataFrame], cfg: Config) -> DataFrame:
    head = first.where(F.col("rank") <= cfg.rerank_top_k)
    pairs = head.select("doc_id", "comp_id", F.explode("matches").alias("m")).select("doc_id", "comp_id", "m.segment_index")
    scored = scorer(pairs).where(F.col("cross_score") >= cfg.threshold).withColumn("score", F.col("cross_score"))
    new = annotations(top_segments(scored, cfg.top_k), cfg.method)
    kept = new.select("doc_id", "comp_id", F.col("doc_score").alias("_s"), F.col("matches").alias("_m"))
    score = F.col("_s") if cfg.use_rerank_score else F.col("doc_score")
    both = lambda c: F.col("_s") if cfg.use_rerank_score else F.col(c)
    redone = head.join(kept, ["doc_id", "comp_id"]).select("doc_id", "comp_id", score.alias("doc_score"), score.alias("max_confidence"), both("sum_score").alias("sum_score"), both("mean_score").alias("mean_score"), "segment_count", F.col("_m").alias("matches"))
    return ranked(redone.unionByName(first.where(F.col("rank") > cfg.rerank_top_k).drop("rank")))


# ---- documents that one task holds --------------------------------------------------------------------------------


def by_size(segments: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of documents of up to ``WHOLE`` segments, and the others', if there are any."""
    many = stash(segments.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > WHOLE).select(F.col("doc_id").alias("_many")), "many")
    if many.isEmpty():
        return segments, None
    same = F.col("doc_id").eqNullSafe(F.col("_many"))
    return segments.join(many, same, "left_anti"), segments.join(many, same, "left_semi")


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _score(v: np.ndarray, n: np.ndarray, method: str) -> np.ndarray:
    """``aggregated`` of the first ``n`` values of each row of ``v``, which fall; sums go from left to right, as there."""
    def fold(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for r in range(x.shape[1]):
            out += np.where(r < n, x[:, r], 0.0)
        return out

    at = lambda r: v[np.arange(len(v)), r]
    weights = np.maximum(0.2, 1 - 0.2 * np.arange(v.shape[1]))
    forms = {
        "max": lambda: v[:, 0],
        "mean": lambda: fold(v) / n,
        "median": lambda: (at(n - (n + 1) // 2) + at(n - (n + 2) // 2)) / 2,
        "weighted_mean": lambda: fold(v * weights) / fold(np.broadcast_to(weights, v.shape)),
        "sum_log_count": lambda: fold(v) * np.log1p(n.astype(np.float64)),
        "mean_log_count": lambda: fold(v) / n * np.log1p(n.astype(np.float64)),
    }
    return forms.get(method, lambda: fold(v))()


def _lanes(x: np.ndarray, concepts: np.ndarray, n: int, k: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document, concept, rows, scores) of the concepts that documents of ``n`` rows each match, with the first ``k``
    rows of each by score, then order."""
    docs, step = len(x) // n, max(1, CELLS // len(x))
    for c0 in range(0, len(concepts), step):
        s = (x @ concepts[c0 : c0 + step].T).reshape(docs, n, -1)
        d, c = np.nonzero((s >= threshold).any(axis=1))
        lane = s[d, :, c]
        order = np.argsort(-lane, axis=1, kind="stable")[:, :k] if n > 1 else np.zeros((len(lane), 1), np.int64)
        yield d, c + c0, order, np.take_along_axis(lane, order, 1)


def _of_documents(table: pa.Table, ids: pa.Array, concepts: np.ndarray, cfg: Config, k: int, heads: bool, matches: bool) -> Iterator[pa.RecordBatch]:
    """What ``whole`` yields of a table of whole documents, whose rows stand together."""
    code = table.column("doc_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.diff(code, prepend=-1))
    doc = np.cumsum(np.diff(code, prepend=-1) != 0) - 1
    segment = np.flatnonzero(table.column("embedding").is_valid().to_numpy())
    if not len(segment) or not len(ids):
        return
    x = _matrix(table.column("embedding").take(pa.array(segment)))
    if x.shape[1] != concepts.shape[1]:
        return
    n = np.bincount(doc[segment], minlength=len(first))
    start = np.cumsum(n) - n
    if "_s" in table.column_names:  # what was scored anew, by document and concept
        redone = np.flatnonzero(table.column("comp_id").is_valid().to_numpy())
        at = pc.index_in(table.column("comp_id").take(pa.array(redone)), value_set=ids).to_numpy()
        new = table.column("_s").take(pa.array(redone)).to_numpy()
        key = doc[redone] * len(ids) + at
        by_key = np.argsort(key, kind="stable")
        key, redone, new = key[by_key], redone[by_key], new[by_key]
    else:
        key = redone = new = None
    for size in np.unique(n[n > 0]):
        mine = np.flatnonzero(n == size)
        step = max(1, CELLS // (int(size) * min(len(ids), CELLS)))
        for some in (mine[a : a + step] for a in range(0, len(mine), step)):
            rows = (start[some][:, None] + np.arange(size)).ravel()
            parts = list(_lanes(x[rows], concepts, int(size), k, cfg.threshold))
            d, c, order, v = (np.concatenate(p) for p in zip(*parts))
            count = (v >= cfg.threshold).sum(axis=1)
            total, score = _score(v, count, "sum"), _score(v, count, cfg.method)
            mean, again = total / count, np.full(len(d), -1)
            if key is not None and len(key):
                lane = some[d].astype(np.int64) * len(ids) + c
                at = np.minimum(np.searchsorted(key, lane), len(key) - 1)
                again = np.where(key[at] == lane, at, -1)
                if cfg.use_rerank_score:
                    total, mean, score = (np.where(again >= 0, new[again], x) for x in (total, mean, score))
                keep = (again < 0) | ~np.isnan(new[again])
                d, c, order, v, count, total, mean, score, again = (x[keep] for x in (d, c, order, v, count, total, mean, score, again))
            by_rank = np.lexsort((c, -score, d))
            d, c, order, v, count, total, mean, score, again = (x[by_rank] for x in (d, c, order, v, count, total, mean, score, again))
            rank = np.arange(len(d)) - np.searchsorted(d, d) + 1
            row = lambda d: pa.array(first[some[d]])
            if heads:
                l, r = np.nonzero((rank <= cfg.rerank_top_k)[:, None] & (v >= cfg.threshold))
                met = pa.array(segment[start[some[d[l]]] + order[l, r]])
                yield from table.select([c for c in table.column_names if c not in ("embedding", "_n")]).take(met).append_column("comp_id", ids.take(pa.array(c[l]))).combine_chunks().to_batches()
                continue
            out = [table.column("doc_id").take(row(d)).combine_chunks(), ids.take(pa.array(c)), pa.array(score), pa.array(count, pa.int32()), pa.array(rank, pa.int32())]
            names = ["doc_id", "comp_id", "doc_score", "segment_count", "rank"]
            if matches:
                l, r = np.nonzero(v >= cfg.threshold)
                met = table.column("segment_index").take(pa.array(segment[start[some[d[l]]] + order[l, r]])).combine_chunks()
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.StructArray.from_arrays([met, pa.array(v[l, r])], names=["segment_index", "score"]))
                if key is not None and len(key):
                    anew = table.column("_m").take(pa.array(redone)).combine_chunks().cast(lists.type)
                    lists = pa.concat_arrays([lists, anew]).take(pa.array(np.where(again >= 0, len(lists) + again, np.arange(len(lists)))))
                out += [pa.array(total), pa.array(mean), lists]
                names += ["sum_score", "mean_score", "matches"]
            yield pa.RecordBatch.from_arrays(out, names=names)


def _by_document(rows: DataFrame, shared, cfg: Config, k: int, heads: bool, matches: bool, schema: str) -> DataFrame:
    """``_of_documents`` of rows (doc_id, segment_index, ..), whose documents a window puts together, unless they have
    ``_n`` and stand together already."""
    together = rows if "_n" in rows.columns else rows.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("segment_index")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, concepts = shared.value
        held: pa.Table | None = None
        for batch in batches:
            got = pa.Table.from_batches([batch])
            held = got if held is None else pa.concat_tables([held, got])
            begins = np.flatnonzero(held.column("_n").to_numpy() == 1)
            if len(begins) and begins[-1] > 0:
                yield from _of_documents(held.slice(0, begins[-1]), ids, concepts, cfg, k, heads, matches)
                held = held.slice(begins[-1])
        if held is not None and held.num_rows:
            yield from _of_documents(held, ids, concepts, cfg, k, heads, matches)

    return together.mapInArrow(run, schema)


def whole(segments: DataFrame, comps: DataFrame, cfg: Config = Config(), scorer: Callable[[DataFrame], DataFrame] | None = None, matches: bool = True) -> DataFrame:
    """``annotate`` of documents that one task holds (see ``by_size``): pairs are made and ranked where the document's
    vectors stand and are never shuffled.  Rows that have ``_n``, 1 at a document's first row, stand together already.

    With a ``scorer``, further columns of ``segments`` come with the pairs, and ``scorer`` must return every pair.  What
    it gives goes back to the documents' vectors.  Without ``matches`` there is neither ``matches`` nor the sum, the mean
    and the confidence.  An ontology of more than a block, or with an id twice, goes by ``annotate``.
    """
    again = scorer is not None and cfg.rerank_top_k > 0
    least = ["doc_id", "comp_id", "doc_score", "segment_count", "rank"]
    some = comps.where("embedding is not null").select("comp_id", "embedding")
    if some.count() > BLOCK or not some.groupBy("comp_id").count().where("count > 1 or comp_id is null").isEmpty():
        out = annotate(segments.drop("_n"), comps, cfg, scorer)
        return out if matches else out.select(*least)
    shared = segments.sparkSession.sparkContext.broadcast(_gathered(some))
    k = max(cfg.top_k, 50) if again else cfg.top_k
    doc, index, comp = _kinds(segments, comps)
    plain = segments.select("doc_id", "segment_index", "embedding", *["_n"] * ("_n" in segments.columns))  # a filter on vectors would have them made twice
    if again:
        others = [f for f in segments.schema if f.name != "embedding"]
        pairs = _by_document(segments, shared, cfg, k, True, False, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others) + f", comp_id {comp}")
        listed = scorer(pairs).groupBy("doc_id", "comp_id").agg(F.sort_array(F.collect_list(F.struct(F.col("cross_score").alias("score"), (-F.col("segment_index")).alias("_i"), "segment_index")), asc=False).alias("_l"))
        best = F.slice(F.filter("_l", lambda x: x.score >= cfg.threshold), 1, cfg.top_k)
        found = listed.withColumn("_l", best).withColumn("_s", F.when(F.size("_l") > 0, aggregated(F.transform("_l", lambda x: x.score), cfg.method)))
        found = found.select("doc_id", "comp_id", "_s", *[F.transform("_l", lambda x: F.struct(x.segment_index.alias("segment_index"), x.score.alias("score"))).alias("_m")] * matches)
        plain = plain.unionByName(found, allowMissingColumns=True)
    out = _by_document(plain, shared, cfg, k, False, matches, f"doc_id {doc}, comp_id {comp}, doc_score double, segment_count int, rank int" + f", sum_score double, mean_score double, matches array<struct<segment_index: {index}, score: double>>" * matches)
    return out.select("doc_id", "comp_id", "doc_score", F.col("doc_score").alias("max_confidence"), "sum_score", "mean_score", "segment_count", "matches", "rank") if matches else out


def clipped(score: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score) if isinstance(score, str) else score))


def sigmoid(score: Column | str) -> Column:
    return 1 / (1 + F.exp(-(F.col(score) if isinstance(score, str) else score) / 5))


def top_codes(anns: DataFrame, codes: DataFrame, n: int = 20) -> DataFrame:
    """(doc_id, code, rank): leaf codes of ranked annotations, each once at its best rank, the first n."""
    best = anns.join(codes.where(is_leaf("code")), "comp_id").groupBy("doc_id", "code").agg(F.min("rank").alias("best"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("best"))).where(F.col("rank") <= n).drop("best")


def rolled_up(anns: DataFrame, codes: DataFrame, level: int, top_n: int) -> DataFrame:
    """(doc_id, code, doc_score, segment_count): sums of the best annotations by their code at a level."""
    rows = anns.where(F.col("rank") <= top_n).join(codes.where(is_leaf("code")), "comp_id")
    return rows.withColumn("code", to_level("code", level)).where("code is not null").groupBy("doc_id", "code").agg(F.sum("doc_score").alias("doc_score"), F.sum("segment_count").alias("segment_count"))


def max_pooled(scores: DataFrame, k: int) -> DataFrame:
    """(doc_id, comp_id, score, rank): the best segment of each concept, then the best concepts of each document."""
    best = scores.groupBy("doc_id", "comp_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "comp_id"))).where(F.col("rank") <= k)


def context(text: str, before: Column, after: Column, max_length: int) -> Column:
    """The doubled text between its neighbours' first 200 characters; a text longer than ``max_length`` as it is."""
    side = lambda c: F.when(F.length(c) > 200, F.concat(F.left(c, F.lit(200)), F.lit("..."))).otherwise(c)
    joined = F.concat_ws("  ", side(before), F.col(text), F.col(text), side(after))
    return F.when(F.length(text) > max_length, F.col(text)).otherwise(joined)


def with_context(segments: DataFrame, max_length: int, text: str = "segment_text", ranges: int | None = None) -> DataFrame:
    """``segments`` with ``context_text``: neighbours around the doubled segment, unless it is longer than ``max_length``.

    Rows are put in ranges of (doc_id, segment_index), so a hot document is spread over several tasks; a range's first
    and last row meet the neighbouring ranges' ends, one row a range.
    """
    placed = stash(segments.repartitionByRange(*[ranges] * (ranges is not None), "doc_id", "segment_index").withColumn("_p", F.spark_partition_id()), "ranges")
    end = F.struct("doc_id", "segment_index", F.left(text, F.lit(201)).alias("t"))
    by_range = Window.orderBy("_p")
    ends = placed.groupBy("_p").agg(F.min(end).alias("_a"), F.max(end).alias("_z")).select("_p", F.lag("_z").over(by_range).alias("_before"), F.lead("_a").over(by_range).alias("_after"))
    w = Window.partitionBy("_p", "doc_id").orderBy("segment_index")
    beyond = lambda c: F.when(F.col(f"{c}.doc_id").eqNullSafe(F.col("doc_id")), F.col(f"{c}.t"))
    before = F.when(F.lag(F.lit(1)).over(w).isNull(), beyond("_before")).otherwise(F.lag(text).over(w))
    after = F.when(F.lead(F.lit(1)).over(w).isNull(), beyond("_after")).otherwise(F.lead(text).over(w))
    found = placed.join(F.broadcast(ends), "_p").withColumn("context_text", context(text, before, after, max_length))
    return found.select(*segments.columns, "context_text")
