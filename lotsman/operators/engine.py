"""From texts to annotations: segments, filter, context, vectors, scores, rerank; encoders and scorers are functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotsman.functions.text import missing, uninformative
from lotsman.operators import annotate as an
from lotsman.operators import ontology as on
from lotsman.operators import segment as sg
from lotsman.session import stash

#: (rows, name of a text column) -> rows with ``embedding``, an array of float of unit length.  An encoder with a true
#: attribute ``in_place`` leaves all other columns and the rows' order as they are.
Encoder = Callable[[DataFrame, str], DataFrame]
#: rows (query, text) -> rows with ``raw``, the score of a pair.
PairModel = Callable[[DataFrame], DataFrame]
Progress = Callable[[str, float], None]
#: Parts of names of models whose scores are shares already.
SHARE_MODELS = ("russian", "rusbeir", "final_model")


def hash_encoder(dims: int = 16) -> Encoder:
    """Counts of words by a digest, scaled to unit length: an encoder without a model.

    Built-in functions make the words; a batch's different words are digested once and its texts counted at once.
    """

    def encode(rows: DataFrame, text: str) -> DataFrame:
        @F.arrow_udf("array<double>")
        def unit(texts: pa.Array) -> pa.Array:
            words = pc.split_pattern(texts, " ")
            coded = words.flatten().dictionary_encode()
            slot = np.array([int(md5(w.encode()).hexdigest()[:4], 16) % dims if w else -1 for w in coded.dictionary.to_pylist()], np.int64)
            slots = slot[coded.indices.to_numpy()]
            row = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))[slots >= 0]
            counted = np.bincount(row * dims + slots[slots >= 0], minlength=len(words) * dims).reshape(-1, dims).astype(np.float64)
            length = np.sqrt((counted * counted).sum(axis=1))
            made = counted / np.where(length > 0, length, 1.0)[:, None]
            return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * dims, pa.int32()), pa.array(made.ravel()), mask=pa.array(length == 0))

        return rows.withColumn("embedding", unit(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " ")))

    encode.in_place = True
    return encode


def arrow_encoder(encode: Callable[[list[str]], object], batch: int = 64) -> Encoder:
    """An encoder of a function from a list of texts to a matrix; texts go to it in Arrow batches."""

    def run(rows: DataFrame, text: str) -> DataFrame:
        @F.pandas_udf("array<float>")
        def vectors(texts: pd.Series) -> pd.Series:
            out: list = []
            for at in range(0, len(texts), batch):
                out += [list(map(float, v)) for v in encode(texts.iloc[at : at + batch].fillna("").tolist())]
            return pd.Series(out)

        return rows.withColumn("embedding", vectors(text))

    run.in_place = True
    return run


def concept_vectors(nodes: DataFrame, encoder: Encoder) -> DataFrame:
    """(comp_id, embedding) of the concepts that have a text to encode."""
    return encoder(on.embedding_texts(nodes), "text").where("embedding is not null").select(F.col("id").alias("comp_id"), "embedding")


def stored_vectors(comps: DataFrame, vectors: DataFrame) -> DataFrame:
    """(comp_id, embedding) of concepts (id) with a stored vector (id, embedding); those without one are left out."""
    return comps.select("id").distinct().join(vectors, "id").select(F.col("id").alias("comp_id"), "embedding")


def pair_texts(pairs: DataFrame, segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` (doc_id, segment_index, comp_id) with query, the concept's label and description, and the segment's text
    without context.  Pairs that have a ``segment_text`` give it and are all kept."""
    query = F.when(missing("description").isNotNull(), F.concat("label", F.lit(". "), "description")).otherwise(F.col("label"))
    named = nodes.select(F.col("id").alias("comp_id"), query.alias("query"))
    if "segment_text" in pairs.columns:
        return pairs.withColumnRenamed("segment_text", "text").join(named, "comp_id", "left")
    texts = segments.select("doc_id", "segment_index", F.col("segment_text").alias("text"))
    return pairs.join(texts, ["doc_id", "segment_index"]).join(named, "comp_id")


def normal_form(model_name: str) -> Callable[[Column | str], Column]:
    """Clipping for models whose scores are shares already, else a sigmoid."""
    low = model_name.lower()
    return an.clipped if any(x in low for x in SHARE_MODELS) else an.sigmoid


@dataclass(frozen=True)
class Engine:
    """What a run needs beside the documents.  ``context`` above 0 is the length up to which a segment gets neighbours.

    Without ``matches`` an annotation is (doc_id, comp_id, doc_score, segment_count, rank): no matches, no labels.
    """

    nodes: DataFrame
    encoder: Encoder
    vectors: DataFrame | None = None
    pair_model: PairModel | None = None
    pair_model_name: str = ""
    config: an.Config = field(default_factory=an.Config)
    context: int = 0
    informative: bool = True
    progress: Progress | None = None
    matches: bool = True

    def told(self, stage: str, share: float) -> None:
        if self.progress is not None:
            self.progress(stage, share)

    def annotate_segments(self, segments: DataFrame) -> DataFrame:
        """Ranked annotations of documents given as segments (doc_id, segment_index, segment_text).

        Labels of the concept come with each annotation, and each match has its segment's text.  Null documents and
        empty texts have no annotations.
        """
        segments = segments.select("doc_id", "segment_index", "segment_text").where("doc_id is not null")
        kept = stash(segments.where(~uninformative("segment_text")) if self.informative else segments, "segments")
        small, large = an.by_size(kept)
        concepts = self.vectors if self.vectors is not None else concept_vectors(self.nodes, self.encoder)
        self.told("context", 0.0)
        parts = [self.around(small)]
        if large is not None:
            large = stash(sg.informative(large) if self.informative else large, "large")
            parts.append(an.with_context(large, self.context).withColumnRenamed("context_text", "_t") if self.context > 0 else large.withColumn("_t", F.col("segment_text")))
        self.told("vectors", 0.0)
        again = self.pair_model is not None and self.config.rerank_top_k > 0
        encoded = [self.encoder(p, "_t") for p in parts]
        standing = ["_n"] * (not again and getattr(self.encoder, "in_place", False))
        encoded = [e.select("doc_id", "segment_index", "embedding", *["segment_text"] * again, *standing * (i == 0)) for i, e in enumerate(encoded)]
        if again:  # read twice
            encoded[0] = stash(encoded[0], "vectors")
        self.told("matching", 0.0)
        anns = an.whole(encoded[0], concepts, self.config, self.scorer(small) if again else None, self.matches)
        if large is not None:
            anns = anns.unionByName(an.annotate(encoded[1].drop("segment_text"), concepts, self.config, self.scorer(large) if again else None).select(*anns.columns))
        self.told("matching", 1.0)
        if not self.matches:
            return anns if self.vectors is None else anns.join(self.nodes.select(F.col("id").alias("comp_id")), "comp_id", "left_semi")
        numbered = self.around(small).drop("_t", "_n")
        return self.labelled(stash(anns, "annotations"), numbered if large is None else numbered.unionByName(large))

    def around(self, segments: DataFrame) -> DataFrame:
        """Segments of documents that one task holds, numbered anew if uninformative ones went, with ``_t``, the text to
        encode; as ``segment.informative`` and ``annotate.with_context`` do it, in one shuffle.  ``_n`` numbers the rows
        of a document, which stand together."""
        w = Window.partitionBy("doc_id").orderBy("segment_index")
        near = F.left("segment_text", F.lit(201))
        sides = [F.lag(near).over(w).alias("_before"), F.lead(near).over(w).alias("_after")] if self.context > 0 else []
        rows = segments.select("doc_id", "segment_index", "segment_text", F.row_number().over(w).alias("_n"), *sides)
        number = (F.col("_n") - 1).cast(segments.schema["segment_index"].dataType) if self.informative else F.col("segment_index")
        text = an.context("segment_text", F.col("_before"), F.col("_after"), self.context) if sides else F.col("segment_text")
        return rows.select("doc_id", number.alias("segment_index"), "segment_text", text.alias("_t"), "_n")

    def annotate(self, docs: DataFrame) -> DataFrame:
        """``annotate_segments`` of whole texts (doc_id, text)."""
        self.told("segments", 0.0)
        return self.annotate_segments(sg.segments(docs))

    def scorer(self, segments: DataFrame) -> Callable[[DataFrame], DataFrame]:
        form = normal_form(self.pair_model_name)
        return lambda pairs: self.pair_model(pair_texts(pairs, segments, self.nodes)).withColumn("cross_score", form("raw")).select("doc_id", "comp_id", "segment_index", "cross_score")

    def labelled(self, anns: DataFrame, segments: DataFrame) -> DataFrame:
        labels = self.nodes.select(F.col("id").alias("comp_id"), "label", F.coalesce(missing("full_label"), F.col("label")).alias("full_label"))
        texts = segments.select("doc_id", "segment_index", F.col("segment_text").alias("segment"))
        each = anns.select("doc_id", "comp_id", F.posexplode("matches").alias("pos", "m")).select("doc_id", "comp_id", "pos", "m.segment_index", "m.score")
        met = each.join(texts, ["doc_id", "segment_index"]).groupBy("doc_id", "comp_id").agg(F.array_sort(F.collect_list(F.struct("pos", "segment_index", "score", "segment"))).alias("_m"))
        plain = F.transform("_m", lambda x: F.struct(x.segment_index.alias("segment_index"), x.score.alias("score"), x.segment.alias("segment")))
        return anns.drop("matches").join(met, ["doc_id", "comp_id"]).join(labels, "comp_id").withColumn("matches", plain).drop("_m")


def annotate_document(text: str, engine: Engine) -> DataFrame:
    """The annotations of one text."""
    docs = engine.nodes.sparkSession.createDataFrame([("document", text)], "doc_id string, text string")
    return engine.annotate(docs)


def silver_labels(anns: DataFrame, n: int = 20) -> DataFrame:
    """(doc_id, labels): the first ``n`` predicted concepts of each document as its labels."""
    best = F.array_sort(F.collect_list(F.struct("rank", "comp_id")))
    return anns.where(F.col("rank") <= n).groupBy("doc_id").agg(F.transform(best, lambda x: x.comp_id).alias("labels"))


def rank_table(anns: DataFrame, top_n: int) -> DataFrame:
    """(doc_id, rank, label, score, segments) of the first ``top_n`` annotations, for display."""
    return anns.where(F.col("rank") <= top_n).select("doc_id", "rank", "label", F.round("doc_score", 4).alias("score"), F.col("segment_count").alias("segments"))


def evaluate(engine: Engine, docs: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """``metrics.document_report`` of an engine's annotations of texts (doc_id, text) against gold codes."""
    from lotsman.operators import metrics as mt

    codes = on.code_map(engine.nodes).withColumnRenamed("id", "comp_id")
    pred = an.top_codes(engine.annotate(docs.where(missing("text").isNotNull())), codes, k)
    return mt.document_report(pred, gold, docs, k)
