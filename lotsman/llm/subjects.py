"""Subject areas of documents: term weights, truncated singular value decomposition, refined seed centroids.

Terms are stems, hashed to SLOTS numbers, so that every term of every text takes part and all tables have a bound.  A
term's weight is its inverse document frequency times its purity (how far its use is bound to one area).  The matrix
of documents by weighted terms is decomposed; a term's vector is its row of right singular vectors times the singular
values, a sentence's the weighted sum over its terms.  Centroids of the areas start from labelled rows and the areas'
names.  A sentence belongs to the area whose centroid is nearest by cosine, above a threshold, and a document has an
area when at least two of its sentences do.  Weights, decomposition and centroids are then refined on the documents
that got one area.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotsman.session import stash

SLOTS = 1 << 18  # numbers that terms are hashed to: bounds all that is broadcast or gathered
LEAST_SENTENCES = 3  # of a term
RANK = 128
POWER_STEPS = (2, 1)  # passes of the first decomposition, and of the second, which starts from the first
REFINEMENTS = 2
PURITY = 0.25  # below it a term has no weight
SCORE = 0.3  # least cosine of a sentence to its area
STRONGEST = 0.4  # least weight of a sentence's strongest term
CONTEXT = 0.35  # weight of the document's cosine beside a sentence's
PRIOR = 5  # sentences at which a term's pull on the centroids is half of what it can be
SENTENCES = 2  # of an area in a document
EVEN = 1  # sentences, spread evenly over the areas, that are added to those of each term
CENTROIDS = 2  # of an area
ROUNDS = 5  # in which terms are dealt to an area's centroids
BLOCKS = 16  # into which a gathered table is cut
TERMS = 200_000  # whose vectors a task makes at once
FAN = 64  # tables added up by one task

SENTENCE = re.compile(r"(?<=[.!?;…])\s+(?=[A-ZА-ЯЁ\d«(•–—*-])|[\r\n]+")
WORD = re.compile(r"[^\W\d_]{3,}")


def term(word: str) -> str:
    """A word without its ending: at most eight letters, at least four where it has them."""
    w = word.lower().replace("ё", "е")
    return w[: max(4, min(len(w) - 2, 8))]


class Slots(dict):
    """The number of each word's stem, computed once a word."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = n = zlib.crc32(term(word).encode()) % SLOTS
        return n


def sentences(text: str, slots: Slots) -> list[list[int]]:
    """Different terms of each sentence with at least two words."""
    return [sorted({slots[w] for w in found}) for s in SENTENCE.split(text) if len(found := WORD.findall(s)) >= 2]


def _encoded(texts: DataFrame) -> DataFrame:
    """``texts`` with the sentences as lists of term numbers instead of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for batch in batches:
            lists = [sentences(x, slots) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(lists, pa.list_(pa.list_(pa.int32())))], names=["table_name", "row_id", "labels", "s"])

    return texts.select("table_name", "row_id", "labels", "text").mapInArrow(run, "table_name string, row_id bigint, labels array<int>, s array<array<int>>")


class Sentences:
    """The sentences of a batch as arrays: ``ids`` of the terms, ``sentence`` of each term, ``owner`` of each sentence."""

    def __init__(self, column: pa.Array):
        docs = column.fill_null([]) if column.null_count else column
        inner = docs.flatten()
        self.n = len(docs)
        self.owner = np.repeat(np.arange(self.n), np.diff(docs.offsets.to_numpy()))
        self.ids = inner.flatten().to_numpy(zero_copy_only=False)
        self.sentence = np.repeat(np.arange(len(self.owner)), np.diff(inner.offsets.to_numpy()))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about TERMS terms, as vectors of all terms are made at once."""
    docs = batch.column(3).fill_null([]) if batch.column(3).null_count else batch.column(3)
    if not len(docs):
        return
    of_doc, of_sentence = docs.offsets.to_numpy(), docs.flatten().offsets.to_numpy()
    at = of_sentence[of_doc - of_doc[0]] - of_sentence[0]  # terms before each document
    start = 0
    while start < len(docs):
        end = max(start + 1, int(np.searchsorted(at, at[start] + TERMS, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def _sum_rows(values: np.ndarray, by: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by ``by``, which rises."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(by):
        first = np.flatnonzero(np.diff(by, prepend=-1))
        out[by[first]] = np.add.reduceat(values, first, axis=0)
    return out


def _gathered(docs: DataFrame, partial: Callable[[pa.RecordBatch, np.ndarray], None], shape: tuple[int, int]) -> np.ndarray:
    """Sum over all documents of ``partial(batch, total)``; ``shape`` has a bound.

    Each partition's table is cut into blocks of rows, and blocks are added up as a tree, FAN at a time, so that no task
    and not the driver holds more than a bounded number of tables, whatever the number of partitions.
    """
    step = -(-shape[0] // BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for some in _slices(batch):
                partial(some, total)
        for b in range(BLOCKS):
            part = total[b * step : (b + 1) * step]
            rows = np.flatnonzero(part.any(1)).astype(np.int32)
            if len(rows):
                yield pa.RecordBatch.from_pydict({"b": pa.array([b], pa.int32()), "i": pa.array([rows.tobytes()], pa.binary()), "m": pa.array([part[rows].tobytes()], pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((step, shape[1]))
        for i, m in zip(pdf["i"], pdf["m"]):
            total[np.frombuffer(i, np.int32)] += np.frombuffer(m, np.float64).reshape(-1, shape[1])
        rows = np.flatnonzero(total.any(1)).astype(np.int32)
        return pd.DataFrame({"b": [pdf["b"].iloc[0]], "p": [pdf["p"].iloc[0] // FAN], "i": [rows.tobytes()], "m": [total[rows].tobytes()]})

    schema = "b int, p int, i binary, m binary"
    parts = docs.rdd.getNumPartitions()
    tables = docs.mapInArrow(run, "b int, i binary, m binary").select("b", F.spark_partition_id().alias("p"), "i", "m")
    while parts > 1:
        tables = tables.groupBy("b", F.floor(F.col("p") / FAN)).applyInPandas(add, schema)
        parts = -(-parts // FAN)
    out = np.zeros(shape)
    for r in tables.toLocalIterator():
        out[r["b"] * step + np.frombuffer(bytes(r["i"]), np.int32)] += np.frombuffer(bytes(r["m"]), np.float64).reshape(-1, shape[1])
    return out


def _often(docs: DataFrame) -> np.ndarray:
    """Sentences with each term, and all sentences in the last place, over all documents."""

    def partial(batch: pa.RecordBatch, total: np.ndarray) -> None:
        s = Sentences(batch.column(3))
        total[:-1, 0] += np.bincount(s.ids, minlength=SLOTS)
        total[-1, 0] += len(s.owner)

    return _gathered(docs, partial, (SLOTS + 1, 1))[:, 0]


def _singular(docs: DataFrame, weight: np.ndarray, rank: int, steps: int, before: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(terms with a weight, their rows of right singular vectors times the singular values), of the weighted documents.

    Power iteration on a block of ``rank`` vectors, random or the ones of ``before``; one pass over all documents a
    step.
    """
    active = np.flatnonzero(weight > 0)
    if not len(active):
        return active, np.zeros((0, 1))
    number = np.full(SLOTS, -1, np.int64)
    number[active] = np.arange(len(active))
    y = np.random.default_rng(0).standard_normal((len(active), min(rank, len(active))))
    if before is not None and before[1].shape[1] <= y.shape[1]:
        here = number[before[0]]
        y[here[here >= 0], : before[1].shape[1]] = before[1][here >= 0]
    y = np.linalg.qr(y)[0]
    for _ in range(steps):
        shared = docs.sparkSession.sparkContext.broadcast((number, weight[active], y))

        def partial(batch: pa.RecordBatch, total: np.ndarray, shared=shared) -> None:
            number, w, y = shared.value
            s = Sentences(batch.column(3))
            t = number[s.ids]
            doc = s.owner[s.sentence][t >= 0]
            key, count = np.unique(doc * len(w) + t[t >= 0], return_counts=True)
            doc, t = key // len(w), key % len(w)
            v = (1 + np.log(count)) * w[t]
            v /= np.maximum(np.sqrt(np.bincount(doc, v * v, minlength=s.n))[doc], 1e-12)
            z = _sum_rows(v[:, None] * y[t], doc, s.n)
            by = np.argsort(t, kind="stable")
            total += _sum_rows((v[:, None] * z[doc])[by], t[by], len(w))

        b = _gathered(docs, partial, y.shape)
        square, turn = np.linalg.eigh(y.T @ b)
        order = np.argsort(-square)
        square, turn = np.maximum(square[order], 1e-12), turn[:, order]
        vectors = b @ turn / square
        y = np.linalg.qr(b)[0]
    return active, vectors * np.sqrt(square)


def _purity(counts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(purity of each term, its share by area over an even one), from its sentences by area."""
    n = counts.shape[1]
    rate = counts / np.maximum(sizes, 1)
    total = counts.sum(1, keepdims=True)
    p = (rate + 1e-9) / (rate.sum(1, keepdims=True) + n * 1e-9)
    p = (p * total + EVEN / n) / (total + EVEN)
    return (p * np.log(p * n)).sum(1) / np.log(n), p - 1 / n


def weights(counts: np.ndarray, sizes: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return idf * np.maximum(0, _purity(counts, sizes)[0] - PURITY)


def centroids(vectors: np.ndarray, pull: np.ndarray) -> np.ndarray:
    """Up to CENTROIDS unit vectors of an area from its terms, as terms of different languages hardly meet: the terms
    are dealt to the nearest centroid in turn, and a new centroid starts from the term that pulls most from afar."""
    length = np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    unit = vectors / length
    drawn = pull[:, None] * vectors
    norm = lambda c: c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    out = norm(drawn.sum(0, keepdims=True))
    while len(vectors) and len(out) < CENTROIDS:
        far = pull * np.maximum(0, 1 - (unit @ out.T).max(1)) * (length[:, 0] > 1e-9)
        if far.max() <= 0:
            break
        out = np.concatenate([out, unit[[far.argmax()]]])
        for _ in range(ROUNDS):
            near = (unit @ out.T).argmax(1)
            sums = np.stack([drawn[near == k].sum(0) for k in range(len(out))])
            out = norm(np.where(sums.any(1, keepdims=True), sums, out))
    return out


class Model:
    """Term vectors, weights and centroids; ``counts`` are a term's sentences by area, ``sizes`` the sentences of an area."""

    def __init__(self, terms: np.ndarray, vectors: np.ndarray, idf: np.ndarray, counts: np.ndarray, sizes: np.ndarray):
        self.areas = counts.shape[1]
        weight = weights(counts, sizes, idf)[terms]
        total = counts[terms].sum(1, keepdims=True)
        pull = weight[:, None] * np.maximum(0, _purity(counts[terms], sizes)[1]) * total / (total + PRIOR)
        found = [centroids(vectors[at], pull[at, a]) for a in range(self.areas) for at in [np.flatnonzero(pull[:, a] > 0)]]
        self.centroids = np.concatenate(found).astype(np.float32)
        self.first = np.cumsum([0, *(len(x) for x in found[:-1])])
        active = np.flatnonzero(weight > 0)
        self.number = np.full(SLOTS, -1, np.int32)
        self.number[terms[active]] = np.arange(len(active))
        self.weight = weight[active].astype(np.float32)
        self.vectors = self.weight[:, None] * vectors[active].astype(np.float32)

    def sentence_areas(self, s: Sentences) -> np.ndarray:
        """The area of each sentence, or -1.  Where a sentence is near to several, its document's vector tips the scale."""
        t = self.number[s.ids]
        sentence, t = s.sentence[t >= 0], t[t >= 0]
        out = np.full(len(s.owner), -1)
        at, first = np.unique(sentence, return_index=True)
        if len(at):
            unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            x = unit(np.add.reduceat(self.vectors[t], first, axis=0))
            near = lambda m: np.maximum.reduceat(m @ self.centroids.T, self.first, axis=1)
            score = near(x)
            ok = (score.max(1) >= SCORE) & (np.maximum.reduceat(self.weight[t], first) >= STRONGEST)
            whole = near(unit(_sum_rows(x, s.owner[at], s.n)))[s.owner[at]]
            out[at] = np.where(ok, (score + CONTEXT * whole).argmax(1), -1)
        return out

    def document_areas(self, s: Sentences) -> tuple[np.ndarray, np.ndarray]:
        """(sentences by document and area, area of each sentence)."""
        area = self.sentence_areas(s)
        ok = area >= 0
        return np.bincount(s.owner[ok] * self.areas + area[ok], minlength=s.n * self.areas).reshape(s.n, self.areas), area


def _count_terms(docs: DataFrame, n_areas: int, model: Model | None) -> tuple[np.ndarray, np.ndarray]:
    """Terms of the sentences of documents with one area (labelled, or given by ``model``), and sentences, by area."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def partial(batch: pa.RecordBatch, total: np.ndarray) -> None:
        s = Sentences(batch.column(3))
        one, area = np.full(s.n, -1), np.full(len(s.owner), -1)
        if shared.value is not None:
            got, area = shared.value.document_areas(s)
            has = got >= SENTENCES
            one = np.where(has.sum(1) == 1, has.argmax(1), -1)
        labels = batch.column(2)
        for i in np.flatnonzero(labels.is_valid().to_numpy(zero_copy_only=False)).tolist():
            known = labels[i].as_py()
            one[i] = known[0] if len(known) == 1 else -1
        of = one[s.owner]
        keep = (of >= 0) & ((area < 0) | (area == of))
        term_area = np.where(keep, of, -1)[s.sentence]
        ok = term_area >= 0
        np.add.at(total, (s.ids[ok], term_area[ok]), 1)
        total[-1] += np.bincount(of[keep], minlength=n_areas)

    m = _gathered(docs if model is not None else docs.where("labels is not null"), partial, (SLOTS + 1, n_areas))
    return m[:-1], m[-1]


def assign_areas(texts: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """(table_name, row_id, area) for ``texts`` (table_name, row_id, text), one row an area.

    ``areas`` (area, area_label) is a fixed list; ``labels`` (table_name, row_id, area) holds complete labels of some
    rows, which only train: labelled rows are assigned by the model like all others.  Null, blank and short texts have
    no area; a single mention is none.  Repeated texts are assigned alike.  Without areas, labels or texts there are no
    rows.  All texts are counted, decomposed and assigned; what is broadcast or gathered is bounded by SLOTS.
    """
    spark = texts.sparkSession
    names = [(r["area"], r["area_label"] or "") for r in areas.where("area is not null").orderBy("area").collect()]
    empty = texts.select("table_name", "row_id", F.lit("").alias("area")).where("false")
    if len(names) < 2:
        return empty
    order = F.create_map(*[x for i, (a, _) in enumerate(names) for x in (F.lit(a), F.lit(i))])
    known = labels.where(F.col("area").isin([a for a, _ in names])).groupBy("table_name", "row_id").agg(F.array_sort(F.collect_set(order[F.col("area")])).alias("labels"))
    full = texts.where(F.col("text").isNotNull() & (F.length("text") > 0)).select("table_name", F.col("row_id").cast("bigint").alias("row_id"), "text")
    docs = stash(_encoded(full.join(known, ["table_name", "row_id"], "left").select("table_name", "row_id", "labels", "text")), "docs")
    often = _often(docs)
    if not often[-1]:
        return empty
    idf = np.where(often[:-1] >= LEAST_SENTENCES, np.log(max(often[-1], 2) / np.maximum(often[:-1], 1)), 0)
    counts, sizes = _count_terms(docs, len(names), None)
    slots = Slots()
    for a, (_, label) in enumerate(names):  # the area's name is a seed of its own
        for w in WORD.findall(label):
            if len(w) > 3:
                counts[slots[w], a] += 1
        sizes[a] += 1
    found = None
    for turn in range(REFINEMENTS + 1):
        if turn < len(POWER_STEPS):
            found = _singular(docs, weights(counts, sizes, idf), RANK, POWER_STEPS[turn], found)
        model = Model(*found, idf, counts, sizes)
        if turn < REFINEMENTS:
            counts, sizes = _count_terms(docs, len(names), model)
    shared = spark.sparkContext.broadcast((model, [a for a, _ in names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, area_names = shared.value
        for batch in (x for b in batches for x in _slices(b)):
            row, area = np.nonzero(m.document_areas(Sentences(batch.column(3)))[0] >= SENTENCES)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([area_names[a] for a in area], pa.string())], names=["table_name", "row_id", "area"])

    return docs.mapInArrow(run, "table_name string, row_id bigint, area string")


def composition(assigned: DataFrame, texts: DataFrame) -> DataFrame:
    """(table_name, area, n_docs, permille) of documents by area, with the null area for documents without one."""
    per = texts.select("table_name", "row_id").join(assigned, ["table_name", "row_id"], "left").groupBy("table_name", "area").agg(F.count(F.lit(1)).alias("n_docs"))
    total = texts.groupBy("table_name").agg(F.count(F.lit(1)).alias("_n"))
    return per.join(total, "table_name").select("table_name", "area", "n_docs", F.floor(F.col("n_docs") * 1000 / F.col("_n")).alias("permille"))
