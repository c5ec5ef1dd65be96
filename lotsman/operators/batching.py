"""Hierarchy-aware batches for contrastive training: weights, relations, audits, and the sequential batch builders."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotsman.functions.text import grand_of, parent_of
from lotsman.session import stash


def curriculum(text: str) -> tuple[float, float, float]:
    """Target shares (far, mid, hard) that sum to 1; not-a-numbers for a random order."""
    if text.strip().lower() in ("random", "rand", "none"):
        return (float("nan"),) * 3
    shares = [float(x) for x in text.split(",")]
    if len(shares) != 3 or sum(shares) <= 0:
        raise ValueError(f"three shares with a positive sum are needed, not {text!r}")
    return tuple(x / sum(shares) for x in shares)  # type: ignore[return-value]


def relation(a: str, b: str) -> Column:
    """How row b relates to row a: equal leaf, other grand, other parent, or sibling."""
    same = lambda c: F.col(f"{a}.{c}") == F.col(f"{b}.{c}")
    return F.when(same("leaf"), "dup").when(~same("grand"), "far").when(~same("parent"), "mid").otherwise("hard")


def hierarchical_rows(segments: DataFrame, texts: DataFrame) -> DataFrame:
    """Training rows of (doc_id, segment_index, segment_text, codes) and (code, text): one row a segment and leaf code."""
    from lotsman.functions.text import is_leaf

    each = segments.select("doc_id", "segment_index", "segment_text", F.explode("codes").alias("leaf")).where(is_leaf("leaf"))
    gold = each.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("leaf")), ";").alias("doc_gold_leaves"))
    rows = each.join(texts.select(F.col("code").alias("leaf"), F.col("text").alias("text2")), "leaf").join(gold, "doc_id")
    return rows.select(F.col("segment_text").alias("text1"), "text2", "doc_id", "segment_index", "leaf", parent_of("leaf").alias("parent"), grand_of("leaf").alias("grand"), "doc_gold_leaves")


def sampling_weights(rows: DataFrame, power: float = 0.5, grand_power: float = 1.0) -> DataFrame:
    """``rows`` with ``weight``: (most frequent leaf / own leaf) ^ power * the same of grands ^ grand_power."""
    def ratio(c: str, p: float) -> DataFrame:
        n = rows.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        most = n.agg(F.max("n").alias("m"))
        return n.crossJoin(F.broadcast(most)).select(c, F.pow(F.col("m") / F.col("n"), F.lit(p)).alias(f"_{c}"))

    return rows.join(ratio("leaf", power), "leaf").join(ratio("grand", grand_power), "grand").withColumn("weight", F.col("_leaf") * F.col("_grand")).drop("_leaf", "_grand")


def batch_pairs(batches: DataFrame) -> DataFrame:
    """Ordered pairs of different rows of a batch; a batch is bounded by its size, so the pairs are linear in rows."""
    b = batches.select("batch", F.struct("pos", "doc_id", "leaf", "parent", "grand", "gold").alias("r"))
    x, y = b.select("batch", F.col("r").alias("a")), b.select("batch", F.col("r").alias("b"))
    return x.join(y, "batch").where("a.pos <> b.pos")


def batch_mix(batches: DataFrame) -> DataFrame:
    """(batch, far, mid, hard): shares of the relations between different leaves."""
    r = batch_pairs(batches).select("batch", relation("a", "b").alias("rel")).where("rel <> 'dup'")
    share = lambda k: (F.count_if(F.col("rel") == k) / F.count(F.lit(1))).alias(k)
    return r.groupBy("batch").agg(share("far"), share("mid"), share("hard"))


def batch_violations(batches: DataFrame) -> DataFrame:
    """(batch, size, dup_docs, dup_leaves)."""
    return batches.groupBy("batch").agg(F.count(F.lit(1)).alias("size"), (F.count(F.lit(1)) - F.countDistinct("doc_id")).alias("dup_docs"), (F.count(F.lit(1)) - F.countDistinct("leaf")).alias("dup_leaves"))


def false_negatives(batches: DataFrame) -> DataFrame:
    """(batch, size, fraction): ordered pairs in which the one's leaf is in the other's gold set."""
    sizes = batches.groupBy("batch").agg(F.count(F.lit(1)).alias("size"))
    bad = batch_pairs(batches).groupBy("batch").agg(F.count_if(F.array_contains("a.gold", F.col("b.leaf"))).alias("bad"))
    return sizes.join(bad, "batch", "left").select("batch", "size", F.when(F.col("size") > 1, F.col("bad") / (F.col("size") * (F.col("size") - 1))).otherwise(0.0).alias("fraction"))


def kept_batches(fractions: DataFrame, most: float) -> DataFrame:
    return fractions.where((F.col("size") <= 1) | (F.col("fraction") <= most))


def truncated_epochs(plan: DataFrame) -> DataFrame:
    """Batches of a plan (epoch, batch) cut to the length of the shortest epoch and numbered anew."""
    n = plan.select("epoch", "batch").distinct()
    least = n.groupBy("epoch").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"))
    numbered = n.withColumn("new", F.row_number().over(Window.partitionBy("epoch").orderBy("batch")) - 1).crossJoin(F.broadcast(least)).where("new < least")
    return plan.join(numbered.drop("least"), ["epoch", "batch"]).drop("batch").withColumnRenamed("new", "batch")


@dataclass(frozen=True)
class BatchConfig:
    size: int = 16
    targets: tuple[tuple[float, float, float], ...] = ((0.6, 0.3, 0.1), (0.3, 0.4, 0.3), (0.1, 0.3, 0.6))
    candidates: int = 256
    drop_last: bool = True
    margin: float | None = None
    seed: int = 42


class Picker:
    """The open batch over the rows of one task, with what it rules out kept up to date by each pick."""

    def __init__(self, rows: pd.DataFrame, cfg: BatchConfig):
        self.cfg, n = cfg, len(rows)
        self.doc, self.leaf, self.parent, self.grand = (pd.factorize(rows[c])[0] for c in ("doc_id", "leaf", "parent", "grand"))
        number = dict(zip(rows["leaf"], self.leaf))
        self.gold = [[number[x] for x in set((g or "").split(";")) if x in number] for g in rows["gold"]]
        self.by_leaf = [np.flatnonzero(self.leaf == k) for k in range(self.leaf.max() + 1 if n else 0)]
        holders: list[list[int]] = [[] for _ in self.by_leaf]
        for i, leaves in enumerate(self.gold):
            for k in leaves:
                holders[k].append(i)
        self.holders = [np.array(h, int) for h in holders]
        self.weight = rows["weight"].to_numpy(float)
        self.vectors = None
        if cfg.margin is not None and {"seg_vec", "pos_vec"} <= set(rows.columns):
            self.vectors = tuple(np.array(rows[c].tolist(), float) for c in ("seg_vec", "pos_vec"))
            self.own = (self.vectors[0] * self.vectors[1]).sum(1)
        self.free = np.ones(n, bool)
        self.start()

    def start(self) -> None:
        self.batch: list[int] = []
        self.edges = np.zeros(3)
        self.repeats = np.zeros(len(self.free), bool)
        self.clashes = np.zeros(len(self.free), bool)
        self.n_leaf, self.n_parent, self.n_grand = (np.zeros(c.max() + 1 if len(c) else 0, int) for c in (self.leaf, self.parent, self.grand))

    def relations(self, of: np.ndarray) -> np.ndarray:
        """(far, mid, hard) counts of candidates against the batch; a leaf lies in one parent, a parent in one grand."""
        g, p, k = self.n_grand[self.grand[of]], self.n_parent[self.parent[of]], self.n_leaf[self.leaf[of]]
        return np.stack([len(self.batch) - g, g - p, p - k], 1)

    def unsafe(self, of: np.ndarray) -> np.ndarray:
        """Candidates with a sibling in the batch that is nearly as close to the one's text as its own label, either way."""
        if self.vectors is None or not self.batch:
            return np.zeros(len(of), bool)
        seg, pos = self.vectors
        b = np.array(self.batch)
        hard = (self.parent[of][:, None] == self.parent[b]) & (self.leaf[of][:, None] != self.leaf[b])
        least = 1 - self.cfg.margin
        near = (seg[of] @ pos[b].T >= self.own[of][:, None] * least) | ((seg[b] @ pos[of].T).T >= self.own[b][None, :] * least)
        return (hard & near).any(1)

    def add(self, i: int) -> None:
        self.edges += 2 * self.relations(np.array([i]))[0]
        self.batch.append(i)
        self.free[i] = False
        self.repeats |= self.doc == self.doc[i]
        self.repeats[self.by_leaf[self.leaf[i]]] = True
        self.clashes[self.holders[self.leaf[i]]] = True
        for k in self.gold[i]:
            self.clashes[self.by_leaf[k]] = True
        self.n_leaf[self.leaf[i]] += 1
        self.n_parent[self.parent[i]] += 1
        self.n_grand[self.grand[i]] += 1

    def pick(self, target: tuple[float, ...], rng: np.random.Generator) -> int:
        """The best of some candidates drawn by weight, else the first fit of all in random order; constraints are
        dropped one by one where nothing fits: safety of siblings, then gold codes, then repeats."""
        pool = np.flatnonzero(self.free)
        w = self.weight[pool] / max(self.weight[pool].sum(), 1e-12)
        n = min(len(pool), self.cfg.candidates, int(np.count_nonzero(w)) or len(pool))
        some = rng.choice(pool, n, replace=False, p=w if w.sum() > 0 else None)
        for safe, gold, basic in ((1, 1, 1), (0, 1, 1), (0, 0, 1), (0, 0, 0)):
            for of, scored in ((some, True), (pool, False)):
                bad = (self.clashes[of] & bool(gold)) | (self.repeats[of] & bool(basic))
                if safe:
                    bad |= self.unsafe(of)
                fit = of[~bad]
                if len(fit):
                    return self.best(fit, target) if scored else int(rng.choice(fit))
        raise ValueError("nothing is left to pick")

    def best(self, fit: np.ndarray, target: tuple[float, ...]) -> int:
        """Of drawn candidates the one that brings the mix of relations nearest to the target, the first drawn on a tie."""
        if not self.batch or np.isnan(target[0]):
            return int(fit[0])
        e = self.edges + 2 * self.relations(fit)
        total = e.sum(1, keepdims=True)
        gain = np.where(total[:, 0] == 0, np.inf, -np.abs(e / np.maximum(total, 1) - np.array(target)).sum(1))
        return int(fit[int(np.argmax(gain))])


def build_epoch(rows: pd.DataFrame, epoch: int, cfg: BatchConfig) -> list[list[int]]:
    """Batches of row positions.  An unfinished batch is left out with ``drop_last``; its rows are used up all the same."""
    rng = np.random.default_rng(cfg.seed + epoch)
    target = cfg.targets[min(epoch, len(cfg.targets)) - 1]
    picker = Picker(rows, cfg)
    out: list[list[int]] = []
    while picker.free.any():
        picker.start()
        while len(picker.batch) < cfg.size and picker.free.any():
            picker.add(picker.pick(target, rng))
        if len(picker.batch) == cfg.size or not cfg.drop_last:
            out.append(picker.batch)
    return out


def fill_tail(rows: pd.DataFrame, prefix: list[int], pool: list[int], cfg: BatchConfig, epoch: int = 1) -> list[int]:
    """A batch that begins with ``prefix`` and is filled from ``pool``; an error where they overlap."""
    if set(prefix) & set(pool):
        raise ValueError("prefix and pool overlap")
    picker = Picker(rows, cfg)
    for i in prefix:
        picker.add(i)
    picker.free[:] = False
    picker.free[pool] = True
    rng = np.random.default_rng(cfg.seed + epoch)
    while len(picker.batch) < cfg.size and picker.free.any():
        picker.add(picker.pick(cfg.targets[min(epoch, len(cfg.targets)) - 1], rng))
    return picker.batch


def batch_count(n: int, size: int, drop_last: bool = True) -> int:
    return n // size if drop_last else -(-n // size)


def unsafe_siblings(batches: DataFrame, margin: float) -> DataFrame:
    """(batch, a, b): sibling pairs in which b's label is nearly as close to a's text as a's own label.

    ``batches`` holds (batch, pos, leaf, parent, grand, seg_vec, pos_vec).
    """
    b = batches.select("batch", F.struct("pos", "leaf", "parent", "grand", "seg_vec", "pos_vec").alias("r"))
    pairs = b.select("batch", F.col("r").alias("a")).join(b.select("batch", F.col("r").alias("b")), "batch").where("a.pos <> b.pos").where(relation("a", "b") == "hard")
    dot = lambda x, y: F.aggregate(F.zip_with(F.col(x), F.col(y), lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return pairs.where(dot("a.seg_vec", "b.pos_vec") >= dot("a.seg_vec", "a.pos_vec") * (1 - margin)).select("batch", F.col("a.pos").alias("a"), F.col("b.pos").alias("b"))


#: Rows that one task of a batch plan holds, about.
ROWS_OF_SHARD = 200_000


def _sharded(rows: DataFrame, shards: int | None) -> tuple[DataFrame, int]:
    """``rows`` with shard: documents by hash, and the rows of a document that is larger than a shard over all of them."""
    n = rows.count()
    shards = shards or max(1, -(-n // ROWS_OF_SHARD))
    if shards == 1:
        return rows.withColumn("shard", F.lit(0)), 1
    large = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > n // shards).select("doc_id", F.lit(1).alias("_large"))  # at most ``shards`` documents
    by = F.when(F.col("_large") == 1, F.xxhash64("row_id")).otherwise(F.xxhash64("doc_id"))
    return rows.join(F.broadcast(large), "doc_id", "left").withColumn("shard", F.pmod(by, F.lit(shards)).cast("int")).drop("_large"), shards


def batch_plan(rows: DataFrame, epochs: int, cfg: BatchConfig = BatchConfig(), shards: int | None = None) -> DataFrame:
    """(epoch, batch, pos, row_id) from (row_id, doc_id, leaf, parent, grand, gold, weight).

    Picking is sequential, so each epoch and shard is one task.  Rows are sharded by their document, in as many shards as
    keep a task's rows bounded; a row's candidates are those of its shard.
    """
    spark: SparkSession = rows.sparkSession
    dealt, shards = _sharded(rows, shards)
    every = dealt.crossJoin(F.broadcast(spark.range(1, epochs + 1).select(F.col("id").cast("int").alias("epoch"))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id").reset_index(drop=True)
        ids = pdf["row_id"].to_numpy()
        plan = [(key[0], b * shards + key[1], p, ids[i]) for b, batch in enumerate(build_epoch(pdf, int(key[0]), cfg)) for p, i in enumerate(batch)]
        return pd.DataFrame(plan, columns=["epoch", "batch", "pos", "row_id"])

    # A stated number of partitions, as small groups of slow work would else be put into one task.
    return every.repartition(2 * epochs * shards, "epoch", "shard").groupBy("epoch", "shard").applyInPandas(run, "epoch int, batch int, pos int, row_id bigint")


def unique_batches(rows: DataFrame, size: int, epoch: int = 1, seed: int = 42, shards: int | None = None) -> DataFrame:
    """(batch, pos, row_id): rows in random order; one that repeats a segment, code or document of the open batch is lost."""
    dealt, shards = _sharded(rows, shards)
    keyed = dealt.withColumn("_o", F.md5(F.concat_ws("~", F.lit(str(seed + epoch)), F.col("row_id").cast("string"))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, batch, seen = [], 0, (set(), set(), set())
        held: list[int] = []
        for r in pdf.sort_values(["_o", "row_id"]).itertuples():
            values = (r.segment, r.leaf, r.doc_id)
            if any(v in s for v, s in zip(values, seen)):
                continue
            held.append(r.row_id)
            for v, s in zip(values, seen):
                s.add(v)
            if len(held) == size:
                out += [(batch * shards + int(key[0]), p, i) for p, i in enumerate(held)]
                batch, held, seen = batch + 1, [], (set(), set(), set())
        return pd.DataFrame(out, columns=["batch", "pos", "row_id"])

    return keyed.groupBy("shard").applyInPandas(run, "batch int, pos int, row_id bigint")


def replayed(plan: DataFrame, epoch: int) -> DataFrame:
    """The batches of an epoch of a stored plan; after the last one it repeats."""
    last = plan.agg(F.max("epoch").alias("last"))
    return plan.crossJoin(F.broadcast(last)).where(F.col("epoch") == F.least(F.lit(epoch), F.col("last"))).drop("last")


def resume_window(rows: DataFrame, order: str, done: int, most: int) -> DataFrame:
    """Rows ``done`` + 1 to ``done`` + ``most`` by the unique column ``order``.

    Rows are put in ranges and numbered within each; the driver sees the number of rows by range.
    """
    placed = stash(rows.repartitionByRange(order).withColumn("_p", F.spark_partition_id()), "ranges")
    offset, at = {}, 0
    for r in sorted(placed.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["_p"]):
        offset[r["_p"]], at = at, at + r["n"]
    if not offset:
        return placed.drop("_p")
    wanted = [p for p, o in offset.items() if o < done + most]
    before = F.create_map(*[x for p, o in offset.items() for x in (F.lit(p), F.lit(o))])
    number = F.row_number().over(Window.partitionBy("_p").orderBy(order)) + before[F.col("_p")]
    return placed.where(F.col("_p").isin(wanted)).withColumn("_n", number).where(F.col("_n").between(done + 1, done + most)).drop("_n", "_p")


def plain_pairs(segments: DataFrame, texts: DataFrame) -> DataFrame:
    """(row_id, anchor, positive, code): a segment with the text of each of its codes (an array) that has one."""
    rows = segments.select("row_id", F.col("segment_text").alias("anchor"), F.explode(F.array_distinct("codes")).alias("code")).where(F.length("anchor") > 0)
    return rows.join(texts.select("code", F.col("text").alias("positive")), "code").select("row_id", "anchor", "positive", "code")


def document_pairs(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, anchor, positive, code) from gold documents (doc_id, text, gold_codes); codes without text are left out."""
    return plain_pairs(docs.select(F.col("doc_id").alias("row_id"), F.col("text").alias("segment_text"), F.col("gold_codes").alias("codes")), texts).withColumnRenamed("row_id", "doc_id")


def plan_audit(plan: DataFrame, rows: DataFrame) -> DataFrame:
    """(epoch, batches, n_rows, distinct_rows, smallest, largest, unknown): what each epoch of a plan uses."""
    known = plan.join(rows.select("row_id", F.lit(1).alias("_k")).distinct(), "row_id", "left")
    sizes = known.groupBy("epoch", "batch").agg(F.count(F.lit(1)).alias("n"), F.count("_k").alias("k"))
    per = sizes.groupBy("epoch").agg(F.count(F.lit(1)).alias("batches"), F.sum("n").alias("n_rows"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.sum(F.col("n") - F.col("k")).alias("unknown"))
    return per.join(plan.groupBy("epoch").agg(F.countDistinct("row_id").alias("distinct_rows")), "epoch")
