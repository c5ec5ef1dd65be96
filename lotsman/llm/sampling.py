"""A sample whose categories match target shares (acceptance probabilities, then exact correction)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lotsman.operators.packed import learn, split_values
from lotsman.session import stash

#: Equal parts of [0, 1) by which accepted rows are counted for the exact correction.
PARTS = 4096
#: Share of the acceptance probability that is added, so that counts rarely fall short.
OVERSAMPLING = 0.1


def _missing(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))


def with_category(df: DataFrame, id_col: str = "row_id") -> DataFrame:
    """(id, category): two characters of the stripped top_code, else of the smallest packed value, else null.

    One row a row of ``df``; equal rows stay apart.  Frequencies are learnt from the whole column; only rows without
    top_code are split into values.
    """
    top = df.select(id_col, _missing(F.col("top_code")).alias("_t"), "grnti_codes")
    smallest = split_values(top.where("_t is null"), id_col, "grnti_codes", learn(df, "grnti_codes")).groupBy(id_col).agg(F.min("code_value").alias("_v"))
    told = top.where("_t is not null").select(id_col, F.substring("_t", 1, 2).alias("category"))
    rest = top.where("_t is null").select(id_col).join(smallest, id_col, "left").select(id_col, F.substring("_v", 1, 2).alias("category"))
    return told.unionByName(rest)


def sample_size(rows: int) -> int:
    return 3 * rows // 10


def quotas(have: dict[str, int], targets: list[tuple[str, int, int]], size: int, other: int) -> dict[str | None, int]:
    """Rows to draw of each target category, and under None of all rows outside them; they sum to ``size``.

    A category gets its share (largest remainders), at least its minimum, at most its rows.  What one lacks goes to
    others in proportion to their shares; rows outside the targets come only when those are used up.
    """
    want = {c: p * size / 1000 for c, p, _ in targets}
    low = {c: min(have.get(c, 0), m) for c, _, m in targets}
    fixed: dict[str, float] = {}
    open_ = {c for c in want if have.get(c, 0) > 0}
    while open_:  # each round fixes a category, so there are at most as many rounds as categories
        room = max(0.0, size - sum(fixed.values()))
        weight = sum(want[c] for c in open_)
        scaled = {c: room * want[c] / weight if weight else 0.0 for c in open_}
        over = {c for c in open_ if scaled[c] >= have[c]}
        under = {c for c in open_ if scaled[c] < low[c]}
        if over:
            fixed |= {c: float(have[c]) for c in over}
            open_ -= over
        elif under:
            fixed |= {c: float(low[c]) for c in under}
            open_ -= under
        else:
            fixed |= scaled
            break
    out: dict[str | None, int] = {c: int(x) for c, x in fixed.items()}
    short = min(size, sum(have.get(c, 0) for c in want)) - sum(out.values())
    for c in sorted(fixed, key=lambda c: (int(fixed[c]) - fixed[c], c)):  # largest remainder first
        if short > 0 and out[c] < have[c]:
            out[c] += 1
            short -= 1
    for c in sorted(fixed):
        add = min(short, have[c] - out[c]) if short > 0 else max(short, low[c] - out[c])
        out[c] += add
        short -= add
    out[None] = max(0, min(other, size - sum(out.values())))
    return out


def _counts(cat: DataFrame) -> tuple[dict[str | None, int], int]:
    """Rows by category; categories outside the targets are under None before this, so the result is small."""
    got = {r["category"]: int(r["n"]) for r in cat.groupBy("category").agg(F.count(F.lit(1)).alias("n")).collect()}
    return got, sum(got.values())


def _targets(targets: DataFrame) -> list[tuple[str, int, int]]:
    """The target table is the caller's specification; one row a category."""
    return sorted((r["top_code"], int(r["target_permille"]), int(r["min_rows"] or 0)) for r in targets.where("top_code is not null and target_permille is not null").collect())


def _within_targets(cat: DataFrame, names: list[str]) -> DataFrame:
    return cat.withColumn("category", F.when(F.col("category").isin(names), F.col("category")))


class Plan:
    """What a draw starts from: rows with category and a number in [0, 1), counts, targets and quotas by category."""

    def __init__(self, df: DataFrame, targets: DataFrame, id_col: str, seed: int):
        self.goal = _targets(targets)
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11) / F.lit(float(2**53))
        self.rows = stash(_within_targets(with_category(df, id_col), [c for c, _, _ in self.goal]).withColumn("_u", u), "categories")
        self.have, self.n = _counts(self.rows)
        self.size = sample_size(self.n)
        self.quota = quotas({c: n for c, n in self.have.items() if c is not None}, self.goal, self.size, self.have.get(None, 0))

    def report(self) -> list[tuple[str, int, int, int, int, int, int]]:
        """(top_code, target_permille, min_rows, n_rows, wanted, quota, deficit) of each target, from which the draw
        takes its quotas; ``wanted`` is the larger of minimum and share, the deficit what the rows there lack of it."""
        out = []
        for c, p, low in self.goal:
            n, wanted = self.have.get(c, 0), max(low, -(-p * self.size // 1000))
            out.append((c, p, low, n, wanted, self.quota.get(c, 0), max(0, wanted - n)))
        return out


REPORT = "top_code string, target_permille int, min_rows int, n_rows bigint, wanted bigint, quota bigint, deficit bigint"


def deficits(df: DataFrame, targets: DataFrame, id_col: str = "row_id", seed: int = 42) -> DataFrame:
    """(top_code, n_rows, wanted, min_rows, quota, deficit): targets whose rows are fewer than the minimum or the share,
    as the plan of the draw reports them."""
    short = [r for r in Plan(df, targets, id_col, seed).report() if r[-1] > 0]
    return df.sparkSession.createDataFrame(short, REPORT).select("top_code", "n_rows", "wanted", "min_rows", "quota", "deficit")


def draw(df: DataFrame, targets: DataFrame, id_col: str = "row_id", seed: int = 42, plan: Plan | None = None) -> DataFrame:
    """(id, category) of the sampled rows: floor(3 * rows / 10) of them, fewer only if there are fewer rows.

    Each row has a number in [0, 1) from its id and the seed.  It is accepted below its category's probability, the
    ratio of quota and rows with slight oversampling; a category that falls short gets a larger probability.  The
    exact correction counts accepted rows by 1/4096 parts of [0, 1), keeps whole parts, and ranks only the rows of
    the one part in each category where the quota ends.  The driver sees counts by category and part: at most
    (targets + 1) * 4096.  Rows without a target category are drawn only when targets cannot fill the size.
    """
    spark = df.sparkSession
    plan = plan or Plan(df, targets, id_col, seed)
    cat, have, quota = plan.rows, plan.have, plan.quota
    chance = {c: min(1.0, (1 + OVERSAMPLING) * q / have[c]) for c, q in quota.items() if q > 0}
    schema = T.StructType([T.StructField("_key", T.StringType()), T.StructField("_p", T.DoubleType())])
    key = F.coalesce("category", F.lit("\x00"))
    part = F.floor(F.col("_u") * PARTS).cast("int")
    while True:
        p = spark.createDataFrame([(c if c is not None else "\x00", x) for c, x in chance.items()], schema)
        accepted = cat.withColumn("_key", key).join(F.broadcast(p), "_key").where("_u < _p").withColumn("_part", part)
        counts: dict[str, dict[int, int]] = {}
        for r in accepted.groupBy("_key", "_part").agg(F.count(F.lit(1)).alias("n")).collect():
            counts.setdefault(r["_key"], {})[r["_part"]] = int(r["n"])
        short = [c for c, x in chance.items() if x < 1 and sum(counts.get(c if c is not None else "\x00", {}).values()) < quota[c]]
        if not short:
            break
        for c in short:
            chance[c] = min(1.0, chance[c] * 1.5)
    ends = []
    for c in chance:
        k, left, end = (c if c is not None else "\x00"), quota[c], PARTS
        for x in sorted(counts.get(k, {})):
            if counts[k][x] > left:
                end = x
                break
            left -= counts[k][x]
        ends.append((k, end, left))
    e = spark.createDataFrame(ends, "_key string, _end int, _left int")
    placed = accepted.join(F.broadcast(e), "_key")  # as many rows as categories
    sure = placed.where("_part < _end").select(id_col, "category")
    last = placed.where("_part = _end").withColumn("_rank", F.row_number().over(Window.partitionBy("_key").orderBy("_u", id_col))).where("_rank <= _left")
    return sure.unionByName(last.select(id_col, "category"))


def draw_report(df: DataFrame, targets: DataFrame, id_col: str = "row_id", seed: int = 42) -> DataFrame:
    """(top_code, target_permille, min_rows, n_rows, deficit, drawn, sample_permille) for each target category."""
    plan = Plan(df, targets, id_col, seed)
    s = draw(df, targets, id_col, seed, plan).groupBy("category").agg(F.count(F.lit(1)).alias("drawn"))
    total = s.agg(F.greatest(F.coalesce(F.sum("drawn"), F.lit(0)), F.lit(1)).alias("_total"))
    told = df.sparkSession.createDataFrame(plan.report(), REPORT)
    return told.join(s, F.col("category") == F.col("top_code"), "left").crossJoin(F.broadcast(total)).select(
        "top_code", "target_permille", "min_rows", "n_rows", "deficit", F.coalesce("drawn", F.lit(0)).alias("drawn"), F.floor(F.coalesce("drawn", F.lit(0)) * 1000 / F.col("_total")).alias("sample_permille")
    )
