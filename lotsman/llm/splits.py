"""Splits that keep all rows of a document together (largest differencing into equal bins, then bins to splits)."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotsman.session import stash

#: Units balanced by one task, hash groups at least, groups whose bins the driver deals out, bins of a group.  The driver
#: sees MOST_GROUPS * BINS sums at most, whatever the data.
GROUP_UNITS = 200_000
LEAST_GROUPS = 16
MOST_GROUPS = 4096
BINS = 40
#: Parts into which rows without a document are hashed; each part is a unit like a document.
FREE_PARTS = 4096


def document_key(col: Column | str) -> Column:
    """Prefix word without regard to case and number as a value, else the letters and digits; null where missing."""
    c = F.col(col) if isinstance(col, str) else col
    c = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    word = F.lower(F.regexp_extract(c, r"(\p{L}+)", 1))
    number = F.regexp_replace(F.regexp_extract(c, r"(\p{Nd}+)", 1), r"^0+(?=.)", "")
    other = F.concat(F.lit("?"), F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")))
    return F.when((c == "") | c.isNull(), F.lit(None)).when((word != "") & (number != ""), F.concat(word, F.lit("_"), number)).otherwise(other)


def units(rows: DataFrame, id_col: str = "row_id", doc_col: str = "doc_id") -> DataFrame:
    """``rows`` (table_name, id, doc_id) with the unit that must stay together: the document, or a part of the free rows."""
    free = F.concat(F.lit("\x00free"), F.pmod(F.xxhash64("table_name", id_col), F.lit(FREE_PARTS)))
    return rows.withColumn("unit", F.coalesce(document_key(doc_col), free))


def difference(weights: list[int], bins: int) -> list[int]:
    """The bin of each weight: partial solutions are kept in a heap by the gap between their extreme bins; the two with
    the largest gaps are combined, heavy bins with light ones, until one is left."""
    if not weights:
        return []
    # A solution is a list of (sum, members) by bin in use, heaviest first; members are a linked tree, read at the end.
    heap = [(-w, k, [(w, ("leaf", k))]) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    tie = len(weights)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # Bins of a by falling sum on bins of b by rising sum, empty ones included: the lightest of either meet.
        both = max(0, len(a) + len(b) - bins)
        joined = a[: len(a) - both] + b[: len(b) - both]
        joined += [(x + y, ("both", s, t)) for (x, s), (y, t) in zip(a[len(a) - both :], reversed(b[len(b) - both :]))]
        joined.sort(key=lambda x: -x[0])
        low = joined[-1][0] if len(joined) == bins else 0
        heapq.heappush(heap, (low - joined[0][0], tie, joined))
        tie += 1
    out = [0] * len(weights)
    for b, (_, tree) in enumerate(heap[0][2]):
        stack = [tree]
        while stack:
            t = stack.pop()
            if t[0] == "leaf":
                out[t[1]] = b
            else:
                stack += t[1:]
    return out


def allocate(bins: list[tuple[tuple, int]], shares: list[tuple[str, int]]) -> dict[tuple, str]:
    """A split for each whole bin: heaviest first, to the split furthest below its target."""
    total = sum(w for _, w in bins)
    whole = sum(s for _, s in shares) or 1
    left = {name: total * share / whole for name, share in shares}
    out = {}
    for key, w in sorted(bins, key=lambda x: (-x[1], x[0])):
        name = max(shares, key=lambda s: (left[s[0]], s[1], s[0]))[0]
        out[key] = name
        left[name] -= w
    return out


def assign_units(weighted: DataFrame, shares: DataFrame, groups: int | None = None, bins: int = BINS, most_groups: int = MOST_GROUPS) -> DataFrame:
    """(unit, split_name) from (unit, n).

    A group of units fits one task whatever their number; where there are more than ``most_groups`` groups, their bins
    are balanced again as units, so the driver sees at most ``most_groups * bins`` sums and the shares.
    """
    weighted = stash(weighted, "weights")
    groups = groups or max(LEAST_GROUPS, weighted.count() // GROUP_UNITS)

    def balance(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # Units of one weight are exchangeable: a full round of them, one a bin, changes no difference.
        pdf = pdf.sort_values(["n", "unit"], ascending=[False, True], kind="stable").reset_index(drop=True)
        size = pdf.groupby("n")["n"].transform("size")
        place = pdf.groupby("n").cumcount()
        even = place < (size // bins) * bins
        pdf["bin"] = (place % bins).astype("int32")
        rest = pdf.index[~even]
        pdf.loc[rest, "bin"] = np.array(difference(pdf.loc[rest, "n"].astype(int).tolist(), bins), np.int32)
        pdf["grp"] = int(key[0])
        return pdf[["unit", "n", "grp", "bin"]].astype({"bin": "int32", "grp": "int32"})

    grouped = weighted.select("unit", "n", F.pmod(F.xxhash64("unit"), F.lit(groups)).cast("int").alias("_g"))
    binned = stash(grouped.groupBy("_g").applyInPandas(balance, "unit string, n bigint, grp int, bin int"), "bins")
    if groups > most_groups:  # the bins are units in their turn: fewer by GROUP_UNITS / bins
        whole = F.concat_ws(":", "grp", "bin")
        of_bin = assign_units(binned.groupBy(whole.alias("unit")).agg(F.sum("n").alias("n")), shares, most_groups=most_groups).withColumnRenamed("unit", "_bin")
        return binned.withColumn("_bin", whole).join(of_bin, "_bin").select("unit", "split_name")
    sums = [((r["grp"], r["bin"]), int(r["n"])) for r in binned.groupBy("grp", "bin").agg(F.sum("n").alias("n")).collect()]
    share_rows = sorted((r["split_name"], int(r["share_permille"])) for r in shares.where("split_name is not null and share_permille > 0").collect())
    if not sums or not share_rows:
        return binned.select("unit", F.lit(None).cast("string").alias("split_name")).where("false")
    chosen = allocate(sums, share_rows)
    spark = weighted.sparkSession
    plan = spark.createDataFrame([(g, b, s) for (g, b), s in chosen.items()], "grp int, bin int, split_name string")
    return binned.join(F.broadcast(plan), ["grp", "bin"]).select("unit", "split_name")  # at most groups * bins rows


def assign_splits(rows: DataFrame, shares: DataFrame, id_col: str = "row_id", doc_col: str = "doc_id", salts: int = 16) -> DataFrame:
    """(table_name, id, split_name) for ``rows`` (table_name, id, doc_id).

    All rows of a document, however its id is spelled, land in one split; rows without a document are free and are
    spread to fill the shares.  A document larger than a split's share still stays whole.  Repeated rows are rows.
    Without shares or rows there are no rows.  Rows of a hot document are counted map-side and joined by salt.
    """
    u = stash(units(rows, id_col, doc_col).select("table_name", id_col, "unit"), "units")
    assigned = assign_units(u.groupBy("unit").agg(F.count(F.lit(1)).alias("n")), shares)
    copies = assigned.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return u.withColumn("_s", F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int")).join(copies, ["unit", "_s"]).select("table_name", id_col, "split_name")


def found_spellings(rows: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """(doc_id_a, doc_id_b): every two different stored ids of one document, the smaller first; missing ids are none.

    Read off the units that ``assign_splits`` keeps together, on distinct ids, so rows of a hot document count once for
    each spelling.
    """
    distinct = rows.select("table_name", doc_col).groupBy(doc_col).agg(F.min("table_name").alias("table_name")).where(document_key(doc_col).isNotNull())
    spelled = units(distinct, doc_col, doc_col).select(F.col(doc_col).alias("doc_id"), "unit")
    a, b = spelled.withColumnRenamed("doc_id", "doc_id_a"), spelled.withColumnRenamed("doc_id", "doc_id_b")
    return a.join(b, "unit").where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")


def split_report(assigned: DataFrame, shares: DataFrame) -> DataFrame:
    """(split_name, n_rows, permille, share_permille) for every split, also one without rows."""
    per = assigned.groupBy("split_name").agg(F.count(F.lit(1)).alias("n_rows"))
    total = assigned.agg(F.count(F.lit(1)).alias("total"))
    return shares.join(per, "split_name", "left").crossJoin(F.broadcast(total)).select(
        "split_name", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.floor(F.coalesce("n_rows", F.lit(0)) * 1000 / F.greatest("total", F.lit(1))).alias("permille"), "share_permille"
    )


