"""Filling containers of fixed capacity with texts measured in tokens (variable-capacity best fit)."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotsman.llm.tokens import token_counts
from lotsman.session import stash

#: Lengths a container may be cut down to; the largest is the capacity.
LENGTHS = (256, 512, 1024, 1536, 2048)
#: Tokens that a container costs besides its length.
OVERHEAD = 64
#: Tokens packed by one task: bounds its memory, and wastes at most about one container in 15,000.
GROUP_TOKENS = 32_000_000


class Supply:
    """Sizes still to be placed that no open container counts on."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.free = np.bincount(sizes, minlength=capacity + 1).tolist()
        self.free[0] = 0
        self.promised = [0] * (capacity + 1)
        self.mask = sum(1 << s for s, n in enumerate(self.free) if n)

    def take(self, s: int, promised: bool) -> None:
        """An item of size ``s`` is placed: one that was promised, or a free one."""
        if self.promised[s] and (promised or not self.free[s]):
            self.promised[s] -= 1
        elif self.free[s]:
            self.free[s] -= 1
            if not self.free[s]:
                self.mask &= ~(1 << s)

    def filling(self, room: int) -> tuple[int, list[tuple[int, int]]]:
        """(what is left of ``room``, [(size, number)]) when it is filled with the largest free sizes in turn."""
        plan = []
        mask = self.mask
        while room > 0:
            mask &= (2 << room) - 1
            if not mask:
                break
            s = mask.bit_length() - 1
            k = min(self.free[s], room // s)
            plan.append((s, k))
            room -= k * s
            mask ^= 1 << s
        return room, plan

    def promise(self, plan: list[tuple[int, int]]) -> None:
        for s, k in plan:
            self.promised[s] += k
            self.free[s] -= k
            if not self.free[s]:
                self.mask &= ~(1 << s)


def best_fit(sizes: np.ndarray, lengths: tuple[int, ...], overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(container, slot, start, container length) of each size; sizes are at most ``lengths[-1]``.

    Largest first, each into the open container whose free room fits it most closely.  Where none fits, a container is
    opened.  Its length is the permitted one that costs least for what it will hold: what would stay unused when it is
    filled with sizes that no other container counts on, and an overhead, over the length; the longer on a tie.  Those
    sizes are then promised to it, so the lengths of all containers are chosen together.  At the end each container is
    cut down to the shortest length that holds its contents.
    """
    capacity = lengths[-1]
    order = np.argsort(-sizes, kind="stable")
    n = len(sizes)
    container, slot, start = np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros(n, np.int32)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set where a container with room r is open
    used: list[int] = []
    held: list[int] = []
    supply = Supply(sizes, capacity)
    for i in order.tolist():
        s = int(sizes[i])
        fits = rooms >> s
        supply.take(s, promised=bool(fits))
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            c = by_room[r].pop()
            if not by_room[r]:
                rooms &= ~(1 << r)
        else:
            c = len(used)
            used.append(0)
            held.append(0)
            plans = [(x, *supply.filling(x - s)) for x in lengths if x >= s]
            r, _, plan = min(plans, key=lambda p: ((p[1] + overhead) / p[0], -p[0]))
            supply.promise(plan)
        container[i], slot[i], start[i] = c, held[c], used[c]
        used[c] += s
        held[c] += 1
        if not by_room[r - s]:
            rooms |= 1 << (r - s)
        by_room[r - s].append(c)
    steps = np.array(lengths)
    length = steps[np.searchsorted(steps, np.array(used or [0]))].astype(np.int32)
    return container, slot, start, length[container] if n else np.zeros(0, np.int32)


def pack_sizes(sizes: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", lengths: tuple[int, ...] = LENGTHS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Places items into containers of ``max(lengths)``.

    (id, piece, n_tokens, container, slot, start, container_length).  An item is split only where it is longer than
    the capacity: into full pieces, each filling a container, and a rest that is packed like other items.  An item
    of size 0 (null or empty text) gets a place of size 0, a null id a place like any other.  Repeated rows are packed each for itself.  An empty
    table gives no rows.  Items are packed in groups by a hash of the row's place, so that rows of one id
    or none are spread, no task sees more than about
    ``group_tokens`` tokens; a group is one Arrow batch of three numbers an item.
    """
    lengths = tuple(sorted(lengths))
    cap = lengths[-1]
    total = sizes.agg(F.sum(size_col).alias("s"), F.count(F.lit(1)).alias("n")).first()
    groups = max(1, -(-int(total["s"] or 0) // group_tokens), -(-int(total["n"]) // 1_000_000))
    group = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))
    pieces = sizes.select(F.col(id_col), F.col(size_col).cast("bigint").alias("_n"), group.alias("_group")).select(
        id_col, "_n", "_group", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("_n") - 1) / cap)).cast("int"))).alias("piece")
    )
    pieces = pieces.select(
        id_col, "piece", F.least(F.lit(cap), F.col("_n") - F.col("piece") * cap).cast("int").alias("n_tokens"), "_group"
    )
    kind = sizes.schema[id_col].dataType.simpleString()

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(id_col, "ascending"), ("piece", "ascending")]))
        c, slot, start, length = best_fit(rows.column("n_tokens").to_numpy(), lengths)
        placed = {"container": (key[0].as_py() << 32) + c, "slot": slot, "start": start, "container_length": length}
        return pa.table({**{n: rows.column(n) for n in (id_col, "piece", "n_tokens")}, **{n: pa.array(x) for n, x in placed.items()}})

    return pieces.groupBy("_group").applyInArrow(run, f"`{id_col}` {kind}, piece int, n_tokens int, container bigint, slot int, start int, container_length int")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS, vocabulary: str | None = None) -> DataFrame:
    """``pack_sizes`` of the token counts of the texts; texts are read and encoded once."""
    return pack_sizes(stash(token_counts(df, id_col, text_col, vocabulary), "sizes"), id_col, "n_tokens", lengths)


def fill_report(packed: DataFrame, capacity: int = LENGTHS[-1]) -> DataFrame:
    """One row: containers, tokens, permille of the fixed capacity and of the cut-down lengths that is filled."""
    each = packed.groupBy("container").agg(F.sum("n_tokens").alias("t"), F.max("container_length").alias("l"), F.count(F.lit(1)).alias("n"))
    return each.agg(
        F.count(F.lit(1)).alias("containers"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("pieces"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"),
        F.floor(F.sum("t") * 1000 / (F.count(F.lit(1)) * capacity)).alias("filled_permille"),
        F.floor(F.sum("t") * 1000 / F.sum("l")).alias("filled_permille_cut_down"),
    )


