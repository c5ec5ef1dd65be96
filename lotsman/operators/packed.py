"""Several values packed in one field: one row per value, with its position.

Quoted spans are atomic values.  Every run of digits and dots between them is a lattice: its arcs are the codes it can
be read as, and the joints between codes that no delimiter parts.  Paths are weighed with the frequencies of codes and
of bare joints, learnt from the whole column by expectation maximisation, from even frequencies on; the best path
(Viterbi) gives the values.  So it is the column that tells whether ``12.34.56`` is one code or several.  Runs that no
path covers, words and delimiters are no values.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotsman.session import stash

CODE = re.compile(r"\d\d(?:\.\d\d){0,2}", re.ASCII)
#: Quoted spans (double quotes may hold doubled ones), else runs of digits and dots that touch no letter or digit.
TOKEN = re.compile(r'"((?:[^"]|"")*)"|\'([^\']*)\'|«([^»]*)»|(?<![\w.])([0-9][0-9.]*)(?!\w)')
#: Different codes that can exist: bounds the table of frequencies that the driver holds.
MAX_VALUES = 100 + 100**2 + 100**3


class Weights:
    """Frequencies of codes, ``floor`` for unseen ones, and of a bare joint after a code."""

    def __init__(self, codes: dict[str, float], floor: float, joint: float):
        self.codes, self.floor, self.joint = codes, floor, joint

    def arc(self, code: str, last: bool) -> float:
        return self.codes.get(code, self.floor) * (1 - self.joint if last else self.joint)


EVEN = Weights({}, 1e-3, 0.5)


def paths(run: str) -> list[list[tuple[int, str]]]:
    """Arcs by start position: (end, code), where an arc also passes over one dot after its code."""
    arcs: list[list[tuple[int, str]]] = [[] for _ in range(len(run) + 1)]
    for i in range(len(run)):
        for size in (2, 5, 8):
            code = run[i : i + size]
            if len(code) == size and CODE.fullmatch(code):
                arcs[i].append((i + size, code))
                if run[i + size : i + size + 1] == ".":
                    arcs[i].append((i + size + 1, code))
    return arcs


def viterbi(run: str, w: Weights) -> list[str]:
    """The most probable reading of a run as codes, fewer codes on a tie; empty where there is none."""
    n = len(run)
    arcs = paths(run)
    best: list[tuple[float, int, int, str] | None] = [None] * (n + 1)
    best[0] = (0.0, 0, -1, "")
    for i in range(n):
        if best[i] is None:
            continue
        for j, code in arcs[i]:
            cand = (best[i][0] + math.log(w.arc(code, j == n)), best[i][1] - 1, i, code)
            if best[j] is None or cand[:2] > best[j][:2]:
                best[j] = cand
    out: list[str] = []
    j = n
    while j > 0:
        if best[j] is None:
            return []
        out.append(best[j][3])
        j = best[j][2]
    return out[::-1]


def expected(run: str, w: Weights) -> Counter:
    """Expected number of each code, and of bare joints under "", over all readings of a run (forward and backward sums)."""
    n = len(run)
    best = [0.0, *[-math.inf] * n]
    steps = [(i, j, code, w.arc(code, j == n)) for i, arcs in enumerate(paths(run)) for j, code in arcs]
    for i, j, _, p in steps:
        best[j] = max(best[j], best[i] + math.log(p))
    if best[n] == -math.inf:
        return Counter()
    # Scaled by the best path a character, so that sums over long runs neither vanish nor overflow.
    steps = [(i, j, code, math.exp(math.log(p) - best[n] * (j - i) / n)) for i, j, code, p in steps]
    forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
    forward[0] = backward[n] = 1.0
    for i, j, _, p in steps:
        forward[j] += forward[i] * p
    for i, j, _, p in reversed(steps):
        backward[i] += p * backward[j]
    out: Counter = Counter()
    if forward[n] > 0:
        for i, j, code, q in steps:
            p = forward[i] * q * backward[j] / forward[n]
            out[code] += p
            if j < n:
                out[""] += p
    return out


def tokens(field: str) -> Iterator[tuple[str, str]]:
    """("quoted" | "run", text) in order."""
    for m in TOKEN.finditer(field):
        double, single, angle, run = m.groups()
        if run is not None:
            run = run.rstrip(".")
            if len(run) == 2 or "." in run:
                yield "run", run
        else:
            value = (double.replace('""', '"') if double is not None else single if single is not None else angle).strip()
            if value:
                yield "quoted", value


class Reader(dict):
    """The values of each run, read once a run."""

    def __init__(self, w: Weights):
        self.w = w

    def __missing__(self, run: str) -> list[str]:
        if len(self) > 200_000:
            self.clear()
        self[run] = out = viterbi(run, self.w)
        return out


def split_field(field: str, read: Reader) -> list[str]:
    """The values of one field in order."""
    out: list[str] = []
    for kind, text in tokens(field):
        if kind == "run":
            out += read[text]
        else:
            out.append(text)
    return out


def learn(df: DataFrame, col: str, iterations: int = 3) -> Weights:
    """Weights learnt over the whole column.

    Runs are counted once and kept with their counts in a table of the shared folder; a code that begins a quoted value
    counts as read.  From even weights on, each iteration takes the expected counts of all readings of all runs.  Only
    sums by code reach the driver: at most MAX_VALUES rows.
    """
    schema = pa.schema([("kind", pa.string()), ("text", pa.string()), ("n", pa.float64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"kind": [k for k, _ in c], "text": [t for _, t in c], "n": [float(n) for n in c.values()]}, schema=schema)

        for batch in batches:
            for field in batch.column(0).to_pylist():
                for kind, text in tokens(field):
                    if kind == "run":
                        c[kind, text] += 1
                    elif m := CODE.match(text):
                        c["code", m.group(0)] += 1
            if len(c) > 100_000:
                yield rows()
                c.clear()
        if c:
            yield rows()

    counted = stash(df.select(col).where(F.col(col).isNotNull()).mapInArrow(count, "kind string, text string, n double").groupBy("kind", "text").agg(F.sum("n").alias("n")), "counts")
    base = Counter({r["text"]: r["n"] for r in counted.where("kind = 'code'").toLocalIterator()})
    runs = counted.where("kind = 'run'").select("text", "n")
    w = EVEN
    for _ in range(iterations):
        shared = df.sparkSession.sparkContext.broadcast(w)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            c: Counter = Counter()
            for batch in batches:
                for run, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for code, p in expected(run, shared.value).items():
                        c[code] += p * n
            yield pa.RecordBatch.from_pydict({"text": pa.array(list(c), pa.string()), "n": pa.array(list(c.values()), pa.float64())})

        counts = Counter(base)
        for r in runs.mapInArrow(expect, "text string, n double").groupBy("text").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[r["text"]] += r["n"]
        joints = counts.pop("", 0.0)
        values = sum(counts.values())
        total = values + 0.5 * (len(counts) + 1)
        w = Weights({k: (v + 0.5) / total for k, v in counts.items()}, 0.5 / total, (joints + 0.5) / (values + 1))
    return w


def split_values(df: DataFrame, id_col: str = "row_id", col: str = "grnti_codes", weights: Weights | None = None) -> DataFrame:
    """(id, pos, code_value), one row per value, positions from 1.

    Null, empty and blank fields, and fields without a value, give no rows; repeated values and repeated rows are
    kept; an empty quoted span is no value.  Row by row without a shuffle, apart from the learning of frequencies
    where no ``weights`` are given.
    """
    shared = df.sparkSession.sparkContext.broadcast(weights or learn(df, col))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(shared.value)
        for batch in batches:
            row, pos, out = [], [], []
            for i, field in enumerate(batch.column(1).to_pylist()):
                values = split_field(field, read)
                row += [i] * len(values)
                pos += range(1, len(values) + 1)
                out += values
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(pos, pa.int32()), pa.array(out, pa.string())], names=[id_col, "pos", "code_value"])

    return df.where(F.col(col).isNotNull()).select(id_col, col).mapInArrow(run, f"`{id_col}` {kind}, pos int, code_value string")
