"""Cutting oversized texts at natural boundaries, with overlap (recursive separator hierarchy)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Separators from strong to weak; a cut is at the end of a match.
SECTION = re.compile(r"\n(?=[ \t]*(?:РАЗДЕЛ|Раздел|SECTION|Section|#{1,6} |\d+(?:\.\d+)*\.? +[A-ZА-ЯЁ]))")
PARAGRAPH = re.compile(r"(?:\r\n|\r|\n)[ \t ]*(?:\r\n|\r|\n)\s*")
LINE = re.compile(r"\r\n|\r|\n")
SENTENCE = re.compile(r"[.!?…]+[\"»”’)\]]*\s+|;\s+")
WORD = re.compile(r"\s+")
LEVELS = (SECTION, PARAGRAPH, LINE, SENTENCE, WORD)


def atoms(text: str, start: int, end: int, limit: int, level: int = 0) -> list[tuple[int, int]]:
    """Consecutive spans of at most ``limit`` that cover ``[start, end)``, each as strong a unit as fits."""
    done: list[tuple[int, int]] = []
    todo = [(start, end, level)]
    while todo:
        a, b, k = todo.pop()
        if b - a <= limit:
            done.append((a, b))
        elif k == len(LEVELS):
            done += [(x, min(x + limit, b)) for x in range(a, b, limit)]
        else:
            cuts = [a, *(m.end() for m in LEVELS[k].finditer(text, a, b) if a < m.end() < b), b]
            todo += [(x, y, k + 1) for x, y in zip(cuts[-2::-1], cuts[:0:-1])]
    return done


def overlap_start(text: str, piece: int, end: int, room: int) -> int:
    """Where the next piece starts: the first sentence start within ``room`` before ``end``, else word start, else ``end``."""
    low = max(piece + 1, end - room)
    if low >= end:
        return end
    back = max(piece, low - 200)  # a separator may begin before the window
    for pattern in (SENTENCE, WORD):
        for m in pattern.finditer(text, back, end):
            if low <= m.end() < end:
                return m.end()
    return end


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of the pieces: each at most ``limit`` code points, each but the first starting up to ``overlap`` before
    the end of the one before it; together they cover the whole text."""
    parts = atoms(text, 0, len(text), limit)
    # Atoms are packed in order, whichever unit they end, so a piece can end within a paragraph that did not fit whole.
    out: list[tuple[int, int]] = []
    start, end = parts[0]
    for a, b in parts[1:]:
        if b - start <= limit:
            end = b
            continue
        out.append((start, end))
        start = overlap_start(text, start, end, min(overlap, limit - (b - a)))
        end = b
    out.append((start, end))
    return out


def oversized(df: DataFrame, text: str, limit: int) -> Column:
    """Whether a text must be cut; null texts need not be."""
    return F.length(F.col(text)) > limit


def split_oversized(df: DataFrame, id_col: str, text_col: str, limit: int, overlap: int) -> DataFrame:
    """(id, piece_no from 1, start, end, piece) of each text above ``limit``; positions count code points from 0.

    Texts within the limit, null and empty ones need no cut and give no rows.  Repeated rows are cut each for
    itself.  Works row by row without a shuffle; only oversized texts leave the JVM.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "piece_no", "start", "end", "piece"]
        for batch in batches:
            row, no, starts, ends, pieces = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for k, (a, b) in enumerate(cut(text, limit, overlap), 1):
                    row.append(i)
                    no.append(k)
                    starts.append(a)
                    ends.append(b)
                    pieces.append(text[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(no, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(pieces, pa.string())], names=names)

    return df.where(oversized(df, text_col, limit)).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece_no int, start bigint, end bigint, piece string")
