"""Splitting oversized texts at natural boundaries by recursive bisection.

``split_spans`` cuts a text at the strongest boundary near its midpoint and goes on with every half that is still longer
than ``limit - overlap``; then each piece but the first is extended to the left by ``overlap`` characters. Lengths count
code points. Texts of at most ``limit`` characters stay one piece; null and empty texts have none.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 6000
OVERLAP = 200

# Boundary kinds, strongest first; each pattern's match START or END is the cut.
_HEADING = re.compile(r"^[ \t]*(?:#{1,6}[ \t]|(?:Article|Section|Seksyen|§+|มาตรา)[ \t]*[\d๐-๙])", re.M)
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n\s*")
_LINE = re.compile(r"[\r\n]+")
_SENTENCE = re.compile(r"[.!?…;。]+[\"'”’»)\]]*\s+")
_SPACE = re.compile(r"\s+")


def boundaries(text: str) -> list[list[int]]:
    """Cut positions by strength: articles and headings, paragraphs, lines, sentences, white space."""
    return [
        [m.start() for m in _HEADING.finditer(text)],
        [m.end() for m in _PARAGRAPH.finditer(text)],
        [m.end() for m in _LINE.finditer(text)],
        [m.end() for m in _SENTENCE.finditer(text)],
        [m.end() for m in _SPACE.finditer(text)],
    ]


def _nearest(positions: list[int], low: int, high: int, mid: int) -> int | None:
    """The position in [low, high] closest to ``mid``; the earlier of two equally close ones."""
    i = bisect.bisect_left(positions, mid)
    best = [p for p in positions[max(0, i - 1) : i + 1] if low <= p <= high]
    return min(best, key=lambda p: (abs(p - mid), p)) if best else None


def _cut(text: str, cuts: list[list[int]], start: int, end: int, least: int) -> int:
    """Where to cut text[start:end]: the strongest kind that has a boundary in the middle half, nearest to the midpoint.
    Without any, at the midpoint, but not before a combining mark. ``least`` characters stay on either side."""
    mid, reach = (start + end) // 2, (end - start) // 4
    low, high = max(mid - reach, start + least), min(mid + reach, end - least)
    for positions in cuts:
        if (at := _nearest(positions, low, high, mid)) is not None:
            return at
    at = mid
    while at > low and unicodedata.combining(text[at]) or unicodedata.category(text[at]) in ("Mn", "Mc", "Me") and at > low:
        at -= 1
    return at


def split_spans(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of each piece; consecutive pieces share ``overlap`` characters and none is longer than ``limit``."""
    if not 0 <= overlap <= limit // 4:
        raise ValueError("overlap must be at most a quarter of limit")
    if not text:
        return []
    if len(text) <= limit:
        return [(0, len(text))]
    cuts, core, edges, todo = boundaries(text), limit - overlap, [], [(0, len(text))]
    while todo:
        start, end = todo.pop()
        if end - start <= core:
            edges.append((start, end))
        else:
            at = _cut(text, cuts, start, end, max(1, overlap))
            todo += [(at, end), (start, at)]
    return [(start - overlap if start else 0, end) for start, end in edges]


def _pieces(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            keys = batch.column(0).to_pylist()
            for row, text in enumerate(batch.column(1).to_pylist()):
                for no, (start, end) in enumerate(split_spans(text, limit, overlap)):
                    for column, v in zip(out, (keys[row], no, start, end, text[start:end])):
                        column.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], batch.column(0).type), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.string())],
                names=["doc_id", "piece_no", "start", "end", "piece"],
            )

    return run


def split_oversized(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every text longer than ``limit``: doc_id, piece_no, start, end, piece.

    Texts of at most ``limit`` characters, null and empty ones give no rows. Rows with the same key are split each.
    Only the key and the text leave the JVM, and only of oversized rows.
    """
    big = docs.where(F.length(text) > limit).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    return big.mapInArrow(_pieces(limit, overlap), "doc_id long, piece_no int, start long, end long, piece string")


def file_key(path):
    """A path without what doesn't tell files apart: kinds and repetitions of separators, a leading ``./``."""
    return F.regexp_replace(F.regexp_replace(path, r"[\\/]+", "/"), r"^(?:\./)+", "")


def named_files(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """The documents whose file at least one row of the manifest that didn't fail names (null ``failed``: it didn't)."""
    names = manifest.where(~F.coalesce("failed", F.lit(False)) & F.col("md_relpath").isNotNull()).select(file_key(F.col("md_relpath")).alias("_file")).distinct()
    return docs.withColumn("_file", file_key(F.col("md_relpath"))).join(names, "_file", "left_semi").drop("_file")
