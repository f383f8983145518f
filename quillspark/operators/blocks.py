"""Greedy blocks of segments and their context."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .schema import BLOCK_CHARS, BLOCK_SECONDS


def greedy_blocks(segments: DataFrame, max_chars: int = BLOCK_CHARS, max_seconds: float = BLOCK_SECONDS) -> DataFrame:
    """segments with block (from 1): in order, a block ends before the segment that would bring it
    over max_chars or end more than max_seconds after its start.

    A fold over the ordered segments of a meeting. What it carries from one Arrow batch to the next
    is a few numbers, so a meeting of any length takes the memory of one batch. The window that
    numbers the segments sorts them, and the groups are read in that order; a row that comes out of
    turn raises. Shuffles by meeting once, and not at all where segments are so dealt already."""
    order = Window.partitionBy("meeting_id").orderBy("start", "end", "ordinal")
    rows = segments.select("*", F.row_number().over(order).alias("_nth"), F.length("text").alias("_chars"))
    width = len(segments.columns)
    names = [*segments.columns, "block"]
    at_start, at_end = segments.columns.index("start"), segments.columns.index("end")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, chars, first, nth = 0, 0, 0.0, 0
        for b in batches:
            out = []
            for start, end, n, turn in zip(*(b.column(i).to_pylist() for i in (at_start, at_end, width + 1, width)), strict=True):
                nth += 1
                if turn != nth:
                    raise ValueError(f"segment {turn} came as number {nth}")
                if not block or chars + n > max_chars or end - first > max_seconds:
                    block, chars, first = block + 1, 0, start
                chars += n
                out.append(block)
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(out, pa.int32())], names=names)

    schema = T.StructType([*segments.schema.fields, T.StructField("block", T.IntegerType())])
    return rows.groupBy("meeting_id").applyInArrow(fold, schema)


def blocks(blocked: DataFrame) -> DataFrame:
    """One row per block: ids in order, chars, uncertain."""
    ordered = F.array_sort(F.collect_list(F.struct("start", "end", "ordinal", "id")))
    rows = blocked.groupBy("meeting_id", "block").agg(ordered.alias("o"), F.sum(F.length("text")).alias("chars"), F.bool_or("uncertain").alias("uncertain"))
    return rows.select("meeting_id", "block", F.transform("o", lambda x: x["id"]).alias("ids"), "chars", "uncertain")


def block_context(blocked: DataFrame, rows: int = 2) -> DataFrame:
    """blocks with before and after: the last ids of the block before, the first of the next."""
    return around(blocks(blocked), rows, before=("ids", "before"), after=("ids", "after"))


def around(units: DataFrame, rows: int, before: tuple[str, str], after: tuple[str, str]) -> DataFrame:
    """units (one row per block) with two more columns: the last rows of an array column of the
    block before, and the first of one of the next; each named (array, new column)."""
    w = Window.partitionBy("meeting_id").orderBy("block")
    last, first = F.lag(before[0]).over(w), F.lead(after[0]).over(w)
    none = F.array()
    last, first = F.coalesce(last, none), F.coalesce(first, none)
    return units.withColumns({before[1]: F.slice(last, F.greatest(F.size(last) - rows + 1, F.lit(1)), rows), after[1]: F.slice(first, 1, rows)})
