"""Ordered folds whose next step depends on what has gathered so far.

Rows are dealt out by their keys and sorted there; a task streams through all keys that it holds and carries a few numbers, which it forgets where the key changes. So work is linear in
the rows, costs nothing for a key, and no key's history is held at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: What a fold is given of a key's rows, one after the other and None at the end, and the rows that it gives back each time.
Step = Callable[[tuple | None], list[tuple]]


def folded(rows: DataFrame, keys: Sequence[str], order: Sequence[str], schema: T.StructType, fold: Callable[[], Step]) -> DataFrame:
    """What a new fold for each key gives for the key's rows in order."""
    at, arrow = [rows.columns.index(k) for k in keys], to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step, out = None, None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                own = tuple(row[i] for i in at)
                if step is None or own != key:
                    out += step(None) if step else []
                    key, step = own, fold()
                out += step(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                out = []
        if step and (out := step(None)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _added(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def quota(events: DataFrame, keys: Sequence[str], order: str, size: str, most_one: int, most_all: int) -> DataFrame:
    """keys, order and `admitted` of events: a file above most_one, or that would take its key above most_all, is turned away and takes no room."""
    rows = events.select(*keys, order, size)

    def fold() -> Step:
        used = 0

        def step(row: tuple | None) -> list[tuple]:
            nonlocal used
            if row is None:
                return []
            admitted = row[-1] <= most_one and used + row[-1] <= most_all
            used += row[-1] * admitted
            return [(*row, admitted)]

        return step

    return folded(rows, keys, [order, size], _added(rows, "admitted", T.BooleanType()), fold).drop(size)


def superchunks(df: DataFrame, most: int = 25_000, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Greedy chunks of a recording's intervals in order: a chunk grows while an interval's end is at most so far from the chunk's own start, and ends where its last interval does."""
    rows = df.select("recording_id", start, end)
    number = lambda name: T.StructField(name, T.LongType())
    schema = T.StructType([rows.schema["recording_id"], number("chunk_idx"), rows.schema[start], rows.schema[end], number("regions")])

    def fold() -> Step:
        done, chunk = 0, None

        def step(row: tuple | None) -> list[tuple]:
            nonlocal done, chunk
            out = []
            if chunk and (row is None or row[2] - chunk[2] > most):
                out, done, chunk = [tuple(chunk)], done + 1, None
            if row is not None:
                who, a, b = row
                chunk = [who, done, chunk[2] if chunk else a, b, chunk[4] + 1 if chunk else 1]
            return out

        return step

    return folded(rows, ["recording_id"], [start, end], schema, fold)


def detection_units(pieces: DataFrame, short: int = 1500, enough: int = 8000, span: int = 25_000) -> DataFrame:
    """pieces (recording_id, piece_idx, start_ms, end_ms) with `unit`: short pieces in a row share one while its speech is under `enough` and it spans at most `span`."""
    rows = pieces.select("recording_id", "piece_idx", "start_ms", "end_ms")

    def fold() -> Step:
        unit, speech, began = -1, 0, None

        def step(row: tuple | None) -> list[tuple]:
            nonlocal unit, speech, began
            if row is None:
                return []
            who, piece, a, b = row
            brief = b - a < short
            if not (brief and began is not None and speech < enough and b - began <= span):
                unit, speech, start = unit + 1, 0, a
            else:
                start = began
            speech += b - a
            began = start if brief else None  # a long piece closes its unit
            return [(who, piece, unit)]

        return step

    schema = T.StructType([rows.schema["recording_id"], rows.schema["piece_idx"], T.StructField("unit", T.LongType())])
    return folded(rows, ["recording_id"], ["start_ms", "end_ms", "piece_idx"], schema, fold)


def budget(spans: DataFrame, keys: Sequence[str], rank: str, most: int, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Spans in order of rank, clipped to what is left of the budget: a running sum decides, as no span depends on more than those before it."""
    w = W.partitionBy(*keys).orderBy(rank)
    used = F.coalesce(F.sum(F.col(end) - F.col(start)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return spans.withColumn("_left", most - used).where("_left > 0").withColumn(end, F.least(F.col(end), F.col(start) + F.col("_left"))).drop("_left")


def stitch(parts: DataFrame, keys: Sequence[str], size: int = 3000, least: int = 2000, start: str = "start_ms", end: str = "end_ms", ties: Sequence[str] = ()) -> DataFrame:
    """Windows cut from short parts laid end to end: window, its length, and its number of source spans.

    A part's place on the common axis is a running sum; a window meets the parts whose places it overlaps. A last window shorter than least is dropped.
    """
    w = W.partitionBy(*keys).orderBy(start, end, *ties).rowsBetween(W.unboundedPreceding, 0)
    length = F.col(end) - F.col(start)
    on = parts.where(length > 0).withColumn("_b", F.sum(length).over(w)).withColumn("_a", F.col("_b") - length)
    cut = on.withColumn("window", F.explode(F.sequence(F.floor(F.col("_a") / size), F.floor((F.col("_b") - 1) / size))))
    piece = F.least("_b", (F.col("window") + 1) * size) - F.greatest("_a", F.col("window") * size)
    return cut.groupBy(*keys, "window").agg(F.sum(piece).alias("length"), F.count("*").alias("sources")).where(F.col("length") >= least)
