"""Languages of chunks, speakers and pieces from detections: sure ones keep theirs, others follow a majority or their nearest sure neighbour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Speech and probability of a sure detection; those of a piece that differs from its prior; the code taken without any.
LEAST_S, LEAST_P, PIECE_S, OTHER_P, FALLBACK = 1.0, 0.5, 1.5, 0.85, 1


def sure(least_s: float = LEAST_S, least_p: float = LEAST_P) -> Column:
    return F.coalesce(F.col("code_idx").isNotNull() & (F.col("seconds") >= least_s) & (F.col("probability") >= least_p), F.lit(False))


def majority(items: DataFrame, keys: Sequence[str] = ("recording_id",), least_s: float = LEAST_S, least_p: float = LEAST_P, doubtful: bool = True) -> DataFrame:
    """keys, majority: the code with most seconds of sure items; without any, and if doubtful, of items with enough speech. The earlier code on a tie."""
    own = sure(least_s, least_p)
    rows = items.where((F.col("code_idx").isNotNull() & (F.col("seconds") >= least_s)) if doubtful else own)
    by = rows.groupBy(*keys, "code_idx").agg(F.sum(F.when(own, F.col("seconds"))).alias("sure_s"), F.sum("seconds").alias("all_s"))
    best = F.struct(F.col("sure_s").isNotNull().alias("t"), F.coalesce("sure_s", "all_s").alias("s"), (-F.col("code_idx")).alias("c"))
    return by.groupBy(*keys).agg(F.max_by("code_idx", best).alias("majority"))


def smoothed_chunks(items: DataFrame, keys: Sequence[str] = ("recording_id",), fallback: int = FALLBACK) -> DataFrame:
    """items with `smoothed`: a sure item's own code, else the majority, else the fallback."""
    rows = items.join(majority(items, keys), [*keys], "left")
    return rows.withColumn("smoothed", F.when(sure(), F.col("code_idx")).otherwise(F.coalesce("majority", F.lit(fallback)))).drop("majority")


def speaker_languages(speakers: DataFrame, keys: Sequence[str] = ("recording_id",), fallback: int = FALLBACK) -> DataFrame:
    """speakers with `resolved` and `source`: detected if sure, else the majority of the detected, else the fallback."""
    rows = speakers.join(majority(speakers, keys, doubtful=False), [*keys], "left")
    source = F.when(sure(), "detected").when(F.col("majority").isNotNull(), "majority").otherwise("fallback")
    return rows.withColumns({"resolved": F.when(sure(), F.col("code_idx")).otherwise(F.coalesce("majority", F.lit(fallback))), "source": source}).drop("majority")


def smoothed_pieces(pieces: DataFrame, order: str = "item_idx", keys: Sequence[str] = ("recording_id",), fallback: int = FALLBACK) -> DataFrame:
    """pieces (keys, order, start_s, end_s, seconds, code_idx, probability) with `smoothed`.

    An anchor is a piece of PIECE_S seconds or more that is sure of the majority's code, or with OTHER_P of another one. Each other piece takes the
    code of the anchor whose end or start is nearest to it, the earlier on a tie; without anchors the majority, without any detection the fallback.
    Both neighbours are running values in either order, so the work is linear in a recording's pieces.
    """
    rows = pieces.join(majority(pieces, keys, PIECE_S), [*keys], "left")
    anchor = sure(PIECE_S) & ((F.col("code_idx") == F.col("majority")) | (F.col("probability") >= OTHER_P))
    rows = rows.withColumn("_anchor", F.when(anchor, F.struct(F.col("start_s").alias("s"), F.col("end_s").alias("e"), F.col("code_idx").alias("c"))))
    near = lambda way: F.last("_anchor", ignorenulls=True).over(W.partitionBy(*keys).orderBy(way).rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumns({"_before": near(F.asc(order)), "_after": near(F.desc(order))})
    back, ahead = F.col("start_s") - F.col("_before.e"), F.col("_after.s") - F.col("end_s")
    earlier = F.col("_after").isNull() | F.coalesce(back <= ahead, F.lit(False))
    code = F.when(F.col("_anchor").isNotNull(), F.col("code_idx")).when(earlier, F.col("_before.c")).otherwise(F.col("_after.c"))
    return rows.withColumn("smoothed", F.coalesce(code, "majority", F.lit(fallback))).drop("majority", "_anchor", "_before", "_after")
