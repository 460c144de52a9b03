"""Switches, names, settings and plans of requests; diagnostics and roll-back of a refinement. Expressions, joins, windows and aggregates only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import joins as J

#: Bytes of a file name, distance in MiB of a known card, share of speech that may move, samples and seconds of a seed.
MOST_NAME, CARD_MIB, MOST_MOVED, SEED_SAMPLES, SEED_S, SEED_PURITY = 240, 2048, 0.10, 3, 6.0, 0.70


def filter_enabled(header: Column) -> Column:
    """A filter runs unless it is switched off in so many words."""
    return ~(F.lower(F.trim(F.coalesce(header, F.lit("")))) == "off")


def gate_enabled(header: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(header, F.lit("")))).isin("off", "0", "false", "no")


def detection_applies(backend: Column, language: Column, enabled: Column) -> Column:
    """Languages are detected where the backend needs one, none is asked for, and detection is on."""
    return enabled & (backend == "cohere") & F.lower(F.trim(F.coalesce(language, F.lit("")))).isin("", "auto")


def live_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    """Sessions whose expires_at (ISO text) has not passed; what is no date stays."""
    return sessions.where(F.coalesce(F.try_to_timestamp("expires_at") >= now, F.lit(True)))


def safe_name(name: Column, most: int = MOST_NAME) -> Column:
    """The last part of a path without control characters and outer dots and blanks, cut to so many bytes between characters."""
    base = F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"[\x00-\x1F\x7F]", "")
    base = F.regexp_replace(base, r"^[. ]+|[. ]+$", "")
    # a character that is cut through becomes one mark at the end, which goes
    short = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(base, "UTF-8"), 1, most).cast("string")), "�$", "")
    return F.when(F.octet_length(base) > most, short).otherwise(base)


def response(text: Column, length_ms: Column, kind: Column) -> Column:
    """A transcript as json, text or verbose_json."""
    return F.when(kind == "text", text).when(kind == "verbose_json", F.to_json(F.struct((length_ms / 1000).alias("duration"), text.alias("text")))).otherwise(F.to_json(F.struct(text.alias("text"))))


def matched_cards(machines: DataFrame, cards: DataFrame, total: str = "total_mib") -> DataFrame:
    """machines with the first card (by card_idx) whose size is near; cards (card_idx, card, target_mib) are few and go to every task."""
    near = machines.join(F.broadcast(cards), F.abs(F.col(total) - F.col("target_mib")) <= CARD_MIB, "left")
    return near.groupBy(*machines.columns).agg(F.min_by("card", "card_idx").alias("card"))


def merged_forms(typed: DataFrame, base: DataFrame, service: DataFrame, changed: Column) -> DataFrame:
    """Settings (name, value) by name: what was typed where it differs from the base; else the service's where the model changed, else what was typed."""
    rows = typed.withColumnRenamed("value", "typed").join(base.withColumnRenamed("value", "base"), "name", "full").join(service.withColumnRenamed("value", "service"), "name", "full")
    own = F.col("typed").isNotNull() & ~F.col("typed").eqNullSafe(F.col("base"))
    return rows.select("name", F.when(own, F.col("typed")).when(changed, F.coalesce("service", "typed")).otherwise(F.coalesce("typed", "service")).alias("value"))


def cycle(files: DataFrame, order: str, n: int) -> DataFrame:
    """n requests that go through the files in order again and again; request from 0. Files get their places without gathering in one task: counts by part, then places within it."""
    parts = files.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(64)))
    w = W.partitionBy("_part").orderBy(order)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.alias("a").join(F.broadcast(sizes).alias("b"), F.col("b._part") < F.col("a._part"), "left").groupBy("a._part").agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))
    placed = parts.withColumn("_k", F.row_number().over(w) - 1).join(F.broadcast(before), "_part").withColumn("_at", F.col("_k") + F.col("_before")).drop("_part", "_k", "_before")
    total = placed.agg(F.count("*").alias("_all"))
    plan = files.sparkSession.range(n).withColumnRenamed("id", "request").crossJoin(F.broadcast(total)).where("_all > 0")  # one row
    return plan.withColumn("_at", F.pmod("request", "_all")).join(placed, "_at").drop("_at", "_all")


def batches(items: DataFrame, keys: Sequence[str], order: str, size: int) -> DataFrame:
    """items with `batch` and `place`: those of the same keys in order, so many a batch; results go back by the items' own order."""
    w = W.partitionBy(*keys).orderBy(order)
    k = F.row_number().over(w) - 1
    return items.withColumns({"batch": F.floor(k / size), "place": k % size})


def concatenated(segments: DataFrame, keys: Sequence[str], start: str = "start_ms", end: str = "end_ms", order: Sequence[str] = ()) -> DataFrame:
    """Segments with `offset`, their place where all of a key's speech is laid end to end."""
    w = W.partitionBy(*keys).orderBy(start, end, *order)
    length = F.col(end) - F.col(start)
    return segments.where(length > 0).withColumn("offset", F.sum(length).over(w.rowsBetween(W.unboundedPreceding, 0)) - length)


def first_changes(changes: DataFrame, keys: Sequence[str], order: str, most: int = 100) -> DataFrame:
    """The first changes of each key, and whether there are more."""
    w = W.partitionBy(*keys)
    rows = changes.withColumns({"_k": F.row_number().over(w.orderBy(order)), "_n": F.count("*").over(w)})
    return rows.where(F.col("_k") <= most).withColumn("truncated", F.col("_n") > most).drop("_k", "_n")


def stable_seeds(clouds: DataFrame) -> DataFrame:
    """Clouds (recording_id, speaker_id, status, purity, kept, kept_s) that a refinement may rest on."""
    return clouds.where((F.col("status") == "ready") & (F.col("purity") >= SEED_PURITY) & (F.col("kept") >= SEED_SAMPLES) & (F.col("kept_s") >= SEED_S))


def rollback_reasons(turns: DataFrame, standard: DataFrame, seeds: DataFrame, clouds: DataFrame) -> DataFrame:
    """recording_id and the first invariant that a refinement breaks, null if none.

    turns: each turn before and after (start_ms, end_ms, speaker_id, new_start_ms, new_end_ms, new_speaker_id, of which one half is null where a turn came or went);
    standard: segments by speaker; seeds: samples kept and their seconds by speaker; clouds: status and new_status by speaker.
    """
    length, moved = F.col("end_ms") - F.col("start_ms"), ~F.col("speaker_id").eqNullSafe(F.col("new_speaker_id"))
    bent = ~F.col("start_ms").eqNullSafe(F.col("new_start_ms")) | ~F.col("end_ms").eqNullSafe(F.col("new_end_ms"))
    a = turns.groupBy("recording_id").agg(
        F.max(bent).alias("bent"), (F.array_sort(F.collect_set("speaker_id")) != F.array_sort(F.collect_set("new_speaker_id"))).alias("others"),
        F.coalesce(F.sum(length), F.lit(0)).alias("all_ms"), F.coalesce(F.sum(F.when(moved, length)), F.lit(0)).alias("moved_ms"),
    )
    # a moved turn that meets its new speaker's own segments; speakers' spans are told apart by a key of both
    both = lambda name: F.concat_ws("\x00", "recording_id", name).alias("recording_id")
    new = turns.where(moved & F.col("new_speaker_id").isNotNull()).select(F.col("recording_id").alias("r"), both("new_speaker_id"), F.monotonically_increasing_id().alias("k"), F.col("new_start_ms").alias("start_ms"), F.col("new_end_ms").alias("end_ms"))
    hit = J.overlaps(new, standard.select(both("speaker_id"), "start_ms", "end_ms"), "k").groupBy(F.col("r").alias("recording_id")).agg(F.max("has_overlap").alias("hit"))
    lost = seeds.groupBy("recording_id").agg(F.max((F.col("kept") < SEED_SAMPLES) | (F.col("kept_s") < SEED_S)).alias("lost"))
    mixed = clouds.groupBy("recording_id").agg(F.max((F.col("status") == "ready") & (F.col("new_status") == "mixed_cluster")).alias("mixed"))
    rows = a.join(hit, "recording_id", "left").join(lost, "recording_id", "left").join(mixed, "recording_id", "left")
    tests = (
        (F.col("bent"), "timeline_invariant_violation"), (F.col("others"), "speaker_count_changed"), ((F.col("all_ms") <= 0) | (F.col("moved_ms") > F.col("all_ms") * MOST_MOVED), "reassigned_speech_exceeds_10_percent"),
        (F.col("hit"), "overlap_invariant_violation"), (F.col("lost"), "seed_core_lost"), (F.col("mixed"), "ready_cloud_became_mixed_cluster"),
    )
    return rows.select("recording_id", F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for test, name in tests]).alias("reason"))
