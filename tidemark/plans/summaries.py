"""Registered queries on histories, batches, language scores, vectors and text; with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import aggregates as A
from tidemark.operators import languages as L
from tidemark.operators import ranking as R
from tidemark.sources import views as V
from tidemark.sources.views import SQL as S
from tidemark.sources.views import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


@query("agg_stats", f"WITH {S['history']} SELECT count(*) AS entries, count(duration_ms) AS timed, round_even(avg(duration_ms), 2) AS avg_duration_ms FROM history")
def agg_stats(spark: SparkSession, d: str) -> DataFrame:
    return A.history_summary(V.history(spark, d))


@query("agg_usage", f"WITH {S['history']} SELECT key_id, CAST(sum(coalesce(duration_ms, 0)) AS BIGINT) AS total_ms, count(*) AS request_count, CAST(epoch_us(max(recorded)) AS BIGINT) AS last_used_us FROM history GROUP BY ALL")
def agg_usage(spark: SparkSession, d: str) -> DataFrame:
    u = A.usage(V.history(spark, d))
    return u.select("key_id", "total_ms", "request_count", F.unix_micros("last_used_at").alias("last_used_us"))


@query("agg_rtf", f"WITH {S['segment']}, b AS (SELECT batch_id, sum(seconds) AS audio, count(*) AS n FROM segment GROUP BY ALL) SELECT batch_id, CASE WHEN audio > 0 AND n > 1 THEN round_even(audio / (n - 1), 3) END AS rtf FROM b")
def agg_rtf(spark: SparkSession, d: str) -> DataFrame:
    b = V.segment(spark, d).groupBy("batch_id").agg(F.sum("seconds").alias("audio"), F.count("*").alias("n"))
    return b.select("batch_id", A.rtf(F.col("audio"), F.col("n") - 1).alias("rtf"))


@query("agg_load_round", f"WITH {S['segment']} SELECT processing_key, count(*) AS requests, count(*) FILTER (seconds > 1) AS ok, count(*) FILTER (NOT seconds > 1) AS failed, min(seconds) AS min_s, round_even(avg(seconds), 2) AS avg_s, max(seconds) AS max_s, round_even(avg(seconds) FILTER (seconds > 1), 2) AS avg_ok_s, round_even(sum(seconds) / count(DISTINCT batch_id), 3) AS rtf FROM segment GROUP BY ALL")
def agg_load_round(spark: SparkSession, d: str) -> DataFrame:
    """Segments as requests, of which those of a second fail; a batch takes a second."""
    return A.load_round(V.segment(spark, d), ["processing_key"], ok=F.col("seconds") > 1, audio=F.sum("seconds"), wall=F.count_distinct("batch_id"))


@query("agg_benchmark", f"WITH {S['segment']} SELECT processing_key, count(DISTINCT batch_id) AS batches, count(*) AS chunks, round_even(count(*) / count(DISTINCT batch_id), 3) AS chunks_per_batch, count(DISTINCT segment_idx) <= 1 AS matches FROM segment GROUP BY ALL")
def agg_benchmark(spark: SparkSession, d: str) -> DataFrame:
    s = V.segment(spark, d).groupBy("processing_key").agg(F.countDistinct("batch_id").alias("batches"), F.count("*").alias("chunks"), F.countDistinct("segment_idx").alias("_s"))
    return s.select("processing_key", "batches", "chunks", F.bround(F.col("chunks") / F.col("batches"), 3).alias("chunks_per_batch"), (F.col("_s") <= 1).alias("matches"))


@query("agg_queue", f"WITH {S['segment']}, j AS (SELECT processing_key, batch_id, count(*) AS pending, batch_id % 4 = 0 AS active FROM segment GROUP BY ALL) SELECT processing_key, CAST(coalesce(sum(pending) FILTER (active), 0) AS BIGINT) AS active_pending, CAST(coalesce(sum(pending) FILTER (NOT active), 0) AS BIGINT) AS waiting_pending, count(*) AS jobs FROM j GROUP BY ALL")
def agg_queue(spark: SparkSession, d: str) -> DataFrame:
    jobs = V.segment(spark, d).groupBy("processing_key", "batch_id").agg(F.count("*").alias("pending")).withColumn("active", F.col("batch_id") % 4 == 0)
    return A.queue(jobs)


_MAJ = f"{S['lid']}, mj AS (SELECT recording_id, code_idx, sum(greatest(seconds, 0)) AS s FROM lid WHERE code_idx IS NOT NULL GROUP BY recording_id, code_idx QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY sum(greatest(seconds, 0)) DESC, code_idx) = 1)"


@query("agg_majority", f"WITH {_MAJ} SELECT recording_id, code_idx, s AS seconds FROM mj")
def agg_majority(spark: SparkSession, d: str) -> DataFrame:
    return A.majority_language(V.lid(spark, d))


@query("agg_lang_seconds", f"WITH {S['lid']} SELECT recording_id, language, round_even(sum(seconds), 1) AS seconds FROM lid WHERE language IS NOT NULL GROUP BY ALL")
def agg_lang_seconds(spark: SparkSession, d: str) -> DataFrame:
    return V.lid(spark, d).where("language is not null").groupBy("recording_id", "language").agg(F.bround(F.sum("seconds"), 1).alias("seconds"))


_SCORES = "sc AS (SELECT recording_id, seconds, c AS code_idx, CASE WHEN c = code_idx THEN probability ELSE (1 - probability) / 13 END AS p FROM (SELECT *, unnest(range(1, 15)) AS c FROM lid))"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    s = V.lid(spark, d).withColumn("c", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(14).cast("bigint"))))
    return s.select("recording_id", "seconds", F.col("c").alias("code_idx"), F.when(F.col("c") == F.col("code_idx"), F.col("probability")).otherwise((1 - F.col("probability")) / 13).alias("p"))


@query("agg_pool_lid", f"WITH {S['lid']}, {_SCORES}, m AS (SELECT recording_id, code_idx, sum(seconds * ln(least(greatest(p, 1e-12), 1.0))) / sum(seconds) AS m FROM sc WHERE p IS NOT NULL AND seconds > 0 GROUP BY ALL), e AS (SELECT *, exp(m - max(m) OVER (PARTITION BY recording_id)) AS e FROM m), s AS (SELECT recording_id, code_idx, e / sum(e) OVER (PARTITION BY recording_id) AS p FROM e) SELECT recording_id, code_idx, round(p, 6) AS probability FROM s QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY p DESC, code_idx) = 1")
def agg_pool_lid(spark: SparkSession, d: str) -> DataFrame:
    return A.pooled_language(_scores(spark, d), ["recording_id"]).withColumn("probability", F.round("probability", 6))


def _majority_sql(name: str, least: float, doubtful: bool = True) -> str:
    """The code with most seconds of sure items, else (if doubtful) of those with enough speech."""
    return (
        f"{name}c AS (SELECT recording_id, code_idx, sum(seconds) FILTER (probability >= 0.5) AS sure_s, sum(seconds) AS all_s FROM lid WHERE code_idx IS NOT NULL AND seconds >= {least}{'' if doubtful else ' AND probability >= 0.5'} GROUP BY ALL), "
        f"{name} AS (SELECT recording_id, code_idx FROM {name}c QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY sure_s IS NULL, coalesce(sure_s, all_s) DESC, code_idx) = 1)"
    )


@query("win_smooth_chunk", f"WITH {S['lid']}, {_majority_sql('mj', 1.0)} SELECT l.recording_id, l.item_idx, CASE WHEN l.seconds >= 1.0 AND l.probability >= 0.5 THEN l.code_idx ELSE coalesce(m.code_idx, 1) END AS code_idx FROM lid l LEFT JOIN mj m ON m.recording_id = l.recording_id")
def win_smooth_chunk(spark: SparkSession, d: str) -> DataFrame:
    return L.smoothed_chunks(V.lid(spark, d)).select("recording_id", "item_idx", F.col("smoothed").alias("code_idx"))


@query("win_speaker_lang", f"WITH {S['lid']}, {_majority_sql('mj', 1.0, False)} SELECT l.recording_id, l.item_idx, CASE WHEN l.seconds >= 1.0 AND l.probability >= 0.5 THEN l.code_idx ELSE coalesce(m.code_idx, 1) END AS code_idx, CASE WHEN l.seconds >= 1.0 AND l.probability >= 0.5 THEN 'detected' WHEN m.code_idx IS NOT NULL THEN 'majority' ELSE 'fallback' END AS source FROM lid l LEFT JOIN mj m ON m.recording_id = l.recording_id")
def win_speaker_lang(spark: SparkSession, d: str) -> DataFrame:
    return L.speaker_languages(V.lid(spark, d)).select("recording_id", "item_idx", F.col("resolved").alias("code_idx"), "source")


@query("win_turn_lang", f"WITH {_MAJ} SELECT l.recording_id, l.item_idx, CASE WHEN l.code_idx IS NOT NULL AND l.seconds >= 1.5 AND l.probability >= 0.85 AND (m.code_idx IS NULL OR l.code_idx <> m.code_idx) THEN l.code_idx ELSE m.code_idx END AS code_idx FROM lid l LEFT JOIN mj m ON m.recording_id = l.recording_id")
def win_turn_lang(spark: SparkSession, d: str) -> DataFrame:
    items = V.lid(spark, d)
    m = A.majority_language(items).select("recording_id", F.col("code_idx").alias("m"))
    return items.join(m, "recording_id", "left").select("recording_id", "item_idx", X.language_override(F.col("code_idx"), F.col("probability"), F.col("seconds"), F.col("m")).alias("code_idx"))


_ANCHOR = (
    f"{S['lid']}, {_majority_sql('mj', 1.5)}, sp AS (SELECT l.*, m.code_idx AS mj, item_idx * 11.0::DOUBLE AS s, item_idx * 11.0::DOUBLE + seconds AS e FROM lid l LEFT JOIN mj m ON m.recording_id = l.recording_id), "
    "an AS (SELECT *, CASE WHEN seconds >= 1.5 AND probability >= 0.5 AND (code_idx = mj OR probability >= 0.85) THEN item_idx END AS a FROM sp), "
    "pn AS (SELECT *, max(a) OVER (PARTITION BY recording_id ORDER BY item_idx ROWS UNBOUNDED PRECEDING) AS pi, min(a) OVER (PARTITION BY recording_id ORDER BY item_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni FROM an)"
)


@query("win_nearest_anchor", f"WITH {_ANCHOR} SELECT p.recording_id, p.item_idx, CASE WHEN p.a IS NOT NULL THEN p.code_idx WHEN p.pi IS NULL AND p.ni IS NULL THEN coalesce(p.mj, 1) WHEN p.ni IS NULL OR p.s - b.e <= n.s - p.e THEN b.code_idx ELSE n.code_idx END AS smoothed FROM pn p LEFT JOIN sp b ON b.item_idx = p.pi LEFT JOIN sp n ON n.item_idx = p.ni")
def win_nearest_anchor(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("item_idx") * 11.0
    items = V.lid(spark, d).withColumns({"start_s": start, "end_s": start + F.col("seconds")})
    return L.smoothed_pieces(items).select("recording_id", "item_idx", "smoothed")


@query("top_history", f"WITH {S['history']} SELECT history_id, mode, duration_ms FROM history ORDER BY recorded DESC, history_id DESC LIMIT 25")
def top_history(spark: SparkSession, d: str) -> DataFrame:
    return R.top_history(V.history(spark, d)).select("history_id", "mode", "duration_ms")


@query("top_ring", f"WITH {S['history']} SELECT mode, history_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY recorded DESC, history_id DESC) AS rank FROM history) WHERE rank <= 50")
def top_ring(spark: SparkSession, d: str) -> DataFrame:
    return R.newest(V.history(spark, d), ["mode"], "recorded", "history_id", 50).select("mode", "history_id", "rank")


@query("win_ring72", f"WITH {S['turn']} SELECT recording_id, turn_idx, rank FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY start_ms DESC, turn_idx DESC) AS rank FROM turn) WHERE rank <= 72")
def win_ring72(spark: SparkSession, d: str) -> DataFrame:
    return R.newest(V.turn(spark, d), ["recording_id"], "start_ms", "turn_idx", 72).select("recording_id", "turn_idx", "rank")


@query("jn_retry", f"WITH {S['history']} SELECT a.history_id, a.retry_of, b.mode AS original_mode, b.mode = 'transcript' AS may_retry FROM history a JOIN history b ON b.history_id = a.retry_of")
def jn_retry(spark: SparkSession, d: str) -> DataFrame:
    h = V.history(spark, d)
    b = h.select(F.col("history_id").alias("retry_of"), F.col("mode").alias("original_mode"))
    return h.where("retry_of is not null").select("history_id", "retry_of").join(b, "retry_of").withColumn("may_retry", F.col("original_mode") == "transcript")


@query("jn_new_batches", f"WITH {S['segment']} SELECT DISTINCT batch_id FROM segment s WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = s.batch_id AND o.o_orderstatus = 'F')")
def jn_new_batches(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("batch_id"))
    return V.segment(spark, d).select("batch_id").distinct().join(seen, "batch_id", "left_anti")


@query("set_distinct_requests", f"WITH {S['segment']} SELECT processing_key, count(DISTINCT batch_id) AS requests FROM segment GROUP BY ALL")
def set_distinct_requests(spark: SparkSession, d: str) -> DataFrame:
    return V.segment(spark, d).groupBy("processing_key").agg(F.countDistinct("batch_id").alias("requests"))


@query("set_unresolved", f"WITH {S['sample']} SELECT DISTINCT recording_id, speaker_id FROM sample WHERE (recording_id, speaker_id) NOT IN (SELECT (recording_id, speaker_id) FROM sample GROUP BY recording_id, speaker_id HAVING count(*) >= 25)")
def set_unresolved(spark: SparkSession, d: str) -> DataFrame:
    """Speakers of a recording that are not among those with samples enough to be accepted."""
    s = V.sample(spark, d).select("recording_id", "speaker_id")
    accepted = s.groupBy("recording_id", "speaker_id").agg(F.count("*").alias("n")).where("n >= 25").drop("n")
    return s.distinct().join(accepted, ["recording_id", "speaker_id"], "left_anti")


@query("set_union_labels", f"WITH {S['turn']}, {S['sample']} SELECT speaker_id FROM turn UNION SELECT speaker_id FROM sample")
def set_union_labels(spark: SparkSession, d: str) -> DataFrame:
    return V.turn(spark, d).select("speaker_id").union(V.sample(spark, d).select("speaker_id")).distinct()


_PLAN = f"{S['segment']}, r AS (SELECT *, row_number() OVER (PARTITION BY processing_key, batch_id ORDER BY segment_idx, seconds) AS round FROM segment), p AS (SELECT *, row_number() OVER (PARTITION BY processing_key ORDER BY round, batch_id) AS place FROM r), c AS (SELECT *, sum(seconds) OVER (PARTITION BY processing_key ORDER BY place ROWS UNBOUNDED PRECEDING) AS so_far FROM p WHERE place <= 16), o AS (SELECT *, max(CASE WHEN place > 1 AND so_far > 250 THEN 1 ELSE 0 END) OVER (PARTITION BY processing_key ORDER BY place ROWS UNBOUNDED PRECEDING) AS over FROM c)"


@query("st_plan_rr", f"WITH {_PLAN} SELECT processing_key, batch_id, segment_idx, CAST(place AS BIGINT) AS place, so_far AS seconds_so_far FROM o WHERE over = 0")
def st_plan_rr(spark: SparkSession, d: str) -> DataFrame:
    return R.round_robin(V.segment(spark, d), 16, 250.0).select("processing_key", "batch_id", "segment_idx", F.col("place").cast("bigint").alias("place"), "seconds_so_far")


@query("st_plan_fast", f"WITH {S['segment']}, f AS (SELECT * FROM segment QUALIFY row_number() OVER (PARTITION BY processing_key, batch_id ORDER BY segment_idx) = 1), p AS (SELECT *, row_number() OVER (PARTITION BY processing_key ORDER BY batch_id) AS place FROM f) SELECT processing_key, batch_id, segment_idx, place FROM p WHERE place <= 16")
def st_plan_fast(spark: SparkSession, d: str) -> DataFrame:
    """First segments only, so that fresh jobs are served at once."""
    first = V.segment(spark, d).groupBy("processing_key", "batch_id").agg(F.min_by(F.struct("segment_idx", "seconds"), "segment_idx").alias("x")).select("processing_key", "batch_id", "x.*")
    return R.round_robin(first, 16, float("inf")).select("processing_key", "batch_id", "segment_idx", F.col("place").cast("bigint").alias("place"))


_MEAN = f"{S['sample']}, pt AS (SELECT recording_id, speaker_id, weight, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM sample), mn AS (SELECT recording_id, speaker_id, i, sum(weight * x) / sum(weight) AS m FROM pt GROUP BY ALL)"


@query("agg_weighted_mean", f"WITH {_MEAN} SELECT recording_id, speaker_id, count(*) AS dim, round(max(m) / sqrt(sum(m * m)), 6) AS largest, round(sum(m) / sqrt(sum(m * m)), 6) AS total FROM mn GROUP BY ALL")
def agg_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    p = A.weighted_mean_vector(V.sample(spark, d), ["recording_id", "speaker_id"])
    return p.select("recording_id", "speaker_id", F.size("prototype").cast("bigint").alias("dim"), F.round(F.array_max("prototype"), 6).alias("largest"), F.round(F.aggregate("prototype", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("agg_voice_vector", f"WITH {S['sample']}, pt AS (SELECT recording_id, weight, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM sample), mn AS (SELECT recording_id, i, sum(weight * x) / sum(weight) AS m FROM pt GROUP BY ALL) SELECT recording_id, count(*) AS dim, round(max(m) / sqrt(sum(m * m)), 6) AS largest FROM mn GROUP BY ALL")
def agg_voice_vector(spark: SparkSession, d: str) -> DataFrame:
    p = A.weighted_mean_vector(V.sample(spark, d), ["recording_id"])
    return p.select("recording_id", F.size("prototype").cast("bigint").alias("dim"), F.round(F.array_max("prototype"), 6).alias("largest"))


_PROFILE = f"{_MEAN.removeprefix(S['sample'] + ', ')}, pr AS (SELECT recording_id, 'profile-' || speaker_id AS profile_id, list_transform(list(m ORDER BY i), lambda x: x / sqrt(sum(m * m))) AS pv FROM mn GROUP BY recording_id, speaker_id)"


def _profiles(samples: DataFrame) -> DataFrame:
    """A profile of each recording's speaker: the mean of all its samples."""
    p = A.weighted_mean_vector(samples, ["recording_id", "speaker_id"])
    return p.select("recording_id", F.concat(F.lit("profile-"), "speaker_id").alias("profile_id"), F.col("prototype").alias("profile_vector"))


@query("agg_support", f"WITH {S['sample']}, {_PROFILE}, b AS (SELECT s.recording_id, s.speaker_id, s.sample_idx, s.weight, p.profile_id, max(list_inner_product(s.vector, p.pv)) AS c FROM sample s JOIN pr p ON p.recording_id = s.recording_id GROUP BY ALL) SELECT recording_id, speaker_id, profile_id, round(sum(CASE WHEN c >= 0.5 THEN weight ELSE 0 END) / sum(weight), 6) AS support, round(max(c), 6) AS best FROM b GROUP BY ALL")
def agg_support(spark: SparkSession, d: str) -> DataFrame:
    s = V.sample(spark, d)
    return A.support(s, _profiles(s)).select("recording_id", "speaker_id", "profile_id", F.round("support", 6).alias("support"), F.round("best", 6).alias("best"))


@query("win_top2", f"WITH {S['sample']}, {_PROFILE}, b AS (SELECT s.recording_id, s.sample_idx, p.profile_id, max(list_inner_product(s.vector, p.pv)) AS c FROM sample s JOIN pr p ON p.recording_id = s.recording_id GROUP BY ALL) SELECT recording_id, sample_idx, profile_id, round(c, 6) AS c, round(coalesce(lead(c) OVER w, -1), 6) AS runner_up FROM b WINDOW w AS (PARTITION BY recording_id, sample_idx ORDER BY c DESC, profile_id) QUALIFY row_number() OVER w = 1")
def win_top2(spark: SparkSession, d: str) -> DataFrame:
    s = V.sample(spark, d)
    c = s.join(_profiles(s), "recording_id").groupBy("recording_id", "sample_idx", "profile_id").agg(F.max(A.dot(F.col("vector"), F.col("profile_vector"))).alias("c"))
    return R.best_two(c, ["recording_id", "sample_idx"], "c", "profile_id").withColumns({"c": F.round("c", 6), "runner_up": F.round("runner_up", 6)})


@query("win_loo", f"WITH {_MEAN.replace('sum(weight * x) / sum(weight)', 'sum(x)')}, j AS (SELECT s.recording_id, s.speaker_id, s.sample_idx, list(m.m ORDER BY m.i) AS t, any_value(s.vector) AS v FROM sample s JOIN mn m ON m.recording_id = s.recording_id AND m.speaker_id = s.speaker_id GROUP BY ALL), r AS (SELECT *, list_transform(list_zip(t, v), lambda z: z[1] - z[2]) AS o FROM j) SELECT recording_id, speaker_id, sample_idx, CASE WHEN sqrt(list_inner_product(o, o)) > 1e-9 THEN round(list_inner_product(v, o) / sqrt(list_inner_product(o, o)), 6) END AS loo FROM r")
def win_loo(spark: SparkSession, d: str) -> DataFrame:
    """Each sample's cosine to the sum of its speaker's other samples."""
    s = V.sample(spark, d)
    total = s.select("recording_id", "speaker_id", F.posexplode("vector").alias("i", "x")).groupBy("recording_id", "speaker_id", "i").agg(F.sum("x").alias("m"))
    total = total.groupBy("recording_id", "speaker_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda z: z["m"]).alias("t"))
    r = s.join(total, ["recording_id", "speaker_id"]).withColumn("o", F.zip_with("t", "vector", lambda a, b: a - b))
    norm = F.sqrt(A.dot(F.col("o"), F.col("o")))
    return r.select("recording_id", "speaker_id", "sample_idx", F.when(norm > 1e-9, F.round(A.dot(F.col("vector"), F.col("o")) / norm, 6)).alias("loo"))


_LOW = "lower(word)"


@query("flt_wordnorm", "WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents), n AS (SELECT doc_id, i, regexp_replace(replace(translate(lower(word), 'äöü', 'aou'), 'ß', 'ss'), '[^a-z]', '', 'g') AS norm FROM w) SELECT doc_id, count(*) AS words, sum(length(norm))::BIGINT AS letters FROM n WHERE norm <> '' GROUP BY ALL")
def flt_wordnorm(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", " ", -1)).alias("word"))
    return w.select("doc_id", X.alignable(F.col("word")).alias("norm")).where("norm is not null").groupBy("doc_id").agg(F.count("*").alias("words"), F.sum(F.length("norm")).alias("letters"))


@query("flt_disposition", "SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[\\p{L}\\p{N}_]') THEN 'keep' WHEN turn * 700 >= 1000 THEN 'asr_failure' ELSE 'drop' END AS disposition FROM conversations")
def flt_disposition(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", X.disposition(F.col("text"), F.col("turn") * 700).alias("disposition"))


@query("prj_nice_scale", "SELECT o_orderkey, CASE WHEN o_totalprice > 0 THEN (CASE WHEN r <= 1 THEN 1 WHEN r <= 2 THEN 2 WHEN r <= 5 THEN 5 ELSE 10 END) * b ELSE 1.0 END AS scale FROM (SELECT *, o_totalprice / b AS r FROM (SELECT *, pow(10.0, floor(log10(o_totalprice))) AS b FROM orders))")
def prj_nice_scale(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", X.nice_scale(F.col("o_totalprice")).alias("scale"))


@query("prj_queue_scale", "SELECT p_partkey, CAST(CASE WHEN p_size <= 4 THEN 4 WHEN p_size <= 8 THEN 8 WHEN p_size <= 16 THEN 16 WHEN p_size <= 32 THEN 32 WHEN p_size <= 64 THEN 64 ELSE ceil(p_size / 32) * 32 END AS BIGINT) AS scale, CAST(least(8, pow(2, ceil(log2(greatest(p_size, 1))))) AS BIGINT) AS bucket FROM part")
def prj_queue_scale(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.queue_scale(F.col("p_size")).alias("scale"), X.batch_bucket(F.col("p_size")).alias("bucket"))


@query("jn_apikey", "SELECT c_custkey, sha256('key-' || CAST(c_custkey AS VARCHAR)) IN (SELECT sha256('key-' || CAST(s_suppkey AS VARCHAR)) FROM supplier) AS authorized FROM customer")
def jn_apikey(spark: SparkSession, d: str) -> DataFrame:
    h = lambda c: F.sha2(F.concat(F.lit("key-"), F.col(c).cast("string")), 256)
    keys = table(spark, d, "supplier").select(h("s_suppkey").alias("hash"), F.lit(True).alias("found"))
    return table(spark, d, "customer").select("c_custkey", h("c_custkey").alias("hash")).join(keys, "hash", "left").select("c_custkey", F.coalesce("found", F.lit(False)).alias("authorized"))


@query("hist_refcount", f"WITH {S['history']} SELECT key_id AS blob_id, CAST(sum(CASE WHEN mode = 'transcript' THEN 1 ELSE -1 END) AS BIGINT) AS refs, sum(CASE WHEN mode = 'transcript' THEN 1 ELSE -1 END) <= 0 AS removable FROM history GROUP BY ALL")
def hist_refcount(spark: SparkSession, d: str) -> DataFrame:
    r = V.history(spark, d).groupBy(F.col("key_id").alias("blob_id")).agg(F.sum(F.when(F.col("mode") == "transcript", 1).otherwise(-1)).alias("refs"))
    return r.withColumn("removable", F.col("refs") <= 0)
