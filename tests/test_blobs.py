"""The blob store against a plain version, and as the sink of a stream whose batches come again."""

import random

from tidemark.streaming import blobs as S

EVENTS = "seq bigint, kind string, history_id string, of string, size_bytes bigint, filename string"
ONE, ALL = 60, 200


def plain(batches):
    entries, out = {}, []
    for events in batches:
        for _, kind, h, *_ in events:
            if kind == "purge":
                entries.pop(h, None)
        used = sum({e[1]: e[2] for e in entries.values() if e[1]}.values())
        seen = set()
        for seq, kind, h, _, size, _ in sorted(events):
            if kind == "capture" and h not in seen and not (h in entries and entries[h][1]):
                seen.add(h)
                fits = size <= ONE and used + size <= ALL
                used += size * fits
                entries[h] = ("available" if fits else "file_too_large" if size > ONE else "storage_quota", (h, seq) if fits else None, size)
        first = {}
        for _, kind, h, of, *_ in sorted(events):
            if kind == "retry":
                first.setdefault(h, of)
        source = dict(entries)
        for h, of in first.items():
            if source.get(of, (0, None))[1] and not (h in source and source[h][1]):
                entries[h] = source[of]
        out.append(dict(entries))
    return out


def made(seed, n=6):
    r = random.Random(seed)
    seq, out = 0, []
    for _ in range(n):
        rows = []
        for _ in range(8):
            seq += 1
            kind = r.choice(["capture", "capture", "capture", "retry", "purge"])
            rows.append((seq, kind, f"h{r.randrange(12)}", f"h{r.randrange(12)}" if kind == "retry" else None, r.choice([5, 30, 50, 61]) if kind == "capture" else None, "f"))
        out.append(rows)
    return out


def shape(rows):
    """Entries with their blobs by the smallest entry that shares each."""
    groups = {}
    for h, (_, blob, _) in rows.items():
        if blob:
            groups.setdefault(blob, []).append(h)
    return {h: (status, min(groups[blob]) if blob else None, size) for h, (status, blob, size) in rows.items()}


def test_sink_and_replay(spark, tmp_path):
    for seed in range(2):
        batches, store = made(seed), f"{tmp_path}/{seed}"
        write = S.sink(store, ONE, ALL)
        for k, expected in enumerate(plain(batches)):
            df = spark.createDataFrame(batches[k], EVENTS).repartition(3)
            for _ in range(2):  # the second time is a replay
                write(df, k)
                got = {r.history_id: (r.status, r.blob_id, r.size_bytes) for r in S.entries(spark, store, k).collect()}
                assert shape(got) == shape(expected)
        state = S.entries(spark, store, len(batches) - 1)
        kept = S.blobs(state).collect()
        assert sum(b.size_bytes for b in kept) <= ALL and sum(b.references for b in kept) == state.where("blob_id is not null").count()


def test_stream(spark, tmp_path):
    batches = made(7, 3)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = stream.writeStream.foreachBatch(S.sink(f"{tmp_path}/store", ONE, ALL)).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.history_id: (r.status, r.blob_id, r.size_bytes) for r in S.entries(spark, f"{tmp_path}/store", 2).collect()}
    assert shape(got) == shape(plain(batches)[-1])


def test_public(spark):
    state = spark.createDataFrame([("a", "available", "x", 3, "f"), ("b", "storage_quota", None, 9, "f")], S.ENTRIES)
    history = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "history_id string, n int")
    assert [tuple(r) for r in S.public(history, state).orderBy("n").collect()] == [("a", 1, True, "/history/a/audio", "available"), ("b", 2, False, None, "storage_quota"), ("c", 3, False, None, None)]
