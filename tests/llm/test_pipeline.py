"""Each stage of the pipeline against a brute-force version over what the stage before it kept; and run() as a whole."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

from .test_operators import groups_of, shingles  # noqa: E402


def test_stages(spark, tmp_path):
    r = random.Random(1)
    texts = [" ".join(f"w{r.randrange(300)}" for _ in range(40)) for _ in range(600)]
    item = " ".join(f"b{i}" for i in range(20))
    for i in range(0, 600, 6):
        texts[i] += " awful words awful"
    for i in range(5, 60, 10):
        texts[i + 1] = texts[i] + " more"
    texts[70] = item + " " + texts[70]
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)] + [(600, None, "en", None, 0), (601, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int("awful" in t)) for i, t in enumerate(texts) if i % 3 == 0 or i % 5 == 0], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {x.doc_id: x.text for x in docs.collect()}
        if name == "mixing":
            times = Counter(x.doc_id for x in docs.select("doc_id").collect())
    assert set(kept["quality"]) == {i for i, t in enumerate(texts) if "awful" not in t} | {600, 601}
    ids = sorted(kept["quality"])
    sets = [shingles(kept["quality"][i], 5) for i in ids]
    links = [(a, b) for a, b in itertools.combinations(range(len(ids)), 2) if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    at = groups_of(len(ids), links)
    assert set(kept["near_duplicates"]) == {i for k, i in enumerate(ids) if at[k] == k}
    assert set(kept["near_duplicates"]) - set(kept["decontamination"]) == {70}
    assert set(times) <= set(kept["decontamination"]) and max(times.values()) <= 3
    packs = corpus_pipeline.packing(spark, docs, str(tmp_path)).collect()
    assert sum(p.n_tokens for p in packs) > 0 and {d for p in packs for d in p.doc_ids} == {i for i in times if kept["mixing"][i]}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(p.n_tokens for p in whole) == sum(p.n_tokens for p in packs) and all(np.frombuffer(p.ids, "<u2").size == 2048 for p in whole)
