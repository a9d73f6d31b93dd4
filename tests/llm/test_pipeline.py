import random

import corpus_pipeline
from tests.llm.test_decontaminate import brute
from tests.llm.test_simhash import slow_components
from tests.llm.test_toxicity import make


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, t, "en", rng.choice(["a", "b", None]), len(t)) for i, (t, _) in enumerate(make())]
    item = " ".join(f"item{k}" for k in range(20))
    rows += [(1000 + k, rows[k][1], "en", "b", 1) for k in range(1, 9)] + [(1100, f"see {item} end", "en", "a", 1), (1101, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y, 1) for i, (_, y) in enumerate(make())], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}.parquet")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}.parquet")
        seen.append([r.doc_id for r in docs.collect()])
        if name != "tokens":
            assert docs.columns == columns
        if name == "near_dedup":
            want = {c for _, _, c in slow_components([(r.doc_id, r.text) for r in before.collect()])}
            assert sorted(seen[-1]) == sorted(want)
        if name == "decontaminate":
            bad = {i for i, *_ in brute([(r.doc_id, r.text) for r in before.collect()], [(1, item)])}
            assert bad == {1100} and set(seen[-2]) - set(seen[-1]) == bad
    toxic = {i for i, (_, y) in enumerate(make()) if y}
    clean = {r[0] for r in rows} - toxic - {1000 + k for k in toxic}
    assert len(set(seen[0]) & toxic) < 0.1 * len(toxic) and set(seen[0]) >= clean
    assert sorted(seen[-1]) == sorted(seen[-2])
    final = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)
    assert final == sorted(map(tuple, docs.collect()), key=str)
