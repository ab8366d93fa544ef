import corpus_pipeline
from weftgraph.llm import langid, minhash, mixing, tiling, tokenbin


def test_run_equals_its_steps(spark, tmp_path, doc_rows):
    en = "the cat sat on the mat and the dog ran with that thing for a while"
    rows = [(d, f"{t} {en} doc{d}" if t and len(t) > 20 else t, x, s, len(t or "")) for d, t, x, s in doc_rows if d is not None]
    rows += [(700, "quiz " + " ".join(f"q{k}" for k in range(20)), "en", "s3", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"q{k}" for k in range(20)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], str(tmp_path)))
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert seen[-1].columns == docs.columns, name
    ids = [sorted(r["doc_id"] for r in x.select("doc_id").collect()) for x in seen]
    rejected = set(ids[0]) - set(ids[1])
    assert {300, 301, 302} <= rejected
    judged = minhash.near_duplicates(seen[1]).filter("kept").select("doc_id").distinct().collect()
    assert sorted(set(ids[2])) == sorted(r["doc_id"] for r in judged)
    leaked = {r["doc_id"] for r in tiling.leaks(seen[2], spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect()}
    assert leaked == {700} and ids[3] == sorted(x for x in ids[2] if x != 700)
    assert ids[4] == sorted(r["doc_id"] for r in mixing.mix(seen[3]).filter("sampled").collect())
    assert ids[5] == ids[4]
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, seen[5].collect()))
    assert langid.HELD_OUT == 2 and tokenbin.END == 2
