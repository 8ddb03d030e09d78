import brute
import corpus_pipeline

SF = "/root/testdata/sf0.001"
WORDS = [" ".join(f"{c}{i}" for i in range(70)) for c in "abcdefgh"]


def test_each_stage_on_planted_rows(spark, tmp_path):
    item = " ".join(f"item{i}" for i in range(30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, WORDS[0]), (2, WORDS[0]), (3, WORDS[0] + " more"), (4, "too short"), (5, None), (6, WORDS[1] + " " + item),
            (7, WORDS[2] + " mail me@example.org now"), (8, WORDS[3]), (8, WORDS[3]), (None, WORDS[4])]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    want = [[1, 2, 3, 6, 7, 8, 8, None], [1, 6, 7, 8, None], [1, 7, 8, None], [1, 7, 8, None], [1, 7, 8, None]]
    for (_, stage), ids in zip(corpus_pipeline.STAGES, want):
        out = stage(spark, docs, str(tmp_path))
        assert sorted((r.doc_id for r in out.collect()), key=str) == sorted(ids, key=str)
        if "text" in out.columns:
            assert out.columns == docs.columns
            docs = out
    assert "[EMAIL]" in docs.where("doc_id = 7").first().text


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and all(r.restored for r in out)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    near = brute.near_components(rows, 5, 80)
    kept = {r.doc_id for r in out}
    assert len({near[d][1] for d in kept}) == len(kept)  # no two of one group


def test_two_texts_of_one_id(spark):
    rows = [(1, WORDS[0] + " more"), (2, WORDS[1]), (2, WORDS[0]), (2, WORDS[1]), (3, None), (3, None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, gone int, __row string")
    out = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [(1, rows[0][1]), (2, WORDS[1]), (3, "")]
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), SF).count() == 0
