import corpus_pipeline
from parcelgraph.llm import registry
from tests.llm.conftest import DOCS, awkward_rows, passage

SF = "/root/testdata/sf0.001"


def test_stages_in_a_row(spark, tmp_path):
    spark.createDataFrame([(1, passage(100, 60))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = awkward_rows() + [(500, f"{passage(60, 40)} {passage(100, 60)} end", "en", "a", None)]
    docs, seen = spark.createDataFrame(rows, DOCS), []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        seen.append((name, docs.count()))
        if name != "token_ids":
            assert docs.columns == before.columns
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "language":
            assert ids == {r[0] for r in rows} - {4, 5, 6, 12}
        if name == "near_duplicates":
            assert {2, 3, 10} & ids == set() and {1, 7, 9, 11, 500} <= ids and docs.count() == docs.dropDuplicates(["doc_id"]).count()
        if name == "decontamination":
            assert 500 not in ids and 1 in ids
    assert [s for s, _ in seen] == ["language", "near_duplicates", "decontamination", "mix", "token_ids"]


def test_run_equals_its_stages(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(tuple, got)) == sorted(map(tuple, docs.collect()))


def test_registered_names():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))
