import corpus_pipeline
from loanweave.llm import catalog, near_dedup, quality
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def test_stages_name_and_keep_columns(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "mixing", "packing"]
    docs = cases.with_clashes(cases.documents(spark))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.count()
        assert stage(spark, cases.empty(spark), SF).collect() == []


def test_decisions_take_effect(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    scored = quality.score(docs, labels).select("doc_id", "keep").collect()
    first = stages["quality"](spark, docs, SF)
    assert {r.doc_id for r in first.collect()} == {r.doc_id for r in scored if r.keep}
    second = stages["near_duplicates"](spark, docs, SF)
    kept = near_dedup.near_duplicates(docs).where("keep").collect()
    assert sorted(r.doc_id for r in second.collect()) == sorted(r.doc_id for r in kept)
    third = stages["mixing"](spark, docs, SF)
    assert {r.doc_id for r in third.collect()} < {r.doc_id for r in docs.collect()}


def test_run_packs_what_the_stages_leave(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    sizes = {}
    for r in rows:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    assert rows and all(n & (n - 1) == 0 and n <= 1024 for n in sizes.values())


def test_one_query_per_operator():
    names = sorted(int(n[2:].split("_")[0]) for n in catalog.queries())
    assert names == list(range(1, 11)) and set(catalog.oracle_sql()) <= set(catalog.queries())
