"""The pipeline's stages, against the operators' own definitions on a small table."""

import os

import pytest


@pytest.fixture(scope="module")
def sf_dir(spark, docs, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs.filter("doc_id is not null").write.parquet(f"{path}/documents.parquet")
    bench = [(1, texts[20]), (2, "nothing of the kind occurs here at all, ten words in one row")]
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, sf_dir, texts):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "benchmark", "surrogates", "tokens"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "tokens":
            assert out.columns == columns
        path = os.path.join(sf_dir, name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    start = set(range(len(texts)))
    assert start - set(kept["language"]) >= {i for i, t in enumerate(texts) if not t or t in (" ", "12 34", "...")}
    assert {5, 6, 7, 8, 9} <= set(kept["near_duplicates"]) and not {60, 65, 66, 67, 68, 70} & set(kept["near_duplicates"])
    assert set(kept["near_duplicates"]) - set(kept["benchmark"]) == {20}
    assert 20 not in kept["benchmark"] and {5, 7} <= set(kept["benchmark"])
    assert set(kept["tokens"]) == set(kept["surrogates"]) == set(kept["benchmark"])
    whole = {r.doc_id: r.ids for r in pipeline.run(spark, sf_dir).collect()}
    assert whole == {r.doc_id: r.ids for r in docs.collect()}


def test_queries_registered():
    from celltide.llm import queries

    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in queries.QUERIES) == 1


def test_tables_are_shared_and_swept(spark, docs):
    from celltide.llm import common

    first = common.written(docs, "x")
    files = first.inputFiles()
    assert files and first.count() == docs.count()
    common.sweep(spark)
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
