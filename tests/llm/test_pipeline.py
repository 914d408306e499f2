import importlib
from collections import Counter

import pytest

from tests.llm.helpers import frame, rows

pipeline = importlib.import_module("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("docs")
    frame(spark, rows(n=80)).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages_keep_the_columns_and_whole_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    schema, seen = docs.schema, {tuple(r) for r in docs.collect()}
    for k, (name, stage) in enumerate(pipeline.STAGES[:-1]):
        before = Counter(tuple(r) for r in docs.collect())
        docs = stage(spark, docs, folder)
        after = Counter(tuple(r) for r in docs.collect())
        assert docs.schema == schema and set(after) <= set(before) <= seen, name
        if name == "exact dedup":
            assert Counter(r[1] or "" for r in after.elements()) == Counter({r[1] or "": 1 for r in before})
        if name == "source mixing":
            assert set(after) == set(before) and max(after.values()) <= 4
    pieces = pipeline.STAGES[-1][1](spark, docs, folder)
    assert pieces.count() > 0


def test_run(spark, folder):
    got = pipeline.run(spark, folder)
    sizes = {r["sequence_id"]: r["n"] for r in got.groupBy("sequence_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert set(sorted(sizes.values())[1:]) <= {2048} and sorted(sizes) == list(range(len(sizes)))


def test_an_empty_table(spark, tmp_path):
    frame(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
