import importlib
import random

from pyspark.sql import functions as F

from tests.llm.helpers import frame, rows
from tests.llm.test_dedup import closure
from tidemark.llm import near_dedup


def sets(text: str | None) -> set:
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(a: set, b: set) -> bool:
    return a == b or len(a & b) >= 0.8 * len(a | b)


def edited(rnd: random.Random, words: list[str], n: int) -> list[str]:
    out = list(words)
    for k in rnd.sample(range(len(out)), n):
        out[k] = f"new{rnd.random()}"
    return out


def texts() -> list[str]:
    rnd, out = random.Random(7), []
    for i in range(12):
        base = [f"w{i}x{rnd.randrange(10**6)}" for _ in range(300)]
        out += [" ".join(base), *(" ".join(edited(rnd, base, n)) for n in (1, 4, 6, 7, 9, 15))]
    chain = [f"c{k}" for k in range(400)]
    out += [" ".join(chain[k : k + 200]) for k in range(0, 200, 15)]  # neighbours are similar, the ends are not
    out += [" ".join(edited(rnd, chain, rnd.randrange(12))) for _ in range(60)]  # many members in one key
    return out


def check(spark, drop):
    data = texts()
    docs = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").withColumn("source", F.lit("s")).repartition(3)
    found = [sets(t) for t in data]
    want = set(closure(len(data), lambda i, j: near(found[i], found[j])))
    assert {r.doc_id for r in drop(docs).collect()} == want and len(want) < len(data) - 60


def test_pairs_of_similarity_four_fifths_are_linked(spark):
    check(spark, near_dedup.drop_near_duplicates)


def test_the_pipeline_links_by_similarity(spark):
    check(spark, lambda docs: importlib.import_module("corpus_pipeline").drop_near_copies(spark, docs, ""))


def test_odd_rows_and_an_empty_table(spark):
    data = rows()
    docs = frame(spark, data)
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.schema == docs.schema
    found = [sets(r[1]) for r in data]
    least = {}
    for r, root in zip(data, closure(len(data), lambda i, j: near(found[i], found[j]))):
        least[root] = min(least.get(root, r[0]), r[0])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    assert near_dedup.drop_near_duplicates(frame(spark, [])).count() == 0
