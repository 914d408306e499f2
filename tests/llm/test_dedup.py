import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import frame, rows
from tidemark.llm import exact_dedup, graph, simhash, substring_dedup


def slow_fingerprint(text: str | None, width: int) -> int:
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(n: int, linked) -> list[int]:
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_against_brute_force(spark):
    data = rows()
    got = simhash.near_duplicates(frame(spark, data), width=3, radius=2).collect()
    fps = [slow_fingerprint(r[1], 3) for r in data]
    roots = closure(len(data), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    least = {}
    for r, root in zip(data, roots):
        least[root] = min(least.get(root, r[0]), r[0])
    want = Counter((r[0], f"{fp:016x}", least[root]) for r, fp, root in zip(data, fps, roots))
    assert Counter(map(tuple, got)) == want


@pytest.mark.parametrize("radius,limit", [(1, 4), (2, 4), (3, 4), (2, 1000)])
def test_near_pairs_lose_no_link_in_large_keys(spark, radius, limit):
    rnd = random.Random(radius)
    base, fps = rnd.getrandbits(64), {rnd.getrandbits(64) for _ in range(50)}
    for _ in range(300):
        x = base
        for _ in range(rnd.randint(0, 5)):
            x ^= 1 << rnd.randrange(64)
        fps.add(x)
    fps = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {tuple(r) for r in simhash.near_pairs(spark.createDataFrame([(x,) for x in fps], "fp long"), radius, limit).collect()}
    assert got == {(min(a, b), max(a, b)) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= radius}


def test_one_document_of_each_near_group_stays(spark):
    docs = frame(spark)
    marks = simhash.near_duplicates(docs, width=5, radius=3)
    kept = simhash.drop_near_duplicates(docs, width=5, radius=3)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in marks.collect()})


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.id: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(spark, keep, weak):
    data = rows()
    digest = F.length("_text") % 3 if weak else None  # weak: most texts collide and are told apart by their bytes
    got = exact_dedup.exact_duplicates(frame(spark, data), keep, digest=digest).collect()
    groups = {}
    for r in data:
        groups.setdefault(r[1] or "", []).append(r[0])
    pick = min if keep == "smallest" else max
    want = Counter((r[0], pick(g := groups[r[1] or ""]), len(g), r[0] == pick(g), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in data)
    assert Counter(map(tuple, got)) == want


@pytest.mark.parametrize("limit", [0, 1000])
def test_drop_duplicates_keeps_one_row_of_each_text(spark, limit):
    docs = frame(spark)
    kept = exact_dedup.drop_duplicates(docs, broadcast_rows=limit)
    assert kept.schema == docs.schema
    texts = [r.text or "" for r in kept.collect()]
    assert Counter(texts) == Counter({r[1] or "" for r in rows()})


def slow_boundaries(data: bytes) -> list[int]:
    gear = substring_dedup._GEAR
    h = [sum(int(gear[data[i - j]]) << (2 * j) for j in range(16) if i >= j) & 0xFFFFFFFF for i in range(len(data))]
    r, out, top = substring_dedup.REACH, [], 0xFFFFFFFF
    for i in range(len(data)):
        before = [h[k] if k >= 0 else top for k in range(i - r, i)]
        after = [h[k] if k < len(data) else top for k in range(i + 1, i + r + 1)]
        if h[i] < min(before) and h[i] <= min(after) and i + 1 < len(data):
            out.append(i + 1)
    return out


@pytest.mark.parametrize("size", [0, 1, 2, 30, 500])
def test_boundaries(size):
    data = random.Random(size).randbytes(size) if size != 500 else (b"abc def ghi " * 50)[:500]
    assert substring_dedup.boundaries(np.frombuffer(data, np.uint8)).tolist() == slow_boundaries(data)


def words(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyzäöü") for _ in range(rnd.randint(2, 9))) for _ in range(n))


def test_repeated_passages_are_found_and_clean_texts_left_alone(spark):
    passage, line = words(1, 55), words(2, 9)
    data = [(i, f"{words(100 + i, 80)} {line} {words(300 + i, 60)}") for i in range(20)]
    data += [(50 + i, f"{words(500 + i, 30 + i)} {passage} {words(600 + i, 40)}") for i in range(4)] + [(90, passage * 2), (91, None), (92, ""), (93, "aaaa" * 5000)]
    docs = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, keep string")
    got = substring_dedup.repeated_spans(docs).collect()
    assert {r.doc_id for r in got} == {51, 52, 53, 90} and {r.keep_id for r in got} == {50}
    texts = dict(data)
    for r in got:
        span = texts[r.doc_id][r.start : r.end]
        assert span in texts[50] and len(span.split()) >= 16
    common = substring_dedup.repeated_spans(docs, hot=2, hot_chunks=3).collect()  # some chunks broadcast
    assert sorted(map(tuple, common)) == sorted(map(tuple, got))
    left = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs).collect()}
    assert left.keys() == texts.keys() and all(left[k] == texts[k] for k in [*range(20), 50, 91, 92, 93]) and len(left[51]) < len(texts[51]) - 150


def test_empty_tables(spark):
    docs = frame(spark, [])
    assert simhash.near_duplicates(docs).count() == 0 and simhash.drop_near_duplicates(docs).count() == 0
    assert exact_dedup.exact_duplicates(docs).count() == 0 and exact_dedup.drop_duplicates(docs).count() == 0
    assert substring_dedup.repeated_spans(docs).count() == 0


def slow_spans(texts: dict[int, str], least: int) -> set[tuple]:
    """(id, start, end, keeper): of every chunk the first document's stays; runs of later ones of enough words, cut where the keeper changes."""
    cut, first = {}, {}
    chars = lambda part: sum(x & 0xC0 != 0x80 for x in part)  # noqa: E731 - a chunk may end inside a character
    for i in sorted(texts):
        data = texts[i].encode()
        ends = [0, *slow_boundaries(data), len(data)]
        cut[i] = [(a, b, data[a:b]) for a, b in zip(ends, ends[1:])] if data else []
        for *_, chunk in cut[i]:
            first.setdefault(chunk, i)
    out = set()
    for i, chunks in cut.items():
        data, run = texts[i].encode(), []
        for a, b, chunk in [*chunks, (0, 0, None)]:
            if chunk is not None and first[chunk] != i:
                run.append((a, b, first[chunk]))
                continue
            begins = lambda a, b: sum(not data[k : k + 1].isspace() and (k == 0 or data[k - 1 : k].isspace()) for k in range(a, b))
            if sum(begins(a, b) for a, b, _ in run) >= least:
                for k, (a, b, keeper) in enumerate(run):
                    if k and run[k - 1][2] == keeper:
                        continue
                    last = next((j - 1 for j in range(k, len(run)) if run[j][2] != keeper), len(run) - 1)
                    out.add((i, chars(data[:a]), chars(data[: run[last][1]]), keeper))
            run = []
    return out


def test_spans_against_brute_force(spark):
    rnd = random.Random(9)
    passages = [words(k, rnd.randint(10, 60)) for k in range(8)]
    texts = {i: " ".join(rnd.choice(passages) if rnd.random() < 0.4 else words(1000 + 10 * i + j, rnd.randint(5, 40)) for j in range(5)) for i in range(30)}
    texts |= {40: "", 41: texts[3], 42: passages[0] * 2}
    got = substring_dedup.repeated_spans(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {(r.doc_id, r.start, r.end, r.keep_id) for r in got.collect()} == slow_spans(texts, 16)


def test_spans_are_cut_with_rows_and_clashing_columns_kept(spark):
    docs = frame(spark)
    left = substring_dedup.remove_repeats(docs)
    assert left.schema == docs.schema and left.count() == docs.count()
    keep = [c for c in docs.columns if c != "text"]
    assert Counter(map(tuple, left.select(*keep).collect())) == Counter(map(tuple, docs.select(*keep).collect()))
