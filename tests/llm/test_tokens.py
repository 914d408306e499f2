import os
import random
import subprocess
import sys
import tracemalloc
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import DATA
from tests.llm.helpers import CLASHING, frame, rows
from tidemark.llm import order_minhash, packing, token_store
from tidemark.llm.word_ids import WordEncoder, tokenizer_path

PATH = tokenizer_path()
WHOLE = Tokenizer.from_file(PATH)
ENCODER = WordEncoder(PATH, 2)
ALPHABET = st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from([" ", "\n", "\t", "'", "'s", ".", "a", "B", "é", "İ", "é", "<|endoftext|>", "<|ENDOFTEXT|>", "word", "Σ"]))


def ids_of(text: str | None) -> np.ndarray:
    return np.array([*WHOLE.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


@settings(max_examples=400, deadline=None)
@given(st.lists(ALPHABET, max_size=30).map("".join))
def test_ids_by_words_are_those_of_whole_texts(text):
    got = np.frombuffer(ENCODER([text.encode()])[0], "<u2")
    assert got.tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_parts_of_texts_bound_what_encoding_holds():
    rnd = random.Random(8)
    texts = pa.array([" ".join(f"{rnd.choice('abcdefgh')}{rnd.randrange(500)}" for _ in range(20_000)) for _ in range(20)])

    def held(together):
        tracemalloc.start()
        ids = ENCODER.encode(texts, b"\1\0", together)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return ids, peak

    held(8_000_000)  # its words are known now
    (whole, most), (parts, least) = held(8_000_000), held(200_000)
    assert parts.equals(whole) and least < most / 3


def with_null_ids() -> list[tuple]:
    data = rows()
    return data + [(None, "no id", *data[0][2:]), (None, None, *data[1][2:]), (-5, "below nought", *data[0][2:])]


def test_store_round_trip(spark):
    data = with_null_ids()
    store = token_store.write_store(frame(spark, data), file_bytes=2000)
    assert store.manifest.count() > 8
    got = token_store.read_store(spark, store, with_ids=True).collect()
    start, want = 0, []
    for doc_id, ids in sorted(((r[0], ids_of(r[1])) for r in data), key=lambda x: (x[0] is not None, x[0] or 0, x[1].astype("<u2").tobytes())):
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        start += len(ids)
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got) == Counter(want)
    some = {r.doc_id for r in token_store.read_store(spark, store, only=[3, 66, 999]).collect()}
    assert some == {3, 66}
    ranged = token_store.read_store(spark, store, only=[3, 66, 999, -5], with_ids=True).collect()
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in ranged) == Counter(w for w in want if w[0] in (3, 66, -5))


def test_ids_must_be_integers(spark):
    texts = frame(spark).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    for use in (token_store.write_store, order_minhash.compare_with_edits):
        with pytest.raises(TypeError, match="integers"):
            use(texts)


def test_store_refuses_another_dictionary(spark):
    store = token_store.write_store(frame(spark))
    other = token_store.TokenStore(store.directory, store.manifest, b"other" * 50, store.width)
    with pytest.raises(Exception, match="not a token file of this dictionary"):
        token_store.read_store(spark, other).collect()


def test_empty_store(spark):
    assert token_store.read_store(spark, token_store.write_store(frame(spark, []))).count() == 0


@pytest.mark.parametrize("weights,exponent", [(None, 1.0), (None, 0.5), ({"big": 1, "s0": 2, "s1": 3, "s2": 4, None: 1}, 1.0)])
def test_packing(spark, weights, exponent):
    data, window = rows(), 256
    pieces = packing.pack(frame(spark, data), window=window, packet=16, weights=weights, exponent=exponent, with_ids=True).collect()
    # every id of every row lies in one piece
    by_doc = defaultdict(list)
    for p in pieces:
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
        by_doc[p.doc_id].append(p)
    for doc_id, n in Counter(r[0] for r in data).items():
        texts = [ids_of(r[1]) for r in data if r[0] == doc_id]
        at = Counter()
        for p in by_doc[doc_id]:
            assert any(t[p.start : p.start + p.length].tobytes() == bytes(p.ids) and len(t) == p.doc_tokens for t in texts)
            at.update(range(p.start, p.start + p.length))
        assert at == Counter(i for t in texts for i in range(len(t)))
    # sequences are gapless and full, but for the last
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
    sizes = []
    for s in sorted(by_sequence):
        at = 0
        for offset, length in sorted(by_sequence[s]):
            assert offset == at
            at += length
        sizes.append(at)
    assert sorted(by_sequence) == list(range(len(sizes))) and set(sizes[:-1]) == {window} and 0 < sizes[-1] <= window
    share = Counter()
    for p in pieces:
        share[p.source] += p.length
    wanted = weights or {k: n**exponent for k, n in share.items()}
    target = {k: w / sum(wanted.values()) for k, w in wanted.items()}
    # every window holds every source's target but for two packets, until the first queue runs out
    inside = defaultdict(Counter)
    for p in pieces:
        inside[p.sequence_id][p.source] += p.length
    whole = int(min(n / target[k] for k, n in share.items()) / window) - 1
    assert whole >= 1
    for s in range(whole):
        assert all(abs(inside[s][k] - window * target[k]) <= 2 * 16 for k in share)


def test_windows_of_many_sources_hold_their_shares(spark):
    """As registered: windows of 2048 over all documents' sources."""
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    inside, share = defaultdict(Counter), Counter()
    for r in packing.pack(docs, exponent=0.7).groupBy("sequence_id", "source").agg(F.sum("length").alias("n")).collect():
        inside[r.sequence_id][r.source] = r.n
        share[r.source] += r.n
    wanted = {k: n**0.7 for k, n in share.items()}
    target = {k: 2048 * w / sum(wanted.values()) for k, w in wanted.items()}
    whole = int(min(n / target[k] for k, n in share.items())) - 1
    assert len(share) >= 20 and whole > 300 and max(abs(inside[s][k] - target[k]) for s in range(whole) for k in share) <= 64


def test_a_source_without_a_weight_is_an_error(spark):
    with pytest.raises(Exception, match="no weight for source"):
        packing.pack(frame(spark), weights={"big": 1.0}).collect()


def test_copies_of_a_document_lie_apart(spark):
    rnd = random.Random(5)
    big = [(i, " ".join(str(rnd.random()) for _ in range(30)), "en", "big", None, *[None] * len(CLASHING)) for i in range(60)]
    rare = [(100 + i, f"rare {i} " * 15, "en", "rare", None, *[None] * len(CLASHING)) for i in range(20)]
    pieces = packing.pack(frame(spark, big + 4 * rare), window=512, copies=True).collect()
    n = {r.doc_id: r.doc_tokens for r in pieces}
    total = Counter()
    for p in pieces:
        total[p.doc_id] += p.length
    assert all(total[i] == n[i] * (4 if i >= 100 else 1) for i in n) and len(n) == 80
    order = [p.doc_id for p in sorted((p for p in pieces if p.source == "rare"), key=lambda p: (p.sequence_id, p.offset))]
    runs = [x for x, before in zip(order, [None, *order]) if x != before]
    assert len(runs) == 80 and all(len(set(runs[k : k + 20])) == 20 for k in range(0, 80, 20))


def test_sequences_are_padded_unless_a_power_of_two(spark):
    data = [(1, "a b c", "en", "s", None, *[None] * len(CLASHING)), (2, "d e f g", "en", "s", None, *[None] * len(CLASHING))]
    pieces = packing.pack(frame(spark, data), window=16, packet=4, with_ids=True)
    (one,) = packing.sequences(pieces, 16).collect()
    got = np.frombuffer(bytes(one.ids), "<u4")
    assert len(got) == 16 and (got[9:] == 0).all() and sorted(got[:9]) == sorted([*ids_of("a b c"), *ids_of("d e f g")])
    (two,) = packing.sequences(packing.pack(frame(spark, data[:1]), window=16, packet=4, with_ids=True), 16).collect()
    assert len(two.ids) == 16


def test_packing_an_empty_table(spark):
    assert packing.pack(frame(spark, [])).count() == 0


def test_long_words_and_cache_limits(monkeypatch):
    from tidemark.llm import word_ids

    monkeypatch.setattr(word_ids, "CACHE_WORDS", 5)
    rnd = random.Random(3)
    texts = [" ".join("".join(rnd.choice("abcé.,") for _ in range(rnd.randint(1, 5))) for _ in range(50)) for _ in range(20)] + ["q" * 30_000]
    got = WordEncoder(PATH, 4)([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [WHOLE.encode(t, add_special_tokens=False).ids for t in texts]


GROWTH = """
import re, random, sys
import pyarrow as pa
from tidemark.llm import word_ids

def held():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def task(seed):
    r = random.Random(seed)
    texts = pa.array([" ".join("".join(r.choices("abcdefghijklmnop", k=9)) for _ in range(50)) for _ in range(300)])
    def run(batches):
        encoder = word_ids.WordEncoder(word_ids.tokenizer_path(), 2)
        for b in word_ids.small_batches(batches):
            yield encoder.encode(b.column(0))
    for _ in getattr(word_ids, "lean", lambda f: f)(run)([pa.RecordBatch.from_arrays([texts], names=["t"])]):
        pass

for i in range(3):
    task(i)
before = held()
for i in range(3, 13):
    task(i)
print(held() - before)
"""


def test_tasks_of_one_worker_leave_nothing_behind():
    """A worker encodes for one task after the other; what their tokenizers cached must not add up."""
    if not os.path.exists("/proc/self/smaps_rollup"):
        pytest.skip("memory can't be read here")
    done = subprocess.run([sys.executable, "-c", GROWTH], capture_output=True, text=True, cwd=Path(__file__).parents[2], timeout=120)
    assert done.returncode == 0, done.stderr
    assert float(done.stdout.split()[-1]) < 15
