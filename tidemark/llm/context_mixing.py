"""Language-model scores of whole texts by online logistic context mixing.

bit_mixer codes the lower-cased bytes of a text one binary decision after the other. Its tables of context counts
are gathered from all training documents, and so is what gates, weighs and refines the predictors: sums of a fixed size
that every task adds up over its documents. The tables have a fixed size (at most 2^22 slots each), so they keep less and less of rare
contexts as a corpus grows; the exact counts of all words, which have no bound and are joined by word, are
mixed in after each word by a share that follows how often they foretold this text's earlier words better.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import replace
from itertools import count, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bit_mixer
from tidemark.llm.bit_mixer import Learner, MixingModel, Shape, Stream
from tidemark.llm.common import fold, materialise, ship_by_value
from tidemark.llm.word_ids import groups, text_bytes

#: White space bytes in order; the end of a text is the last symbol.
SPACES = (32, 9, 10, 11, 12, 13)
_SYMBOL = np.full(256, -1)
_SYMBOL[[*SPACES, bit_mixer.END]] = range(7)
#: Bytes of texts whose contexts are held at once.
TOGETHER = 200_000
TOPIC_WORDS = 1024
#: Entries of an array that a task sends in one row.
PART = 1 << 17
SUMS = "k int, c int, part binary"


def space_counts(text: bytes) -> list[int]:
    """How often each white-space byte and the end follow anything but a full stop, then how often a full stop."""
    stop = [text.count(b"." + bytes([s])) for s in SPACES] + [int(text.endswith(b"."))]
    return [text.count(s) - n for s, n in zip(SPACES, stop)] + [1 - stop[-1], *stop]


def encode_blocks(docs: DataFrame, block_bytes: int = 6_000_000, id_col: str = "doc_id", text_col: str = "text", train_col: str = "train") -> DataFrame:
    """Word rows (kind 0: block, at, word, n) and document rows (kind 1: block, at, id, text, counts of its spaces).

    A block is a run of whole documents of one task with at most about block_bytes of text. at numbers its distinct words
    as they first appear, or its documents; n counts a word in the block's training documents; texts are lower-cased.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"kind int, block long, at int, word binary, n long, `{id_col}` {kind}, train boolean, n_bytes long, text binary, spaces array<long>"
    names = ["kind", "block", "at", "word", "n", id_col, "train", "n_bytes", "text", "spaces"]
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`"), F.col(f"`{train_col}`"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for b in slices(batches):
            texts = [t.lower() for t in text_bytes(b.column(3))]
            numbers, train = b.column(0).to_pylist(), b.column(2).to_pylist()
            own_type = b.schema.field(1).type
            for lo, hi in groups([len(t) for t in texts], block_bytes):
                at: dict[bytes, int] = defaultdict(count().__next__)
                taught = []
                for i in range(lo, hi):
                    every = np.fromiter(map(at.__getitem__, texts[i].split()), np.int32)
                    if train[i]:
                        taught.append(every)
                n = np.bincount(np.concatenate(taught), minlength=len(at)) if taught else np.zeros(len(at), np.int64)
                block, size, m = numbers[lo], len(at), hi - lo
                none = lambda k, t: pa.nulls(k, t)
                words = [pa.array(np.zeros(size, np.int32)), pa.array(np.full(size, block, np.int64)), pa.array(np.arange(size, dtype=np.int32)), pa.array(list(at), pa.binary()), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*words, none(size, own_type), none(size, pa.bool_()), none(size, pa.int64()), none(size, pa.binary()), none(size, pa.list_(pa.int64()))], names=names)
                rows = [pa.array(np.ones(m, np.int32)), pa.array(np.full(m, block, np.int64)), pa.array(np.arange(m, dtype=np.int32)), none(m, pa.binary()), none(m, pa.int64())]
                own = [pa.array([len(t) for t in texts[lo:hi]], pa.int64()), pa.array([pack.compress(t) for t in texts[lo:hi]], pa.binary()), pa.array([space_counts(t) for t in texts[lo:hi]], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*rows, b.column(1)[lo:hi], b.column(2)[lo:hi], *own], names=names)

    return numbered.mapInArrow(run, schema)


def slices(batches, rows: int = 2000):
    """Record batches in parts, so that few texts are held as Python objects at once."""
    for b in batches:
        for lo in range(0, len(b), rows):
            yield b.slice(lo, rows)


def streams(texts: list[bytes], shape: Shape):
    """The texts in runs of about TOGETHER bytes: (first, last, Stream). A text of more than a segment comes in several
    streams, one for each segment, so that no stream hangs on the length of a text."""
    for lo, hi in groups([len(t) for t in texts], TOGETHER):
        if hi - lo == 1 and len(texts[lo]) >= bit_mixer.SEGMENT:
            for at in range(0, len(texts[lo]) + 1, bit_mixer.SEGMENT):
                yield lo, hi, Stream(texts[lo:hi], shape, (at, at + bit_mixer.SEGMENT))
        else:
            yield lo, hi, Stream(texts[lo:hi], shape)


def coded_texts(texts: list[bytes], model: MixingModel):
    """(first, last, log10 of every byte and end, the bytes, whose they are) of runs of whole texts."""
    for (lo, hi), parts in groupby(streams(texts, model.shape), key=itemgetter(0, 1)):
        found = [(model.byte_logs(s), s.data[s.place], s.owner) for _, _, s in parts]
        yield lo, hi, *(np.concatenate(x) for x in zip(*found))


def _lower(column: pa.Array) -> list[bytes]:
    return [t.lower() for t in text_bytes(column)]


def sent(arrays: list[np.ndarray]):
    """Rows (k, c, part) of a task's arrays, for summed()."""
    pack = zstandard.ZstdCompressor(level=1)
    for k, array in enumerate(arrays):
        flat = array.reshape(-1)
        for c in range(0, len(flat), PART):
            if flat[c : c + PART].any():
                part = pack.compress(np.ascontiguousarray(flat[c : c + PART], "<f8").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([c], pa.int32()), pa.array([part], pa.binary())], names=["k", "c", "part"])


def summed(parts: DataFrame, shapes: list[tuple[int, ...]], tasks: int) -> list[np.ndarray]:
    """The sums of what the tasks have sent() of arrays of the given shapes."""

    def add(batches):
        unpack, total, key = zstandard.ZstdDecompressor(), None, None
        for b in batches:
            for k, c, data in zip(*[x.to_pylist() for x in b.columns]):
                if key not in (None, (k, c)):
                    yield from row(key, total)
                    total = None
                key, more = (k, c), np.frombuffer(unpack.decompress(data))
                total = more if total is None else total + more
        if key:
            yield from row(key, total)

    def row(key, total):
        data = zstandard.ZstdCompressor(level=1).compress(total.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([data], pa.binary())], names=["k", "c", "part"])

    sums, unpack = [np.zeros(math.prod(shape)) for shape in shapes], zstandard.ZstdDecompressor()
    for r in parts.repartition(tasks, "k", "c").sortWithinPartitions("k", "c").mapInArrow(add, SUMS).collect():  # as large as the arrays
        data = np.frombuffer(unpack.decompress(bytes(r["part"])))
        sums[r["k"]][r["c"] : r["c"] + len(data)] = data
    return [x.reshape(shape) for x, shape in zip(sums, shapes)]


def byte_triples(taught: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Distinct triples of bytes of all training texts (one column) and how often they stand there."""

    def run(batches):
        triples, times = np.zeros(0, np.int32), np.zeros(0, np.int64)
        for b in slices(batches, 500):
            texts = _lower(b.column(0))
            for lo, hi in groups([len(t) for t in texts], 2_000_000):
                own, n = np.unique(np.concatenate([bit_mixer.byte_triples(t).astype(np.int32) for t in texts[lo:hi]]), return_counts=True)
                triples, at = np.unique(np.concatenate([triples, own]), return_inverse=True)
                times = np.bincount(at, np.concatenate([times, n]), len(triples)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(triples, pa.int32()), pa.array(times, pa.int64())], names=["triple", "times"])

    found = taught.mapInArrow(run, "triple int, times long").groupBy("triple").agg(F.sum("times").alias("times"))
    got = found.toArrow().sort_by("triple")  # at most 2^24 triples of bytes
    return got.column(0).to_numpy().astype(np.int64), got.column(1).to_numpy()


def word_company(taught: DataFrame, words: list[bytes], tasks: int) -> np.ndarray:
    """[words, words]: how often each word stands in the training texts of another, texts weighted by that word's share in them."""
    number = {w: i for i, w in enumerate(words)}
    m = len(words)

    def run(batches):
        total = np.zeros((m, m))
        for b in slices(batches, 500):
            counts = np.zeros((len(b), m), np.float32)
            for row, text in zip(counts, _lower(b.column(0))):
                at = [i for i in map(number.get, text.split()) if i is not None]
                if at:
                    row += np.bincount(at, minlength=m)
            total += (counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).T @ counts
        yield from sent([total])

    return summed(taught.mapInArrow(run, SUMS), [(m, m)], tasks)[0]


def fit_shape(taught: DataFrame, frequent: list[bytes], slots: tuple[int, ...], tasks: int) -> Shape:
    """Codes of bytes and topics of words from all training texts; frequent: the words that may speak for a topic.

    A topic is a group of words that keep the same company: the mixture is fitted to the company of every frequent word.
    """
    words = sorted((w for w in frequent if w and all(bit_mixer._LETTER[c] for c in w)), key=bit_mixer.word_hash)
    codes, sizes, contexts = bit_mixer.byte_codes(*byte_triples(taught))
    odds = bit_mixer.topic_odds(word_company(taught, words, tasks)) if words else np.zeros((0, 1), np.float32)
    return Shape(codes, sizes, contexts, np.array([bit_mixer.word_hash(w) for w in words], np.uint64), odds, slots)


def count_contexts(taught: DataFrame, shape: Shape, tasks: int, part: int = 1 << 17) -> tuple[list[np.ndarray], np.ndarray]:
    """Tables [slots, 2] of zero and one counts of every hashed predictor, over all training texts (one column), and counts
    [codes, 2] of the bits that followed each match.

    Each of `tasks` tasks adds up tables of its own and sends them in parts; the sum has a fixed size, so that
    it can go to the driver and to every worker. Counts past 65,000 are scaled down together.
    """
    whole, last = taught.sparkSession.sparkContext.broadcast(shape), len(shape.slots)

    def run(batches):
        tables, matches = [np.zeros(2 << s, np.uint32) for s in whole.value.slots], np.zeros(2 * bit_mixer.CODES, np.int64)
        for b in slices(batches, 500):
            for _, _, stream in streams(_lower(b.column(0)), whole.value):
                bit_mixer.add_counts(tables, stream, matches)
        pack = zstandard.ZstdCompressor(level=1)
        yield row(last, 0, pack.compress(matches.astype(np.uint64).tobytes()))
        for k, table in enumerate(tables):
            for c in range(0, len(table), part):
                if table[c : c + part].any():
                    yield row(k, c, pack.compress(table[c : c + part].tobytes()))

    def add(batches):
        pack, unpack, total, key = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor(), None, None
        for b in batches:
            for k, c, data in zip(*[x.to_pylist() for x in b.columns]):
                if key not in (None, (k, c)):
                    yield row(*key, pack.compress(small(key[0], total)))
                    total = None
                key = (k, c)
                more = np.frombuffer(unpack.decompress(data), np.uint64 if k == last else np.uint32).astype(np.uint64)
                total = more if total is None else total + more
        if key:
            yield row(*key, pack.compress(small(key[0], total)))

    def row(k, c, data):
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([c], pa.int32()), pa.array([data], pa.binary())], names=["k", "c", "part"])

    def small(k, total):
        if k == last:
            return total.tobytes()
        n = total.reshape(-1, 2)
        scale = np.maximum(np.uint64(1), (n.max(axis=1) + np.uint64(64_999)) // np.uint64(65_000))[:, None]
        return np.where((n > 0) & (n < scale), 1, n // scale).astype(np.uint16).tobytes()

    parts = taught.mapInArrow(run, SUMS).repartition(tasks, "k", "c").sortWithinPartitions("k", "c")
    tables, matches, unpack = [np.zeros(2 << s, np.uint16) for s in shape.slots], np.zeros(2 * bit_mixer.CODES), zstandard.ZstdDecompressor()
    for r in parts.mapInArrow(add, SUMS).collect():  # 4 bytes for each of the fixed slots at most
        if r["k"] == last:
            matches[:] = np.frombuffer(unpack.decompress(bytes(r["part"])), np.uint64)
            continue
        data = np.frombuffer(unpack.decompress(bytes(r["part"])), np.uint16)
        tables[r["k"]][r["c"] : r["c"] + len(data)] = data
    return [t.reshape(-1, 2) for t in tables], matches.reshape(-1, 2)


class Sent:
    """A model's tables compressed for broadcast; every worker opens them once. training: counts, which also give the codes that leave one out."""

    def __init__(self, shape: Shape, tables: list[np.ndarray], training: bool, *fitted: np.ndarray):
        pack = zstandard.ZstdCompressor(level=3)
        self.shape, self.training, self.fitted, self.model = shape, training, fitted, None
        self.parts = [pack.compress(np.ascontiguousarray(t).tobytes()) for t in tables]

    def __getstate__(self):
        return self.__dict__ | {"model": None}

    def open(self) -> MixingModel:
        if self.model is None:
            unpack, without = zstandard.ZstdDecompressor(), None
            kind = np.uint16 if self.training else np.int16
            tables = [np.frombuffer(unpack.decompress(p), kind) for p in self.parts]
            if self.training:
                tables = [t.reshape(-1, 2) for t in tables]
                tables, without = [_by_parts(bit_mixer.codes_of, t) for t in tables], [_by_parts(bit_mixer.left_out, t) for t in tables]
            self.model = MixingModel(self.shape, tables, without, *(self.fitted or (None, None)))
        return self.model


def _by_parts(f, table: np.ndarray, part: int = 1 << 17) -> np.ndarray:
    return np.concatenate([f(table[i : i + part]) for i in range(0, len(table), part)])


def fit_mixer(taught: DataFrame, shape: Shape, tables: list[np.ndarray], matches: np.ndarray, tasks: int) -> MixingModel:
    """Maps from the tables and the counts of matches, then weights and refinement over all training texts (one column), in
    whose predictions each bit is left out of its counts."""
    codes = [_by_parts(bit_mixer.codes_of, t) for t in tables]
    maps = bit_mixer.maps_of(np.stack([*map(bit_mixer.seen_in, tables), matches]))
    model = taught.sparkSession.sparkContext.broadcast(Sent(shape, tables, True, maps, None))  # a fixed size: SLOTS
    g, n, cells = bit_mixer.GATES, bit_mixer.INPUTS, bit_mixer.REFINED * bit_mixer.BUCKETS

    def learn(batches):
        learner = Learner(replace(model.value.open()))
        for b in slices(batches, 500):
            for _, _, stream in streams(_lower(b.column(0)), learner.model.shape):
                learner.read(stream)
        yield from sent([*learner.state()])

    state = summed(taught.mapInArrow(learn, SUMS), [(g, n, n), (g, n), (cells,), (cells,)], tasks)
    if not state[0].any():  # no task at all
        state = Learner(MixingModel(None, [], None, None, None)).state()
    weights, refine = bit_mixer.joined([tuple(state)])
    model.unpersist()
    return MixingModel(shape, codes, None, maps, weights, refine)


def word_logs(n: np.ndarray, blank: np.ndarray, after_stop: np.ndarray, symbol: np.ndarray, kinds: tuple[int, int, int], total: int, spaces: np.ndarray) -> np.ndarray:
    """log10 by counts alone of words seen n times and the white space (or end) behind each; -inf for unknown words.

    kinds: how many words were seen, seen once, seen twice; they give the absolute discount that unknown words leave.
    """
    _, once, twice = kinds
    d = once / (once + 2 * twice) if once and twice else 0.75
    with np.errstate(divide="ignore"):
        direct = np.log10(np.maximum(n - d, 0) / max(total, 1))
    return direct + np.log10(spaces / spaces.sum(axis=1, keepdims=True))[after_stop, symbol]


def mixed(coded: np.ndarray, counted: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 of both words' probabilities, mixed; first: where each text's words begin.

    The share of the counts for a text's word i is (1 + w) / (8 + i), w: its earlier words that counts foretold better.
    """
    better = counted > coded
    wins = np.cumsum(better) - better
    sizes = np.diff(np.r_[first, len(coded)])
    wins = wins - np.repeat(wins[first], sizes)
    share = (1.0 + wins) / (8.0 + np.arange(len(coded)) - np.repeat(first, sizes))
    return np.logaddexp2(coded / math.log10(2) + np.log2(1 - share), counted / math.log10(2) + np.log2(share)) * math.log10(2)


def score_documents(
    docs: DataFrame, train_col: str = "train", id_col: str = "doc_id", text_col: str = "text", hot_words: int = 100_000
) -> DataFrame:
    """(id_col, train, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte): one row for each row of docs.

    train_col (boolean, null counts as false) marks the rows that teach. Null texts are empty; an empty text is
    its end. Tokens are words and one end. base_score: log10 probability of the tokens by add-half unigram
    counts. score: that of the lower-cased text, every byte and the end coded in turn. Rows that repeat an id are
    scored each. Counts, byte codes, topics, maps, weights and refinement are gathered from all training documents and
    whole texts. The hot_words words of most blocks are broadcast, all others joined.
    """
    spark = docs.sparkSession
    marked = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("t"), F.coalesce(F.col(f"`{train_col}`"), F.lit(False)).alias("train"))
    encoded = materialise(encode_blocks(marked, id_col=id_col, text_col="t"), "mixing-encoded")
    words, texts = encoded.where("kind = 0"), encoded.where("kind = 1")
    vocabulary = materialise(words.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("blocks")), "mixing-words")
    sums = [F.count_if("train").alias("ends"), F.sum(F.when(F.col("train"), F.col("n_bytes"))).alias("bytes"), *[F.sum(F.when(F.col("train"), F.element_at("spaces", i + 1))).alias(f"s{i}") for i in range(14)]]
    ends = texts.agg(*sums).first()
    counts = vocabulary.agg(F.sum("n").alias("words"), *[F.count_if(F.col("n") >= 1).alias("kinds"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")]).first()
    n_ends, n_words = ends["ends"], counts["words"] or 0
    kinds, total = counts["kinds"] + (n_ends > 0), n_words + n_ends
    spaces = np.array([(ends[f"s{i}"] or 0) + 0.5 for i in range(14)]).reshape(2, 7)
    n_blank = sum(ends[f"s{i}"] or 0 for i in range(14)) - n_words  # empty words, between two spaces
    seen = (counts["kinds"] + (n_blank > 0), counts["once"] + (n_blank == 1), counts["twice"] + (n_blank == 2))
    norm = math.log10(total + 0.5 * (kinds + 1))

    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))
    taught = marked.where("train").select(F.col("t").cast("string").alias("t")).coalesce(tasks)
    frequent = [bytes(r.word) for r in vocabulary.where("n > 0").orderBy(F.desc("n"), "word").limit(TOPIC_WORDS).collect()]
    slots = tuple(min(s, 2 + int(ends["bytes"] or 0).bit_length()) for s in bit_mixer.SLOTS)
    shape = fit_shape(taught, frequent, slots, tasks)
    fitted = fit_mixer(taught, shape, *count_contexts(taught, shape, tasks), tasks)
    whole = spark.sparkContext.broadcast(Sent(shape, fitted.codes, False, fitted.maps, fitted.weights, fitted.refine))  # a fixed size: SLOTS

    hot = vocabulary.where("blocks > 1").orderBy(F.desc("blocks"), "word").limit(hot_words).select("word", F.col("n").alias("hot_n"))
    own = words.select(F.col("block").alias("block_"), F.col("at").alias("at_"), "word")
    known = own.join(F.broadcast(hot), "word", "left")  # hot_words rows at most
    rare = known.where("hot_n is null").select("block_", "at_", "word").join(vocabulary.select("word", "n"), "word").select("block_", "at_", "n")
    of_blocks = known.where("hot_n is not null").select("block_", "at_", F.col("hot_n").alias("n")).union(rare)
    kind = docs.schema[id_col].dataType.simpleString()

    def put_together(texts_: pa.Table, words_: pa.Table) -> pa.Table:
        n = np.zeros(len(words_), np.int64)
        n[words_.column("at_").to_numpy()] = words_.column("n").to_numpy()
        texts_ = texts_.sort_by("at")
        unpack, at = zstandard.ZstdDecompressor(), defaultdict(count().__next__)
        bodies = [unpack.decompress(t) for t in texts_.column("text").to_pylist()]
        columns: list[list[np.ndarray]] = [[] for _ in range(4)]
        model = whole.value.open()
        for lo, hi, logs, data, owners in coded_texts(bodies, model):
            closes = np.flatnonzero(_SYMBOL[data] >= 0)
            opens = np.r_[0, closes[:-1] + 1]
            blank, owner = closes == opens, owners[closes]
            times = np.full(len(closes), n_blank, np.int64)
            times[~blank] = n[[at[w] for t in bodies[lo:hi] for w in t.split()]]
            after_stop = (~blank & (data[closes - 1] == 46)).astype(np.int64)
            counted = word_logs(times, blank, after_stop, _SYMBOL[data[closes]], seen, n_words + n_blank, spaces)
            score = mixed(np.add.reduceat(logs, opens), counted, np.searchsorted(owner, np.arange(hi - lo)))
            tokens = np.where(blank, 0.0, np.log10(times + 0.5) - norm)
            for column, values in zip(columns, (~blank, ~blank & (times > 0), tokens, score)):
                column.append(np.bincount(owner, values, hi - lo))
        n_tokens, n_known, base, score = (np.concatenate(c) if c else np.zeros(0) for c in columns)
        n_bytes = texts_.column("n_bytes").to_numpy()
        return pa.table(
            {
                id_col: texts_.column(id_col),
                "train": texts_.column("train"),
                "n_tokens": pa.array(n_tokens.astype(np.int64) + 1),
                "n_known": pa.array(n_known.astype(np.int64) + (n_ends > 0)),
                "train_tokens": pa.array(np.full(len(base), total, np.int64)),
                "base_score": pa.array(base + math.log10(n_ends + 0.5) - norm),
                "score": pa.array(score),
                "bits_per_byte": pa.array(-score / math.log10(2) / np.maximum(n_bytes, 1)),
            }
        )

    left = texts.select("block", "at", id_col, "train", "n_bytes", "text").groupBy("block")
    schema = f"`{id_col}` {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return left.cogroup(of_blocks.groupBy("block_")).applyInArrow(put_together, schema)


def held_out(id_col: str = "doc_id", folds: int = 5, out: int = 1):
    return fold(id_col, folds) == out


ship_by_value(__name__)
