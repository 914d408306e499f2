"""Substring dedup by content-defined chunking with a gear rolling hash.

A boundary stands where the gear hash of the last WINDOW bytes is the least within REACH bytes on either
side, so it depends on the bytes around it alone: an insertion moves only the chunks it touches. Chunks are
deduplicated by a 128-bit digest; consecutive chunks that other documents have had before form a run of spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import materialise, ship_by_value
from tidemark.llm.word_ids import text_bytes

WINDOW, REACH = 16, 24
_GEAR = np.random.default_rng(42).integers(0, 1 << 32, 256, dtype=np.uint32)
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[byte i - j] << 2j over the last 16 bytes, by doubling."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8):
        moved = h[:-width] << np.uint32(2 * width)
        h = h.copy()
        h[width:] += moved
    return h


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """[i]: least of h[i : i + width], width a power of two; h is padded by the caller."""
    step = 1
    while step < width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return h


def boundaries(data: np.ndarray) -> np.ndarray:
    """Ends of all chunks but the last: strictly less than what lies REACH before, not more than what lies REACH after."""
    n = len(data)
    if n < 2:
        return np.zeros(0, np.int64)
    pad = np.full(REACH, 0xFFFFFFFF, np.uint32)
    h = np.concatenate([pad, gear(data), pad])
    by16, by8 = _least(h, 16), _least(h, 8)
    own = h[REACH : REACH + n]
    left = np.minimum(by16[:n], by8[16 : 16 + n])
    right = np.minimum(by8[REACH + 1 : REACH + 1 + n], by16[REACH + 9 : REACH + 9 + n])
    ends = np.flatnonzero((own < left) & (own <= right)) + 1
    return ends[ends < n]


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id_col, i, start, end, words, hi, lo): chunks of whole texts; start and end in code points, end exclusive.

    words counts words that start in the chunk. A null or empty text has no chunk.
    """

    def run(batches):
        digest = xxhash.xxh3_128_intdigest
        for b in batches:
            pieces: list[list[np.ndarray]] = [[] for _ in range(5)]
            digests: list[int] = []
            for at, text in enumerate(text_bytes(b.column(2))):
                if not text:
                    continue
                data = np.frombuffer(text, np.uint8)
                cuts = np.concatenate([[0], boundaries(data), [len(data)]])
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[cuts]
                space = _SPACE[data]
                begins = ~space & np.concatenate([[True], space[:-1]])
                words = np.concatenate([[0], np.cumsum(begins)])[cuts]
                for column, value in zip(pieces, (np.full(len(cuts) - 1, at), np.arange(len(cuts) - 1), chars[:-1], chars[1:], np.diff(words))):
                    column.append(value)
                spans = cuts.tolist()
                digests += [digest(text[x:y]) for x, y in zip(spans, spans[1:])]
                if len(digests) > 200_000:
                    yield batch(b, pieces, digests)
                    pieces, digests = [[] for _ in range(5)], []
            yield batch(b, pieces, digests)

    def batch(b, pieces, digests):
        at, i, start, end, words = (np.concatenate(p).astype(np.int64) if p else np.zeros(0, np.int64) for p in pieces)
        hi = np.array([x >> 64 for x in digests], np.uint64).view(np.int64)
        lo = np.array([x & 0xFFFFFFFFFFFFFFFF for x in digests], np.uint64).view(np.int64)
        take = pa.array(at)
        columns = [b.column(0).take(take), b.column(1).take(take), *[pa.array(x.astype(np.int32)) for x in (i, start, end, words)], pa.array(hi), pa.array(lo)]
        return pa.RecordBatch.from_arrays(columns, names=["row", id_col, "i", "start", "end", "words", "hi", "lo"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), id_col, F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, `{id_col}` {kind}, i int, start int, end int, words int, hi long, lo long")


def repeated_spans(docs: DataFrame, min_words: int = 16, id_col: str = "doc_id", text_col: str = "text", hot: int = 1000, hot_chunks: int = 50_000) -> DataFrame:
    """(row, id_col, start, end, words, keep_id): spans of documents that an earlier document has as well.

    Of every chunk the occurrence in the document of least (id, row) stays; occurrences in other documents
    are marked, those within one document are not. Consecutive marked chunks of a document make one run,
    whichever documents their first occurrences lie in; runs with fewer than min_words words are left alone
    (chance repeats, license lines). A run is then reported as one span for each stretch that stays in the same
    document, so a span itself can be short. A passage of n bytes shared between documents is found but for its
    outer 40 to 100 bytes or so on either side, so 50 words leave more than min_words. Documents with a null id
    come first among equals. The hot_chunks most frequent chunks of those with `hot` occurrences or more are
    broadcast, so that a very common line does not meet in one task; all others are joined.
    """
    chunks = materialise(chunk_documents(docs, id_col, text_col), "chunks")
    owner = F.struct(F.col(id_col), F.col("row"))
    repeated = chunks.groupBy("hi", "lo").agg(F.min("row").alias("a"), F.max("row").alias("b"), F.min(owner).alias("keep"), F.count("*").alias("n")).where("a <> b").drop("a", "b")
    repeated = materialise(repeated, "chunks-repeated")
    often = repeated.where(F.col("n") >= hot).orderBy(F.desc("n"), "hi", "lo").limit(hot_chunks).select("hi", "lo", F.col("keep").alias("hot_keep"))
    seen = chunks.join(F.broadcast(often), ["hi", "lo"], "left")  # hot_chunks rows at most
    rare = seen.where("hot_keep is null").drop("hot_keep").join(repeated.drop("n"), ["hi", "lo"])
    marked = seen.where("hot_keep is not null").withColumnRenamed("hot_keep", "keep").unionByName(rare).where(F.col("row") != F.col("keep.row"))
    ordered = Window.partitionBy("row").orderBy("i")
    marked = marked.withColumn("run", F.col("i") - F.row_number().over(ordered))
    changed = (F.lag("run").over(ordered) != F.col("run")) | (F.lag("keep.row").over(ordered) != F.col("keep.row"))
    marked = marked.withColumn("changed", F.coalesce(changed, F.lit(False)).cast("int")).withColumn("piece", F.sum("changed").over(ordered))
    marked = marked.withColumn("run_words", F.sum("words").over(Window.partitionBy("row", "run"))).where(F.col("run_words") >= min_words)
    spans = marked.groupBy("row", id_col, "keep", "piece").agg(F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), F.sum("words").alias("words"))
    return spans.select("row", id_col, "start", "end", "words", F.col(f"keep.{id_col}").alias("keep_id"))


def remove_repeats(docs: DataFrame, min_words: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the spans that repeated_spans marks; all rows stay, with all their columns, a text may become empty."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.monotonically_increasing_id().alias("n"))
    held = materialise(whole, "chunk-docs").withColumn("t", F.col(f"d.`{text_col}`").cast("string"))
    spans = repeated_spans(held.select("n", "t"), min_words, "n", "t")
    cuts = spans.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))  # those of one document

    def run(batches):
        for b in batches:
            texts = []
            for text, cuts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for cut in reversed(cuts or []):
                    text = text[: cut["start"]] + text[cut["end"] :]
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), b.column(2)], names=["cut", "m"])

    touched = held.select("n", "t").join(cuts, "n").select("t", "cuts", "n").mapInArrow(run, "cut string, m long")
    joined = held.join(touched, F.col("n") == F.col("m"), "left")
    text = F.when(F.col("m").isNotNull(), F.col("cut").cast(docs.schema[text_col].dataType)).otherwise(F.col(f"d.`{text_col}`"))
    return joined.select(*[(text if c == text_col else F.col(f"d.`{c}`")).alias(c) for c in docs.columns])


ship_by_value(__name__)
