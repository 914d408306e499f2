"""Token ids in files of separately compressed documents that share one zstandard dictionary.

A file: MAGIC; one zstandard frame for each document (ids as little-endian integers of `width` bytes);
the index (for n documents: n int64 ids, n + 1 uint64 frame offsets, n uint32 id counts), itself one
frame; a JSON footer (dictionary's sha256, width, n, how many ids at the start are null, index offset); its length as uint32.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import materialise, scratch_path, ship_by_value
from tidemark.llm.ranges import LEAST, keys_of, long_ids, range_bounds, range_count, range_of
from tidemark.llm.word_ids import WordEncoder, tokenizer_path, wide, width_of

MAGIC = b"TIDETOK1"
#: Manifests of more files than this are joined, not broadcast.
BROADCAST_FILES = 100_000


@dataclass(frozen=True)
class TokenStore:
    """directory of the files, the manifest (one row a file) and the shared dictionary."""

    directory: str
    manifest: DataFrame
    dictionary: bytes
    width: int


def _qualified(spark: SparkSession, directory: str) -> str:
    """With its scheme, so that drivers and workers agree on the filesystem that a bare path means."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _filesystem(directory: str):
    if directory.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + directory[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(directory)


def train_dictionary(docs: DataFrame, path: str, sample_docs: int = 500, size: int = 65_536, sample_bytes: int = 65_536, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """From the id arrays of the sample_docs documents whose ids have the least hashes; b"" where there are none.

    The sample only shapes compression, never what is stored: workers encode it, and of every array its first
    sample_bytes are gathered, so that what reaches the driver is bounded.
    """
    width = width_of(path)
    hashed = docs.select(F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    least = [r.h for r in hashed.orderBy("h").limit(sample_docs).collect()]
    if not least:
        return b""

    def encode(batches):
        encoder = WordEncoder(path, width)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pc.binary_slice(encoder.encode(b.column(0)), 0, sample_bytes)], names=["ids"])

    chosen = docs.where(F.xxhash64(F.col(id_col).cast("string")) <= least[-1]).select(F.col(text_col).cast("string").alias("t"))
    gathered = chosen.mapInArrow(encode, "ids binary").where("length(ids) > 0").limit(2 * sample_docs).collect()
    samples = sorted(bytes(r.ids) for r in gathered)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples: plain content serves as the dictionary
        return b"".join(samples)[-size:]


def _dictionary(raw: bytes):
    return zstandard.ZstdCompressionDict(raw) if raw else None


class _File:
    def __init__(self, directory: str, name: str, dictionary: bytes, width: int, level: int):
        fs, base = _filesystem(directory)
        self.name, self.width, self.sha = name, width, hashlib.sha256(dictionary).hexdigest()
        self.out = fs.open_output_stream(f"{base}/{name}", compression=None)
        self.out.write(MAGIC)
        self.ids, self.counts, self.at = [], [], [len(MAGIC)]
        self.level, self.nulls = level, 0

    def add(self, doc_id: int | None, frame: bytes, n: int) -> None:
        self.out.write(frame)
        self.nulls += doc_id is None
        self.ids.append(LEAST if doc_id is None else doc_id)
        self.counts.append(n)
        self.at.append(self.at[-1] + len(frame))

    def close(self) -> int:
        index = np.array(self.ids, "<i8").tobytes() + np.array(self.at, "<u8").tobytes() + np.array(self.counts, "<u4").tobytes()
        self.out.write(zstandard.ZstdCompressor(self.level).compress(index))
        footer = json.dumps({"dictionary": self.sha, "width": self.width, "n": len(self.ids), "nulls": self.nulls, "index": self.at[-1]}).encode()
        self.out.write(footer + len(footer).to_bytes(4, "little"))
        self.out.close()
        return len(self.ids)


def write_store(
    docs: DataFrame,
    directory: str | None = None,
    path: str | None = None,
    end_id: int | None = 1,
    level: int = 3,
    file_bytes: int = 32_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    range_bytes: int = 16_000_000,
) -> TokenStore:
    """Write the ids of every whole text (null: empty) in ascending id order, null ids first, repeated ids by their bytes.

    Ids that are not integers are an error. Ranges of about range_bytes of text go to tasks, each of which starts a new file after file_bytes. A file's name is its
    attempt's own; only the names in the manifest count, so a task that is run again leaves no half results.
    """
    spark = docs.sparkSession
    path = path or tokenizer_path()
    directory = _qualified(spark, directory or scratch_path(spark, "token-store"))
    width = width_of(path)
    raw = train_dictionary(docs, path, id_col=id_col, text_col=text_col)
    fs, base = _filesystem(directory)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/dictionary-{hashlib.sha256(raw).hexdigest()[:16]}", compression=None) as out:
        out.write(raw)
    rows = docs.select(long_ids(docs, id_col).alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    bounds = range_bounds(rows, "doc_id", range_count(rows, "text", range_bytes))
    end = b"" if end_id is None else end_id.to_bytes(width, "little")

    def encode(batches):
        encoder = WordEncoder(path, width)
        for b in batches:
            ids = encoder.encode(b.column(1), end)
            spread = pa.array(range_of(keys_of(b.column(0)), bounds))
            yield pa.RecordBatch.from_arrays([spread, b.column(0), ids], names=["range", "doc_id", "ids"])

    def write(batches):
        compressor = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(raw))
        file, done, key, tokens, last = None, [], None, 0, {}

        def close():
            nonlocal file, tokens
            if file:
                done.append((key[0], key[1], file.name, file.ids[0], file.ids[-1], file.close(), tokens))
            file, tokens = None, 0

        for b in batches:
            for spread, doc_id, ids in zip(*[c.to_pylist() for c in b.columns]):
                if file and (spread != key[0] or file.at[-1] >= file_bytes):
                    close()
                if not file:
                    last[spread] = last.get(spread, -1) + 1
                    key = (spread, last[spread])
                    file = _File(directory, f"{spread:06d}-{last[spread]:06d}-{uuid.uuid4().hex}.ids", raw, width, level)
                file.add(doc_id, compressor.compress(ids), len(ids) // width)
                tokens += len(ids) // width
        close()
        names = ["range", "part", "file", "first_id", "last_id", "n_docs", "n_tokens"]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done) if done else [[]] * 7, kinds)], names=names)

    dealt = rows.mapInArrow(encode, "range int, doc_id long, ids binary").repartition(len(bounds) + 1, "range").sortWithinPartitions("range", "doc_id", "ids")
    schema = "range int, part int, file string, first_id long, last_id long, n_docs long, n_tokens long"
    return TokenStore(directory, materialise(dealt.mapInArrow(write, schema), "token-manifest"), raw, width)


def _parsed(index: bytes, footer: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, which of them are null, offsets of the frames, ids a document."""
    n = footer["n"]
    ids, at = np.frombuffer(index, "<i8", n), np.frombuffer(index, "<u8", n + 1, 8 * n)
    return ids, np.arange(n) < footer["nulls"], at, np.frombuffer(index, "<u4", n, 16 * n + 8).astype(np.int64)


def _rows(ids, nulls, starts, frames, inflate, width: int, with_ids: bool):
    """Record batches of some documents of one file; frames: an iterator of their compressed bytes."""
    frames = iter(frames)
    for lo in range(0, len(ids), 2000):
        part = slice(lo, lo + 2000)
        arrays = [wide(inflate.decompress(next(frames)), width).tobytes() for _ in range(len(ids[part]))]
        columns = [pa.array(ids[part], mask=nulls[part]), pa.array(starts[part]), pa.array([len(x) // 4 for x in arrays], pa.int64()), pa.array([zlib.crc32(x) for x in arrays], pa.int64())]
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        if with_ids:
            columns.append(pa.array(arrays, pa.binary()))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names=names)


def read_store(spark: SparkSession, store: TokenStore, only: list[int] | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) from the files; start: ids of all documents before it.

    only: a short list of ids; then of the files that may hold them the footer, the index and the documents' own
    frames are read, each by its offset, and nothing else.
    """
    files = store.manifest
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    raw, width, sha = store.dictionary, store.width, hashlib.sha256(store.dictionary).hexdigest()
    directory = store.directory
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def checked(footer: dict) -> dict:
        if footer["dictionary"] != sha:
            raise ValueError("not a token file of this dictionary")
        return footer

    def read(batches):
        inflate, plain = zstandard.ZstdDecompressor(dict_data=_dictionary(raw)), zstandard.ZstdDecompressor()
        for b in batches:
            for content, base in zip(b.column(0), b.column(1).to_pylist()):
                data = content.as_buffer().to_pybytes()
                size = int.from_bytes(data[-4:], "little")
                footer = checked(json.loads(data[-4 - size : -4]))
                ids, nulls, at, counts = _parsed(plain.decompress(data[footer["index"] : -4 - size]), footer)
                starts = base + np.cumsum(counts) - counts
                yield from _rows(ids, nulls, starts, (data[x:y] for x, y in zip(at, at[1:])), inflate, width, with_ids)

    def seek(batches):
        inflate, plain = zstandard.ZstdDecompressor(dict_data=_dictionary(raw)), zstandard.ZstdDecompressor()
        fs, folder = _filesystem(directory)
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fs.open_input_file(f"{folder}/{name}") as f:
                    end = f.size()
                    size = int.from_bytes(f.read_at(4, end - 4), "little")
                    footer = checked(json.loads(f.read_at(size, end - 4 - size)))
                    ids, nulls, at, counts = _parsed(plain.decompress(f.read_at(end - 4 - size - footer["index"], footer["index"])), footer)
                    starts = base + np.cumsum(counts) - counts
                    take = np.flatnonzero(np.isin(ids, only) & ~nulls)
                    yield from _rows(ids[take], nulls[take], starts[take], (f.read_at(int(at[i + 1] - at[i]), int(at[i])) for i in take), inflate, width, with_ids)

    if only is not None:
        wanted = F.lit(False)
        for x in only:
            wanted = wanted | F.lit(x).between(F.col("first_id"), F.col("last_id"))
        return files.where(wanted).select("file", "base").mapInArrow(seek, schema)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(store.directory)
    found = found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    bases = files.select("file", "base")
    bases = F.broadcast(bases) if bases.count() <= BROADCAST_FILES else bases
    return found.join(bases, "file").select("content", "base").mapInArrow(read, schema)


ship_by_value(__name__)
