"""Order MinHash fingerprints: sensitive to the order of k-mers, and so to edit distance.

Each k-mer is numbered by its occurrence among equal k-mers. Each of `rows` hash functions selects the
`picks` numbered k-mers of least hash; these are put back into text order and hashed as a tuple. Two
texts are alike to the degree that their tuples agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ship_by_value
from tidemark.llm.ranges import keys_of, long_ids, range_bounds, range_count, range_of

ROWS, PICKS, K = 64, 2, 6
_MIX = np.uint32(0x7FEB352D), np.uint32(0x846CA68B)
#: Matrix cells worked on at once for one text.
_CELLS = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * _MIX[0]
    x = (x ^ (x >> np.uint32(15))) * _MIX[1]
    return x ^ (x >> np.uint32(16))


class OrderMinHash:
    """code points (uint32) -> `rows` tuple hashes of 16 bits."""

    def __init__(self, rows: int = ROWS, picks: int = PICKS, k: int = K, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.flip = rng.integers(0, 1 << 32, (rows, 1), dtype=np.uint32)
        self.times = rng.integers(0, 1 << 32, (rows, 1), dtype=np.uint32) | np.uint32(1)
        self.rows, self.picks, self.k = rows, picks, k

    def _numbered(self, codes: np.ndarray) -> np.ndarray:
        n = max(1, len(codes) - self.k + 1)
        grams = np.full(n, len(codes) if len(codes) < self.k else 0, np.uint32)
        for i in range(min(self.k, len(codes))):
            grams = _mixed(grams ^ codes[i : i + n]) + np.uint32(0x9E3779B9)
        order = np.argsort(grams, kind="stable")
        ranked = grams[order]
        first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        occurrence = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
        numbers = np.empty(n, np.uint32)
        numbers[order] = occurrence
        return _mixed(grams ^ (numbers * np.uint32(0x9E3779B1)))

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        if not len(codes):
            return np.zeros(self.rows, np.uint16)
        x = self._numbered(codes)
        n, picks = len(x), min(self.picks, len(x))
        step = max(picks, _CELLS // self.rows)
        best = at = None
        for lo in range(0, n, step):
            h = (x[None, lo : lo + step] ^ self.flip) * self.times
            part, where = [], []
            row = np.arange(self.rows)
            for _ in range(min(picks, h.shape[1])):
                i = h.argmin(axis=1)
                part.append(h[row, i])
                where.append(i + lo)
                h[row, i] = np.uint32(0xFFFFFFFF)
            part, where = np.stack(part, 1), np.stack(where, 1)
            if best is not None:
                part, where = np.concatenate([best, part], 1), np.concatenate([at, where], 1)
                keep = np.argsort(part, axis=1, kind="stable")[:, :picks]
                part, where = np.take_along_axis(part, keep, 1), np.take_along_axis(where, keep, 1)
            best, at = part, where
        chosen = x[np.sort(at, axis=1)]  # in text order
        out = np.full(self.rows, 0x51ED270B, np.uint32)
        for j in range(picks):
            out = _mixed(out ^ chosen[:, j]) * np.uint32(31) + np.uint32(j)
        return (out >> np.uint32(16)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def hexed(fp: np.ndarray) -> str:
    return fp.astype(">u2").tobytes().hex()


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def fingerprint_documents(docs: DataFrame, rows: int = ROWS, picks: int = PICKS, k: int = K, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint): rows * 4 hex digits for each whole text; null as empty. Any id type, repeated rows included."""

    def run(batches):
        sketch = OrderMinHash(rows, picks, k, seed)
        for b in batches:
            fps = [hexed(sketch(codes_of(t or ""))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.string())], names=[id_col, "fingerprint"])

    rows_ = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    return rows_.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


def compare_with_edits(
    docs: DataFrame, rows: int = ROWS, picks: int = PICKS, k: int = K, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = 16_000_000
) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text: the last n_chars // 2 code points replaced by the first as many (or all) of the next
    document in ascending id; after the last comes the first. Null ids come before all others; rows that
    share an id follow one another by their texts. A single row is its own next. Ids that are not integers are an error.

    Ids are dealt into ranges of about range_bytes of text; the first row of each range goes to the range before it as well (to the
    last, for the first), so the order is followed without a window over all rows.
    """
    texts = docs.select(long_ids(docs, id_col).alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    parts = range_count(texts, "text", range_bytes)
    bounds = range_bounds(texts, "doc_id", parts)

    def place(batches):
        for b in batches:
            key = keys_of(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(range_of(key, bounds)), pa.array(key)], names=["range", "key"])

    firsts = {r["range"]: r["first"] for r in texts.select("doc_id").mapInArrow(place, "range int, key long").groupBy("range").agg(F.min("key").alias("first")).collect()}  # one a range
    filled = sorted(firsts)
    before = {firsts[k]: filled[i - 1] for i, k in enumerate(filled)}

    def deal(batches):
        for b in batches:
            ids = keys_of(b.column(0))
            more = np.array([i for i, x in enumerate(ids.tolist()) if x in before], np.int64)
            take = pa.array(np.r_[np.arange(len(ids)), more].astype(np.int64))
            spread = np.r_[range_of(ids, bounds), np.array([before[x] for x in ids[more].tolist()], np.int32)].astype(np.int32)
            guest = np.r_[np.zeros(len(ids), bool), np.ones(len(more), bool)]
            yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(guest), b.column(0).take(take), b.column(1).take(take)], names=["range", "guest", "doc_id", "text"])

    def run(batches):
        sketch = OrderMinHash(rows, picks, k, seed)
        held = None  # the row that waits for its next: range, id, codes, fingerprint
        out: list[tuple] = []
        closed = None  # the range whose guest has been used
        for b in batches:
            for spread, guest, doc_id, text in zip(*[c.to_pylist() for c in b.columns]):
                if guest and closed == spread:
                    continue
                codes = codes_of(text)
                fp = sketch(codes)
                if held:
                    n = len(held[1])
                    edited = np.concatenate([held[1][: n - n // 2], codes[: n // 2]])
                    other = sketch(edited)
                    sha = hashlib.sha256(edited.tobytes().decode("utf-32-le").encode()).hexdigest()
                    out.append((held[0], n, sha, hexed(held[2]), hexed(other), likeness(held[2], other), likeness(held[2], fp)))
                held = None if guest else (doc_id, codes, fp)
                closed = spread if guest else None
            if len(out) >= 1000:
                yield batch(out)
                out = []
        yield batch(out)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds)], names=names)

    dealt = texts.mapInArrow(deal, "range int, guest boolean, doc_id long, text string")
    dealt = dealt.repartition(len(bounds) + 1, "range").sortWithinPartitions("range", "guest", "doc_id", "text")
    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


ship_by_value(__name__)
