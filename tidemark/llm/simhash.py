"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into few segments: of two fingerprints within the radius, some segment
differs by one bit at most. Every segment is indexed as it is and with each of its bits struck out;
equal keys are joined and the pairs verified on the whole fingerprint. Here radius is 1 to 3: two segments.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import materialise, ship_by_value
from tidemark.llm.graph import components
from tidemark.llm.word_ids import text_bytes


def shingle_hashes(text: bytes, width: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; all words of a shorter text are one; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends)), np.uint64, n)


def fingerprint(text: bytes, width: int, seed: int) -> int:
    """64 bits; 0 for a text without words."""
    return fingerprint_of(shingle_hashes(text, width, seed))


def fingerprint_of(hashes: np.ndarray) -> int:
    n = len(hashes)
    if not n:
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = 2 * np.add.reduce(bits, axis=0, dtype=np.int64) > n
    return int(np.packbits(over, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 5, seed: int = 42, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """The columns and fp (long): whole texts, null as empty. Words are runs without ASCII white space, A-Z lower-cased."""
    kept = docs.select(*[F.col(f"`{c}`") for c in columns or docs.columns], F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("fp", T.LongType())])

    def run(batches):
        for b in batches:
            fps = [fingerprint(t, width, seed) for t in text_bytes(b.columns[-1])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps, pa.int64())], names=schema.names)

    return kept.mapInArrow(run, schema)


def _half_rules(width: int):
    """For a region of width bits: its halves, each as it is (bit -1) and with each of its bits struck out."""
    half = width // 2
    return F.array(*[F.struct(F.lit(part * half).alias("from"), F.lit(bit).alias("bit")) for part in (0, 1) for bit in range(-1, half)])


def near_pairs(fps: DataFrame, radius: int = 2, pair_limit: int = 256) -> DataFrame:
    """fps: (fp) distinct -> (a, b): every pair within radius (1 to 3) bits, once.

    Level 0 cuts all 64 bits into halves: one of them differs by one bit at most. A half is a key as it is,
    and with each bit struck out; a key with bit i struck out only links fingerprints that differ in bit i, so
    equal halves do not meet 32 times. Keys with at most pair_limit fingerprints are joined and verified. The
    members of a larger key are cut again, in the half that the key leaves open, so their keys fix 48 bits, then
    56; then 8 open bits and three struck ones bound a key's members by 2^11. No link is lost at any level.
    """
    if not 1 <= radius <= 3:
        raise ValueError("radius: 1 to 3")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, found = fps.select("fp", F.lit(0).cast("long").alias("mask"), F.lit(0).alias("lo")).repartition(parts, "fp"), []
    for width in (64, 32, 16):
        half = width // 2
        cut = rows.select("fp", "mask", "lo", F.explode(_half_rules(width)).alias("r"))
        segment = F.expr(f"shiftleft({(1 << half) - 1}L, lo + r.from)")
        struck = F.expr("if(r.bit < 0, 0L, shiftleft(1L, lo + r.from + r.bit))")
        keys = cut.select(
            "fp",
            (F.col("mask").bitwiseOR(segment.bitwiseAND(F.bitwise_not(struck)))).alias("mask"),
            F.expr(f"lo + {half} - r.from").alias("lo"),
            F.expr("r.bit < 0").alias("exact"),
            (F.col("fp").bitwiseAND(struck) != 0).cast("int").alias("side"),
        ).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = keys.groupBy("mask", "key").agg(F.count("*").alias("n"), F.sum("side").alias("ones"), F.first("exact").alias("e"))
        sizes = materialise(sizes.where("n > 1 and (e or (ones > 0 and ones < n))").select("mask", "key", "n"), "simhash-sizes")
        keys = materialise(keys.join(sizes, ["mask", "key"]), "simhash-keys")
        few = keys if width == 16 else keys.where(F.col("n") <= pair_limit)
        left = few.select("mask", "key", "exact", F.col("fp").alias("a"), F.col("side").alias("side_a"))
        right = few.select("mask", "key", F.col("fp").alias("b"), F.col("side").alias("side_b"))
        joined = left.join(right, ["mask", "key"]).where("(exact and a < b) or side_a < side_b")
        found.append(joined.where(F.expr(f"bit_count(a ^ b) <= {radius}")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        rows = keys.where(F.col("n") > pair_limit).select("fp", "mask", "lo")
        if width == 16 or rows.isEmpty():
            break
    return reduce(DataFrame.union, found).distinct()


def clusters(rows: DataFrame, radius: int, pair_limit: int, id_col: str) -> DataFrame:
    """rows with fp -> (fp, component_id): the least id of the fingerprints that links connect."""
    vertices = rows.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = components(near_pairs(vertices.select("fp"), radius, pair_limit))
    labelled = vertices.join(roots, vertices.fp == roots.id, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    labelled = materialise(labelled, "simhash-roots")
    component = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    return labelled.join(component, "root").select("fp", "component_id")


def near_duplicates(
    docs: DataFrame, width: int = 5, radius: int = 2, seed: int = 42, pair_limit: int = 256, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, fingerprint, component_id): one row for each input row, whatever other columns docs has.

    Documents link when their fingerprints differ in at most radius bits; component_id is the smallest id
    reachable. Null and empty texts have fingerprint zero and link like any other. Equal fingerprints are
    one vertex, so copies are never paired. A null id never becomes a component_id unless its component has no other.
    """
    rows = materialise(fingerprints(docs, width, seed, text_col, [id_col]), "simhash-fps")
    found = clusters(rows, radius, pair_limit, id_col)
    return rows.join(found, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(
    docs: DataFrame, width: int = 5, radius: int = 3, seed: int = 42, pair_limit: int = 256, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of docs for each component of near_duplicates, that of the smallest id, with all its columns.

    Of rows that share this id inside one component one stays (that of the smallest fingerprint). Null and
    empty texts are one component.
    """
    columns = docs.columns
    numbered = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("d"), F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    rows = materialise(fingerprints(numbered, width, seed, "t", ["d", "k"]).withColumn("n", F.monotonically_increasing_id()), "simhash-docs")
    found = clusters(rows.select("k", "fp"), radius, pair_limit, "k")
    kept = rows.select("n", "k", "fp").join(found, "fp").where(F.col("k").eqNullSafe(F.col("component_id")))
    first = kept.groupBy("component_id").agg(F.min(F.struct("fp", "n"))["n"].alias("n_"))
    return rows.join(first, rows.n == first.n_, "left_semi").select("d.*")


ship_by_value(__name__)
