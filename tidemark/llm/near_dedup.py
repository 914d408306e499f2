"""Near-duplicates by SimHash, completed to a true Jaccard similarity of word shingles.

Candidates are the pairs that simhash finds within RADIUS bits by its deletion variants, and, since a pair of
similarity 0.8 differs in about 10 of 64 bits, those that MinHash bands propose: with BANDS bands of ROWS values
a pair of similarity s is proposed with probability 1 - (1 - s^ROWS)^BANDS, 0.9995 at 0.8, more above. Every
candidate is verified on the whole shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import materialise, ship_by_value
from tidemark.llm.graph import components
from tidemark.llm.simhash import fingerprint_of, near_pairs, shingle_hashes
from tidemark.llm.word_ids import lean, small_batches, text_bytes

BANDS, ROWS, STEP, RADIUS = 25, 6, 1024, 3
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1000
_rng = np.random.default_rng(42)
_XOR = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)


def shingles(text: bytes, width: int, seed: int) -> np.ndarray:
    """The distinct shingles of a text as ascending hashes."""
    return np.unique(shingle_hashes(text, width, seed))


def band_keys(hashes: np.ndarray) -> list[int]:
    """One key a band from the least values of its ROWS permutations; none for an empty set."""
    if not len(hashes):
        return []
    low, least = hashes.astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), STEP):
        least = np.minimum(least, ((low[at : at + STEP, None] ^ _XOR) * _MUL).min(axis=0))
    data, size = least.tobytes(), 4 * ROWS
    return [xxhash.xxh64_intdigest(data[k * size : (k + 1) * size], k) for k in range(BANDS)]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def signatures(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """docs: columns, the last one the text -> the others, sim (SimHash), fp (hash of the shingle set, 0 for none), size, keys."""
    schema = T.StructType([*docs.schema.fields[:-1], T.StructField("sim", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches):
        for b in small_batches(batches):
            sims, fps, sizes, keys = [], [], [], []
            for text in text_bytes(b.columns[-1]):
                every = shingle_hashes(text, width, seed)
                hashes = np.unique(every)
                sims.append(fingerprint_of(every))
                fps.append(xxhash.xxh64_intdigest(hashes.tobytes()) if len(hashes) else 0)
                sizes.append(len(hashes))
                keys.append(np.array(band_keys(hashes), np.uint64).view(np.int64))
            fps = pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sims, pa.int64()), fps, pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=schema.names)

    return docs.mapInArrow(lean(run), schema)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, width: int, seed: int) -> DataFrame:
    """pairs (a, b) of which the shingle sets have the similarity; texts: (fp, text)."""

    def run(batches):
        last, held = None, None
        for b in small_batches(batches):
            keep = []
            for x, y in zip(text_bytes(b.column(2)), text_bytes(b.column(3))):
                if x != last:
                    last, held = x, shingles(x, width, seed)
                keep.append(jaccard(held, shingles(y, width, seed)) >= similarity)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(lean(run), "a long, b long")


def common_shingles(texts: DataFrame, width: int, seed: int) -> DataFrame:
    """texts (fp, text) -> (fp, common): the shingles that another of these texts has too."""

    def run(batches):
        for b in small_batches(batches):
            sets = [shingles(t, width, seed).view(np.int64) for t in text_bytes(b.column(1))]
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(sets)), sizes))), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))], names=["fp", "g"])

    each = materialise(texts.select("fp", "text").mapInArrow(lean(run), "fp long, g long"), "jaccard-shingles")
    often = each.groupBy("g").agg(F.count("*").alias("c")).where("c > 1").select("g")
    return each.join(often, "g").groupBy("fp").agg(F.collect_list("g").alias("common"))  # at most the text's own shingles


def overlaps(pairs: DataFrame, texts: DataFrame, common: DataFrame, width: int, seed: int) -> DataFrame:
    """pairs (fp, hub) -> (fp, hub, inside, other): how many shingles of the hub fp has, and how many others that are common."""

    def run(batches):
        last, held = None, None
        for b in small_batches(batches):
            inside, other = [], []
            for hub, own, shared in zip(text_bytes(b.column(2)), text_bytes(b.column(3)), b.column(4)):
                if hub != last:
                    last, held = hub, shingles(hub, width, seed)
                inside.append(len(np.intersect1d(held, shingles(own, width, seed), assume_unique=True)))
                mine = shared.values.to_numpy().view(np.uint64) if shared.is_valid else np.zeros(0, np.uint64)
                other.append(len(np.setdiff1d(mine, held, assume_unique=True)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(inside, pa.int64()), pa.array(other, pa.int64())], names=["fp", "hub", "inside", "other"])

    both = pairs.join(texts.toDF("fp", "text"), "fp").join(common, "fp", "left").join(texts.toDF("hub", "hub_text"), "hub")
    return both.select("fp", "hub", "hub_text", "text", "common").mapInArrow(lean(run), "fp long, hub long, inside long, other long")


def similar_sets(rows: DataFrame, similarity: float, width: int, seed: int) -> DataFrame:
    """rows (n, sim, fp, size, keys, text), n unique -> (fp, root): sets linked, directly or over others, by a similar pair.

    The members of a band's key are first held against its hub, so a group of m copies takes m pairs; the hub is the
    member whose keys have most members in all: the text that its edited copies share most with.
    Then those that this has not joined to the hub are held against members of other components: pairs inside a
    component can't change it. What two members share lies in the hub, and is at most what the one with less of
    the hub has of it, or outside, and is at most what either has there in common with any text; pairs for which these
    two do not reach the similarity are left out unread, so copies that lie apart by edits of their own are
    no candidates. No link that matters is lost. Sets of one SimHash are held against the
    least of them, and those of near SimHashes against each other, in the same way.
    """
    sims = rows.where("size > 0").groupBy("sim").agg(F.min(F.struct("fp", "size")).alias("hub"))
    near = near_pairs(sims.select(F.col("sim").alias("fp")), RADIUS)
    hub = lambda c, x, y: sims.select(F.col("sim").alias(c), F.col("hub.fp").alias(x), F.col("hub.size").alias(y))
    alike = rows.where("size > 0").select("sim", F.col("fp").alias("q"), F.col("size").alias("y")).join(hub("sim", "p", "x"), "sim").where("p <> q").select("p", "q", "x", "y")
    alike = alike.union(near.join(hub("a", "p", "x"), "a").join(hub("b", "q", "y"), "b").select("p", "q", "x", "y"))
    alike = materialise(alike.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "x", "y").distinct(), "jaccard-alike")
    keyed = rows.select("fp", "size", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("fp").alias("least"), F.max("fp").alias("most"), F.count("*").alias("c")).where("least <> most").select("key", "c")
    shared = materialise(keyed.join(shared, "key").distinct(), "jaccard-shared")
    central = shared.groupBy("fp").agg(F.sum("c").alias("w"))
    hubs = shared.join(central, "fp").groupBy("key").agg(F.max_by(F.struct("fp", "size"), F.struct("w", "fp")).alias("hub"))
    members = materialise(shared.join(hubs, "key").select("key", "fp", "size", F.col("hub.fp").alias("hub"), F.col("hub.size").alias("hub_size")), "jaccard-members")
    wanted = members.select("fp").union(alike.select("a")).union(alike.select("b")).distinct()
    shown = rows.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("n").alias("n"))
    texts = materialise(rows.select("n", "text").join(shown, "n").select("fp", "text"), "jaccard-texts")
    close = f"least(x, y) >= {similarity!r}D * greatest(x, y)"
    star = members.where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b"), F.col("hub_size").alias("x"), F.col("size").alias("y")).where(close)
    star = star.union(alike.where(close))
    links = materialise(verified(star.select("a", "b").distinct(), texts, similarity, width, seed), "jaccard-links")
    roots = materialise(components(links), "jaccard-roots").toDF("fp", "root")
    named = members.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    hub_roots = named.where("fp = hub").select("key", F.col("root").alias("hub_root"))
    apart = materialise(named.join(hub_roots, "key"), "jaccard-named")
    unsettled = apart.where("root <> hub_root").select("key").distinct()
    left = apart.join(unsettled, "key", "left_semi").where("fp <> hub")
    asked = materialise(left.select("fp", "hub").distinct(), "jaccard-asked")
    if asked.isEmpty():
        return roots
    own = texts.join(asked.select("fp").distinct(), "fp", "left_semi")
    left = left.join(materialise(overlaps(asked, texts, common_shingles(own, width, seed), width, seed), "jaccard-overlaps"), ["fp", "hub"])
    side = lambda c, x: [F.col("fp").alias(c), F.col("size").alias(x), F.col("root").alias(f"root_{c}"), F.col("inside").alias(f"inside_{c}"), F.col("other").alias(f"other_{c}")]
    a = left.where("root <> hub_root").select("key", *side("a", "x"))
    b = left.select("key", *side("b", "y"), (F.col("root") == F.col("hub_root")).alias("near_hub"))
    reach = f"least(inside_a, inside_b) + least(other_a, other_b) >= {similarity / (1 + similarity)!r}D * (x + y) - 1e-6D"
    crossed = a.join(b, "key").where(f"root_a <> root_b and (near_hub or a < b) and {close} and {reach}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = materialise(verified(crossed.distinct(), texts, similarity, width, seed), "jaccard-more-links")
    return roots if more.isEmpty() else components(links.union(more)).toDF("fp", "root")


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, width: int = 5, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group that pairs of at least this similarity link: that of the smallest id, with all columns.

    Equal shingle sets are one vertex. Null texts and texts without words are one group. Of rows that share the
    smallest id inside one group one stays.
    """
    columns = docs.columns
    numbered = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("d"), F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    rows = materialise(signatures(numbered, width, seed).withColumn("n", F.monotonically_increasing_id()), "jaccard-docs", BATCH_ROWS)
    roots = similar_sets(rows.select("n", "sim", "fp", "size", "keys", F.col("d")[text_col].cast("string").alias("text")), similarity, width, seed)
    first = F.min(F.struct(F.col("k").isNull().alias("none"), "k", "fp", "n")).alias("first")
    sets = rows.groupBy("fp").agg(first)
    kept = sets.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first")["n"].alias("n_"))
    return rows.join(kept, rows.n == kept.n_, "left_semi").select("d.*")


ship_by_value(__name__)
