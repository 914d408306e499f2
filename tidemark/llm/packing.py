"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of documents cut into packets. Each round adds window * weight tokens to every
source's deficit counter, and a source sends packets while its counter covers them; what is left carries
over. While a queue is not empty, a packet that ends at token e of its queue therefore leaves in round
ceil(e / quantum): rounds, and with them windows, need prefix sums only and carry their deficits across
all partitions. A packet is one token unless larger ones are asked for, so after r rounds each source has sent
what r windows owe it less a part of a token, and all together r windows less a token for each source at most. The
stream of rounds is cut into sequences of exactly window tokens: as long as no queue has run out, a window is a round but
for that shift, and holds each source's target but for one packet for each source and two of its own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import materialise, ordered_offsets, ship_by_value, small_table
from tidemark.llm.word_ids import encode_documents, lean, small_batches, tokenizer_path, wide, width_of

#: Rows of an Arrow batch: the JVM holds batches outside its heap, two for each running task.
BATCH_ROWS = 1000


def _queue_key(column: str):
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def queue_weights(totals: DataFrame, weights: dict[str | None, float] | None, exponent: float) -> DataFrame:
    """totals (queue, tokens) -> with weight: the given ones (missing queues are an error), else tokens ** exponent."""
    whole = Window.partitionBy()  # one row a queue
    if weights is None:
        return totals.withColumn("raised", F.pow("tokens", F.lit(float(exponent)))).withColumn("weight", F.col("raised") / F.sum("raised").over(whole)).drop("raised")
    rows = [("" if q is None else f"={q}", float(w)) for q, w in weights.items()]
    given = small_table(totals.sparkSession, rows, "queue string, raised double")
    known = totals.join(given, "queue", "left").withColumn("raised", F.coalesce("raised", F.raise_error(F.concat(F.lit("no weight for source "), "queue")).cast("double")))
    return known.withColumn("weight", F.col("raised") / F.sum("raised").over(whole)).drop("raised")


def plan_pieces(sizes: DataFrame, window: int, packet: int, weights: dict[str | None, float] | None = None, exponent: float = 1.0) -> DataFrame:
    """sizes (row, copies, queue, n_tokens > 0) -> (row, copy, start, length, sequence_id, offset).

    Queues are ordered by copy, then by a hash of the row: one permutation, gone through once for every copy, so
    that all that is left of a source lies between two copies of a document. Only counts and positions
    move here, never ids or texts.
    """
    each = sizes.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("h", F.xxhash64(F.lit(42), "row"))
    placed = ordered_offsets(each.select("queue", "copy", "h", "row", "n_tokens"), ["queue", "copy", "h", "row"], "n_tokens", "at")
    totals = sizes.groupBy("queue").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"))
    ahead = Window.orderBy("queue").rowsBetween(Window.unboundedPreceding, -1)
    queues = queue_weights(totals, weights, exponent).withColumn("base", F.coalesce(F.sum("tokens").over(ahead), F.lit(0)))  # one row a source
    queues = queues.select("queue", "base", (F.lit(float(window)) * F.col("weight")).alias("q"))
    # a document's parts: those of its rounds where the quantum exceeds a packet, else its packets
    own = placed.join(queues, "queue").withColumn("a", F.col("at") - F.col("base")).withColumn("by_round", F.col("q") >= packet)
    first, last = F.ceil((F.col("a") + F.least(F.lit(packet), "n_tokens")) / F.col("q")), F.ceil((F.col("a") + F.col("n_tokens")) / F.col("q"))
    n_parts = F.when(F.col("by_round"), F.greatest(last - first, F.lit(0)) + 1).otherwise(F.ceil(F.col("n_tokens") / packet))
    parts = own.withColumn("first", first).withColumn("n_parts", n_parts.cast("long")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1)))

    def sent(i):  # tokens of the document that have left after its part i
        whole = F.floor(((F.col("first") + i) * F.col("q") - F.col("a")) / packet) * packet
        upto = F.when(F.col("by_round"), F.least(F.greatest(whole, F.lit(0)), "n_tokens")).otherwise(F.least((i + 1) * packet, "n_tokens"))
        return F.when(i < 0, F.lit(0)).when(i >= F.col("n_parts") - 1, F.col("n_tokens")).otherwise(upto).cast("long")

    parts = parts.withColumn("start", sent(F.col("i") - 1)).withColumn("length", sent(F.col("i")) - F.col("start")).where("length > 0")
    leaves = F.when(F.col("by_round"), F.col("first") + F.col("i")).otherwise(F.ceil((F.col("a") + F.col("start") + F.col("length")) / F.col("q")))
    parts = parts.select("row", "copy", "queue", leaves.cast("long").alias("round"), "start", "length", (F.col("a") + F.col("start")).alias("from"))
    stream = ordered_offsets(parts, ["round", "queue", "from"], "length", "g")
    pieces = stream.withColumn("sequence_id", F.explode(F.sequence(F.floor(F.col("g") / window), F.floor((F.col("g") + F.col("length") - 1) / window))))
    lo = F.greatest(F.col("g"), F.col("sequence_id") * window)
    hi = F.least(F.col("g") + F.col("length"), (F.col("sequence_id") + 1) * window)
    return pieces.select("row", "copy", (F.col("start") + lo - F.col("g")).alias("start"), (hi - lo).alias("length"), "sequence_id", (lo - F.col("sequence_id") * window).alias("offset"))


def pack(
    docs: DataFrame,
    path: str | None = None,
    window: int = 2048,
    packet: int = 1,
    weights: dict[str | None, float] | None = None,
    exponent: float = 1.0,
    end_id: int = 1,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    with_ids: bool = False,
    copies: bool = False,
) -> DataFrame:
    """Pieces (id_col, source_col, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    Every row of docs is packed once, rows that share an id included; a null or empty text is its end id
    alone; a null source is a queue of its own. All sequences but the last hold window ids, so only the
    last is padded. weights: by source, of any sum; None: the sources' token counts to the power of exponent (1: a
    source's own share, with which all queues end together). Where a queue runs out before others, the rest share
    the windows that follow. copies: docs repeats documents (same id, source and text); each is encoded
    once and its copies lie apart. ids: the piece's ids, little-endian 32-bit.
    """
    path = path or tokenizer_path()
    width = width_of(path)
    rows = docs.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{source_col}`").alias("s"), F.col(f"`{text_col}`").cast("string").alias("t"))
    if copies:
        marks = [F.xxhash64("t").alias("h"), F.octet_length("t").alias("size")]
        rows = rows.select("k", "s", "t", *marks).groupBy("k", "s", "h", "size").agg(F.first("t").alias("t"), F.count("*").alias("copies")).select("k", "s", "copies", "t")
    else:
        rows = rows.select("k", "s", F.lit(1).cast("long").alias("copies"), "t")
    encoded = encode_documents(rows, path, end_id, "t", ("k", "s", "copies"))
    encoded = materialise(encoded.withColumn("row", F.monotonically_increasing_id()), "pack-ids", BATCH_ROWS)
    plan = plan_pieces(encoded.select("row", "copies", _queue_key("s").alias("queue"), "n_tokens"), window, packet, weights, exponent)
    cuts = plan.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("cuts"))  # those of one document

    def cut(batches):
        for b in small_batches(batches):
            cuts = b.column(4)
            start, length, sequence, offset = (x.to_numpy() for x in cuts.flatten().flatten())
            at = np.repeat(np.arange(len(b)), cuts.value_lengths().to_numpy())
            sums, parts, own, last = [], [], None, -1
            for i, lo, n in zip(at.tolist(), start.tolist(), length.tolist()):
                if i != last:
                    own, last = wide(b.column(2)[i].as_buffer(), width), i
                part = own[lo : lo + n].tobytes()
                sums.append(zlib.crc32(part))
                if with_ids:
                    parts.append(part)
            take = pa.array(at)
            columns = [b.column(0).take(take), b.column(1).take(take), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), b.column(3).take(take), pa.array(sequence), pa.array(offset)]
            names = [id_col, source_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array(parts, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    joined = encoded.join(cuts, "row").select("k", "s", "ids", "n_tokens", "cuts")
    kinds = [docs.schema[c].dataType.simpleString() for c in (id_col, source_col)]
    schema = f"`{id_col}` {kinds[0]}, `{source_col}` {kinds[1]}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return joined.mapInArrow(lean(cut), schema + (", ids binary" if with_ids else ""))


def sequences(pieces: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids): pieces made with_ids put together, padded to window unless the length is a power of two."""
    whole = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n"))  # window ids at most
    gap = F.when(F.expr("n & (n - 1) = 0"), F.lit(0)).otherwise(F.lit(window) - F.col("n"))
    pad = F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), gap.cast("int"))
    joined = F.aggregate(F.transform("p", lambda x: F.hex(x["ids"])), F.lit(""), lambda a, x: F.concat(a, x))
    return whole.select("sequence_id", F.unhex(F.concat(joined, pad)).alias("ids"))


ship_by_value(__name__)
