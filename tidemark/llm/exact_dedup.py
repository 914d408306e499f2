"""Exact duplicates by 128-bit content hash, with the bytes compared inside every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise


def exact_duplicates(
    docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", digest: Column | None = None, broadcast_rows: int = 200_000
) -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256): one row for each input row.

    Texts are compared as they are; null counts as empty. Of equal texts the row with the smallest (or
    "largest") id stays; rows that repeat that id with the same text are all marked kept (drop_duplicates
    keeps one). A null id stays only where its group has no other. digest is the 128-bit hash by which
    rows are grouped (md5 unless given).

    Groups of two or more have their least and greatest text compared byte by byte, pre-aggregated on the
    map side; a hash under which these differ is grouped by the text itself instead. The repeated hashes
    are broadcast only where their counted number is at most broadcast_rows; else they are joined.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashed = docs.select(F.col(id_col), text.alias("_text")).withColumn("_h", F.unhex(F.md5("_text")) if digest is None else digest)
    chosen = F.min if keep == "smallest" else F.max
    groups = materialise(hashed.groupBy("_h").agg(F.count("*").alias("group_size"), chosen(id_col).alias("keep_id")), "exact-groups")
    repeated = groups.where("group_size > 1").select("_h")
    n = repeated.count()
    repeated = F.broadcast(repeated) if n <= broadcast_rows else repeated
    compared = hashed.join(repeated, "_h", "left_semi").groupBy("_h").agg(F.min("_text").alias("lo"), F.max("_text").alias("hi"))
    mixed = materialise(compared.where("lo <> hi").select("_h"), "exact-mixed")
    rows = hashed.select(id_col, "_h", F.sha2("_text", 256).alias("text_sha256"))
    flag = F.col("kept_flag")
    if mixed.isEmpty():
        joined = rows.join(groups, "_h")
    else:
        clean = rows.join(mixed, "_h", "left_anti").join(groups, "_h").drop("_h")
        apart = hashed.join(mixed, "_h", "left_semi").withColumn("text_sha256", F.sha2("_text", 256))
        sums = apart.groupBy("_text").agg(F.count("*").alias("group_size"), chosen(id_col).alias("keep_id"))
        joined = clean.unionByName(apart.join(sums, "_text").select(*clean.columns))
    joined = joined.withColumn("kept_flag", F.col(id_col).eqNullSafe(F.col("keep_id")))
    return joined.select(id_col, "keep_id", F.col("group_size").cast("long").alias("group_size"), flag.alias("kept"), "text_sha256")


def drop_duplicates(
    docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 200_000
) -> DataFrame:
    """The rows of docs that stay, all their columns; of rows with the same id and text one stays."""
    marked = materialise(exact_duplicates(docs, keep, id_col, text_col, broadcast_rows=broadcast_rows), "exact-marks")
    sha = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    gone = marked.where("not kept").select(F.col(id_col).alias("id_"), F.col("text_sha256").alias("sha_")).distinct()
    gone = F.broadcast(gone) if marked.where("not kept").count() <= broadcast_rows else gone
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col(f"`{id_col}`").alias("k"), sha.alias("sha"))
    left = rows.join(gone, F.col("k").eqNullSafe(F.col("id_")) & (F.col("sha") == F.col("sha_")), "left_anti")
    again = marked.where("kept").groupBy(id_col, "text_sha256").count().where("count > 1")
    if not again.isEmpty():
        left = left.dropDuplicates(["k", "sha"])
    return left.select("d.*")
