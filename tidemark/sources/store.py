"""Parquet tables with keyed merges, checked and then replaced by one rename; copies, verification and digests."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.parsing import nearly_equal
from tidemark.operators import quality
from tidemark.operators.relational import fast_digest, unique
from tidemark.schemas import TABLES, Table, assert_columns, empty

Resolver = dict[str, Callable[[Column, Column], Column]]


#: Beside the tables of a folder: which directories each one consists of now, and consisted of before.
POINTERS = "_tables.json"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _split(path: str) -> tuple[str, str]:
    root, _, name = path.rstrip("/").rpartition("/")
    return root, name


def pointers(spark: SparkSession, root: str) -> dict:
    return _get_json(spark, f"{root}/{POINTERS}") or {"tables": {}, "before": {}}


def _put_json(spark: SparkSession, path: str, value: dict) -> None:
    """Write the file beside its place, then rename it over what is there."""
    p, fs = _path(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(p)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark._sc._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    files.rename(p, _path(spark, path)[0], options)


def _get_json(spark: SparkSession, path: str) -> dict | None:
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def publish(spark: SparkSession, root: str, changed: dict[str, dict[str, str]]) -> None:
    """Point the tables at new directories, all of them by one rename; what neither this nor the former state uses goes.

    One writer at a time; readers of the former state keep their files until the publication after this one.
    """
    old = pointers(spark, root)
    new = {"tables": old["tables"] | changed, "before": old["tables"]}
    _put_json(spark, f"{root}/{POINTERS}", new)
    fs = _path(spark, root)[1]
    used = {d for state in (new["tables"], new["before"]) for dirs in state.values() for d in dirs.values()}
    for dirs in old["before"].values():
        for d in set(dirs.values()) - used:
            fs.delete(_path(spark, f"{root}/{d}")[0], True)


def delete_folder(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    root, name = _split(path)
    p, fs = _path(spark, path)
    return name in pointers(spark, root)["tables"] or fs.exists(p)


def bucket_of(key: tuple[str, ...] | list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _written(df: DataFrame, root: str, name: str, key: tuple[str, ...] = (), buckets: int = 1) -> dict[str, str]:
    """Directories by bucket ("" for a table of one piece)."""
    new = f"{name}.{uuid.uuid4().hex}"
    if buckets == 1:
        df.write.parquet(f"{root}/{new}")
        return {"": new}
    df.withColumn("_b", bucket_of(key, buckets)).repartition(buckets, "_b").write.partitionBy("_b").parquet(f"{root}/{new}")
    p, fs = _path(df.sparkSession, f"{root}/{new}")
    found = [x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()]
    return {f"{buckets}/{d.removeprefix('_b=')}": f"{new}/{d}" for d in found}


def _pieces(spark: SparkSession, root: str, table: Table, dirs: dict[str, str]) -> DataFrame:
    return spark.read.schema(table.schema).parquet(*[f"{root}/{d}" for d in dirs.values()]) if dirs else empty(spark, table.schema)


def _enforce(spark: SparkSession, root: str, written: dict[str, tuple[Table, dict[str, str]]], whole: bool) -> None:
    """QualityError, and the written directories go, where they break a rule of their table: keys, nulls, references and
    checks. Only what was written is checked. whole: the tables are replaced, so keys may be gone that others refer to."""
    new = {name: _pieces(spark, root, t, dirs) for name, (t, dirs) in written.items()}
    now = {t.name: new[t.name] if whole and t.name in new else union_all([load(spark, f"{root}/{t.name}", t), *([new[t.name]] if t.name in new else [])]) for t in TABLES}
    found = [quality.table_issues(t, new[name], now) for name, (t, _) in written.items()]
    if whole:
        left = [t for t in TABLES if t.name not in written and any(r[1] in written for r in t.references) and exists(spark, f"{root}/{t.name}")]
        found += [quality.dangling(t, now[t.name], now) for t in left]
    broken = {r["check"]: r["n"] for r in union_all(found).collect()}  # one row for each rule
    if broken:
        fs = _path(spark, root)[1]
        for _, dirs in written.values():
            for d in {d.partition("/")[0] for d in dirs.values()}:
                fs.delete(_path(spark, f"{root}/{d}")[0], True)
        raise quality.QualityError(", ".join(f"{c}: {n}" for c, n in sorted(broken.items())))


def replace(df: DataFrame, path: str, table: Table | None = None) -> None:
    """Write a new directory, then point the table at it: readers see the old table or the new one, whole. With the
    table's contract its rules are tested in between, and a broken one leaves the old state."""
    root, name = _split(path)
    dirs = _written(df, root, name)
    if table:
        _enforce(df.sparkSession, root, {name: (table, dirs)}, whole=True)
    publish(df.sparkSession, root, {name: dirs})


def replace_all(spark: SparkSession, root: str, tables: dict[str, DataFrame], contracts: dict[str, Table] | None = None) -> None:
    """Replace several tables of a folder at once: all of them or, after any failure or broken rule of contracts, none."""
    dirs = {name: _written(df, root, name) for name, df in tables.items()}
    if contracts:
        _enforce(spark, root, {name: (contracts[name], dirs[name]) for name in tables if name in contracts}, whole=True)
    publish(spark, root, dirs)


def load(spark: SparkSession, path: str, table: Table | None = None, must_exist: bool = False, only: list[int] | None = None) -> DataFrame:
    """only: of a table in buckets, these alone."""
    if not exists(spark, path):
        if must_exist or not table:
            raise FileNotFoundError(path)
        return empty(spark, table.schema)
    root, name = _split(path)
    dirs = pointers(spark, root)["tables"].get(name)
    if only is not None and dirs:
        dirs = {k: d for k, d in dirs.items() if k.rpartition("/")[2] in {str(b) for b in only}}
        if not dirs:
            return empty(spark, table.schema)
    paths = [path] if dirs is None else [f"{root}/{d}" for d in dirs.values()]
    reader = spark.read.schema(table.schema) if table else spark.read
    return reader.parquet(*paths) if paths else empty(spark, table.schema)


def merge(old: DataFrame, new: DataFrame, key: list[str], resolve: Resolver | None = None, update: bool = True) -> DataFrame:
    """old with the rows of new put in by key: new values win, or resolve[column](old, new) of rows in both; update False keeps old rows."""
    columns = old.columns
    unique(assert_columns(new, columns, "new rows"), key, "new rows")
    a = old.select(F.struct(*columns).alias("a"), *[F.col(k).alias(k) for k in key])
    b = new.select(F.struct(*[F.col(c).cast(old.schema[c].dataType).alias(c) for c in columns]).alias("b"), *key)
    joined = a.join(b, key, "full_outer")

    def pick(c: str) -> Column:
        o, n = F.col(f"a.{c}"), F.col(f"b.{c}")
        both = (resolve or {}).get(c, lambda x, y: y if update else x)(o, n)
        return F.when(F.col("b").isNull(), o).when(F.col("a").isNull(), n).otherwise(both).alias(c)

    return joined.select(*[pick(c) for c in columns])


def coerced(rows: DataFrame, table: Table) -> DataFrame:
    """The table's columns in its types: NaN becomes null, and so does a blank text where the table has another type."""
    kinds = dict(rows.dtypes)

    def typed(name: str, kind) -> Column:
        value = F.col(name)
        if kinds[name] in ("double", "float"):
            value = F.when(~F.isnan(value), value)
        elif kinds[name] == "string" and kind.typeName() != "string":
            value = F.when(F.trim(value) != "", F.trim(value))
        return value.cast(kind).alias(name)

    return rows.select(*[typed(f.name, f.dataType) for f in table.schema.fields])


#: A player's seasons only widen; the name changes only with data that is not older.
PLAYER_RESOLVER: Resolver = {
    "first_season": lambda o, n: F.least(o, n),
    "last_season": lambda o, n: F.greatest(o, n),
    "name": lambda o, n: F.when(F.col("b.last_season") >= F.col("a.last_season"), n).otherwise(o),
}


def upsert(spark: SparkSession, path: str, table: Table, new: DataFrame, resolve: Resolver | None = None, update: bool = True, buckets: int = 1, enforce: bool = True) -> None:
    """Merge new into the table. buckets: a table made so keeps that many pieces, and only those with a key of new are read and
    written. The table's rules are tested on the pieces written, before the pointer moves."""
    root, name = _split(path)
    dirs = pointers(spark, root)["tables"].get(name) or {}
    made = next((int(k.partition("/")[0]) for k in dirs if k), buckets if not dirs else 1)
    assert_columns(new, table.schema.names, "new rows")
    typed = coerced(new, table)
    if made == 1:
        pieces, kept = _written(merge(load(spark, path, table), typed, list(table.key), resolve, update), root, name), {}
    else:
        touched = [r[0] for r in typed.select(bucket_of(table.key, made).alias("b")).distinct().collect()]  # as many as buckets at most
        merged = merge(load(spark, path, table, only=touched) if dirs else empty(spark, table.schema), typed, list(table.key), resolve, update)
        pieces, kept = _written(merged, root, name, table.key, made), dirs
    if enforce:
        _enforce(spark, root, {name: (table, pieces)}, whole=False)
    publish(spark, root, {name: kept | pieces})


def delete_keys(spark: SparkSession, path: str, table: Table, keys: DataFrame) -> None:
    """Rows of other tables must not refer to what goes."""
    replace(load(spark, path, table).join(keys, list(table.key), "left_anti"), path, table)


def replace_groups(old: DataFrame, new: DataFrame, group: list[str]) -> DataFrame:
    """Append new after dropping old rows whose group is in it."""
    return old.join(new.select(*group).distinct(), group, "left_anti").unionByName(new)


#: Beside copied tables: the pieces of the source that are in already.
LEDGER = "_copied.json"


def copy_tables(spark: SparkSession, source: str, target: str, tables: tuple[Table, ...], dry_run: bool = False) -> dict[str, int | None]:
    """Merge each source table into the target in the given (reference-safe) order; None: missing in the source.

    A table in buckets goes piece by piece, and a ledger in the target tells which are in: a copy that broke off goes on
    with the next piece. Pieces have names of their own, so one that changed meanwhile is copied again. The ledger goes
    when all is done.
    """
    counted: dict[str, int | None] = {}
    done = {} if dry_run else _get_json(spark, f"{target}/{LEDGER}") or {}
    for t in tables:
        path = f"{source}/{t.name}"
        if not exists(spark, path):
            counted[t.name] = None
            continue
        dirs = pointers(spark, source)["tables"].get(t.name) or {"": t.name}
        counted[t.name], buckets = 0, next((int(k.partition("/")[0]) for k in dirs if k), 1)
        for key, d in sorted(dirs.items()):
            if f"{t.name}/{d}" not in done:
                rows = _pieces(spark, source, t, {key: d})
                n = rows.count()
                if dry_run:
                    counted[t.name] += n
                    continue
                if n:
                    upsert(spark, f"{target}/{t.name}", t, rows, buckets=buckets)
                done[f"{t.name}/{d}"] = n
                _put_json(spark, f"{target}/{LEDGER}", done)
            counted[t.name] += done[f"{t.name}/{d}"]
    if not dry_run:
        p, fs = _path(spark, f"{target}/{LEDGER}")
        fs.delete(p, False)
    return counted


def metrics(df: DataFrame, table: Table) -> DataFrame:
    """(metric, number, text): rows and a digest as text; sum, least and greatest of numeric columns as numbers.

    A sum of doubles hangs on the order of its terms, so numbers are there to be compared by nearly_equal; whole numbers
    are summed as decimals. The digest takes doubles to 9 places, so what differs in the last bits alone is the same.
    """
    kinds = {f.name: f.dataType.typeName() for f in table.schema.fields}
    numeric = [c for c, k in kinds.items() if k in ("integer", "long", "double")]
    exact = lambda c: F.col(c) if kinds[c] == "double" else F.col(c).cast("decimal(38,0)")
    one = df.agg(F.count("*").cast("string").alias("rows"), *[f(exact(c)).cast("double").alias(f"{n} {c}") for c in numeric for n, f in (("sum", F.sum), ("min", F.min), ("max", F.max))])
    names = [f"{n} {c}" for c in numeric for n in ("sum", "min", "max")]
    none = F.lit(None)
    listed = F.array(F.struct(F.lit("rows").alias("metric"), none.cast("double").alias("number"), F.col("rows").alias("text")), *[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("number"), none.cast("string").alias("text")) for n in names])
    rounded = df.select(*[F.round(c, 9).alias(c) if k == "double" else F.col(c) for c, k in kinds.items()])
    digest = fast_digest(rounded, list(kinds)).select(F.lit("digest").alias("metric"), none.cast("double").alias("number"), F.col("digest").alias("text"))
    return one.select(F.explode(listed).alias("m")).select("m.*").unionByName(digest)


def verify(source: DataFrame, target: DataFrame, table: Table) -> DataFrame:
    """(metric, source, target): the metrics in which the two differ, whatever the order or layout of their rows."""
    a, b = (metrics(df, table).select("metric", F.col("number").alias(f"{side}_n"), F.col("text").alias(f"{side}_t")) for df, side in ((source, "a"), (target, "b")))
    same = F.col("a_t").eqNullSafe(F.col("b_t")) & nearly_equal("a_n", "b_n")
    told = lambda side: F.coalesce(f"{side}_t", F.col(f"{side}_n").cast("string"))
    return a.join(b, "metric", "full_outer").where(~same).select("metric", told("a").alias("source"), told("b").alias("target"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
