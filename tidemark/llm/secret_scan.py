"""Secret scans by multipart credential linking, in DataFrame functions only.

Strong patterns are reported wherever they occur. Weak candidates (short secrets, secrets without a
keyword, access identifiers, endpoints) are reported only where complementary parts meet in one scope:
parts are spread over position bins and joined on (row, bin) with an interval condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import materialise

#: The base kinds in their listed order, each with its pattern, the least length and the group it is taken of.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 1),
    ("access", r"""AKIA[A-Z0-9]+""", 16, 0),
    ("hex", r"""[0-9a-f]{32,}""", 32, 0),
)
#: The parts that only count together: kind, role, pattern. Values are shorter than a line, so parts stay local. A name may
#: follow a sign of its own (DB_PASS, db.user, my-key), no letter or digit.
PARTS = (
    ("ident", "identifier", r"""(?i:(?<![A-Za-z0-9])(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""),
    ("weak", "secret", r"""(?i:(?<![A-Za-z0-9])(?:pass|pwd|pw|auth|key|credential))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}"""),
    ("opaque", "secret", r"""(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]{0,39}[0-9])(?=[A-Z0-9+/_-]{0,39}[a-z])(?=[a-z0-9+/_-]{0,39}[A-Z])[A-Za-z0-9+/_-]{40}(?![A-Za-z0-9+/_-])"""),
    ("endpoint", "endpoint", r"""(?i:(?<![A-Za-z0-9])(?:https?|jdbc:[a-z]{2,12}|postgres(?:ql)?|mysql|redis|amqp|mongodb|ftp|ssh)://)[A-Za-z0-9._~:@%/?#=&+-]{4,}"""),
)
#: What every match of a kind contains: most texts are told from these at once.
LITERALS = {"access": "AKIA", "endpoint": "://"}
KINDS = tuple(k for k, *_ in BASE) + tuple(k for k, *_ in PARTS)


def _hits(text: str, kind: str, pattern: str, group: int) -> Column:
    """The pattern's leftmost non-overlapping matches: the text between them has the pieces of a split."""
    rx = F.lit(pattern)
    whole = F.regexp_extract_all(text, rx, F.lit(0))
    part = F.regexp_extract_all(text, rx, F.lit(group)) if group else whole
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    zipped = F.arrays_zip(gaps.alias("gap"), F.transform(whole, F.length).alias("size"), F.transform(part, F.length).alias("value"))
    hits = F.transform(
        zipped,
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["size"].alias("size"), x["value"].alias("value")),
    )
    seen = F.col(text).rlike(pattern)
    if kind in LITERALS:
        seen = F.col(text).contains(LITERALS[kind]) & seen
    return F.when(seen, F.filter(hits, lambda x: x["size"].isNotNull())).otherwise(F.array().cast("array<struct<kind:string,i:int,gap:int,size:int,value:int>>"))


def find_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id_col, kind, start, end): every candidate, positions in code points; a row without any has one with kind null."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    found = F.flatten(F.array(*[_hits("_text", k, rx, g) for k, rx, _, g in BASE], *[_hits("_text", k, rx, 0) for k, _, rx in PARTS]))
    hits = materialise(rows.select("row", id_col, F.explode_outer(found).alias("h")).select("row", id_col, "h.*"), "secret-hits")
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = hits.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before)).withColumn("start", F.col("end") - F.col("size"))
    short = F.lit(False)
    for kind, _, least, _ in BASE:
        short = short | ((F.col("kind") == kind) & (F.col("value") < least))
    blank = F.coalesce(short, F.lit(False))
    return hits.select("row", id_col, *[F.when(~blank, F.col(c)).alias(c) for c in ("kind", "start", "end")])


def link_parts(parts: DataFrame, scope: int = 200) -> DataFrame:
    """(row, kind, start, end): the weak candidates with a part of another role within scope code points.

    A weak secret needs an identifier or an endpoint; an identifier or an endpoint needs a secret of either
    kind, a strong one included. Each part goes to the bins its span touches, widened by scope on one side;
    a bin holds no more parts than fit into scope code points of one text, so no join grows with a group.
    """
    role = F.create_map(*[F.lit(x) for k, r, _ in PARTS for x in (k, r)], *[F.lit(x) for k, r in (("assign", "secret"), ("access", "identifier"), ("hex", "secret")) for x in (k, r)])
    spans = parts.where("kind is not null").select("row", "kind", "start", "end", role[F.col("kind")].alias("role"))
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / scope), F.floor(hi / scope)))
    weak = spans.where(F.col("kind").isin([k for k, *_ in PARTS])).withColumn("bin", bins(F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope))
    other = spans.select(F.col("row").alias("row_"), F.col("role").alias("role_"), F.col("start").alias("start_"), F.col("end").alias("end_")).withColumn("bin_", bins(F.col("start_"), F.col("end_")))
    near = (F.col("start_") <= F.col("end") + scope) & (F.col("end_") >= F.col("start") - scope)
    apart = (F.col("end_") <= F.col("start")) | (F.col("start_") >= F.col("end"))
    complement = ((F.col("role") == "secret") & (F.col("role_") != "secret")) | ((F.col("role") != "secret") & (F.col("role_") == "secret"))
    linked = weak.join(other, (F.col("row") == F.col("row_")) & (F.col("bin") == F.col("bin_")) & near & apart & complement, "left_semi")
    return linked.select("row", "kind", "start", "end").distinct()


def scan_secrets(docs: DataFrame, scope: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id_col, spans): one row for each input row; spans: array of (start, rank, kind, end), sorted.

    Whole texts; null and empty ones have no spans. Rows that share an id are told apart by row. Base kinds
    keep every match; the parts' kinds appear only where linked. Other columns of docs play no part.
    """
    parts = materialise(find_parts(docs, id_col, text_col), "secret-parts")
    strong = parts.where(F.col("kind").isNull() | F.col("kind").isin([k for k, *_ in BASE])).select("row", "kind", "start", "end")
    owners = parts.select("row", id_col).distinct()
    spans = strong.unionByName(link_parts(parts, scope)).withColumn("rank", F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int"))
    span = F.when(F.col("kind").isNotNull(), F.struct("start", "rank", "kind", "end"))
    listed = spans.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))  # the spans of one text
    joined = owners.join(listed, "row", "left")
    return joined.select("row", id_col, F.coalesce("spans", F.array().cast(listed.schema["spans"].dataType)).alias("spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, mask: str = "*", scope: int = 200, text_col: str = "text") -> DataFrame:
    """docs with every reported span replaced by mask characters; all rows and columns stay, also where ids repeat or are null."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.monotonically_increasing_id().alias("n"))
    held = materialise(whole, "redact-docs").withColumn("t", F.coalesce(F.col(f"d.`{text_col}`").cast("string"), F.lit("")))
    found = scan_secrets(held.select("n", "t"), scope, "n", "t").where("size(spans) > 0").select(F.col("n").alias("m"), "spans")
    masked = F.aggregate(
        F.col("spans"),
        F.col("t"),
        lambda t, x: F.concat(F.substr(t, F.lit(1), x["start"].cast("int")), F.repeat(F.lit(mask), (x["end"] - x["start"]).cast("int")), F.substr(t, (x["end"] + 1).cast("int"))),
    )
    text = F.when(F.col("m").isNotNull(), masked.cast(docs.schema[text_col].dataType)).otherwise(F.col(f"d.`{text_col}`"))
    joined = held.join(found, F.col("n") == F.col("m"), "left")
    return joined.select(*[(text if c == text_col else F.col(f"d.`{c}`")).alias(c) for c in docs.columns])
