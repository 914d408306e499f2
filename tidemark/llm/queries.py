"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import context_mixing, conversation_trie, exact_dedup, html_text, language_id, order_minhash, packing, secret_scan, simhash, source_mixing, spelling_variants, substring_dedup, token_store
from tidemark.llm.common import documents, fold


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), width=3, radius=2)


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("train", ~context_mixing.held_out())
    found = context_mixing.score_documents(docs)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), *found.columns[2:])


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets: the sources' token counts to the power of 0.7, so that small sources come early and often."""
    return packing.pack(documents(spark, sf_dir), window=2048, exponent=0.7)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.train(language_id.training_rows(docs))
    found = language_id.identify(docs, model)
    return found.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_store(spark, token_store.write_store(documents(spark, sf_dir)))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir), keep="largest")


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare_with_edits(documents(spark, sf_dir))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares that come nearer to equal ones: 0.999 of their entropy, or as near as using no token over twice allows."""
    docs = documents(spark, sf_dir)
    mixture = source_mixing.solve(source_mixing.token_shares(docs), target_entropy=0.999, max_repetition=2.0)
    return source_mixing.draw(docs, mixture).drop("row")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(documents(spark, sf_dir)).drop("row")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(documents(spark, sf_dir))
    base = [k for k, *_ in secret_scan.BASE]
    counts = [F.expr(f"size(filter(spans, x -> x.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in base]
    listed = secret_scan.span_text(F.filter("spans", lambda x: x["kind"].isin(base)))
    return found.select("doc_id", *counts, F.sha2(listed, 256).alias("base_sha256"), secret_scan.span_text(F.col("spans")).alias("spans"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(documents(spark, sf_dir), delete_one_in=31)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_tree(spark.read.parquet(f"{sf_dir}/conversations.parquet"), splice=20, variants=4)


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), html_text.train_tree(spark))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of op7: sizes and edited texts, which rest on the order of all documents."""
    return op7_order_minhash(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of op10: counts and places of the base kinds."""
    return op10_secret_scan(spark, sf_dir).drop("spans")


def _base_sql() -> str:
    """Places of matches: the lengths of the pieces between them and of the matches before."""
    parts = []
    for rank, (kind, pattern, least, group) in enumerate(secret_scan.BASE):
        rx = "'" + pattern.replace("'", "''") + "'"
        parts.append(f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, unnest(range(len(m))) AS i, m, v, g, {least} AS least
            FROM (SELECT doc_id, regexp_extract_all(t, {rx}) AS m, regexp_extract_all(t, {rx}, {group}) AS v, string_split_regex(t, {rx}) AS g FROM d)""")
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), hits AS ({' UNION ALL '.join(parts)}),
        placed AS (SELECT doc_id, kind, rank, list_sum(list_transform(g[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0) AS s, length(m[i + 1]) AS n FROM hits WHERE length(v[i + 1]) >= least),
        told AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s + n AS BIGINT) AS VARCHAR), ',' ORDER BY s, rank) AS spans FROM placed GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN told ON d.doc_id = told.doc_id"""


#: crc32 of a list of bytes, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes}), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

_SPELLING = f"""WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS raw FROM documents),
    each AS (SELECT id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs WHERE length(raw) >= 7 GROUP BY 1, 2),
    hashed AS (SELECT run, n, {_CRC.format(bytes="flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END))")} AS h FROM each),
    words AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
    spots AS (SELECT word, n, unnest(range(-1, length(word))) AS i FROM words),
    cuts AS (SELECT word, n, i, CASE WHEN i < 0 THEN word ELSE left(word, i) || substr(word, i + 2) END AS cut FROM spots),
    near AS (SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.word <> b.word AND (a.i = b.i OR least(a.i, b.i) < 0)),
    best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
    told AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN other END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
    climb AS (SELECT word, word AS reached, form AS after FROM told UNION ALL SELECT c.word, t.word, t.form FROM climb c JOIN told t ON c.after = t.word)
    SELECT t.word, form, reached AS root, n, n_near, form_n FROM told t JOIN climb c ON t.word = c.word AND c.after IS NULL"""

#: The distinct sequences themselves as keys.
_TRIE = f"""WITH t AS (SELECT CAST(conv_id AS BIGINT) AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT c, r, x, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(length(r) || ':' || r || x)) - 1 AS i FROM t),
    ids AS (SELECT DISTINCT c, {_CRC.format(bytes="list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: ord(ch)::BIGINT)")} % 4 AS h FROM t),
    spliced AS (SELECT ids.c, 0 AS part, own.* EXCLUDE (c) FROM ids JOIN own ON own.c = ids.c - ids.c % 20 AND i < h UNION ALL SELECT ids.c, 1, own.* EXCLUDE (c) FROM ids JOIN own ON own.c = ids.c AND i >= h),
    convs AS (SELECT ids.c, coalesce(list({{'r': r, 'x': x}} ORDER BY part, i) FILTER (r IS NOT NULL), []) AS s FROM ids LEFT JOIN spliced ON ids.c = spliced.c GROUP BY ids.c),
    members AS (SELECT c, s AS whole, unnest(range(len(s) + 1)) AS depth FROM convs),
    nodes AS (SELECT depth, whole[1:depth] AS p, min(c) AS conv_id, count(*) AS n_convs, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(whole) = depth) AS ends FROM members GROUP BY 1, 2),
    told AS (SELECT n.*, (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(p[depth].x, '[^\\x20\\x09-\\x0D]+')) END AS saved, (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.p[1:n.depth] = n.p) AS n_children FROM nodes n),
    above AS (SELECT p[1:k] AS p, k AS depth, saved, n_children FROM (SELECT *, unnest(range(depth + 1)) AS k FROM told)),
    sums AS (SELECT p, depth, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM above GROUP BY 1, 2)
    SELECT t.conv_id, t.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, t.n_convs, t.n_children, n_leaves, saved_tokens, sha256(coalesce(t.ends, '')) AS ends_sha256
    FROM told t JOIN sums s ON t.depth = s.depth AND t.p = s.p LEFT JOIN nodes up ON up.depth = t.depth - 1 AND up.p = t.p[1:t.depth - 1]"""

#: What the given pages show: each holds its main text in one article. The operator does not look for that element alone.
_PAGES = r"""WITH cut AS (SELECT page_id, url, coalesce(regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1), '') AS inner_html FROM pages),
    parts AS (SELECT page_id, url, list_transform(string_split_regex(inner_html, '</?(p|h1)>'), lambda b: regexp_replace(b, '<[^>]*>', ' ', 'g')) AS blocks FROM cut),
    plain AS (SELECT page_id, url, list_transform(blocks, lambda b: regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '&quot;?', '"', 'g'), '&#x27;', chr(39), 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g')) AS blocks FROM parts),
    told AS (SELECT page_id, url, array_to_string(list_filter(list_transform(blocks, lambda b: trim(regexp_replace(b, '\s+', ' ', 'g'))), lambda b: b <> ''), chr(10)) AS text FROM plain)
    SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM told"""

SQL = {
    "edited_texts": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents), o AS (SELECT *, coalesce(lead(t) OVER w, first_value(t) OVER w) AS after FROM d WINDOW w AS (ORDER BY doc_id))
        SELECT doc_id, n AS n_chars, sha256(left(t, n - n // 2) || left(after, n // 2)) AS edited_sha256 FROM o""",
    "base_secrets": _base_sql(),
    "op11_spelling_variants": _SPELLING,
    "op12_conversation_trie": _TRIE,
    "op13_html_text": _PAGES,
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") or name in SQL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
