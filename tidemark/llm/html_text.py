"""Main text of web pages: flat text blocks judged by a decision tree on word counts, link density and their neighbours'."""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import scratch_path, ship_by_value

# What HTML's elements mean here.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = set("article aside blockquote button details dialog div dl fieldset figure footer form header main menu nav ol section select span table td ul".split())
RAW = set("script style title textarea iframe xmp noembed noframes".split())
UNSEEN = set("head noscript template svg math canvas object audio video map datalist option".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
APART = set("aside button dialog fieldset footer form menu nav select".split())
ARTICLE, NAMED_SO, APART_FROM, NEVER = 2, 1, -1, -2
ROLES = {"main": ARTICLE, "article": ARTICLE} | dict.fromkeys(("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"), APART_FROM)
OUTSIDE = set("ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disclaimer discussion disqus footer gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promoted recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget".split())
REPLIES = set("comment comments discussion disqus replies reply respond".split())
INSIDE = set("article content entry main post story".split())
NEUTRAL = set("has no with without".split())
#: What an article has parts of its own of: its head, its author's line, its terms.
OWN = set("byline bylines copyright disclaimer header legal tags".split())

#: The labelled table, by page: what a block is (t heading, p paragraph, i list item, d other), where it stands (+ in an
#: element named as the article, - in one named as menu, advert, notice and so on, . in neither), words, linked words,
#: 1 for main text. Labelled by hand; the ways pages are built differ on purpose.
LABELLED = """
i-1,1,0 i-1,1,0 i-2,2,0 d-9,0,0 t+8,0,1 p+45,0,1 p+80,2,1 p+2,0,1 p+60,0,1 d-8,1,0
i-3,3,0 i-1,1,0 p-25,0,0 t+3,0,1 p+1,0,1 p+12,0,1 p+3,0,1 d-40,0,0 d-6,0,0
d-4,4,0 d-12,12,0 t+14,0,1 p+4,0,1 p+30,30,1 i+6,0,1 i+9,9,1 i+2,0,1 p+120,1,1 p-15,0,0 p-70,0,0 d-11,2,0
i.1,1,0 i.2,2,0 i.1,1,0 t.9,0,1 p.55,0,1 p.70,3,1 p.8,0,1 p.90,0,1 i.4,4,0 i.6,6,0 d.7,1,0
i.2,2,0 i.2,2,0 t.6,0,1 d.40,0,1 d.65,4,1 d.30,0,1 i.5,5,0 i.7,7,0 i.6,6,0 d.5,0,0 d.4,4,0
d.3,3,0 d.2,0,0 t.11,0,1 p.35,0,1 i.12,0,1 i.15,1,1 i.9,0,1 p.48,0,1 d.3,3,0 d.2,2,0 d.6,0,0
t.12,0,1 p.150,0,1 p.95,2,1 p.3,0,1 p.44,0,1
p.200,0,1
p+7,0,1
t+5,0,1
p+16,16,1
d+150,4,1
d.4,4,0 p.60,0,1 d.3,3,0
d.1,1,0 d.1,1,0 d.1,1,0 d.1,1,0
t.2,0,0 i.3,3,0 i.5,5,0 t.2,0,0 i.4,4,0 i.6,6,0
p-50,0,0 p-90,3,0 t-4,0,0 d-2,2,0
t-3,0,0 i-8,8,0 i-7,7,0 t+10,0,1 p+22,0,1 t+4,0,1 p+140,6,1 t+3,0,1 i+11,0,1 i+5,0,1 d+9,9,1 t-1,0,0 p-33,0,0 p-41,0,0
d.5,5,0 t.7,0,1 p.28,0,1 p.14,0,1 p.51,0,1 p-30,0,0 p-18,0,0 d.9,0,0
i.2,2,0 t.8,0,1 p.60,12,1 p.3,0,1 p.45,9,1 p.2,0,1 p.70,14,1 p.6,0,1 p.33,0,1 p.4,0,1 d.6,0,0 d.8,2,0
d.2,0,0 d.3,3,0 t.6,0,1 d.90,15,1 d.4,0,1 d.75,0,1 d.12,12,0 d.9,9,0 d.10,4,0
i-1,1,0 d-6,0,0 t+1,0,1 p+1,0,1 d-7,0,0
d-9,0,0 t+2,0,1 p+30,0,1 t+1,0,1 p+9,0,1 t+2,2,1 d+3,0,1 p+2,2,1 i+1,1,1 i+2,0,1 d-4,0,0
t+2,0,1 i+5,5,1 t+3,0,1 d+6,6,1 p+8,3,1
i.1,1,0 t.5,0,1 p.5,0,1 p.40,0,1 i.4,0,1 i.3,0,1 i.6,1,1 p.50,0,1 i.2,2,0 i.3,3,0 p.7,3,0
"""
#: What the tree sees of a block and its neighbours.
FEATURES = ("where", "kind", "words", "density", "words_before", "density_before", "words_after", "density_after", "where_before", "where_after")
DEPTH = 8

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))", re.S)
NAMED = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
HUMP = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
KINDS = {"t": 0, "p": 1, "i": 2, "d": 3}


def place(tag: str, attributes: str, inside: bool) -> int | None:
    """What the element says of the text in it: ARTICLE by its tag, NAMED_SO by its name, 0 nothing, APART_FROM it, NEVER
    (readers' comments, asides, footers), None if it is not shown. inside: it stands in an article."""
    said = ARTICLE if tag in ("article", "main") else NEVER if tag in ("aside", "footer") else APART_FROM if tag in APART or (tag == "header" and not inside) else 0
    words: set[str] = set()
    for name, *values in NAMED.findall(attributes) if "=" in attributes or "hidden" in attributes else ():
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return None
        if name == "role":
            said = said or ROLES.get(value.strip().lower(), 0)
        elif name in ("class", "id"):
            words.update(w.lower() for w in HUMP.findall(value))
    if words & REPLIES and not words & NEUTRAL:
        return NEVER
    if said:
        return said
    if words & OUTSIDE and not words & NEUTRAL:
        return 0 if inside and words & OUTSIDE <= OWN else APART_FROM
    return NAMED_SO if words & INSIDE else 0


def side(stack: list[tuple[str, int | None]]) -> int:
    """1 in the article, -1 apart from it, 0 in neither, by the open elements from the outermost in: an article's tag
    outdoes a menu or advert around it that was left open, a mere name does not."""
    said = 0
    for _, s in stack:
        if s == NEVER:
            return -1
        if s == APART_FROM:
            said = -1
        elif s == ARTICLE or (s == NAMED_SO and not said):
            said = 1
    return said


def blocks(html: str) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, where, words, linked words) of the page's blocks that have text, in order.

    Any block element's start or end ends a block; a line break is white space. Unclosed elements end with what holds
    them; an article ends unclosed menus and adverts before it. Scripts, styles, comments and what is hidden are no text.
    A page that is cut off in a tag ends before it.
    """
    out: list[tuple[str, str, int, int, int]] = []
    held: list[tuple[str, bool]] = []
    stack: list[tuple[str, int | None]] = []  # open containers and what they say
    at, links, kind, unseen, where, veiled = 0, 0, "d", 0, 0, False

    def close() -> None:
        if held:
            text = " ".join("".join([t for t, _ in held]).split())
            if text:
                words = text.count(" ") + 1
                linked = words if all(a or t.isspace() for t, a in held) else sum(len(t.split()) for t, a in held if a)
                out.append((text, kind, where, words, min(linked, words)))
            held.clear()

    for found in TAG.finditer(html):
        if found.start() < at:
            continue
        if found.start() > at and not (unseen or veiled):
            held.append((unescape(html[at : found.start()]), links > 0))
        at, tag = found.end(), (found[2] or "").lower()
        if not tag:
            continue
        if not html.endswith(">", at - 1, at):
            break  # cut off inside a tag
        ends = found[1] == "/"
        if tag in RAW:
            if not ends:
                stop = re.compile(rf"</{tag}\b[^>]*+>?", re.I).search(html, at)
                at = stop.end() if stop else len(html)
            continue
        if tag == "a":
            links = 0 if ends else int("href" in found[3].lower())
            continue
        if tag in BLOCKS:
            close()
            links = 0
            veiled = not ends and tag not in CONTAINERS and place(tag, found[3], where > 0) is None
            if stack and stack[-1][0] == "head":  # its end may be left out
                stack.pop()
                unseen = sum(s is None for _, s in stack)
            kind = "t" if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and not ends else "i" if tag in ("li", "dt", "dd") and not ends else "p" if tag in ("p", "blockquote", "pre") and not ends else "d"
        elif tag in ("br", "hr"):
            held.append((" ", links > 0))
        if tag in UNSEEN or tag in CONTAINERS:
            if tag in BLOCKS or tag in APART:
                close()
            if ends:
                names = [t for t, _ in stack]
                if tag in names:
                    del stack[len(names) - 1 - names[::-1].index(tag) :]
            else:
                stack.append((tag, None if tag in UNSEEN else place(tag, found[3], where > 0)))
            unseen, where = sum(s is None for _, s in stack), side(stack)
        elif tag == "body":
            stack.clear()
            unseen, where = 0, 0
    else:
        if at < len(html) and not (unseen or veiled):
            held.append((unescape(html[at:]), links > 0))
    close()
    return out


def numbers(found: list[tuple[str, int, int, int]]) -> list[tuple[float, ...]]:
    """FEATURES of blocks (kind, where, words, linked) from themselves and the blocks beside them."""
    flat = [(float(where), float(KINDS[kind]), float(words), linked / words) for kind, where, words, linked in found]
    none = (0.0, 3.0, 0.0, 0.0)
    return [(*b, a[2], a[3], c[2], c[3], a[0], c[0]) for a, b, c in zip([none, *flat], flat, [*flat[1:], none])]


def labelled_blocks() -> list[tuple[float, ...]]:
    """FEATURES and label of each block of the labelled table."""
    rows, sign = [], {"+": 1, "-": -1, ".": 0}
    for line in LABELLED.split("\n"):
        page = [(b[0], sign[b[1]], *map(int, b[2:].split(","))) for b in line.split()]
        rows += [(*x, float(b[4])) for x, b in zip(numbers([b[:4] for b in page]), page)]
    return rows


def train_tree(spark: SparkSession, labelled: list[tuple[float, ...]] | None = None, depth: int = DEPTH) -> list[tuple]:
    """The decision tree as nodes (feature, threshold, left, right, prediction), the root first; feature -1 is a leaf.
    It has at most 2 ** (depth + 1) nodes and goes to the tasks as it is."""
    table = spark.createDataFrame(labelled or labelled_blocks(), [*FEATURES, "label"]).coalesce(1)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=256, minInstancesPerNode=1, seed=1).fit(rows)
    path = scratch_path(spark, "html-tree")
    model.write().save(path)
    nodes = sorted(spark.read.parquet(f"{path}/data").select("id", "prediction", "leftChild", "rightChild", "split.featureIndex", "split.leftCategoriesOrThreshold").collect())
    return [(r.featureIndex, float((r.leftCategoriesOrThreshold or [0.0])[0]), r.leftChild, r.rightChild, r.prediction) for r in nodes]


def is_main(tree: list[tuple], x: tuple[float, ...]) -> bool:
    at = tree[0]
    while at[2] >= 0:
        at = tree[at[2] if x[at[0]] <= at[1] else at[3]]
    return at[4] > 0.5


def main_text(html: str, tree: list[tuple]) -> str:
    found = blocks(html)
    return "\n".join(b[0] for b, x in zip(found, numbers([b[1:] for b in found])) if is_main(tree, x))


def _extractor(tree: list[tuple], n_keys: int):
    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py() or "", tree) for h in batch.column(n_keys)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names[:n_keys], "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, tree: list[tuple], keys: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """(keys, text, n_chars): the main text of every row. A null page is empty, a page without main text has the empty
    text; repeated rows stay, other columns are not read. One pass over the pages, without a shuffle."""
    source = pages.select(*keys, F.col(html_col).cast("string").alias("_html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(_extractor(tree, len(keys)), f"{schema}, text string, n_chars long")


ship_by_value(__name__)
