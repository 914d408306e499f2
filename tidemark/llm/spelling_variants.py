"""Spelling variants: words within one edit, found by bands of letter-parity bitmasks, hung below their frequent forms."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, ship_by_value

#: The letters a-z by falling frequency; U+00C0 to U+00FF follow. They are dealt to the bands in turn, so
#: that each band holds as many frequent letters as the others.
LETTERS = "eariotnslcudpmhgbfywkvxzjq"
BANDS, BAND_BITS, PIECES = 3, 21, 3
FLUSH = 200_000

#: Byte tables of Latin-1: A-Z become a-z, all but letters become spaces; the bit of each letter.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))
_BITS = np.zeros(256, dtype=np.int64)
for _rank, _byte in enumerate([*LETTERS.encode(), *range(192, 256)]):
    _BITS[_byte] = 1 << (_rank % BANDS * BAND_BITS + _rank // BANDS % BAND_BITS)


def thinned(doc_id: str, words: Counter, one_in: int, least: int) -> Counter:
    """Counts of a text's words; one word in one_in, chosen by crc32 of id and word, loses the letter its hash points at."""
    start, out = zlib.crc32(f"{doc_id}:".encode()), Counter()
    for word, n in words.items():
        if len(word) < least:
            continue
        if one_in:
            h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
            if h % one_in == 0:
                cut = h % len(word)
                word = word[:cut] + word[cut + 1 :]
                if len(word) < least:
                    continue
        out[word] += n
    return out


def _counter(one_in: int, least: int):
    def run(batches):
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                if text:  # letters beyond U+00FF become question marks, which end a run as they must
                    words = Counter(text.encode("latin-1", "replace").translate(_FOLD).split())
                    held.update(thinned(doc_id.as_py(), words, one_in, least))
                if len(held) >= FLUSH:
                    yield out()
                    held.clear()
        yield out()

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, occurrences: int = 2, delete_one_in: int = 0) -> DataFrame:
    """(word, n): maximal runs of A-Z, a-z, U+00C0 to U+00FF in all texts, A-Z lower-cased, of at least `least` code
    points and `occurrences` uses. With delete_one_in, a run whose crc32 of `<id>:<run>` it divides loses one code point.
    Each task sums what it reads before the shuffle."""
    source = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = source.mapInArrow(_counter(delete_one_in, least), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def _masks(batches):
    """Adds the parity mask: bit k is set if the letters of bit k occur an odd number of times."""
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
        starts = np.concatenate([[0], np.cumsum([len(w) for w in coded])[:-1]])
        masks = np.bitwise_xor.reduceat(_BITS[np.frombuffer(b"".join(coded), dtype=np.uint8)], starts)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(masks)], names=["word", "n", "mask"])


def _piece(word: Column, length: Column | int, piece: Column | int, longer: Column | int) -> tuple[Column, Column]:
    """What stands before and after one of PIECES parts of a word of `length` (+1 where it is the longer one)."""
    start, end = F.floor(F.lit(length) * piece / PIECES).cast("int"), F.floor(F.lit(length) * (piece + 1) / PIECES).cast("int")
    return word.substr(F.lit(1), start), word.substr(end + longer + 1, F.lit(length) - end)


def _keyed(words: DataFrame, role: str) -> DataFrame:
    """The words under all their keys: as the shorter (or equal) of a pair, or as its second."""
    size = F.length("word")
    spots = [(band, piece, longer) for band in range(BANDS) for piece in range(PIECES) for longer in ((0,) if role == "a" else (0, 1))]
    keys = []
    for band, piece, longer in spots:
        head, tail = _piece(F.col("word"), size - longer, F.lit(piece), F.lit(longer))
        bits = F.shiftright("mask", band * BAND_BITS).bitwiseAND(F.lit((1 << BAND_BITS) - 1))
        keys.append(F.struct(F.xxhash64(F.lit(band), bits, size - longer, F.lit(piece), head, tail).alias("key"), F.lit(band * PIECES + piece).cast("byte").alias("spot"), F.lit(longer).cast("byte").alias("longer")))
    out = words.select(F.col("word").alias(role), F.col("n").alias(f"n_{role}"), F.col("mask").alias(f"m_{role}"), F.explode(F.array(*keys)).alias("k"))
    if role == "a":
        return out.select("k.key", "k.spot", "a", "n_a", "m_a")
    return out.select("k.key", "k.longer", "b", "n_b", "m_b")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each pair of words that differ by exactly one inserted, deleted or replaced code point, once.

    One edit flips at most two bits of the letter-parity mask, so of three bands one is equal. Words join on an equal
    band and their length (equal, or longer by one). Frequent bands hold very many words, so each is split, without
    losing a pair, by the part the edit lies in: of three parts of a word the other two are the same. Pairs with
    more than two different bits go first, then one Levenshtein distance decides. A pair is reported under the least
    band and part at which it meets. Keys with many words are split by Spark's skewed joins.
    """
    masked = materialise(words.select("word", "n").mapInArrow(_masks, "word string, n long, mask long"), "spelling-words")
    pairs = _keyed(masked, "a").join(_keyed(masked, "b"), "key")
    flips = F.col("m_a").bitwiseXOR(F.col("m_b"))
    band, piece, size = F.floor(F.col("spot") / PIECES).cast("int"), F.col("spot") % PIECES, F.length("a")
    differs = lambda k: flips.bitwiseAND(F.lit((1 << BAND_BITS) - 1 << k * BAND_BITS)) != 0

    def meets(p: int) -> Column:
        (head, tail), (head_b, tail_b) = (_piece(F.col(c), size, F.lit(p), x) for c, x in (("a", F.lit(0)), ("b", F.col("longer").cast("int"))))
        return (head == head_b) & (tail == tail_b)

    least = F.lit(True)
    for k in range(BANDS):
        least = least & F.when(band == k, ~differs(k)).when(band > k, differs(k)).otherwise(True)
    first = F.lit(True)
    for p in range(PIECES):
        first = first & F.when(piece == p, meets(p)).when(piece > p, ~meets(p)).otherwise(True)
    apart = (F.length("b") == size + F.col("longer").cast("int")) & ((F.col("longer") == 1) | (F.col("a") < F.col("b")))
    near = F.expr("levenshtein(a, b, 1) = 1")
    return pairs.where((F.bit_count(flips) <= 2) & apart & least & near & first).select("a", "n_a", "b", "n_b")


def _roots(links: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): forms followed to the last, twice as far each round. Forms are at least `times` as
    frequent as their words, so chains have no cycle and are short."""
    at = materialise(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = materialise(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def spelling_forms(words: DataFrame, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of (word, n).

    form: the near word of largest n (ties: the smallest in code-point order), if used at least `times` as often, else
    null. root: the end of the chain of forms, the word itself without one. An empty table gives an empty result.
    """
    words = materialise(words.select("word", "n"), "spelling-counts")
    pairs = near_pairs(words)
    sides = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = pairs.select(F.explode(sides).alias("s")).groupBy("s.word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("s.m")).alias("less"), F.col("s.other").alias("other"))).alias("best"))
    often = -F.col("best.less") >= times * F.col("n")
    told = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("best.other")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n"))
    told = materialise(told, "spelling-forms")
    return told.join(_roots(told.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, occurrences: int = 2, times: int = 10, delete_one_in: int = 0) -> DataFrame:
    """The words of all texts with their near words' count, form and root. Null and empty texts have no words, a null id
    counts as the empty text, repeated rows count as often as they occur; other columns are not read."""
    return spelling_forms(word_counts(docs, id_col, text_col, least, occurrences, delete_one_in), times)


ship_by_value(__name__)
