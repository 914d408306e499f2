"""Language identification by interpolated Kneser-Ney character models, one for each language.

Words are scored letter by letter inside a frame of spaces, with up to ORDER - 1 letters of context that
never reach over a space. The models of all languages share sorted arrays of n-gram hashes; the language
of least cross-entropy for each character wins, unless calibrated bounds reject it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold, materialise, ship_by_value, small_table
from tidemark.llm.word_ids import groups, lean, small_batches, text_bytes

ORDER = 4
CACHE_WORDS = 300_000
#: Bytes of texts whose new words are scored at once: some 120 bytes are held for each.
TOGETHER = 1_000_000


def frame(word: bytes) -> str:
    """The letters of a word, lower-cased, other runs as single spaces, closed by a space; '' where there is no letter."""
    text = word.decode().lower()
    if text.isalpha():
        return text + " "
    kept = "".join(c if c.isalpha() else " " for c in text).split()
    return " ".join(kept) + " " if kept else ""


def grams(framed: str, order: int = ORDER) -> list[str]:
    """For every letter and closing space: it and its context, which starts at the space before the word at most."""
    framed = " " + framed
    out, start = [], 0
    for i in range(1, len(framed)):
        out.append(framed[max(start, i - order + 1) : i + 1])
        if framed[i] == " ":
            start = i
    return out


def _chained(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """[k][i]: hash of the k + 1 code points that end at i (for i >= k)."""
    codes = codes.astype(np.uint64)
    h = np.full(len(codes), 0x9E3779B97F4A7C15, np.uint64)
    out = []
    for k in range(order):
        h = h.copy()
        h[k:] = (h[k:] ^ codes[: len(codes) - k]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
        out.append(h)
    return out


def gram_hashes(names: list[str]) -> np.ndarray:
    """Of grams of one length."""
    if not names:
        return np.zeros(0, np.uint64)
    size = len(names[0])
    codes = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)
    return _chained(codes, size)[size - 1][size - 1 :: size]


def _find(hashes: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(hashes):
        return np.zeros(len(want), np.int64), np.zeros(len(want), bool)
    at = np.minimum(np.searchsorted(hashes, want), len(hashes) - 1)
    return at, hashes[at] == want


@dataclass(frozen=True)
class LanguageModel:
    """For each n-gram order: sorted hashes, log-probabilities and back-off weights by language.

    arrays[k] = (hashes of (k+1)-grams, log p [n, languages], log back-off of the gram as a context [n, languages]).
    unseen: log p of a letter that no model knows. bounds: [language, (median, deviation of long texts, deviation
    times root length of short ones, deviations that are still accepted)] of the cross-entropy of documents held back from the counts.
    """

    languages: tuple[str, ...]
    arrays: tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]
    unseen: np.ndarray
    bounds: np.ndarray
    order: int = ORDER

    def words(self, framed: list[str]) -> np.ndarray:
        """For each framed word: its letters and spaces, then the sum of their log p by language."""
        sizes = np.fromiter(map(len, framed), np.int64, len(framed))
        out = np.zeros((len(framed), len(self.languages) + 1))
        out[:, 0] = sizes
        if not sizes.sum():
            return out
        codes = np.frombuffer((" " + "".join(framed)).encode("utf-32-le"), np.uint32)
        spaces = np.where(codes == 32, np.arange(len(codes)), 0)
        reach = np.arange(1, len(codes)) - np.maximum.accumulate(spaces)[:-1]  # context letters, the space included
        chained = _chained(codes, self.order)
        paid = np.zeros((len(codes) - 1, len(self.languages)))
        open_ = np.arange(len(codes) - 1)  # position less one
        for k in range(self.order - 1, -1, -1):
            now = open_[reach[open_] >= k]
            if not len(now):
                continue
            at, hit = _find(self.arrays[k][0], chained[k][now + 1])
            hit[hit] = ~np.isnan(self.arrays[k][1][at[hit], 0])
            paid[now[hit]] += self.arrays[k][1][at[hit]]
            miss = now[~hit]
            if k and len(miss):
                at, known = _find(self.arrays[k - 1][0], chained[k - 1][miss])
                paid[miss[known]] += self.arrays[k - 1][2][at[known]]
            elif len(miss):
                paid[miss] += self.unseen
            settled = np.zeros(len(codes) - 1, bool)
            settled[now[hit]] = True
            open_ = open_[~settled[open_]]
        some = sizes > 0
        out[some, 1:] = np.add.reduceat(paid, (np.cumsum(sizes) - sizes)[some], axis=0)
        return out


def _kneser_ney(counts: dict[str, dict[str, int]], languages: tuple[str, ...], order: int) -> tuple[list, np.ndarray]:
    """counts: language -> {gram of its full context: count}. One discount for each order, from its counts of counts."""
    n_langs = len(languages)
    logs: list[dict[str, list[float | None]]] = [{} for _ in range(order)]
    backs: list[dict[str, list[float]]] = [{} for _ in range(order)]
    unseen = np.zeros(n_langs)
    for li, lang in enumerate(languages):
        by_order: list[dict[str, int]] = [{} for _ in range(order)]
        for gram, n in counts.get(lang, {}).items():
            by_order[len(gram) - 1][gram] = n
        for k in range(order - 1, 0, -1):  # continuation counts: distinct left neighbours
            lower = by_order[k - 1]
            for gram in by_order[k]:
                lower[gram[1:]] = lower.get(gram[1:], 0) + 1
        floor = 1.0 / (64 * (len(by_order[0]) + 1))
        prob: dict[str, float] = {}
        unseen[li] = np.log(floor)
        for k, found in enumerate(by_order):
            n1, n2 = sum(n == 1 for n in found.values()), sum(n == 2 for n in found.values())
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.75
            total: dict[str, int] = {}
            kinds: dict[str, int] = {}
            for gram, n in found.items():
                total[gram[:-1]] = total.get(gram[:-1], 0) + n
                kinds[gram[:-1]] = kinds.get(gram[:-1], 0) + 1
            now = {}
            for gram, n in found.items():
                context = gram[:-1]
                below = prob[gram[1:]] if k else 1.0 / (len(found) + 1)
                now[gram] = (n - discount + discount * kinds[context] * below) / total[context]
                logs[k].setdefault(gram, [None] * n_langs)[li] = float(np.log(now[gram]))
            for context, n in total.items():
                if k:
                    backs[k - 1].setdefault(context, [0.0] * n_langs)[li] = float(np.log(discount * kinds[context] / n))
                else:
                    unseen[li] = np.log(discount * kinds[context] / n * floor)
            prob = now
    for k, table in enumerate(logs):  # a gram some language lacks: what backing off gives there
        for gram, row in table.items():
            for li in range(n_langs):
                if row[li] is None:
                    row[li] = (backs[k - 1].get(gram[:-1], [0.0] * n_langs)[li] + logs[k - 1][gram[1:]][li]) if k else float(unseen[li])
    arrays = []
    for k in range(order):
        names = list(logs[k].keys() | backs[k].keys())
        hashes = gram_hashes(names)
        by_hash = np.argsort(hashes)
        names = [names[i] for i in by_hash]
        arrays.append(
            (
                hashes[by_hash],
                np.array([logs[k].get(g) or [np.nan] * n_langs for g in names]).reshape(-1, n_langs),
                np.array([backs[k].get(g) or [0.0] * n_langs for g in names]).reshape(-1, n_langs),
            )
        )
    return arrays, unseen


class WordScores:
    """Texts -> (characters scored, log p by language), through a bounded cache of words."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self._reset()

    def _reset(self):
        self.at: dict[bytes, int] = {}
        self.table = np.zeros((0, len(self.model.languages) + 1))

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """One row a text: characters, then log p for each language."""
        out = np.zeros((len(texts), len(self.model.languages) + 1))
        for lo, hi in groups([len(t) for t in texts], TOGETHER):
            split = [t.split() for t in texts[lo:hi]]
            every = set().union(*split)
            new = every - self.at.keys()
            if len(self.at) + len(new) > CACHE_WORDS:
                self._reset()
                new = every
            new = list(new)
            for w in new:
                self.at[w] = len(self.at)
            if new:
                self.table = np.concatenate([self.table, self.model.words([frame(w) for w in new])])
            get = self.at.__getitem__
            for i, words in enumerate(split, lo):
                if words:
                    out[i] = self.table[np.fromiter(map(get, words), np.int64, len(words))].sum(axis=0)
        return out


def sample_rows(docs: DataFrame, docs_per_language: int, max_docs: int, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame, tuple[str, ...]]:
    """(lang, h, text) of the documents whose ids hash lowest, and all languages in order.

    Of a language's n labelled rows those with a hash in the lowest share s / n are taken (s: docs_per_language,
    less where max_docs in all would be passed), so that about s are expected, whatever n is; of rows that
    repeat an id one is taken. Counts alone are gathered, pre-aggregated: no task sees all rows of a language.
    """
    labelled = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.xxhash64(F.col(f"`{id_col}`").cast("string")).alias("h"), F.col(f"`{text_col}`").cast("string").alias("text")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a label
    each = max(1, min(docs_per_language, max_docs // max(1, len(sizes))))
    shares = [(k, 1.0 if n <= each else each / n) for k, n in sizes.items()]
    share = small_table(docs.sparkSession, shares, "lang string, share double")
    taken = labelled.join(share, "lang").where(F.col("h") / F.lit(2.0**64) + 0.5 <= F.col("share")).select("lang", "h", "text")
    return taken.dropDuplicates(["lang", "h"]), tuple(sorted(sizes))


def train(
    docs: DataFrame, docs_per_language: int = 3000, max_docs: int = 60_000, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> LanguageModel:
    """Fit the models on about docs_per_language labelled documents of each language, about max_docs in all.

    The bounds keep the sorted arrays small enough to be sent to every worker; any number of labels is fitted. One of
    ten sampled documents is held back from the counts and calibrates the rejection: its bounds, and the spread,
    which is twice the largest deviation of a held-back document of the language (4 to 20; 8 where under ten are
    held back). Rows with a null label or text teach nothing.
    """
    sample, languages = sample_rows(docs, docs_per_language, max_docs, id_col, text_col, lang_col)
    if not languages:
        return LanguageModel((), tuple((np.zeros(0, np.uint64), np.zeros((0, 0)), np.zeros((0, 0))) for _ in range(order)), np.zeros(0), np.zeros((0, 4)), order)
    sample = materialise(sample, "language-sample").withColumn("held", F.pmod(F.shiftright("h", 7), F.lit(10)) == 0)

    def count(batches):
        for b in batches:
            found: dict[tuple[str, str], int] = {}
            by_lang: dict[str, dict[bytes, int]] = {}
            for lang, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                words = by_lang.setdefault(lang, {})
                for w in text.split():
                    words[w] = words.get(w, 0) + 1
            for lang, words in by_lang.items():
                for w, n in words.items():
                    framed = frame(w)
                    for gram in grams(framed, order) if framed else ():
                        key = (lang, gram)
                        found[key] = found.get(key, 0) + n
            langs, texts = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(texts, pa.string()), pa.array(found.values(), pa.int64())], names=["lang", "gram", "n"])

    taught = sample.where("not held").select("lang", "text").mapInArrow(lean(count), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    for r in taught.collect():  # bounded by the sample
        counts.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    arrays, unseen = _kneser_ney(counts, languages, order)
    model = LanguageModel(languages, tuple(arrays), unseen, np.zeros((len(languages), 4)), order)

    number = {lang: i for i, lang in enumerate(languages)}

    def entropy(batches):
        score = WordScores(model)
        for b in batches:
            got = score(text_bytes(b.column(1)))
            at = np.array([number[x] for x in b.column(0).to_pylist()], np.int64)
            n = got[:, 0]
            h = -got[np.arange(len(got)), at + 1] / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(h)], names=["lang", "n", "h"])

    checked = sample.where("held").select("lang", "text").mapInArrow(lean(entropy), "lang string, n double, h double").where("n > 0")
    got = [(r["lang"], r["n"], r["h"]) for r in checked.collect()]  # a tenth of the sample
    bounds, of_lang = np.tile([np.inf, 0.1, 3.0, 8.0], (len(languages), 1)), {}
    for lang, *pair in got:
        of_lang.setdefault(lang, []).append(pair)
    for li, lang in enumerate(languages):
        n, h = np.array(of_lang.get(lang, [])).reshape(-1, 2).T
        if len(h):
            m = float(np.median(h))
            long, short = h[n >= 500], ((h - m) * np.sqrt(n))[n < 500]
            s, z = max(0.02, float(np.std(long))) if len(long) > 9 else 0.1, max(1.0, float(np.std(short))) if len(short) > 9 else 3.0
            spread = 2 * float(np.max((h - m) / np.sqrt(s**2 + z**2 / n))) if len(h) > 9 else 8.0
            bounds[li] = m, s, z, min(20.0, max(4.0, spread))
    return LanguageModel(languages, tuple(arrays), unseen, bounds, order)


def _judge(texts: list[bytes], score: WordScores | None, model: LanguageModel, spread: float | None):
    """Language number or -1, posterior (half or less where rejected), cross-entropy (NaN without letters), rejected."""
    got = score(texts) if score else np.zeros((len(texts), 1))
    n = got[:, 0]
    pred, prob, h, bad = np.full(len(texts), -1), np.zeros(len(texts)), np.full(len(texts), np.nan), n == 0
    if score and len(texts):
        per = -got[:, 1:] / np.maximum(n, 1)[:, None]
        pred = np.where(bad, -1, per.argmin(axis=1))
        h = np.where(bad, np.nan, per.min(axis=1))
        prob = np.where(bad, 0.0, 1.0 / np.exp(-(per - per.min(axis=1)[:, None]) * np.sqrt(n)[:, None]).sum(axis=1))
        m, s, z, fitted = model.bounds[pred].T
        most = fitted if spread is None else spread
        off = np.where(np.isfinite(m), (np.nan_to_num(h) - m) / np.sqrt(s**2 + z**2 / np.maximum(n, 1)), 0.0)
        far = ~bad & (off > most)
        prob = np.where(far, 0.5 * prob * most / np.where(far, off, 1.0), prob)
        bad = bad | far
    return pred, prob, h, bad


def identify(docs: DataFrame, model: LanguageModel, spread: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, cross_entropy, rejected): one row for each row, whole texts.

    lang_pred: the language of least cross-entropy for each character (ties: the first by name), `und` where the
    text is null or has no letter or no language was learned. score: its posterior under equal priors, with the
    text counted as the root of its characters (neighbouring letters are not independent), 0 for `und`; where
    the text is rejected, half of it times how near the cross-entropy came to the bound.
    rejected: und, or a cross-entropy over the language's held-back median by more than spread (None: the fitted
    one) times its calibrated deviation at this length. Equal texts always get the same result.
    """
    languages = model.languages

    def run(batches):
        score = WordScores(model) if languages else None
        for b in small_batches(batches):
            pred, prob, h, bad = _judge(text_bytes(b.column(1)), score, model, spread)
            names = [languages[i] if i >= 0 else "und" for i in pred]
            h = pa.array(h, from_pandas=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(prob), h, pa.array(bad)], names=[id_col, "lang_pred", "score", "cross_entropy", "rejected"])

    rows = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, cross_entropy double, rejected boolean")


def accept(docs: DataFrame, model: LanguageModel, spread: float | None = None, text_col: str = "text") -> DataFrame:
    """The rows of docs that identify() does not reject, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches):
        score = WordScores(model) if model.languages else None
        for b in small_batches(batches):
            yield b.filter(pa.array(~_judge(text_bytes(b.column(at)), score, model, spread)[3]))

    return docs.mapInArrow(lean(run), docs.schema)


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.where(fold(id_col) != 0)


ship_by_value(__name__)
