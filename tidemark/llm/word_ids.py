"""Token ids of whole texts, by way of the ids of their distinct words.

The word tokenizer drops white space and never merges across it, so a text's ids are those of its
pieces between ASCII white space, one after the other. Workers encode each distinct piece once and keep
a cache of two bounded generations, so that frequent words stay; the tests hold the result against encoding whole texts.
"""

from __future__ import annotations

import ctypes
import os
import string
import sys
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ship_by_value

#: Of one generation.
CACHE_WORDS = 300_000
#: The apostrophe may open a contraction.
PUNCTUATION = string.punctuation.replace("'", "")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def width_of(path: str) -> int:
    """Bytes an id takes in stored arrays."""
    return 2 if vocabulary_size(path) <= 1 << 16 else 4


class WordEncoder:
    """bytes of a text -> its ids, little-endian, width bytes each."""

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(0)  # it would stay, some 5 MB for each task, for as long as the worker lives; known is the cache
        pre = self.tokenizer.pre_tokenizer
        if pre is None or b"[^\\\\s\\\\p{L}\\\\p{N}]+" not in pre.__getstate__():  # its JSON
            raise ValueError("this tokenizer may merge across white space; its texts can't be encoded by words")
        if sys.byteorder != "little":
            raise ValueError("ids are kept as this machine's integers, which must be little-endian")
        self.normalizer = self.tokenizer.normalizer
        suffix = self.tokenizer.model.end_of_word_suffix
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.closes[i] = token.endswith(suffix)
        self.kind = {2: "H", 4: "I"}[width]
        self.known: dict[bytes, bytes] = {}
        self.former: dict[bytes, bytes] = {}

    def _pieces(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct pieces of distinct words, and the first and second piece of each (-1: none).

        A run of punctuation after a letter is a token piece of its own, so both parts are encoded once.
        """
        base = pc.ascii_rtrim(words, PUNCTUATION)
        cut = pc.binary_length(base).to_numpy()
        trimmed = (cut < pc.binary_length(words).to_numpy()) & ~pc.match_substring(words, "<|").to_numpy(zero_copy_only=False)
        last = pc.utf8_slice_codeunits(base, -1)
        parted = trimmed & pc.ascii_is_alpha(last).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(trimmed & ~parted & ~pc.string_is_ascii(last).to_numpy(zero_copy_only=False)).tolist():
            parted[i] = last[i].as_py().lower().isalpha()
        two = pa.array(parted)
        tails = words.filter(two).cast(pa.binary()).to_pylist()
        tails = pa.array([w[n:] for w, n in zip(tails, cut[parted].tolist())], pa.binary()).cast(pa.string())
        every = pa.concat_arrays([pc.if_else(two, base, words), tails]).dictionary_encode()
        at = every.indices.to_numpy().astype(np.int64)
        second = np.full(len(words), -1)
        second[parted] = at[len(words) :]
        return every.dictionary, at[: len(words)], second

    def learn(self, pieces: pa.Array) -> list[bytes]:
        """The ids of distinct pieces; those of the former generation that come again move on."""
        names = pieces.cast(pa.binary()).to_pylist()
        found = list(map(self.known.get, names))
        lacking = []
        for i, x in enumerate(found):
            if x is None:
                before = self.former.get(names[i])
                if before is None:
                    lacking.append(i)
                else:
                    self.known[names[i]] = found[i] = before
        new = pieces.take(pa.array(lacking, pa.int64()))
        plain = pc.and_(pc.ascii_is_alpha(new), pc.ascii_is_lower(new))
        accented, others = [], []
        for word in new.filter(pc.invert(plain)).to_pylist():
            (accented if word.isalpha() and word.lower().isalpha() else others).append(word.encode())
        self.tokenizer.normalizer = None  # it leaves lower-case ASCII letters alone
        self._encode_letters(new.filter(plain).cast(pa.binary()).to_pylist())
        self.tokenizer.normalizer = self.normalizer
        self._encode_letters(accented)
        self._encode_each(others)
        for i in lacking:
            found[i] = self.known[names[i]]
        if len(self.known) > CACHE_WORDS:
            self.known, self.former = {}, self.known
        return found

    def _encode_letters(self, words: list[bytes]) -> None:
        """Words of letters, many in one text: each is one piece, and its last token alone closes a piece."""
        for i in range(0, len(words), 20_000):
            parts = [words[k : k + 500] for k in range(i, min(i + 20_000, len(words)), 500)]
            for part, encoded in zip(parts, self.tokenizer.encode_batch_fast([b" ".join(p).decode() for p in parts], add_special_tokens=False)):
                ids = np.array(encoded.ids, np.uint32)
                ends = (np.flatnonzero(self.closes[ids]) + 1) * array(self.kind).itemsize
                if len(ends) != len(part):
                    self._encode_each(part)
                    continue
                raw, bounds = ids.astype(self.kind).tobytes(), [0, *ends.tolist()]
                self.known.update(zip(part, [raw[x:y] for x, y in zip(bounds, bounds[1:])]))

    def _encode_each(self, words: list[bytes]) -> None:
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            for word, encoded in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                self.known[word] = array(self.kind, encoded.ids).tobytes()

    def __call__(self, texts: list[bytes], end: bytes = b"") -> list[bytes]:
        return [x.as_py() for x in self.encode(pa.array(texts, pa.binary()).cast(pa.string()), end)]

    def encode(self, texts: pa.Array, end: bytes = b"", together: int = 8_000_000) -> pa.Array:
        """Strings (null: empty) -> their ids as binary: distinct words of about so many bytes of text at once, whose arrays
        take some 20 times as much memory."""
        parts = [self._encoded(texts[lo:hi], end) for lo, hi in groups(pc.binary_length(texts).fill_null(0).to_pylist(), together)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    def _encoded(self, texts: pa.Array, end: bytes) -> pa.Array:
        texts = texts.fill_null("")
        lower = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))  # special tokens keep their case
        split = pc.ascii_split_whitespace(lower)
        words = split.flatten().dictionary_encode()
        pieces, first, second = self._pieces(words.dictionary)
        ids_of = self.learn(pieces)
        found = [ids_of[i] for i in first.tolist()]
        parted = np.flatnonzero(second >= 0)
        for i, k in zip(parted.tolist(), second[parted].tolist()):
            found[i] += ids_of[k]
        kind = np.dtype(self.kind)
        flat = np.frombuffer(b"".join(found) + end, kind)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // kind.itemsize
        starts = np.cumsum(sizes) - sizes
        # the end is one more word, after the last one of every text
        at = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n_words = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        if end:
            sizes, starts = np.append(sizes, 1), np.append(starts, len(flat) - 1)
            at, n_words = np.insert(at, np.cumsum(n_words), len(found)), n_words + 1
        length = sizes[at]
        ends = np.r_[0, np.cumsum(length)]
        ids = flat[np.arange(ends[-1]) + np.repeat(starts[at] - ends[:-1], length)]
        offsets = ends[np.r_[0, np.cumsum(n_words)]] * kind.itemsize
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])


def groups(sizes: list[int], most: int):
    """Ranges of neighbours with about most in sum; a single larger one stands alone."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def give_back() -> None:
    """What Arrow and the C library (where it is glibc) hold of memory that is free goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run):
    """run, a function of record batches, that gives back what it held when its task ends: a worker lives on, beside others,
    for the tasks of later stages."""

    def task(batches):
        yield from run(batches)
        give_back()

    return task


def small_batches(batches, rows: int = 1000):
    """Record batches in parts of at most so many rows, so that few texts are Python objects at once; what is held of
    batches that are done goes back."""
    for b in batches:
        for lo in range(0, len(b), rows):
            yield b.slice(lo, rows)
        del b
        give_back()


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def encode_documents(docs: DataFrame, path: str, end_id: int | None = 1, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, ids (binary: little-endian, width_of(path) bytes each, end_id appended) and n_tokens."""
    width = width_of(path)
    end = b"" if end_id is None else end_id.to_bytes(width, "little")

    def run(batches):
        encoder = WordEncoder(path, width)
        for b in small_batches(batches):
            ids = encoder.encode(b.column(len(keep)), end, 2_000_000)
            n_tokens = pc.divide(pc.binary_length(ids), width).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids, n_tokens], names=[*keep, "ids", "n_tokens"])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias("_text"))
    head = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(lean(run), f"{head}, ids binary, n_tokens long")


def wide(ids: bytes | pa.Buffer, width: int) -> np.ndarray:
    return np.frombuffer(ids, f"<u{width}").astype("<u4")


ship_by_value(__name__)
