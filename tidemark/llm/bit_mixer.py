"""A byte stream's bits under online logistic context mixing; everything here works on whole batches of texts.

A text is lower-cased and closed by the byte 0xFF, which UTF-8 never has. The next byte is coded by the bits of
a Huffman code for the byte before it, or for the two before it where these are frequent letters, so that a likely
byte takes one or two binary decisions. For each decision, predictors look up hashed contexts: the last 4 bytes (over
word edges), the word so far with the topic of the words before it, and the word so far with the word before it;
one more follows the last place of the same text where the last 5 bytes stood. Their log odds are summed with weights that a gate selects, and a table
refines the result.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import cached_property

import numpy as np

from tidemark.llm.common import ship_by_value

#: log2 of the most slots of each predictor's table; smaller corpora get smaller tables.
SLOTS = (20, 22, 21)
HASHED = len(SLOTS)
MATCH, INPUTS = HASHED, HASHED + 2
TOPICS = 8
END = 0xFF
#: As many pairs of letters have a code of their own.
PAIRS = 1024
#: Longer texts are read in segments, each with the last WARM bytes of the one before as its context.
SEGMENT, WARM, PAD = 1 << 19, 64, 8
CHUNK, STEP_BYTES = 1 << 15, 1 << 15
GATES, BUCKETS, REFINED = 108, 33, 4096
_U = np.uint64
_BASE, _INVERSE = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MULS = [_U(x) for x in (0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_LETTER = np.zeros(256, bool)
_LETTER[list(range(97, 123)) + list(range(48, 58)) + list(range(128, 255))] = True
_powers: dict[str, np.ndarray] = {}
_codes: list[np.ndarray] = []
#: A state of two counts: where the smaller one is under SMALL, it and the larger one's magnitude; else the steps of their log odds.
SMALL, MAGNITUDES, STEPS, STEP = 6, 18, 192, 16
STATES = SMALL * MAGNITUDES + STEPS
#: A code: twice the state, plus one where ones are more frequent. From ONE_WAY and BOTH_WAYS on, the context was seen (both ways).
CODES, ONE_WAY, BOTH_WAYS = 2 * STATES, 2, 2 * MAGNITUDES
FEW = 64
_LOG = np.log(np.arange(1 << 16) + 0.4).astype(np.float32)
_SIZE = np.ceil(np.log2(np.arange(1 << 16) + 1)).astype(np.int64)
_PATH = _U(0xC2B2AE3D27D4EB4F)
#: Strength of a match by its length; from LONG on it does not grow.
LONG = 1 << 10
_STRENGTH = (2 * np.minimum(np.ceil(np.log2(np.arange(LONG + 1) + 1)), 10)).astype(np.uint8)


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n - 1), kept for the next call."""
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        _powers[key] = np.concatenate([[_U(1)], np.cumprod(np.full(max(n, 1 << 16), base, np.uint64))])
    return _powers[key][:n]


def word_hash(word: bytes) -> int:
    h, power = 0, 1
    for x in word:
        h = (h + (x + 1) * power) & 0xFFFFFFFFFFFFFFFF
        power = power * int(_BASE) & 0xFFFFFFFFFFFFFFFF
    return h


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """counts [context, byte] -> codes and lengths [context, byte]; every byte has a code in every context."""
    codes, sizes = np.zeros(counts.shape, np.int64), np.zeros(counts.shape, np.int64)
    overall = counts.sum(axis=0) + 1e-3
    overall = overall / overall.sum()
    for context, seen in enumerate(counts):
        n = seen + overall
        n = np.maximum(n, n.sum() / (1 << 24))
        heap = [(float(x), i, (i,)) for i, x in enumerate(n)]
        heapq.heapify(heap)
        code, size = [0] * 256, [0] * 256
        while len(heap) > 1:
            x, _, low = heapq.heappop(heap)
            y, tie, high = heapq.heappop(heap)
            for bit, side in ((0, low), (1, high)):
                for s in side:
                    code[s] |= bit << size[s]
                    size[s] += 1
            heapq.heappush(heap, (x + y, tie, low + high))
        codes[context], sizes[context] = code, size
    return codes, sizes


def byte_triples(text: bytes) -> np.ndarray:
    """Of every byte of a closed text: it, below it the byte before, then the one before that, in one number."""
    data = np.frombuffer(b"\xff\xff" + text + b"\xff", np.uint8).astype(np.int64)
    return data[:-2] << 16 | data[1:-1] << 8 | data[2:]


def byte_codes(triples: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, sizes, context of two bytes [65536]) from distinct byte_triples and how often they were seen.

    Contexts 0 to 255 are the byte before; the PAIRS most frequent pairs of letters follow.
    """
    pair = triples >> 8
    seen = np.bincount(pair, times, 1 << 16)
    two = np.arange(1 << 16)
    seen[~(_LETTER[two >> 8] & _LETTER[two & 255])] = 0
    chosen = np.lexsort((two, -seen))[:PAIRS]
    chosen = chosen[seen[chosen] > 0]
    context = (two & 255).astype(np.int64)
    context[chosen] = 256 + np.arange(len(chosen))
    counts = np.bincount(context[pair] * 256 + (triples & 255), times, (256 + len(chosen)) * 256).reshape(-1, 256).astype(np.float64)
    counts[:256] += np.bincount(triples & 0xFFFF, times, 1 << 16).reshape(256, 256) * 1e-3
    return *huffman(counts), context


def codes_of(n: np.ndarray) -> np.ndarray:
    """Counts [rows, 2] -> codes (int16)."""
    if not _codes:
        _codes.append(_codes_of(np.indices((256, 256), np.uint16).reshape(2, -1).T))  # of counts under 256
    out = _codes[0].take((n[:, 0].astype(np.int64) << 8) | n[:, 1], mode="clip")
    many = np.flatnonzero((n[:, 0] | n[:, 1]) >> 8)
    out[many] = _codes_of(n[many])
    return out


def _codes_of(n: np.ndarray) -> np.ndarray:
    low, high = n.min(axis=1), n.max(axis=1)
    steps = np.minimum(np.rint((_LOG[high] - _LOG[low]) * STEP), STEPS - 1).astype(np.int16)
    state = np.where(low < SMALL, low.astype(np.int16) * MAGNITUDES + _SIZE[high], SMALL * MAGNITUDES + steps)
    return (2 * state + (n[:, 1] > n[:, 0])).astype(np.int16)


def left_out(n: np.ndarray) -> np.ndarray:
    """Codes [2 * rows] of the counts with one zero less, and with one one less.

    Counts of FEW or more stay: one less hardly changes the odds, but on a border of two codes it would tell the bit.
    """
    out = np.empty((len(n), 2), np.int16)
    few = n.sum(axis=1, dtype=np.int64) < FEW
    for bit in (0, 1):
        less = n.copy()
        less[:, bit] -= few & (less[:, bit] > 0)
        out[:, bit] = codes_of(less)
    return out.reshape(-1)


@dataclass(frozen=True)
class Shape:
    """What fixes the contexts: codes and lengths of bytes by context, the context of any two bytes, sorted hashes of
    frequent words and their log odds by topic."""

    codes: np.ndarray
    sizes: np.ndarray
    contexts: np.ndarray
    words: np.ndarray
    topics: np.ndarray
    slots: tuple[int, ...] = SLOTS

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("walks", "word_starts")}

    @cached_property
    def walks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, sizes, steps): the decisions of byte b in context c are the sizes[256 * c + b] entries of steps from
        starts[256 * c + b] on. A step has a bit for the decision, two for the depth (at most 3), twelve for the row of the
        refinement and, from the 16th on, the path: the bits so far below a one."""
        sizes = self.sizes.reshape(-1).astype(np.int64)
        ends = np.cumsum(sizes)
        steps = np.empty(ends[-1], np.uint64)
        for lo in range(0, len(sizes), 1 << 14):
            code, size = self.codes.reshape(-1)[lo : lo + (1 << 14)], sizes[lo : lo + (1 << 14)]
            own = np.repeat(np.arange(len(size)), size)
            first = ends[lo] - size[0]
            depth = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
            left = size[own] - depth
            path = ((code[own] >> left) | (1 << depth)).view(np.uint64)
            node = ((((own + lo) & ~255).view(np.uint64) * _MULS[3] + path * _PATH) * _MULS[4]) >> _U(52)
            note = (np.minimum(depth, 3) << 1 | (code[own] >> (left - 1)) & 1).view(np.uint64)
            steps[first : first + len(own)] = path << _U(16) | node << _U(3) | note
        return ends - sizes, sizes.astype(np.uint8), steps

    @cached_property
    def word_starts(self) -> tuple[np.ndarray, int]:
        """Where the words whose hashes begin with any 16 bits begin in words, and how many share them at most."""
        starts = np.searchsorted(self.words >> _U(48), np.arange((1 << 16) + 1, dtype=np.uint64))
        return starts[:-1], int(np.diff(starts).max())


def _spans(at: np.ndarray, until: np.ndarray, size: int) -> np.ndarray:
    """Lengths of what lies before, within and between the ranges [at, until), which follow each other."""
    out = np.empty(2 * len(at) + 1, np.int64)
    out[1::2] = until - at
    out[0::2] = np.r_[at, size] - np.r_[0, until]
    return out


def _among(values: np.ndarray, other) -> np.ndarray:
    """values with other before, between and after them."""
    out = np.full(2 * len(values) + 1, other, values.dtype)
    out[1::2] = values
    return out


class Stream:
    """The segments of some texts one after the other, with the contexts of every byte. only: of each text, the segments
    that begin within this range of bytes, so that a very long text is read in several streams."""

    def __init__(self, texts: list[bytes], shape: Shape, only: tuple[int, int] | None = None):
        parts, owners, coded = [], [], []
        at = 0
        for i, text in enumerate(texts):
            size = len(text) + 1  # with its end
            for lo in range(0, size, SEGMENT):
                if only and not only[0] <= lo < only[1]:
                    continue
                warm = text[max(0, lo - WARM) : lo]
                body = text[lo : lo + SEGMENT] + b"\xff" * (lo + SEGMENT >= size)
                parts.append(b"\xff" * PAD + warm + body)
                start = at + PAD + len(warm)
                coded.append((start, start + len(body)))
                owners.append(i)
                at = start + len(body)
        self.data = np.frombuffer(b"".join(parts), np.uint8) if parts else np.zeros(0, np.uint8)
        self.shape = shape
        spans = np.array(coded, np.int64).reshape(-1, 2)
        lengths = spans[:, 1] - spans[:, 0]
        n = int(lengths.sum())
        #: places in data of the bytes to code, and the text of each
        self.place = np.arange(n) + np.repeat(spans[:, 0] - (np.cumsum(lengths) - lengths), lengths)
        self.owner = np.repeat(np.array(owners, np.int64), lengths)
        self._segment_starts = np.cumsum([0, *map(len, parts)])[:-1].astype(np.int64)
        if n:
            self._contexts()

    def _contexts(self) -> None:
        data, size = self.data, len(self.data)
        # the bytes before, the nearest lowest; the first PAD bytes of all are no text
        last = np.zeros(size, np.uint64)
        last[PAD:] = np.ndarray((size - PAD,), ">u8", data, strides=(1,))
        #: Which code holds at a byte, times 256.
        self.coder = self.shape.contexts.take((last & _U(0xFFFF)).view(np.int64)) * 256
        letter = _LETTER.take(data)
        change = np.flatnonzero(letter[1:] != letter[:-1]) + 1  # the first byte is no letter: words begin and end in turn
        begin, stop = change[::2], change[1::2]  # as many: a segment ends with a byte that is no letter or with its last
        m = len(stop)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((data + _U(1)) * _power(_BASE, size), out=sums[1:])
        back = _power(_INVERSE, size)
        whole = (sums[stop] - sums[begin[:m]]) * back[begin[:m]]
        # from the byte behind a word's first to the one that ends it, the word so far is known
        at, until = begin + 1, np.r_[stop + 1, np.full(len(begin) - m, size)]
        spans = _spans(at, until, size)
        within = sums[:-1] - np.repeat(_among(sums[begin], _U(0)), spans)
        within *= np.repeat(_among(back[begin], _U(0)), spans)
        # a word is over from the byte behind its end to the next word's end, in its own segment
        last_of = np.r_[self._segment_starts, size][np.searchsorted(self._segment_starts, begin[:m], side="right")]
        at = stop + 1
        spans = _spans(at, np.minimum(np.r_[at[1:], size][:m], np.maximum(last_of, at)), size)
        topic = np.repeat(_among(self._topics(whole, begin[:m]).astype(np.uint64) << _U(8), _U(0)), spans)
        previous = np.repeat(_among(whole * _MULS[2], _U(0)), spans)
        byte = last & _U(0xFF)
        topic += byte
        topic += within * _MULS[1]
        previous ^= within
        previous *= _MULS[3]
        previous += byte
        self.hashes = [last & _U(0xFFFFFFFF), topic, previous]
        for k, (own, mul) in enumerate(zip(self.hashes, _MULS)):
            own += _U(k + 1)
            own *= mul
        self._matches(last)

    def _topics(self, words: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The likeliest topic after each word, by all words of its segment so far."""
        known, odds = self.shape.words, self.shape.topics
        out = np.zeros(len(words), np.int64)
        if not len(known) or not len(words):
            return out
        starts, most = self.shape.word_starts
        at = starts.take((words >> _U(48)).view(np.int64))
        for _ in range(most):
            at += known.take(at, mode="clip") < words
        heard = np.flatnonzero(known.take(at, mode="clip") == words)  # other words leave the topic as it is
        at = at[heard]
        first = np.searchsorted(begin, self._segment_starts)
        start = np.searchsorted(heard, first)
        times = np.diff(np.r_[start, len(heard)])
        best, topic = None, np.zeros(len(heard), np.int64)
        for k in range(odds.shape[1]):
            total = np.cumsum(odds[:, k].take(at), dtype=np.float64)
            total = np.rint((total - np.repeat(np.r_[0.0, total][start], times)) * 1e6)
            if k:
                topic[total > best] = k
            best = total if best is None else np.maximum(best, total)
        # each word has the topic of the last heard one of its segment
        last = np.zeros(len(words), np.int64)
        last[heard] = 1
        last = np.cumsum(last)
        own = last > np.repeat(start, np.diff(np.r_[first, len(words)]))
        out[own] = topic[last[own] - 1]
        return out

    def _matches(self, last: np.ndarray) -> None:
        """The byte that followed the last five bytes when they stood in the segment before, and how strong that match is (0: none)."""
        data, size = self.data, len(self.data)
        if size >= 1 << 24:  # a place has 24 bits in a key, as a segment's number has; streams() makes far smaller ones
            raise ValueError("a stream of 2^24 bytes or more: read its segments in several")
        starts = self._segment_starts
        five = np.repeat(np.arange(len(starts), dtype=np.uint64) << _U(40), np.diff(np.r_[starts, size]))
        five |= last & _U(0xFFFFFFFFFF)
        keys = five * _MULS[4]
        keys ^= keys >> _U(32)
        keys *= _MULS[1]
        keys &= _U(0xFFFFFFFFFF000000)
        keys |= np.arange(size, dtype=np.uint64)
        keys.sort()
        same = np.flatnonzero((keys[1:] ^ keys[:-1]) < _U(1 << 24))
        then, now = (keys.take(same) & _U(0xFFFFFF)).view(np.int64), (keys.take(same + 1) & _U(0xFFFFFF)).view(np.int64)
        begun = np.ones(size, bool)  # five bytes of the segment stand before
        begun[(starts[:, None] + np.arange(PAD + 5)).reshape(-1).clip(max=size - 1)] = False
        fits = np.flatnonzero((five.take(now) == five.take(then)) & begun.take(then))
        now, then = now.take(fits), then.take(fits)
        source = np.full(size, -2, np.int64)
        source[now] = then
        self.guess, self.strength = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        self.guess[now] = data.take(then)
        # a run: the match goes on from one byte to the next
        index = np.arange(size)
        run = np.zeros(size, np.int64)
        np.multiply(index[1:], source[1:] != source[:-1] + 1, out=run[1:])
        length = index - np.maximum.accumulate(run)
        self.strength[now] = _STRENGTH.take(length.take(now) + 1, mode="clip")

    def chunks(self, size: int = CHUNK):
        for lo in range(0, len(self.place), size):
            yield Decisions(self, self.place[lo : lo + size]), slice(lo, lo + size)


class Decisions:
    """The binary decisions of the bytes at some places of a stream, byte by byte.

    first: where each byte's decisions begin. bit; depth, at most 3; node: the row of the refinement; match: its code.
    """

    def __init__(self, stream: Stream, place: np.ndarray):
        self.stream, self.place = stream, place
        starts, sizes, steps = stream.shape.walks
        coder, data = stream.coder.take(place), stream.data.take(place)
        own = coder + data
        size = sizes.take(own)
        ends = np.cumsum(size, dtype=np.int64)
        self.first = ends - size
        n = int(ends[-1]) if len(ends) else 0
        step = np.zeros(n, np.uint8)
        step[self.first[1:]] = 1
        self.which = np.cumsum(step, dtype=np.int64)
        at = (starts.take(own) - self.first).take(self.which)
        at += np.arange(n)
        step = steps.take(at)
        self.notes = step.astype(np.uint16)
        step >>= _U(16)
        step *= _PATH
        self.path = step
        self.bit = self.notes.astype(np.uint8) & np.uint8(1)
        # a match holds up to the first decision at which the byte and the guessed one part
        guess, strength = stream.guess.take(place), stream.strength.take(place)
        match = strength.take(self.which)
        match += self.bit * (match > 0)
        wrong = np.flatnonzero((guess != data) & (strength > 0))
        if len(wrong):
            codes, other = stream.shape.codes.reshape(-1), coder.take(wrong) + guess.take(wrong)
            own, ends = own.take(wrong), ends.take(wrong)
            apart = (codes.take(own) << (48 - sizes.take(own).astype(np.int64))) ^ (codes.take(other) << (48 - sizes.take(other).astype(np.int64)))
            part = self.first.take(wrong) + 48 - np.frexp(apart.astype(np.float64))[1]
            match[part] = strength.take(wrong) + (1 - self.bit.take(part))
            over = np.zeros(n + 1, np.int8)
            over[part + 1] = 1
            over[ends] -= 1
            match *= np.cumsum(over[:-1], dtype=np.int8) == 0
        self.match = match

    def __len__(self) -> int:
        return len(self.which)

    def slot(self, k: int) -> np.ndarray:
        h = self.stream.hashes[k].take(self.place).take(self.which)
        h ^= self.path
        h *= _MULS[1]
        h ^= h >> _U(32)
        h *= _MULS[2]
        h >>= _U(64 - self.stream.shape.slots[k])
        return h.view(np.int64)

    def node(self) -> np.ndarray:
        """The row of the refinement: a hash of the code and the path in it."""
        return (self.notes >> 3).astype(np.int64)


@dataclass
class MixingModel:
    """codes: int16 [slots] for each hashed predictor; without: those that leave one occurrence out, in training only.
    maps: log odds of a one [predictor, code]. weights [gates, inputs]. refine [nodes, buckets]."""

    shape: Shape
    codes: list[np.ndarray]
    without: list[np.ndarray] | None
    maps: np.ndarray | None
    weights: np.ndarray | None
    refine: np.ndarray | None = None

    def code(self, k: int, slot: np.ndarray, bit: np.ndarray | None) -> np.ndarray:
        """bit: leave this occurrence out, so that each bit is predicted as if it had been seen one time less."""
        if bit is None:
            return self.codes[k].take(slot)
        slot <<= 1  # a fresh array of slot()
        slot |= bit
        return self.without[k].take(slot)

    def inputs(self, decisions: Decisions, bit: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Log odds [predictor, decision], the last one a constant, and the gates (uint8)."""
        x = np.empty((INPUTS, len(decisions)), np.float32)
        x[-1] = 0.3
        match = decisions.match
        gate = (match >= 2).view(np.uint8) + (match >= 10).view(np.uint8)
        gate += ((decisions.notes >> 1) & 3).astype(np.uint8) * np.uint8(27)
        for k in range(HASHED):
            code = self.code(k, decisions.slot(k), bit)
            np.take(self.maps[k], code, out=x[k], mode="clip")
            if k >= HASHED - 2:  # unseen, one way only, both ways
                gate += ((code >= ONE_WAY).view(np.uint8) + (code >= BOTH_WAYS).view(np.uint8)) * np.uint8(3 if k == HASHED - 1 else 9)
        np.take(self.maps[MATCH], match, out=x[MATCH], mode="clip")
        return x, gate

    def logit(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        weights, gate = self.weights.T.astype(np.float32), gate.astype(np.intp)
        z = (0.3 * weights[-1]).take(gate)
        for own, w in zip(x[:-1], weights):
            z += own * w.take(gate)
        return np.clip(z, -13.8, 13.8, out=z)

    def refined(self, z: np.ndarray, node: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-z))  # float32
        if self.refine is not None:
            p += self.refine.take(node * BUCKETS + bucket(z))
            p *= np.float32(0.5)
        return np.clip(p, 2.0**-20, 1 - 2.0**-20, out=p)

    def byte_logs(self, stream: Stream) -> np.ndarray:
        """log10 probability of every coded byte of the stream, the ends included."""
        out = np.zeros(len(stream.place))
        for decisions, part in stream.chunks():
            p = self.refined(self.logit(*self.inputs(decisions, None)), decisions.node())
            np.abs(np.subtract(p, decisions.bit ^ 1, out=p), out=p)  # of what came true
            sums = np.r_[0.0, np.cumsum(np.log(p, out=p), dtype=np.float64)]
            out[part] = np.diff(sums.take(np.r_[decisions.first, len(decisions)])) / np.log(10)
        return out


def add_counts(tables: list[np.ndarray], stream: Stream, matches: np.ndarray | None = None) -> None:
    """tables: uint32 [2 * slots] of each predictor: counts of zeros and ones. matches [2 * CODES]: those after match codes."""
    found: list[list[np.ndarray]] = [[] for _ in tables]
    for decisions, _ in stream.chunks():
        for k, own in enumerate(found):
            place = decisions.slot(k)
            place <<= 1
            place |= decisions.bit
            own.append(place.astype(np.uint32))
        if matches is not None:
            times = np.bincount(2 * decisions.match.astype(np.int64) + decisions.bit)
            matches[: len(times)] += times
    for table, own in zip(tables, found if len(stream.place) else []):
        place = np.sort(np.concatenate(own))  # so that a table is gone through in order, and once for each place
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        table[place.take(first)] += np.diff(np.r_[first, len(place)]).astype(np.uint32)


def see_codes(seen: np.ndarray, model: MixingModel, stream: Stream) -> None:
    """seen [predictor, code, bit]: how often a bit followed a code; every occurrence is left out of its own counts."""
    for decisions, _ in stream.chunks():
        bit = decisions.bit
        for k in range(HASHED):
            code = model.code(k, decisions.slot(k), bit).astype(np.int64)
            seen[k] += np.bincount(2 * code + bit, minlength=2 * CODES).reshape(-1, 2)
        seen[MATCH] += np.bincount(2 * decisions.match.astype(np.int64) + bit, minlength=2 * CODES).reshape(-1, 2)


def seen_in(table: np.ndarray) -> np.ndarray:
    """What see_codes finds for a predictor over all texts that its table [slots, 2] counts: a slot's n zeros each follow the
    code of its counts without one zero, its ones the code without one one."""
    seen = np.zeros((CODES, 2))
    for lo in range(0, len(table), 1 << 17):
        n = table[lo : lo + (1 << 17)]
        codes = left_out(n).reshape(-1, 2)
        for bit in (0, 1):
            seen[:, bit] += np.bincount(codes[:, bit], n[:, bit], CODES)
    return seen


def maps_of(seen: np.ndarray) -> np.ndarray:
    """Log odds of a one [predictor, code]: what followed a state, with what its counts say as a prior."""
    seen = seen.reshape(HASHED + 1, STATES, 2, 2)  # state, likelier bit, bit
    likelier, other = seen[..., 0, 0] + seen[..., 1, 1], seen[..., 0, 1] + seen[..., 1, 0]
    prior = np.full((HASHED + 1, STATES, 2), 0.4)
    odds = np.exp(np.arange(STEPS) / STEP)
    prior[:HASHED, SMALL * MAGNITUDES :] = 20 * np.stack([odds / (1 + odds), 1 / (1 + odds)], axis=1)
    maps = np.log(likelier + prior[..., 0]) - np.log(other + prior[..., 1])
    maps[:, 0] = 0.0  # unseen
    return np.clip(np.stack([-maps, maps], axis=-1).reshape(HASHED + 1, CODES), -12, 12).astype(np.float32)


#: Pairs of inputs, and of the slope with each input.
_PAIRED = tuple(np.array(x) for x in zip(*[(i, j) for i in range(INPUTS + 1) for j in range(min(i + 1, INPUTS))]))


class Learner:
    """Weights by Newton steps, online in the order of the text; the refinement by what came true in each cell."""

    def __init__(self, model: MixingModel, batch: int = 2048):
        """batch: bytes of the first step; each later one takes twice as many, up to STEP_BYTES."""
        self.model, self.batch = model, batch
        model.weights = np.full((GATES, INPUTS), 0.3)
        self.curve = np.tile(np.eye(INPUTS) * 50.0, (GATES, 1, 1))
        self.cells = np.zeros(2 * REFINED * BUCKETS, np.int64)  # zeros and ones of each

    def read(self, stream: Stream) -> None:
        model, lo = self.model, 0
        while lo < len(stream.place):
            more = np.zeros((len(_PAIRED[0]), GATES))
            for at in range(lo, min(lo + self.batch, len(stream.place)), CHUNK):
                self._add(more, Decisions(stream, stream.place[at : min(at + CHUNK, lo + self.batch)]))
            curve = np.empty((GATES, INPUTS + 1, INPUTS))
            for sums, i, j in zip(more, *_PAIRED):
                curve[:, i, j] = sums
                if i < INPUTS:
                    curve[:, j, i] = sums
            self.curve += curve[:, :INPUTS]
            model.weights -= np.clip(np.linalg.solve(self.curve, curve[:, INPUTS, :, None])[:, :, 0], -0.3, 0.3)
            lo += self.batch
            self.batch = min(2 * self.batch, STEP_BYTES)

    def _add(self, more: np.ndarray, decisions: Decisions) -> None:
        """more [pair, gate]: sums of each pair of inputs, weighted by the bend, and of each input with the slope."""
        model = self.model
        x, gate = model.inputs(decisions, decisions.bit)
        z = model.logit(x, gate)
        np.add.at(self.cells, 2 * (decisions.node() * BUCKETS + bucket(z)) + decisions.bit, 1)
        p = 1 / (1 + np.exp(-z))
        slope, bend = p - decisions.bit, np.maximum(p * (1 - p), 1e-3)
        # a gate's decisions one after the other, so that each sum is over a range
        order = np.argsort(gate, kind="stable")
        times = np.bincount(gate, minlength=GATES)
        there = np.flatnonzero(times)
        first = (np.cumsum(times) - times)[there]
        own = [x[i].take(order) for i in range(INPUTS - 1)] + [np.float32(0.3)]
        bend = bend.take(order)
        bent = [i * bend for i in own] + [slope.take(order)]
        for sums, i, j in zip(more, *_PAIRED):
            sums[there] += np.add.reduceat(bent[i] * own[j], first)

    def state(self) -> tuple[np.ndarray, ...]:
        ones, every = self.cells[1::2].astype(float), self.cells.reshape(-1, 2).sum(axis=1).astype(float)
        return self.curve, np.einsum("gij,gj->gi", self.curve, self.model.weights), ones, every


def joined(states: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights, averaged by their curvature, and the refinement of several learners."""
    if not states:
        states = [Learner(MixingModel(None, [], None, None, None)).state()]
    curve, pulled, ones, every = (sum(x) for x in zip(*states))
    odds = 1 / (1 + np.exp(-(np.arange(BUCKETS) / 2 - 8)))
    refine = (ones.reshape(REFINED, BUCKETS) + 20 * odds) / (every.reshape(REFINED, BUCKETS) + 20)
    return np.linalg.solve(curve, pulled[:, :, None])[:, :, 0], refine.astype(np.float32)


def bucket(z: np.ndarray) -> np.ndarray:
    x = np.rint((z + 8) * 2)
    return np.clip(x, 0, BUCKETS - 1, out=x).astype(np.int64)


def topic_odds(counts: np.ndarray, topics: int = TOPICS, rounds: int = 20) -> np.ndarray:
    """counts [documents, words] -> log odds [words, topics] of a mixture of unigrams, by EM from far-apart documents."""
    if not counts.sum():
        return np.zeros((counts.shape[1], 1), np.float32)
    counts = counts[counts.sum(axis=1) > 0].astype(np.float64)
    overall = counts.sum(axis=0) + 0.5
    overall /= overall.sum()
    unit = np.sqrt(counts / counts.sum(axis=1, keepdims=True))
    heavy = int(np.argmax(counts.sum(axis=1)))
    chosen, near = [heavy], unit @ unit[heavy]
    while len(chosen) < min(topics, len(counts)):
        chosen.append(int(np.argmin(near / np.sqrt(np.minimum(counts.sum(axis=1), 50)))))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    belongs = unit @ unit[chosen].T
    belongs = belongs == belongs.max(axis=1, keepdims=True)
    belongs = belongs / belongs.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        words = belongs.T @ counts + 20 * overall
        words /= words.sum(axis=1, keepdims=True)
        share = (belongs.sum(axis=0) + 1) / (len(counts) + len(chosen))
        logs = counts @ np.log(words).T + np.log(share)
        belongs = np.exp(logs - logs.max(axis=1, keepdims=True))
        belongs /= belongs.sum(axis=1, keepdims=True)
    return (np.log(words) - np.log(overall)).T.astype(np.float32)


ship_by_value(__name__)
