"""Secret scans: fixed patterns, and a character convolutional network over every token.

Every whole text is searched for the fixed patterns and for candidates: all tokens of at least six
characters. Tokens that hold the value of a pattern finding are labelled secrets; numbers, host names
with a known ending and words made of letter triples that are common in the corpus are labelled
harmless; all others are open. The network (one convolution over character classes, max and mean
pooling, a logistic layer; numpy in tasks) learns from two thirds of all different labelled tokens, its
scores are calibrated on the held-out third, and the threshold keeps the wanted recall there with
one-sided confidence. It then scores every candidate with its context, whatever its label; long
candidates are scored piece by piece. What it finds is added to the pattern findings.

Training runs in rounds. A round is one job: every task starts from the same weights and learns from its
share of the round's findings, and the weights of the tasks are averaged. Few findings of a kind are all
learnt from in every round; many are dealt to the rounds, so that each of them is learnt from at least
once and weighs less.

The network reads context, candidate and context as they follow each other, so neighbouring candidates
share most of its places. A place depends on as many characters as the convolution reaches, which are
few classes: what each combination of them activates is tabled once, rounded so that a candidate's score
is bounded from above. Every candidate gets its bound from the tables, by place and not by window, and
those whose bound reaches the threshold are run through the network itself.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semproxy.llm.common import text_bytes, written
from semproxy.llm.quality import binomial_tail
from semproxy.session import scratch_path

# Fixed patterns, in the order kinds are listed; a match must be long enough to stay.
ASSIGN = re.compile(
    rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE,
)
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "model")
LEAST_ASSIGNED, LEAST_ACCESS, LEAST_HEX, LEAST_CANDIDATE = 6, 20, 24, 6

HEX = np.zeros(256, bool)
HEX[list(b"0123456789abcdef")] = True
TOKEN = np.zeros(256, bool)
TOKEN[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_.=-")] = True
# Surely harmless: numbers and rules, host names, and words if their letter triples are common.
NUMBER = re.compile(rb"[+/_.=-]+|[+-]?[0-9]+([./-][0-9]+)*\.?")
ENDINGS = (
    rb"com|org|net|edu|gov|mil|int|info|biz|io|dev|app|local|localhost|eu|uk|de|fr|es|it|nl|be|at|ch|se|no|"
    rb"dk|fi|pl|pt|cz|ie|us|ca|mx|br|ar|au|nz|jp|cn|kr|in|ru"
)
HOST = re.compile(rb"([a-z0-9]([a-z0-9-]{0,18}[a-z0-9])?\.)+(" + ENDINGS + rb")\.?")
WORD = re.compile(rb"([a-z]+|[A-Z][a-z]*|[A-Z]+)(-([a-z]+|[A-Z][a-z]*|[A-Z]+))*\.*")
HARMLESS = (NUMBER, HOST, WORD)
PLAIN = re.compile(rb"(?<![0-9a-z+/_.=-])[a-z]{3,}(?![0-9a-z+/_=])")
LETTERS = 27

CONTEXT, PIECE, STRIDE = 16, 64, 48
WIDTH = PIECE + 2 * CONTEXT
SHORT = 10
KNOWN = 300_000
# Most windows, those of short candidates, are so wide at most.
NARROW = 48
# Windows a task learns from in one round, about.
SHARE = 8192
# Scores of one window may differ by so much between batches.
ROUNDING = 1e-6


def _character_classes() -> np.ndarray:
    """A class per byte; 0 is the padding around a text."""
    classes = np.full(256, 11)
    for number, members in enumerate(
        (b"0123456789", b"abcdef", b"ghijklmnopqrstuvwxyz", b"ABCDEF", b"GHIJKLMNOPQRSTUVWXYZ",
         b"+/=", b"_-", b".", b"\"'", b" \t\n\r", b":"), 1
    ):
        classes[list(members)] = number if number < 11 else 12
    classes[128:] = 13
    return classes


CLASS = _character_classes()
CLASSES = 14
# The classes of the characters of candidates.
TOKENS = (1, 9)
# The classes with the byte between texts as padding around them.
AROUND = CLASS.astype(np.uint8)
AROUND[0] = 0
# One byte of each class, which is all the network sees of a window.
OF_CLASS = bytes(b if b == 0 else 33 if k == 11 else int(np.flatnonzero(CLASS == k)[0]) for b, k in enumerate(CLASS))
# The symbol after a window's end.
PADDING = 2 * CLASSES


@dataclass(frozen=True)
class Training:
    """All labelled findings are learnt from or held out. In a round a class weighs at most as much as
    ``sample`` findings, a third of the harmless ones per form, and a finding as much as ``longest`` of
    its windows; what is more weighs less each. There are ``epochs`` rounds. ``recall`` is kept on
    held-out findings with confidence ``1 - delta``; fewer than ``least`` of a class train nothing. A
    letter triple is common when ``common`` words have it and more than an equal share of all."""

    sample: int = 3000
    least: int = 16
    recall: float = 0.9
    delta: float = 0.05
    filters: int = 16
    reach: int = 5
    epochs: int = 40
    seed: int = 42
    common: int = 5
    longest: int = 64


def long_runs(mask: np.ndarray, least: int) -> np.ndarray:
    """``[start, end)`` of runs of true values at least so long."""
    edges = np.flatnonzero(np.diff(mask, prepend=False, append=False)).reshape(-1, 2)
    return edges[edges[:, 1] - edges[:, 0] >= least]


def pattern_spans(text: bytes, data: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, end, kind)`` of the fixed patterns, in bytes."""
    spans = []
    lowered = text.lower()
    if any(word in lowered for word in KEYWORDS):
        for match in ASSIGN.finditer(text):
            if match.end(2) - match.start(2) >= LEAST_ASSIGNED:
                spans.append((match.start(), match.end(), 0))
    if b"AKIA" in text:
        for match in ACCESS.finditer(text):
            if match.end() - match.start() >= LEAST_ACCESS:
                spans.append((match.start(), match.end(), 1))
    spans += [(start, end, 2) for start, end in long_runs(HEX[data], LEAST_HEX).tolist()]
    return sorted(spans, key=lambda s: (s[0], s[2]))


def pieces(text: bytes, start: int, end: int) -> list[bytes]:
    """Windows of fixed width over a candidate and its context, padded with zero bytes.

    A byte says its place by the window: the candidate's part begins after the context."""
    found = []
    for at in range(start, max(end - PIECE + STRIDE, start + 1), STRIDE):
        left = text[max(0, at - CONTEXT) : at].rjust(CONTEXT, b"\0")
        stop = min(at + PIECE, end)
        right = text[stop : stop + CONTEXT].ljust(CONTEXT, b"\0")
        found.append(left + right + text[at:stop].ljust(PIECE, b"\0"))
    return found


class Slab:
    """Some texts in one run of bytes, with zero bytes between them, and what was found there.

    ``spans`` are pattern findings, ``values`` the secrets in them, ``runs`` all candidates."""

    BYTES = 1 << 19

    def __init__(self, texts: list[bytes]):
        gap = b"\0" * CONTEXT
        self.text = gap + gap.join(texts) + b"\0" * (CONTEXT + PIECE)
        self.data = np.frombuffer(self.text, np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(lengths + CONTEXT) - lengths
        self.spans: list[tuple[int, int, int]] = []
        for start, text in zip(self.starts.tolist(), texts):
            data = self.data[start : start + len(text)]
            self.spans += [(start + s, start + e, kind) for s, e, kind in pattern_spans(text, data)]
        self.values = []
        for start, end, kind in self.spans:
            inner = ASSIGN.match(self.text, start, end) if kind == 0 else None
            self.values.append((inner.start(2) if inner else start, end))
        self.runs = long_runs(TOKEN[self.data], LEAST_CANDIDATE)

    def owners(self, places: np.ndarray) -> np.ndarray:
        """Which text each place is in."""
        return np.searchsorted(self.starts, places, "right") - 1

    def touching(self, spans: list[tuple], whole: bool) -> np.ndarray:
        """Marks candidates that lie inside one of ``spans``, or only touch one."""
        marked = np.zeros(len(self.runs), bool)
        for start, end, *_ in spans:
            first = np.searchsorted(self.runs[:, 1], start, "right")
            last = np.searchsorted(self.runs[:, 0], end)
            part = self.runs[first:last]
            marked[first:last] |= (part[:, 0] >= start) & (part[:, 1] <= end) if whole else True
        return marked

    def lefts(self, text: bytes) -> np.ndarray:
        """The first bytes of the context on the left of each candidate, as numbers of the same order."""
        data = np.frombuffer(text, np.uint8)
        return np.ascontiguousarray(data[self.runs[:, :1] - CONTEXT + np.arange(7)]).astype(np.int64) @ (1 << np.arange(48, -1, -8))

    def words(self, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marks candidates that are one word in small letters, but for the first, and those whose letter
        triples are all common."""
        lowered = self.data | 32
        letter = (lowered >= 97) & (lowered <= 122) & (self.data >= 65) & (self.data <= 122)
        codes = np.where(letter, lowered - 96, 0).astype(np.int32)
        rare = np.zeros(len(codes), bool)
        rare[1:-1] = letter[1:-1] & ~common[(codes[:-2] * LETTERS + codes[1:-1]) * LETTERS + codes[2:]]
        starts, ends = self.runs.T
        other, odd = (np.concatenate([[0], np.cumsum(marks, dtype=np.int32)]) for marks in (self.data < 97, rare))
        other += np.concatenate([[0], np.cumsum(self.data > 122, dtype=np.int32)])
        return letter[starts] & (other[ends] == other[starts + 1]), odd[ends] == odd[starts]

    def points(self) -> np.ndarray:
        """Code points before each byte."""
        return np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])

    def scores(self, network: CharacterNetwork, tables: Tables, runs: np.ndarray) -> np.ndarray:
        """The largest score of each run's windows; 0 where it is surely below the threshold."""
        best = np.zeros(len(runs))
        counts = np.maximum(-(-(runs[:, 1] - runs[:, 0] - PIECE + STRIDE) // STRIDE), 1)
        owner = np.repeat(np.arange(len(runs)), counts)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = runs[owner, 0] + STRIDE * number
        stop = np.minimum(at + PIECE, runs[owner, 1])
        context = AROUND[self.data]
        likely = np.flatnonzero(tables.bounds(context, at, stop) >= network.least_logit)
        for some in np.array_split(likely, -(-len(likely) // 1024) or 1):
            symbols = np.full((len(some), WIDTH), PADDING)
            length = (stop - at)[some, None]
            places = np.arange(WIDTH)
            inside = places < length + 2 * CONTEXT
            read = np.minimum(at[some, None] - CONTEXT + places, len(context) - 1)
            marked = (places >= CONTEXT) & (places < length + CONTEXT)
            symbols[inside] = (context[read] + CLASSES * marked)[inside]
            np.maximum.at(best, owner[some], network.of_symbols(symbols, length[:, 0]))
        return best


def slabs(texts: list[bytes]) -> Iterator[tuple[int, Slab]]:
    """Slabs of bounded bytes, or of one text, each with the number of its first text."""
    first, size = 0, 0
    for number, text in enumerate(texts):
        if size and size + len(text) > Slab.BYTES:
            yield first, Slab(texts[first:number])
            first, size = number, 0
        size += len(text) + CONTEXT
    if first < len(texts):
        yield first, Slab(texts[first:])


def scan_text(text: bytes) -> tuple[list, list]:
    """Pattern spans, and all candidates as ``(start, end)``, in code points."""
    slab = Slab([text])
    points = slab.points() - CONTEXT
    return (
        [(int(points[s]), int(points[e]), kind) for s, e, kind in slab.spans],
        [(int(points[s]), int(points[e])) for s, e in slab.runs.tolist()],
    )


def triples(word: bytes) -> list[int]:
    """Numbers of the letter triples of a word in small letters, with its ends."""
    codes = [0, *(c - 96 for c in word), 0]
    return [(a * LETTERS + b) * LETTERS + c for a, b, c in zip(codes, codes[1:], codes[2:])]


def common_triples(docs: DataFrame, how: Training) -> np.ndarray:
    """Marks the letter triples that are common in the different words of the corpus."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for text in batch.column(0).to_pylist():
                found.update(PLAIN.findall(text.lower()))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary())], names=["word"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros(LETTERS**3, np.int64)
            for word in batch.column(0).to_pylist():
                counts[list(set(triples(word)))] += 1
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["triple", "n"])

    different = docs.select(text_bytes(F.col("text")).alias("text")).mapInArrow(words, "word binary").distinct()
    rows = different.mapInArrow(count, "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(LETTERS**3, np.int64)
    for row in rows:
        counts[row["triple"]] = row["n"]
    return (counts >= how.common) & (counts * len(counts) >= counts.sum())


def harmless_form(token: bytes) -> int:
    """Number of the form in :data:`HARMLESS` the token has, else -1."""
    for kind, form in enumerate(HARMLESS):
        if form.fullmatch(token):
            return kind
    return -1


def harmless_kind(token: bytes, common: np.ndarray) -> int:
    """The same where the token is surely harmless: a word also has common letter triples."""
    kind = harmless_form(token)
    if kind >= 0 and HARMLESS[kind] is WORD:
        parts = token.lower().rstrip(b".").split(b"-")
        return kind if all(common[triples(part)].all() for part in parts) else -1
    return kind


@dataclass(frozen=True)
class CharacterNetwork:
    """Weights of the network, its calibration and the chosen threshold."""

    kernel: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    offset: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    @cached_property
    def least_logit(self) -> float:
        """The logit of the threshold before calibration, a rounding below it."""
        threshold = min(max(self.threshold - ROUNDING, 1e-12), 1 - 1e-12)
        return (np.log(threshold / (1 - threshold)) - self.shift) / self.scale - ROUNDING

    @cached_property
    def single(self) -> np.ndarray:
        """What a symbol (a class, plus ``CLASSES`` in the candidate, or padding) adds to the filters,
        by its place in the reach."""
        kernel = self.kernel.reshape(CLASSES + 1, -1, self.kernel.shape[1]).swapaxes(0, 1)
        marked = kernel[:, :CLASSES] + kernel[:, CLASSES:]
        none = np.zeros((len(kernel), 1, kernel.shape[2]))
        single = np.concatenate([kernel[:, :CLASSES], marked, none], axis=1)
        single[0] += self.bias
        return single.astype(np.float32)

    def probability(self, windows: list[bytes]) -> np.ndarray:
        return self.of_symbols(*in_order(windows))

    def of_symbols(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Scores of windows given as symbols, their candidates of these ``lengths``."""
        return self.calibrated(self.logits(symbols, lengths))

    def calibrated(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -30, 30)))

    def logits(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The same before calibration."""
        reach = len(self.single)
        n = symbols.shape[1] - reach + 1
        active = np.zeros((len(symbols), n, self.kernel.shape[1]), np.float32)
        for back in range(reach):
            active += self.single[back][symbols[:, back : back + n]]
        np.maximum(active, 0, out=active)
        active *= (np.arange(n) < (lengths + 2 * CONTEXT - reach + 1)[:, None])[:, :, None]
        pooled = np.concatenate([active.max(1), active.sum(1) / (WIDTH - reach + 1)], axis=1).astype(np.float64)
        return pooled @ self.dense + self.offset


class Tables:
    """Upper bounds of a network's logits, from what every combination of neighbouring classes
    activates: outside a candidate, inside, and at the places that cross its start or its end.

    ``share`` is what a place adds to the mean part of the logit. ``level`` holds the activation of
    each filter in steps of ``step``, rounded up where the filter raises the logit and down where it
    lowers it; the sixteen of them are one number, so that a place is read at once. The size follows
    from the classes and the reach, not from the data."""

    FILTERS = 16

    def __init__(self, network: CharacterNetwork) -> None:
        single, filters = network.single, network.kernel.shape[1]
        if filters != self.FILTERS:
            raise ValueError(f"bounds are made for {self.FILTERS} filters")
        self.reach = reach = len(single)
        self.offset, self.peak, mean = network.offset, network.dense[:filters], network.dense[filters:]
        self.step = np.maximum(single.max(1).sum(0), 1e-6) / 254
        # Which of the characters of a place are in the candidate, as the tables are numbered.
        patterns = [[False] * reach, [True] * reach]
        patterns += [[False] * k + [True] * (reach - k) for k in range(1, reach)]
        patterns += [[True] * k + [False] * (reach - k) for k in range(1, reach)]
        self.used = [tuple(slice(*TOKENS) if marked else slice(None) for marked in pattern) for pattern in patterns]
        self.share, self.level = [], []
        for pattern in patterns:
            active = np.zeros((1, filters), np.float32)
            for back, marked in enumerate(pattern):
                part = single[back][CLASSES * marked : CLASSES * marked + CLASSES]
                active = (active[:, None, :] + part).reshape(-1, filters)
            np.maximum(active, 0, out=active)
            self.share.append((active @ mean / (WIDTH - reach + 1)).astype(np.float32))
            steps = np.where(self.peak >= 0, np.ceil(active / self.step), np.floor(active / self.step))
            self.level.append(np.ascontiguousarray(steps.astype(np.uint8)).view(np.complex128).ravel())

    def __getstate__(self) -> dict:
        """Only entries that candidates can have travel."""
        shape = (CLASSES,) * self.reach
        tables = {
            name: [table.reshape(shape)[used].copy() for table, used in zip(getattr(self, name), self.used)]
            for name in ("share", "level")
        }
        return {**self.__dict__, **tables}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        for name in ("share", "level"):
            for number, used in enumerate(self.used):
                table = np.zeros((CLASSES,) * self.reach, state[name][number].dtype)
                table[used] = state[name][number]
                state[name][number] = table.ravel()

    def levels(self, table: int, codes: np.ndarray) -> np.ndarray:
        return np.take(self.level[table], codes, mode="clip").view(np.uint8).reshape(-1, self.FILTERS)

    def shares(self, table: int, codes: np.ndarray) -> np.ndarray:
        return np.take(self.share[table], codes, mode="clip")

    def bounds(self, context: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Bounds of the pieces ``[at, stop)`` of a slab given by its classes."""
        reach = self.reach
        codes = np.zeros(len(context) - reach + 1, np.int32)
        for back in range(reach):
            codes *= CLASSES
            codes += context[back : back + len(codes)]
        outside, inside = (np.concatenate([[0.0], np.cumsum(self.shares(t, codes), dtype=np.float64)]) for t in (0, 1))
        # Places wholly in the left context, in the candidate and in the right context.
        wide, left, last = CONTEXT - reach + 1, at - CONTEXT, stop - reach + 1
        logits = self.offset + outside[left + wide] - outside[left] + outside[stop + wide] - outside[stop]
        logits += inside[last] - inside[at]
        blocks = largest_of_eight(self.levels(0, codes))
        top = np.maximum(widest(blocks, left, wide), widest(blocks, stop, wide))
        lengths = last - at
        blocks = largest_of_eight(self.levels(1, codes))
        for length in np.unique(lengths).tolist():
            same = np.flatnonzero(lengths == length)
            top[same] = np.maximum(top[same], widest(blocks, at[same], length))
        for back in range(1, reach):
            for table, places in ((1 + back, at - back), (reach + back, stop - back)):
                crossing = codes[places]
                logits += self.shares(table, crossing)
                np.maximum(top, self.levels(table, crossing), out=top)
        return logits + top.astype(np.float32) @ (self.peak * self.step).astype(np.float32)


def largest_of_eight(levels: np.ndarray) -> list[np.ndarray]:
    """The largest rows of blocks of one, two, four and eight rows from every row on."""
    blocks = [levels]
    for size in (1, 2, 4):
        blocks.append(np.maximum(blocks[-1][:-size], blocks[-1][size:]))
    return blocks


def widest(blocks: list[np.ndarray], start: np.ndarray, length: int) -> np.ndarray:
    """The largest of ``length`` rows from each ``start`` on, by blocks that may overlap."""
    power = min(length.bit_length() - 1, 3)
    size = 1 << power
    found = np.take(blocks[power], start + length - size, axis=0)
    for offset in range(0, length - size, size):
        np.maximum(found, np.take(blocks[power], start + offset, axis=0), out=found)
    return found


def in_order(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows as symbols in the order of the text, with padding at their end, and the lengths of
    their candidates."""
    data = np.frombuffer(b"".join(windows), np.uint8).reshape(len(windows), WIDTH)
    lengths = (data[:, 2 * CONTEXT :] != 0).sum(1)
    places, length = np.arange(WIDTH), lengths[:, None]
    body = (places >= CONTEXT) & (places < CONTEXT + length)
    right = (places >= CONTEXT + length) & (places < 2 * CONTEXT + length)
    source = np.where(body, places + CONTEXT, np.where(right, places - length, np.minimum(places, CONTEXT - 1)))
    classes = np.where(data == 0, 0, CLASS[data])
    symbols = np.take_along_axis(classes, source, axis=1) + CLASSES * body
    return np.where(places < 2 * CONTEXT + length, symbols, PADDING), lengths


def _one_hot(windows: list[bytes]) -> np.ndarray:
    """(rows, width, classes + 1): class of each character; the last channel marks the candidate.
    Padding has no channel."""
    return HOT[in_order(windows)[0]]


def _hot_symbols() -> np.ndarray:
    hot = np.zeros((PADDING + 1, CLASSES + 1), np.float32)
    symbols = np.arange(PADDING)
    hot[symbols, symbols % CLASSES] = 1.0
    hot[symbols, CLASSES] = symbols >= CLASSES
    return hot


HOT = _hot_symbols()


def _forward(hot, kernel, bias, dense, offset):
    """Logits and what the gradients need, as precise as the kernel is given. Windows may come without
    the padding they all end with."""
    rows, width, channels = hot.shape
    taps = kernel.reshape(channels, -1, len(bias)).swapaxes(0, 1)
    n = width - len(taps) + 1
    # Window by window: products so small keep to one thread.
    added = (hot @ np.concatenate(list(taps), axis=1)).reshape(rows, width, len(taps), -1)
    active = bias + sum(added[:, back : back + n, back] for back in range(len(taps)))
    np.maximum(active, 0, out=active)
    # Places that reach into the padding do not count.
    active *= hot[:, len(taps) - 1 :, :CLASSES].any(2)[:, :, None]
    top = active.argmax(1)
    pooled = np.concatenate(
        [np.take_along_axis(active, top[:, None, :], 1)[:, 0], active.sum(1) / (WIDTH - len(taps) + 1)], axis=1
    )
    return pooled @ dense + offset, (active, top, pooled)


def varied(secret: list[bytes], harmless: list[bytes], rng) -> tuple[list[bytes], np.ndarray]:
    """Windows and labels, with secrets also in capitals, shortened, with a dot, and in the context
    of harmless tokens, so that the network does not learn the one spelling, length and surrounding
    the patterns look for."""
    edge = 2 * CONTEXT
    bodies = [w[edge:] for w in secret] + [w[edge:].upper() for w in secret]
    for body in [w[edge:].rstrip(b"\0") for w in secret]:
        length = int(rng.integers(min(SHORT, len(body)), len(body) + 1))
        dot = int(rng.integers(1, max(len(body), 2)))
        bodies += [body[:length], (body[:dot] + b"." + body[dot + 1 :])[: len(body)]]
    around = harmless or secret
    others = [around[i][:edge] for i in rng.integers(0, max(len(around), 1), len(bodies))]
    moved = [context + body.ljust(PIECE, b"\0") for context, body in zip(others, bodies)]
    windows = [*secret, *moved, *harmless]
    return windows, np.repeat([1.0, 0.0], [len(secret) + len(moved), len(harmless)])


# Windows a secret's window becomes.
VARIED = 5

# Windows of a finding, and what each of them weighs.
Finding = tuple[list[bytes], float]


def _varied_findings(secret: list[Finding], harmless: list[Finding], rng) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, lengths of candidates, labels and weights of the varied windows of findings."""
    (secrets_, of_secrets), (others, of_others) = (
        ([w for windows, _ in found for w in windows], np.array([x for windows, x in found for _ in windows]))
        for found in (secret, harmless)
    )
    windows, labels = varied(secrets_, others, rng)
    # As they are, moved, in capitals, and two more of each in turn.
    weights = np.concatenate([of_secrets, of_secrets, of_secrets, np.repeat(of_secrets, 2), of_others])
    symbols, lengths = in_order(windows)
    return symbols.astype(np.uint8), lengths, labels, weights


@dataclass(frozen=True)
class Weights:
    """Parameters of the network with the moments of their gradients, after ``step`` batches."""

    values: tuple
    first: tuple
    second: tuple
    step: int = 0

    @staticmethod
    def shapes(how: Training) -> list[tuple]:
        return [(how.reach * (CLASSES + 1), how.filters), (how.filters,), (2 * how.filters,), ()]

    @staticmethod
    def start(how: Training) -> Weights:
        rng, shapes = np.random.default_rng(how.seed), Weights.shapes(how)
        none = tuple(np.zeros(shape) for shape in shapes)
        return Weights(tuple(rng.normal(0, 0.15, shape) for shape in shapes), none, none)

    def flat(self) -> np.ndarray:
        return np.concatenate([np.ravel(part) for part in (*self.values, *self.first, *self.second)])

    @staticmethod
    def of_flat(flat: np.ndarray, step: int, how: Training) -> Weights:
        parts, at = [], 0
        for shape in Weights.shapes(how) * 3:
            size = int(np.prod(shape))
            parts.append(flat[at : at + size].reshape(shape))
            at += size
        return Weights(*(tuple(parts[i : i + 4]) for i in (0, 4, 8)), step)

    def network(self, scale: float = 1.0, shift: float = 0.0, threshold: float = 0.5) -> CharacterNetwork:
        return CharacterNetwork(*self.values[:3], float(self.values[3]), scale, shift, threshold)

    def gradients(self, symbols: np.ndarray, labels: np.ndarray, weights: np.ndarray, how: Training) -> list:
        """Sums over windows of one width."""
        hot = HOT[symbols]
        kernel, bias, dense, offset = (np.asarray(value, np.float32) for value in self.values)
        logits, (active, top, pooled) = _forward(hot, kernel, bias, dense, offset)
        error = ((1 / (1 + np.exp(-np.clip(logits, -30, 30))) - labels) * weights).astype(np.float32)
        back = error[:, None] * dense[None, :]
        places = active.shape[1]
        slope = np.repeat(back[:, None, how.filters :] / (WIDTH - how.reach + 1), places, axis=1)
        at_top = np.take_along_axis(slope, top[:, None, :], 1)
        np.put_along_axis(slope, top[:, None, :], at_top + back[:, None, : how.filters], 1)
        slope *= active > 0
        taps = [(hot[:, i : i + places].transpose(0, 2, 1) @ slope).sum(0) for i in range(how.reach)]
        return [np.stack(taps, axis=1).reshape(-1, how.filters), slope.sum((0, 1)), pooled.T @ error, error.sum()]

    def learnt(self, symbols: np.ndarray, lengths: np.ndarray, labels: np.ndarray, weights: np.ndarray, how: Training, rng) -> Weights:
        """One pass over windows in batches of random order."""
        now, width = self, lengths + 2 * CONTEXT
        for batch in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // 64)):
            # Most windows are short ones and need not be padded for the others.
            short = width[batch] <= NARROW
            parts = [(part, n) for part, n in ((batch[short], NARROW), (batch[~short], WIDTH)) if len(part)]
            sums = [now.gradients(symbols[part, :n], labels[part], weights[part], how) for part, n in parts]
            grads = [np.asarray(sum(some), np.float64) / len(batch) for some in zip(*sums)]
            grads[0] += 1e-4 * now.values[0]
            grads[2] += 1e-4 * now.values[2]
            step = now.step + 1
            first = tuple(0.9 * old + 0.1 * grad for old, grad in zip(now.first, grads))
            second = tuple(0.999 * old + 0.001 * grad**2 for old, grad in zip(now.second, grads))
            values = tuple(
                value - 0.01 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
                for value, a, b in zip(now.values, first, second)
            )
            now = Weights(values, first, second, step)
        return now


def held_logits(network: CharacterNetwork, secret: list[Finding], harmless: list[Finding], rng):
    """Labels, logits and weights of the varied windows, and the largest logit of each secret's own."""
    symbols, lengths, labels, weights = _varied_findings(secret, harmless, rng)
    logits = np.zeros(len(symbols))
    order = np.argsort(lengths, kind="stable")
    for part in np.array_split(order, max(1, -(-len(order) // 1024))):
        width = 2 * CONTEXT + lengths[part].max(initial=0)
        logits[part] = network.logits(symbols[part, :width], lengths[part])
    counts = [len(windows) for windows, _ in secret]
    best = np.full(len(secret), -np.inf)
    np.maximum.at(best, np.repeat(np.arange(len(secret)), counts), logits[: sum(counts)])
    return labels, logits, weights, best


def train_network(secret: list, harmless: list, how: Training) -> CharacterNetwork:
    """Train on findings at hand, calibrate on every third of them, held out, and choose the threshold
    there; :func:`fit_network` does the same with tables.

    A finding is its window or the list of its windows. The threshold sees every held-out secret
    once and as it was found, by the largest score of its windows."""
    rng = np.random.default_rng(how.seed)
    found = [[([f] if isinstance(f, bytes) else f, 1.0) for f in findings] for findings in (secret, harmless)]
    symbols, lengths, labels, weights = _varied_findings(*([f for i, f in enumerate(fs) if i % 3] for fs in found), rng)
    for label in (0.0, 1.0):
        weights[labels == label] *= 0.5 * len(labels) / weights[labels == label].sum()
    state = Weights.start(how)
    for _ in range(how.epochs):
        state = state.learnt(symbols, lengths, labels, weights, how, rng)
    labels, logits, weights, best = held_logits(state.network(), *(fs[::3] for fs in found), rng)
    scale, shift = _calibrate(_plain_sums(labels, logits, weights))
    return _with_threshold(state, scale, shift, best, how)


def _with_threshold(state: Weights, scale: float, shift: float, best: np.ndarray, how: Training) -> CharacterNetwork:
    """The calibrated network with the threshold from the ``best`` logits of held-out secrets."""
    scores = np.sort(state.network(scale, shift).calibrated(best))
    threshold = recall_threshold(scores, how.recall, how.delta)
    # What is more likely a secret than not is always a finding; rounding must not lose the last one.
    return state.network(scale, shift, min(0.5, threshold) - ROUNDING)


def _targets(positives: float, negatives: float) -> tuple[float, float]:
    """Smoothed targets of both labels."""
    return (positives + 1) / (positives + 2), 1 / (negatives + 2)


# Loss, two parts of its gradient and three of its curvature at a scale and a shift.
Sums = Callable[[float, float], tuple[float, float, float, float, float, float]]


def _plain_sums(labels: np.ndarray, logits: np.ndarray, weights: np.ndarray) -> Sums:
    high, low = _targets(weights[labels == 1].sum(), weights[labels == 0].sum())
    target = np.where(labels == 1, high, low)

    def sums(scale: float, shift: float):
        z = scale * logits + shift
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        gap, bend = weights * (p - target), weights * p * (1 - p)
        loss = weights * (np.logaddexp(0, z) - target * z)
        parts = (loss, gap * logits, gap, bend * logits**2, bend * logits, bend)
        return tuple(float(part.sum()) for part in parts)

    return sums


def _table_sums(held: DataFrame) -> Sums:
    """The same over a table ``(label, logit, weight)``, one aggregate a call."""
    of = {row["label"]: row["n"] for row in held.groupBy("label").agg(F.sum("weight").alias("n")).collect()}
    high, low = _targets(of.get(1.0, 0.0), of.get(0.0, 0.0))
    x, w = F.col("logit"), F.col("weight")
    target = F.when(F.col("label") == 1, high).otherwise(low)

    def sums(scale: float, shift: float):
        z = scale * x + shift
        p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
        gap, bend = w * (p - target), w * p * (1 - p)
        loss = w * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - target * z)
        parts = (loss, gap * x, gap, bend * x * x, bend * x, bend)
        return tuple(held.agg(*[F.sum(part) for part in parts]).first())

    return sums


def _calibrate(sums: Sums) -> tuple[float, float]:
    """Platt scaling by Newton steps on held-out findings, with smoothed targets."""
    at = np.array([1.0, 0.0])
    loss, *slopes = sums(*at.tolist())
    for _ in range(50):
        a, b, c = slopes[2:]
        curvature = np.array([[a, b], [b, c]]) + 1e-3 * np.eye(2)
        move = np.linalg.solve(curvature, np.array(slopes[:2]))
        if np.abs(move).max() <= 1e-9:
            break
        # A full step overshoots where almost all scores are sure.
        while (tried := sums(*(at - move).tolist()))[0] > loss and np.abs(move).max() > 1e-9:
            move = move / 2
        at, (loss, *slopes) = at - move, tried
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def recall_threshold(scores: np.ndarray, recall: float, delta: float) -> float:
    """The largest threshold that misses so few of the sorted held-out secrets that a miss rate
    above ``1 - recall`` is refuted at ``delta``; if they are too few for that, it misses none."""
    missed = bisect_right(range(len(scores)), delta, key=lambda k: binomial_tail(k, len(scores), 1 - recall)) - 1
    return float(scores[max(missed, 0)])


def labelled_findings(docs: DataFrame, common: np.ndarray, how: Training) -> DataFrame:
    """``(key, kind, windows)`` of every different labelled token: the hash of the token, 0 for a secret
    or the number of the harmless form plus one, and its windows without the padding at their end, in
    characters that stand for their classes.

    A token comes once however often it stands, as a secret if it is one anywhere, with its least windows,
    so that nothing depends on partitions. A task forgets what it knows when that gets much."""
    word = HARMLESS.index(WORD) + 1

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of secrets and harmless tokens: the start of the least left context as a number, -1 for tokens
        # that stay open; the kind; the least windows.
        secret: tuple[dict, dict, dict] = ({}, {}, {})
        harmless: tuple[dict, dict, dict] = ({}, {}, {})

        def windows(text: bytes, start: int, end: int) -> bytes | list[bytes]:
            if end - start <= STRIDE:
                return text[start - CONTEXT : start] + text[end : end + CONTEXT] + text[start:end]
            return [window.rstrip(b"\0") for window in pieces(text, start, end)]

        def add(known: tuple, token: bytes, left: int, kind: int, text: bytes, start: int, end: int) -> None:
            lefts, kinds, shown = known
            here = windows(text, start, end)
            lefts[token], kinds[token] = left, kind
            shown[token] = min(shown.get(token, here), here)

        def found() -> pa.RecordBatch:
            keys, kinds, flat, ends = [], [], [], [0]
            for _, of_kind, shown in (secret, harmless):
                for token, some in shown.items():
                    keys.append(_signed(xxhash.xxh3_64_intdigest(token)))
                    flat += [some] if isinstance(some, bytes) else some
                    ends.append(len(flat))
                kinds += of_kind.values()
            for known in (*secret, *harmless):
                known.clear()
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.binary()))
            columns = [pa.array(keys, pa.int64()), pa.array(kinds, pa.int32()), lists]
            return pa.RecordBatch.from_arrays(columns, names=["key", "kind", "windows"])

        for batch in batches:
            for _, slab in slabs(batch.column(0).to_pylist()):
                text, plain = slab.text, slab.text.translate(OF_CLASS)
                marked, inside = slab.touching(slab.values, False), slab.touching(slab.spans, False)
                (plain_word, usual), lefts = slab.words(common), slab.lefts(plain)
                for number in np.flatnonzero(marked).tolist():
                    start, end = slab.runs[number].tolist()
                    token, left = text[start:end], int(lefts[number])
                    if left <= secret[0].get(token, left):
                        add(secret, token, left, 0, plain, start, end)
                known = harmless[0]
                outside = [a[~inside].tolist() for a in (*slab.runs.T, lefts, plain_word, usual)]
                for start, end, left, is_word, is_usual in zip(*outside):
                    token = text[start:end]
                    least = known.get(token)
                    if least is None:
                        form = word if is_word else harmless_form(token) + 1
                        if form == word and not is_usual:
                            form = 0
                        if form:
                            add(harmless, token, left, form, plain, start, end)
                        else:
                            known[token] = -1
                    elif left <= least:
                        add(harmless, token, left, harmless[1][token], plain, start, end)
                if len(known) + len(secret[0]) >= KNOWN:
                    yield found()
        yield found()

    rows = docs.select(text_bytes(F.col("text")).alias("text")).mapInArrow(
        label, "key long, kind int, windows array<binary>"
    )
    split = _split(how)
    least = rows.select("*", *split).repartition("held", "turn", F.pmod(F.xxhash64("key", F.lit(2)), F.lit(4)))
    least = least.groupBy("held", "turn", F.pmod(F.xxhash64("key", F.lit(2)), F.lit(4)), "key").agg(F.min(F.struct("kind", "windows")).alias("least"))
    return least.select("key", "least.*")


def _split(how: Training) -> list[Column]:
    """Whether a finding is held out, and its turn among the rounds."""
    turn = F.pmod(F.xxhash64("key"), F.lit(how.epochs)).cast("int")
    return [(F.pmod(F.col("key"), F.lit(3)) == 0).alias("held"), turn.alias("turn")]


def labelled_sample(docs: DataFrame, common: np.ndarray, how: Training) -> dict[int, list[list[bytes]]]:
    """A bounded look at the labelled findings, for inspection: the first ``how.sample`` windows lists
    per class in the order of their hashes, at most ``how.longest`` windows each, evenly spread. The
    scan learns from all findings."""
    rows = labelled_findings(docs, common, how)
    sample = {}
    for secret, kind in ((1, F.col("kind") == 0), (0, F.col("kind") > 0)):
        found = [row["windows"] for row in rows.where(kind).orderBy("key").limit(how.sample).collect()]
        sample[secret] = [[bytes(w).ljust(WIDTH, b"\0") for w in windows[:: -(-len(windows) // how.longest)]] for windows in found]
    return sample


def _findings(rows: pa.Table, factors: list[float], how: Training) -> tuple[list[Finding], list[Finding]]:
    """Secrets and harmless findings of a table in the order of their keys, a window's weight being the
    factor of its kind, and less in a finding of many windows."""
    found: tuple[list[Finding], list[Finding]] = ([], [])
    rows = rows.sort_by([("kind", "ascending"), ("key", "ascending")])
    for kind, windows in zip(rows["kind"].to_pylist(), rows["windows"].to_pylist()):
        weight = factors[kind] * min(1.0, how.longest / len(windows))
        found[int(kind > 0)].append(([w.ljust(WIDTH, b"\0") for w in windows], weight))
    return found


def fit_network(findings: DataFrame, how: Training) -> CharacterNetwork | None:
    """The network of all labelled findings; None if there are too few.

    A third is held out by hash. The others are dealt to tasks and, kinds with more findings than weigh
    in a round, to rounds; a round is one job, and all are one job where one task has all findings."""
    path = scratch_path(findings.sparkSession, "secret-findings")
    findings = findings.select("key", "kind", "windows", *_split(how))
    findings.write.partitionBy("held", "kind", "turn").parquet(path)
    # A round reads only the folders of its turn.
    findings = findings.sparkSession.read.schema(findings.schema).parquet(path)
    size = F.size("windows")
    rows = findings.groupBy("kind", "held").agg(
        F.count("*").alias("n"), F.sum(size).alias("windows"), F.sum(F.least(size, F.lit(how.longest))).alias("weighed")
    )
    counts = {(row["kind"], row["held"]): row for row in rows.collect()}
    kinds = range(len(HARMLESS) + 1)

    def total(column: str, kind: int, *parts: bool) -> int:
        return sum(counts[kind, part][column] for part in parts or (False, True) if (kind, part) in counts)

    for some in (kinds[:1], kinds[1:]):
        if sum(total("n", kind) for kind in some) < how.least:
            return None
        if not all(any(total("n", kind, part) for kind in some) for part in (False, True)):
            return None
    bounds = [how.sample] + [how.sample // len(HARMLESS)] * len(HARMLESS)
    learnt = [2 * bound / 3 for bound in bounds]
    periods = [min(how.epochs, max(1, int(total("n", k, False) / learnt[k]))) for k in kinds]
    # The weight of a finding, what a class weighs and the windows it has in a round.
    factors = [min(1.0, learnt[k] * periods[k] / max(total("n", k, False), 1)) for k in kinds]
    copies = [VARIED] + [1] * len(HARMLESS)
    weighs = [copies[k] * factors[k] * total("weighed", k, False) / periods[k] for k in kinds]
    windows = sum(copies[k] * total("windows", k, False) / periods[k] for k in kinds)
    factors = [f * 0.5 * windows / (weighs[0] if k == 0 else sum(weighs[1:])) for k, f in enumerate(factors)]

    def dealt(shards: int) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")

    shards = int(-(-windows // SHARE))
    rows = findings.where("NOT held").select("key", "kind", "windows", "turn", dealt(shards))
    state = Weights.start(how)
    step = 1 if shards > 1 else how.epochs
    for begin in range(0, how.epochs, step):
        turns = [(F.col("kind") == k) & (F.col("turn") % p == begin % p) for k, p in enumerate(periods)]
        now = rows if step > 1 else rows.where(reduce(Column.__or__, turns))
        state = _rounds(now, state, range(begin, begin + step), shards, periods, factors, how)

    network = state.network()
    held_factors = [min(1.0, bounds[k] / 3 / max(total("n", k, True), 1)) for k in kinds]

    def score(key: tuple, table: pa.Table) -> pa.Table:
        rng = np.random.default_rng([how.seed, how.epochs, key[0].as_py()])
        secret, harmless = _findings(table, held_factors, how)
        labels, logits, weights, best = held_logits(network, secret, harmless, rng)
        # A secret's best has no weight.
        columns = [np.append(labels, np.ones(len(best))), np.append(logits, best)]
        weights = pa.array([*weights.tolist(), *[None] * len(best)], pa.float64())
        return pa.table([pa.array(columns[0]), pa.array(columns[1]), weights], ["label", "logit", "weight"])

    shards = -(-sum(copies[k] * total("windows", k, True) for k in kinds) // SHARE)
    scored = findings.where("held").select("key", "kind", "windows", dealt(shards)).repartition(shards, "shard")
    scored = written(scored.groupBy("shard").applyInArrow(score, "label double, logit double, weight double"), "held-secrets")
    scale, shift = _calibrate(_table_sums(scored.where("weight IS NOT NULL")))
    # One number per held-out secret.
    best = scored.where("weight IS NULL").select("logit").toArrow().column(0).to_numpy()
    return _with_threshold(state, scale, shift, best, how)


def _rounds(
    rows: DataFrame, state: Weights, numbers: range, shards: int, periods: list[int], factors: list[float], how: Training
) -> Weights:
    """The mean of what the shards have learnt in rounds, by their windows."""

    def learn(key: tuple, table: pa.Table) -> pa.Table:
        mine, seen = state, 0
        period = np.asarray(periods)[table["kind"].to_numpy()]
        for number in numbers:
            rng = np.random.default_rng([how.seed, number, key[0].as_py()])
            now = table["turn"].to_numpy() % period == number % period
            symbols, lengths, labels, weights = _varied_findings(*_findings(table.filter(pa.array(now)), factors, how), rng)
            if len(labels):
                mine = mine.learnt(symbols, lengths, labels, weights, how, rng)
                seen += len(labels)
        columns = [pa.array([key[0].as_py()], pa.int32()), pa.array([seen], pa.int64()), pa.array([mine.step], pa.int64())]
        return pa.table([*columns, pa.array([mine.flat()], pa.list_(pa.float64()))], ["shard", "seen", "step", "flat"])

    found = rows.repartition(shards, "shard").groupBy("shard").applyInArrow(
        learn, "shard int, seen long, step long, flat array<double>"
    )
    parts = sorted(row for row in found.collect() if row["seen"])
    if not parts:
        return state
    flat = np.average([row["flat"] for row in parts], axis=0, weights=[row["seen"] for row in parts])
    return Weights.of_flat(flat, max(row["step"] for row in parts), how)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


SPANS = "array<struct<start:bigint,end:bigint,kind:int,score:double>>"


def scan_secrets(docs: DataFrame, how: Training = Training()) -> DataFrame:
    """``(doc_id, spans array<struct<start, kind, end, score>>)`` of ``docs(doc_id, text)``.

    The text is read three times: for its words, for the labelled findings and for the spans, where
    every token outside the pattern findings is scored. A null or empty text has no spans. Repeated
    rows are scanned each, copies have equal spans. With too few labelled findings (so in an empty
    table) only pattern spans are returned. Extra columns are ignored."""
    network = fit_network(labelled_findings(docs, common_triples(docs, how), how), how)
    # Built once; their size is fixed by the classes and the reach.
    shared = docs.sparkSession.sparkContext.broadcast(None if network is None else Tables(network))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for first, slab in slabs(batch.column(1).to_pylist()):
                spans = [(*span, 1.0) for span in slab.spans]
                if network is not None:
                    runs = slab.runs[~slab.touching(slab.spans, True)]
                    scores = slab.scores(network, shared.value, runs)
                    above = scores >= network.threshold
                    spans += [
                        (*run, 3, score) for run, score in zip(runs[above].tolist(), scores[above].tolist())
                    ]
                if not spans:
                    continue
                points = slab.points()
                owners = slab.owners(np.array([span[0] for span in spans])).tolist()
                for owner, (start, end, kind, score) in zip(owners, spans):
                    before = points[slab.starts[owner]]
                    rows[first + owner].append(
                        {"start": int(points[start] - before), "end": int(points[end] - before), "kind": kind, "score": score}
                    )
            span = pa.struct(
                [("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("score", pa.float64())]
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(span))], names=["doc_id", "spans"]
            )

    scored = docs.select("doc_id", text_bytes(F.col("text")).alias("text")).mapInArrow(
        scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPANS}"
    )
    ordered = F.array_sort(
        F.transform(
            "spans",
            lambda s: F.struct(
                s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["score"].alias("score")
            ),
        )
    )
    return scored.select("doc_id", ordered.alias("spans"))


def _said(spans: Column) -> Column:
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def secret_report(docs: DataFrame, how: Training = Training()) -> DataFrame:
    """Counts, digest and list of the spans of every row."""
    scanned = scan_secrets(docs, how)

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] < 3)
    return scanned.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_said(base), 256).alias("base_sha256"),
        _said(F.col("spans")).alias("spans"),
        count(3).alias("n_model"),
    )
