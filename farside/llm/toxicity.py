"""Toxicity: a support vector machine over a subsequence string kernel with Nystroem landmarks.

Two strings are compared by the gap-weighted subsequence kernel (subsequences of `order` letters, `decay` for every letter
spanned in each), divided by the root of both strings' own values: 1 for equal strings, less for every letter inserted or
left out. A word's features are its values for all landmarks times the inverse square root of the landmarks' own kernel
matrix, as Nystroem's method has it; no value is cut off or rounded. Landmarks are strings that set apart the toxic texts
of a bounded, labelled sample, and the words of its clean texts that come nearest to those.

The machine (linear, squared hinge) is trained on sentences: one is as toxic as its most toxic word, so every word of a
clean sentence is an example of its kind. Labels are known for whole texts only: of a toxic text the word that the machine
finds most toxic is the example, chosen anew in every round, together with forms of it that have letters inserted or left
out. A text scores as its most toxic sentence, calibrated to 0..1.

Values are linear in a word's weighted subsequences, so when scoring the machine is one table: a number for every four
letters, summed over a word's subsequences and divided by the root of the word's own value.

Letters spaced out one by one are read as one word, characters that are not letters are dropped from within words, and
longer words are read in overlapping pieces.

Defined results: null and empty texts score like a sentence of short words (below `order` letters, so without a value);
texts are whole, words of any length are read whole in pieces; without a label of each kind every score is 0; null labels,
labels without a text and repeats of a labelled id are not used; an empty table gives an empty result; other columns are
kept, and a clash of names with the new one is avoided by leading underscores.
"""

from __future__ import annotations

import functools
import itertools
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import column_name, discard, small_batches, stash, tidy, trim

#: Letters in a piece of a longer word, and from one piece's start to the next one's: short pieces for what stands within
#: a word or before an ending, long ones for long insults.
SCALES = ((8, 2), (12, 4))
WIDTH = 12
#: Strings looked up together, so that their keys stay in the processor's cache.
STEP = 256
#: Rows of features that the fit copies at a time.
ROWS = 4096
START = "^"
#: From this kernel value on a word of a toxic text is an example for a landmark.
HELD = 0.6
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
_NO_LETTERS = re.compile(r"[\W\d_]+")


@dataclass
class Settings:
    """max_per_class bounds the labelled rows that the fit reads of each class, by order of a hash of their id, and
    max_bytes their texts together. clean_weight is the share that clean texts have in the calibration: above a half, as a
    clean text lost counts for more than a toxic one kept. forms: a quarter of the altered forms of each landmark. max_words: the
    pieces of clean words that the machine is trained on, those nearest to a landmark."""

    max_per_class: int = 2000
    max_bytes: int = 64 << 20
    max_words: int = 30_000
    landmarks: int = 96
    order: int = 4
    decay: float = 0.9
    rounds: int = 4
    cost: float = 1000.0
    forms: int = 6
    clean_weight: float = 0.96


def words_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    return _SPACED.sub(lambda m: m.group().replace(" ", "").replace("\t", ""), text).split()


def letters_of(word: str) -> str:
    """START and the letters of a word."""
    return START + (word if word.isalpha() else _NO_LETTERS.sub("", word))


def _starts(size: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a string: of each scale so many that any width - stride + 1 letters are in one."""
    found = [(k, min(k + width, size)) for width, stride in SCALES for k in range(0, max(1, size - width + stride), stride)]
    return sorted(set(found))


def pieces(word: str) -> list[str]:
    """START and the letters of a word, in overlapping pieces of at most WIDTH."""
    w = letters_of(word)
    return [w[a:b] for a, b in _starts(len(w))]


def _codes(strings: list[str]) -> np.ndarray:
    return np.array(strings, f"U{WIDTH}").view(np.uint32).reshape(len(strings), WIDTH)


def subsequence_kernel(s: np.ndarray, t: np.ndarray, order: int, decay: float) -> np.ndarray:
    """Gap-weighted subsequence kernel of rows of letter codes, pair by pair (0 pads the end)."""
    if not len(s):
        return np.zeros(0)
    ls, lt = int((s != 0).sum(axis=1).max()), int((t != 0).sum(axis=1).max())
    s, t = np.ascontiguousarray(s[:, :ls].T), np.ascontiguousarray(t[:, :lt].T)
    n, d = s.shape[1], np.float32(decay)
    same = [[(x == y) & (x != 0) for y in t] for x in s]
    before = np.ones((ls + 1, lt + 1, n), np.float32)
    for _ in range(order - 1):
        now = np.zeros((ls + 1, lt + 1, n), np.float32)
        for i in range(ls):
            run = np.zeros(n, np.float32)
            for j in range(lt):
                run = d * run + d * d * before[i, j] * same[i][j]
                now[i + 1, j + 1] = d * now[i, j + 1] + run
        before = now
    total = np.zeros(n, np.float32)
    for i in range(ls):
        for j in range(lt):
            total += d * d * before[i, j] * same[i][j]
    return total.astype(np.float64)


@functools.cache
def _choices(length: int, order: int, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """The places of all subsequences of `order` letters of a word, and decay to the letters each spans."""
    at = np.array(list(itertools.combinations(range(length), order)), np.int64).reshape(-1, order)
    return at, (decay ** (at[:, -1] - at[:, 0] + 1)).astype(np.float32)


@functools.cache
def _pairs(length: int, order: int) -> np.ndarray | None:
    """For each row of _choices, the places of its first and of its last two letters in the list of all pairs of places;
    None for another order than four."""
    if order != 4:
        return None
    number = {p: k for k, p in enumerate(itertools.combinations(range(length), 2))}
    at, _ = _choices(length, order, 1.0)
    return np.array([(number[a, b], number[c, d]) for a, b, c, d in at.tolist()], np.int64).reshape(-1, 2)


class OwnValues:
    """Roots of strings' own kernel values. These follow from which letters of a string are equal, so each pattern of
    equal letters is worked out once; the table is emptied when full."""

    MOST = 100_000

    def __init__(self, order: int, decay: float):
        self.order, self.decay = order, decay
        self.known: dict[int, float] = {}

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """Of rows of codes of one length, without padding."""
        pattern = np.full(len(codes), codes.shape[1], np.int64)
        columns = np.ascontiguousarray(codes.T)
        for i, column in enumerate(columns):
            first = np.full(len(codes), i, np.int64)
            for j in range(i - 1, -1, -1):
                first[columns[j] == column] = j
            pattern = pattern * WIDTH + first
        kinds, at, kind = np.unique(pattern, return_index=True, return_inverse=True)
        new = np.array([k for k, p in enumerate(kinds.tolist()) if p not in self.known], np.int64)
        if len(self.known) + len(new) > self.MOST:
            self.known, new = {}, np.arange(len(kinds))
        rows = codes[at[new]]
        for k in range(0, len(new), 2048):
            part = rows[k : k + 2048]
            value = np.sqrt(subsequence_kernel(part, part, self.order, self.decay))
            self.known.update(zip(kinds[new[k : k + 2048]].tolist(), value.tolist()))
        return np.array([self.known[p] for p in kinds.tolist()])[kind.reshape(-1)]


class Subsequences:
    """The subsequences of `order` letters that some landmark has, numbered from 1; all others are 0. Letters are digits
    of a key (0: in no landmark), and keys are looked up directly if the letters are few enough for a table of them."""

    def __init__(self, strings: list[str], order: int, decay: float):
        codes = _codes(strings)
        self.letters, self.order, self.decay = np.unique(codes[codes > 0]), order, decay
        self.base, self.own = len(self.letters) + 1, OwnValues(order, decay)
        keys = [self._keys(c[c > 0][None, :])[0][:, 0] for c in codes]
        self.found = np.unique(np.concatenate(keys))
        self.direct = None
        if self.base**order <= 1 << 23:
            self.direct = np.zeros(self.base**order, np.int32)
            self.direct[self.found] = np.arange(1, len(self.found) + 1)

    def _keys(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(subsequences, rows) keys of rows of codes of one length, and the subsequences' weights."""
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        digits = np.where(self.letters[at] == codes, at + 1, 0).T
        digits = np.ascontiguousarray(digits, np.int32 if self.base**self.order < 1 << 31 else np.int64)
        places, weight = _choices(codes.shape[1], self.order, self.decay)
        ends = _pairs(codes.shape[1], self.order)
        if ends is not None and len(ends):
            a, b = np.array(list(itertools.combinations(range(codes.shape[1]), 2))).T
            two = digits[a] * digits.dtype.type(self.base) + digits[b]
            key = (two * digits.dtype.type(self.base**2))[ends[:, 0]]
            key += two[ends[:, 1]]
            return key, weight
        key = np.zeros((len(places), len(codes)), digits.dtype)
        for place in places.T:
            key *= self.base
            key += digits[place]
        return key, weight

    def numbers(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key, weight = self._keys(codes)
        if self.direct is not None:
            return self.direct[key], weight
        at = np.minimum(np.searchsorted(self.found, key), len(self.found) - 1)
        return np.where(self.found[at] == key, at + 1, 0), weight

    def sums(self, codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """For rows of codes of one length: of all subsequences, the weight times the number in each of the tables."""
        out = np.zeros((len(tables), len(codes)), np.float64)
        for k in range(0, len(codes), STEP):
            number, weight = self.numbers(codes[k : k + STEP])
            for row, table in zip(out, tables):
                row[k : k + STEP] = weight @ table[number]
        return out

    def profile(self, code: np.ndarray) -> np.ndarray:
        """One string's own table: the summed weights of each of its subsequences."""
        number, weight = self.numbers(code[code > 0][None, :])
        return np.bincount(number[:, 0], weight, len(self.found) + 1).astype(np.float32)


def _by_length(strings: list[str], least: int):
    """(places, codes without padding) of the strings with `least` letters or more, length by length."""
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    for n in np.unique(size[size >= least]):
        at = np.flatnonzero(size == n)
        for k in range(0, len(at), 4096):
            yield at[k : k + 4096], np.ascontiguousarray(_codes([strings[x] for x in at[k : k + 4096]])[:, :n])


class Landmarks:
    def __init__(self, strings: list[str], s: Settings):
        self.strings, self.settings = strings, s
        self.subsequences, codes = Subsequences(strings, s.order, s.decay), _codes(strings)
        self.own = np.sqrt(subsequence_kernel(codes, codes, s.order, s.decay))
        self.tables = np.stack([self.subsequences.profile(c) for c in codes]) / self.own[:, None].astype(np.float32)
        value, vector = np.linalg.eigh(self.values(strings))
        self.whiten = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-6))) @ vector.T

    def values(self, strings: list[str]) -> np.ndarray:
        """Normalised kernel of each string and each landmark; 0 for strings of fewer than `order` letters."""
        return _normalised(self.subsequences, self.tables, strings)

    def features(self, strings: list[str]) -> np.ndarray:
        out = np.empty((len(strings), len(self.strings)))
        for k in range(0, len(strings), ROWS):
            out[k : k + ROWS] = self.values(strings[k : k + ROWS]) @ self.whiten
        return out


def _values(subsequences: Subsequences, tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(tables, rows) of the tables' sums over each row, divided by the root of its own kernel value."""
    if codes.shape[1] < subsequences.order:
        return np.zeros((len(tables), len(codes)))
    return subsequences.sums(codes, tables) / subsequences.own(codes)


def _normalised(subsequences: Subsequences, tables: np.ndarray, strings: list[str]) -> np.ndarray:
    out = np.zeros((len(strings), len(tables)))
    for at, codes in _by_length(strings, subsequences.order):
        out[at] = _values(subsequences, tables, codes).T
    return out


def _texts_once(texts: list[set[str]]) -> list[int]:
    """Places of texts that are no near copy of an earlier one: of 8 least hashes of their words of 6 letters or more, 4
    agree for most texts with a similarity of a half."""
    seen: list[dict[int, list[int]]] = [{} for _ in range(8)]
    turns = np.random.default_rng(3).integers(1, 1 << 32, 8, np.uint64) | np.uint64(1)
    out = []
    for k, words in enumerate(texts):
        hashes = np.array([zlib.crc32(w.encode()) for w in words if len(w) >= 6], np.uint64)
        if len(hashes) >= 8:
            least = ((hashes[:, None] * turns) & np.uint64(0xFFFFFFFF)).min(axis=0).tolist()
            agree = Counter(x for found, m in zip(seen, least) for x in found.get(m, ()))
            if agree and max(agree.values()) >= 4:
                continue
            for found, m in zip(seen, least):
                found.setdefault(m, []).append(k)
        out.append(k)
    return out


def choose_landmarks(texts: list[set[str]], toxic: np.ndarray, s: Settings) -> list[str]:
    """Words and their beginnings that are in many toxic texts and hardly any others, each unlike those before it. Near
    copies count once, or scraps of ordinary words in copies of a mislabelled text would look like insults."""
    once = _texts_once(texts)
    pos, neg = max(1, sum(toxic[k] for k in once)), max(1, sum(not toxic[k] for k in once))

    def beginnings(words, known=None):
        found = set()
        for w in words:
            p = letters_of(w)
            found.update(p[:n] for n in range(5, min(len(p), 11) + 1))
        return found if known is None else found & known.keys()

    seen = Counter(p for k in once if toxic[k] for p in beginnings(texts[k]))
    seen = Counter({p: n for p, n in seen.items() if n >= max(3, 0.008 * pos)})
    clean = Counter(p for k in once if not toxic[k] for p in beginnings(texts[k], seen))
    worth = {}
    for p, n in seen.items():
        a, b = n / pos, (clean[p] + 0.5) / (neg + 1)
        if a > 4 * b:
            worth[p] = a * np.log(a / b) * (1 + 0.02 * len(p))
    least = 0.1 * max(worth.values(), default=0)
    ranked = sorted((p for p in worth if worth[p] >= least), key=lambda p: (-worth[p], p))[: 20 * s.landmarks]
    chosen: list[str] = []
    if ranked:
        codes = _codes(ranked)
        own = subsequence_kernel(codes, codes, s.order, s.decay)
        free = np.ones(len(ranked), bool)
        for k, p in enumerate(ranked):
            if free[k] and len(chosen) < s.landmarks // 2 and not any(p in q or q in p for q in chosen):
                chosen.append(p)
                rest = np.flatnonzero(free)
                near = subsequence_kernel(codes[rest], np.repeat(codes[k : k + 1], len(rest), axis=0), s.order, s.decay) / np.sqrt(own[rest] * own[k])
                free[rest[near > 0.45]] = False
    return chosen


def with_neighbours(chosen: list[str], clean: list[str], s: Settings) -> Landmarks:
    """Landmarks: the chosen ones and, for each in turn, the clean word nearest to it, up to `landmarks` in all."""
    value = Landmarks(chosen, s).values(clean)
    order, more, at = np.argsort(-value, axis=0, kind="stable"), [], 0
    while len(chosen) + len(more) < s.landmarks and at < min(len(clean), s.landmarks):
        for word in (clean[k] for k in order[at]):
            if word not in more and word not in chosen and len(chosen) + len(more) < s.landmarks:
                more.append(word)
        at += 1
    return Landmarks([*chosen, *more], s)


def _forms(word: str, count: int) -> list[str]:
    """The word with one or two letters inserted, with one left out, and as a piece within a longer word."""
    rnd, out, word = random.Random(zlib.crc32(word.encode())), [], word.removeprefix(START)
    other = lambda: rnd.choice("abcdefghijklmnopqrstuvwxyz")
    for k in range(count):
        x = list(word)
        if k % 4 == 3:
            out.append((other() + word + other())[:WIDTH])
            continue
        if k % 4 == 2 and len(x) > 4:
            del x[rnd.randrange(len(x))]
        else:
            for _ in range(1 + k % 4):
                x.insert(rnd.randint(1, len(x) - 1), other())
        out.append(START + "".join(x)[: WIDTH - 1])
    return out


def _machine(blocks: list[np.ndarray], y: np.ndarray, weight: np.ndarray, cost: float) -> np.ndarray:
    """Weights and, last, the bias of a linear machine with squared hinge loss, by Newton steps. blocks: the examples' features,
    one block after the other, of which a few rows at a time are copied."""
    ends = np.cumsum([len(x) for x in blocks])
    parts = [(x[k : k + ROWS], end - len(x) + k) for x, end in zip(blocks, ends) for k in range(0, len(x), ROWS)]
    keep = np.eye(blocks[0].shape[1] + 1)
    keep[-1, -1] = 1e-6
    w = np.zeros(len(keep))
    for _ in range(30):
        square, side = keep.copy(), np.zeros(len(keep))
        for x, at in parts:
            z, own = np.c_[x, np.ones(len(x))], y[at : at + len(x)]
            active = own * (z @ w) < 1
            z = z[active]
            scaled = z * (cost * weight[at : at + len(x)][active])[:, None]
            square += scaled.T @ z
            side += scaled.T @ own[active]
        new = np.linalg.solve(square, side)
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def _calibrate(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the sigmoid from margins to probabilities."""
    a, b = 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        off, v = weight * (p - target), weight * p * (1 - p) + 1e-9
        g = np.array([(off * margin).sum() + 1e-3 * a, off.sum()])
        cross = (v * margin).sum()
        step = np.linalg.solve(np.array([[(v * margin * margin).sum() + 1e-3, cross], [cross, v.sum() + 1e-6]]), g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


class Model:
    """The machine as one table over subsequences; what is sent to executors."""

    def __init__(self, marks: Landmarks, weights: np.ndarray, slope: float, offset: float):
        self.subsequences, self.strings, self.slope, self.offset = marks.subsequences, marks.strings, slope, offset
        self.table = ((marks.whiten @ weights[:-1]) @ marks.tables).astype(np.float32)[None, :]
        self.bias = float(weights[-1])

    def margins(self, strings: list[str]) -> np.ndarray:
        """Of single pieces."""
        return _normalised(self.subsequences, self.table, strings)[:, 0] + self.bias

    def margins_of_words(self, words: list[str]) -> np.ndarray:
        """The greatest margin of each word's pieces; words begin with START."""
        size, out = np.fromiter(map(len, words), np.int64, len(words)), np.full(len(words), self.bias)
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            step = max(1, 500_000 // int(n))
            for k in range(0, len(at), step):
                part = at[k : k + step]
                codes = np.array([words[x] for x in part], f"U{n}").view(np.uint32).reshape(len(part), n)
                for a, b in _starts(int(n)):
                    out[part] = np.maximum(out[part], _values(self.subsequences, self.table, np.ascontiguousarray(codes[:, a:b]))[0] + self.bias)
        return out

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -700, 700))))


class Reader:
    """Margins of words, kept for the words that a task has seen; emptied when full."""

    def __init__(self, model: Model, most: int = 60_000):
        self.model, self.most = model, most
        self.known: dict[str, float] = {}

    def learn(self, texts: list[list[str]]) -> None:
        words = set().union(*texts)
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known, new = {}, list(words)
        best = self.model.margins_of_words(list(map(letters_of, new)))
        self.known.update(zip(new, best.tolist()))

    def score(self, words: list[str]) -> float:
        """Of a text whose words are known: that of its most toxic word, so of its most toxic sentence."""
        return self.model.score(max(map(self.known.__getitem__, words), default=self.model.bias))


def fit(texts: list[str | None], labels: list[int], s: Settings = Settings()) -> Model | None:
    """Of a bounded sample in memory; None without texts of both kinds or without anything that sets them apart."""
    toxic = np.array(labels, int) == 1
    same: dict[str, str] = {}  # one object for each word, however many texts have it
    words = [{same.setdefault(w, w) for w in words_of(t)} for t in texts]
    chosen = choose_landmarks(words, toxic, s) if toxic.any() and not toxic.all() else []
    if not chosen:
        return None
    number: dict[str, int] = {}
    bags = []
    for bag in words:
        found = sorted({number.setdefault(p, len(number)) for w in bag for p in pieces(w) if len(p) >= s.order})
        bags.append(np.array(found, np.int32))
    del words, same
    strings = list(number)
    often = np.zeros(len(strings))
    for bag, t in zip(bags, toxic):
        often[bag] += not t
    del number
    marks, parts = Landmarks(chosen, s), []
    for k in range(0, len(strings), 20_000):
        near = marks.values(strings[k : k + 20_000])
        parts.append((near.argmax(axis=1).astype(np.int32), near.max(axis=1)))
    kind, most = (np.concatenate(c) for c in zip(*parts))
    # of clean words those that come nearest to a landmark are examples; others are far from any, and from the boundary
    clean = np.flatnonzero(often)
    clean = np.sort(clean[np.argsort(-most[clean], kind="stable")[: s.max_words]])
    marks = with_neighbours(chosen, [strings[k] for k in clean if not any(c in strings[k] for c in chosen)], s)
    x = marks.features([strings[k] for k in clean])
    # the examples of a toxic text: what comes nearest to each of the chosen landmarks that it holds, else its most toxic
    # word, at first that nearest to any, then that of the machine
    bad = [bag for bag, t in zip(bags, toxic) if t and len(bag)]
    held = []
    for bag in bad:
        best: dict[int, int] = {}
        for k in bag[most[bag] >= HELD].tolist():
            if kind[k] not in best or most[k] > most[best[kind[k]]]:
                best[kind[k]] = k
        held.append(list(best.values()))
    found = [bag[np.argmax(most[bag])] for bag in bad]
    margin = np.zeros(len(strings))
    candidates = np.unique(np.concatenate(bad))
    for _ in range(s.rounds):
        count: Counter = Counter()
        for own, other in zip(held, found):
            for k in own or [other]:
                count[k] += 1 / len(own or [other])
        plain, weight = list(count), np.array(list(count.values()))
        at = np.zeros(len(chosen))
        np.add.at(at, kind[plain], most[plain] * weight)
        forms = [(f, w / s.forms) for c, w in zip(chosen, at) for f in _forms(c, 4 * s.forms)]
        more = marks.features([f for f, _ in forms])
        examples = [x, marks.features([strings[k] for k in plain]), more]
        y = np.r_[-np.ones(len(clean)), np.ones(len(plain) + len(more))]
        # a word of clean texts weighs as their number, all examples of a toxic text as one
        weights = _machine(examples, y, np.r_[often[clean], weight, [w for _, w in forms]] / len(bad), s.cost)
        model = Model(marks, weights, 1.0, 0.0)
        margin[candidates] = model.margins([strings[k] for k in candidates])
        new = [bag[np.argmax(margin[bag])] for bag in bad]
        if new == found:
            break
        found = new
    margin = model.margins(strings)
    margins = np.r_[[margin[bag].max(initial=model.bias) for bag in bags], more @ weights[:-1] + model.bias]
    # altered forms count as much as the toxic texts: the threshold lies between them and what clean texts hold
    kinds = np.r_[toxic, np.ones(len(more))]
    share = s.clean_weight * len(kinds)
    each = np.where(kinds > 0, (len(kinds) - share) / 2, share / (~toxic).sum())
    each[: len(toxic)][toxic] /= toxic.sum()
    each[len(toxic) :] /= max(1, len(more))
    slope, offset = _calibrate(margins, kinds, each)
    # an even score needs at least half the margin that toxic examples are trained to have
    offset = min(offset, -0.5 * slope)
    return Model(marks, weights, slope, float(offset))


def sample(docs: DataFrame, labels: DataFrame, s: Settings, id_col: str = "doc_id", text_col: str = "text", train: str | None = None) -> tuple[list, list]:
    """Texts and labels of at most max_per_class labelled rows of each class, by order of a hash of the id, as long as they
    stay below max_bytes. Of repeated ids one text counts (the least), and with labels of both kinds it is toxic."""
    rows = labels.select(F.col("doc_id").alias("i"), F.col("toxic").cast("int").alias("y")).where("i is not null and y in (0, 1)")
    rows = rows.groupBy("i").agg(F.max("y").alias("y"))
    if train:
        rows = rows.where(train)
    ids = [rows.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(s.max_per_class) for y in (0, 1)]
    few = F.broadcast(ids[0].unionAll(ids[1]))  # at most two times max_per_class ids
    texts = docs.select(F.col(f"`{id_col}`").alias("d"), F.col(f"`{text_col}`").cast("string").alias("t"))
    found = stash(texts.join(few, F.col("d") == F.col("i")).groupBy("i", "y").agg(F.min("t").alias("t")))
    sizes = found.select("i", "y", F.xxhash64("i").alias("h"), F.coalesce(F.octet_length("t"), F.lit(0)).alias("n")).collect()
    held, kept = [0, 0], []
    for i, y, _, n in sorted(sizes, key=lambda r: (r[2], str(r[0]))):
        if held[y] + n <= s.max_bytes // 2:
            held[y] += n
            kept.append((i,))
    if len(kept) < len(sizes):
        found = found.join(F.broadcast(docs.sparkSession.createDataFrame(kept, found.select("i").schema)), "i")
    out = sorted(((r[0] or "", r[1]) for r in found.select("t", "y").collect()), key=lambda r: (r[1], r[0]))
    discard(found)
    return [t for t, _ in out], [y for _, y in out]


_TRAIN = "crc32(encode(cast(i as string), 'UTF-8')) % 5 <> 0"


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model | None:
    """Fitted on labelled rows of which crc32 of the id as text modulo 5 is not 0."""
    model = fit(*sample(docs, labels, s, train=_TRAIN), s)
    trim()
    return model


def score(docs: DataFrame, model: Model | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a column score_col (double) behind the others."""
    small_batches(docs.sparkSession)
    out, at = T.StructType([*docs.schema.fields, T.StructField(column_name(docs, score_col), T.DoubleType())]), docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # tables of bounded size, by the settings

    def run(batches):
        fitted = sent.value
        reader = Reader(fitted) if fitted else None
        try:
            yield from scored(batches, reader)
        finally:
            if fitted:  # a worker outlives its task, and others work beside it
                fitted.subsequences.own.known = {}

    def scored(batches, reader):
        for big in batches:
            for k in range(0, big.num_rows, 512):
                batch = big.slice(k, 512)
                if reader is None:
                    scores = [0.0] * batch.num_rows
                else:
                    words = [words_of(t) for t in batch.column(at).to_pylist()]
                    reader.learn(words)
                    scores = [reader.score(w) for w in words]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=out.names)

    return docs.mapInArrow(tidy(run), out)


def screen(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score threshold or more."""
    col = column_name(docs, "_toxicity")
    return score(docs, model, text_col, col).where(F.col(col) < threshold).drop(col)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity scores of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), train(docs, labels))
    held = F.expr("crc32(encode(coalesce(cast(doc_id as string), ''), 'UTF-8')) % 5 = 0").alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
