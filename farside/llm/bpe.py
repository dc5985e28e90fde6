"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens: it starts as one state with an arc for every byte, and merge after merge, in rank order, a
gadget is built in. The merge of a and b into c adds arc c wherever a then b can be read, and takes arc b away from every
state that an a standing at that rank leads to. So a token sequence is accepted exactly if it is the encoding of its bytes,
every text has exactly one accepted sequence, and each token leads to one state: the automaton is deterministic. It is
compiled at once, on the driver: states that have lost the same arcs are one state, labels lost by the same states one
class, and a table of bits says which state has lost which class (for the 50k vocabulary 14,411 states and 10,481 classes,
19 MB, compiled in about 4 s).

A pre-split word is encoded in one pass over its bytes by table: a scanner's transition gives the longest token that ends
here, the bit table says whether the path up to its beginning has an arc for it, and so do the next shorter ones; one of
them has. Nothing is taken back. The tokens are then read off from the end. Decoding emits the arcs' labels.

Defined results: null text counts as empty and gives no ids; null ids decode to an empty text; added tokens of the
vocabulary file found in a text are encoded as their own id; texts of any length are encoded whole, in memory in proportion
to the text; rows repeat as they come; an empty table gives an empty result; all other columns are kept, and a clash of
names with the new ones is avoided by leading underscores. Vocabulary files of over MAX_FILE_MB, and settings other than
plain byte-level BPE with its usual pre-splitting, are refused with a ValueError.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import pre_tokenizers

from .util import column_name, shared, small_batches, tidy

#: Fixed value: the pre-splitting pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where Unicode tables of different age agree on letters and numbers; a text with other characters is pre-split by the
#: tokenizers library itself.
UNSETTLED = (
    r"[^\x00-\u0557\u0900-\u0939\u2010-\u205e\u20a0-\u20bf\u2100-\u218b\u3041-\u3096"
    r"\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e\U0001f300-\U0001f5ff]"
)
NEVER = 1 << 40
#: A vocabulary file larger than this is refused rather than sent to every executor.
MAX_FILE_MB = 64


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: itself if printable, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


def _read(source: bytes) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]], dict[str, int]]:
    """(vocabulary, merges in rank order, added tokens) of a vocabulary file; ValueError for settings that the automaton
    does not have, rather than other ids."""
    spec, letters = json.loads(source), byte_letters()
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    wrong += ["normalizer"] if spec.get("normalizer") else []
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        wrong.append("pre_tokenizer")
    for a in spec.get("added_tokens", []):
        wrong += [f"{k} of {a['content']!r}" for k in ("single_word", "lstrip", "rstrip") if a.get(k)]
    if model.get("type", "BPE") != "BPE" or wrong:
        raise ValueError("unsupported settings of the vocabulary file: " + ", ".join(wrong or ["model type"]))
    raw = lambda t: bytes(letters[x] for x in t)
    vocab = {raw(t): i for t, i in model["vocab"].items()}
    if missing := [b for b in range(256) if bytes([b]) not in vocab]:
        raise ValueError(f"no token for bytes {missing}")
    pairs = (p.split(" ") if isinstance(p, str) else p for p in model["merges"])
    return vocab, [(raw(a), raw(b)) for a, b in pairs], {a["content"]: a["id"] for a in spec.get("added_tokens", [])}


class _Gadgets:
    """Merge gadgets, built in one after the other. `right` and `left` of a token are the tokens that stand at its right
    and left end while it is put together, each with the rank at which a merge consumes it: a merge of p and q at rank r
    takes the arc of y away from the state of x if p ends x until after r, and q starts y until r or after."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.rank: dict[int, dict[int, int]] = {}
        self.right: dict[int, tuple] = {i: ((i, NEVER),) for t, i in vocab.items() if len(t) == 1}
        self.left: dict[int, tuple] = dict(self.right)
        for rank, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault(x, {})[y] = rank
            # z can be read only if earlier gadgets leave its own two halves side by side until now
            if z not in self.right and x in self.right and y in self.right and not self._taken(x, y, rank):
                self.right[z] = (*self.right[y][:-1], (y, rank), (z, NEVER))
                self.left[z] = (*self.left[x][:-1], (x, rank), (z, NEVER))

    def _taken(self, x: int, y: int, before: int) -> bool:
        """Whether a merge of lower rank than `before` joins the end of x with the start of y."""
        starts = self.left[y]
        for p, p_until in self.right[x]:
            if row := self.rank.get(p):
                for q, q_until in starts:
                    # of equal ranks the leftmost merge comes first: x's own before this one, this one before y's own
                    if q in row and (r := row[q]) < before and r < p_until and r <= q_until:
                        return True
        return False

    def table(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(state of each token, class of each token as a label, bits by state and class: 1 where the gadgets have taken
        the arc away), states and classes merged as far as their rows and columns are equal. The last state is the start."""
        joins = {q for row in self.rank.values() for q in row}
        ends, starts = {}, {}
        end = {x: ends.setdefault(tuple(e for e in spine if e[0] in self.rank), len(ends)) for x, spine in self.right.items()}
        start = {y: starts.setdefault(tuple(e for e in spine if e[0] in joins), len(starts)) for y, spine in self.left.items()}
        by_end, by_start = {}, {}
        for found, places in ((ends, by_end), (starts, by_start)):
            for spine, k in found.items():
                for token, until in spine:
                    places.setdefault(token, []).append((until, k))
        bits = np.zeros((len(ends), -(-len(starts) // 8)), np.uint8)
        for p, row in self.rank.items():  # the gadgets with p on the left, by rank; each adds to what states lose
            lost, gadgets, k = np.zeros(bits.shape[1], np.uint8), sorted((r, q) for q, r in row.items()), 0
            states = by_end.get(p, [])
            for until in sorted({u for u, _ in states}):
                while k < len(gadgets) and gadgets[k][0] < until:
                    r, q = gadgets[k]
                    at = np.array([c for v, c in by_start.get(q, ()) if v >= r], np.int64)
                    np.bitwise_or.at(lost, at >> 3, (1 << (at & 7)).astype(np.uint8))
                    k += 1
                bits[[s for u, s in states if u == until]] |= lost
        bits, state_of = _distinct(np.concatenate([bits, np.zeros((1, bits.shape[1]), np.uint8)]))
        # columns are compared in slices, so that bits are never unpacked all at once
        turned = [np.packbits(np.unpackbits(bits[:, k : k + 64], axis=1, bitorder="little"), axis=0).T for k in range(0, bits.shape[1], 64)]
        columns, class_of = _distinct(np.ascontiguousarray(np.concatenate(turned)[: len(starts)]))
        first = np.unique(class_of, return_index=True)[1]
        kept = [np.packbits(np.unpackbits(bits[k : k + 512], axis=1, bitorder="little")[:, first], axis=1, bitorder="little") for k in range(0, len(bits), 512)]
        state, label = np.full(size, state_of[-1], np.int32), np.zeros(size, np.int32)
        state[list(end)], label[list(start)] = state_of[list(end.values())], class_of[list(start.values())]
        return np.r_[state, state_of[-1]].astype(np.int32), label, np.concatenate(kept)


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows in the order of their first appearance, and which of them each row is."""
    seen: dict[bytes, int] = {}
    which = np.fromiter((seen.setdefault(r.tobytes(), len(seen)) for r in rows), np.int64, len(rows))
    return np.frombuffer(b"".join(seen), np.uint8).reshape(len(seen), rows.shape[1]), which


class Automaton:
    """Compiled once; pickles as its tables. Working parts (patterns, words seen) are made anew where it is used."""

    def __init__(self, source: bytes, cache_words: int = 100_000):
        vocab, merges, added = _read(source)
        self.labels = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for t, i in vocab.items():
            self.labels[i] = t
        for t, i in added.items():
            self.labels[i] = t.encode()
        self.added = {t: i.to_bytes(4, "little") for t, i in added.items()}
        gadgets = _Gadgets(vocab, merges)
        self.readable = frozenset(gadgets.right)
        state, label, bits = gadgets.table(len(self.labels))
        self.state, self.label, self.width, self.taken = state.tolist(), label.tolist(), bits.shape[1], bits.tobytes()
        self._scanner()
        self.cache_words = cache_words
        self._ready()

    def _ready(self) -> None:
        names = sorted(self.added, key=len, reverse=True)
        self.added_split = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.words_of, self.unsettled = regex.compile(PATTERN).findall, re.compile(UNSETTLED).search
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
        self.words = _Words(self, self.cache_words)

    def __getstate__(self) -> dict:
        made = ("added_split", "words_of", "unsettled", "library", "words")
        return {k: v for k, v in self.__dict__.items() if k not in made}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def arc(self, x: int, y: int) -> bool:
        """Whether y can be read after x."""
        c = self.label[y]
        return not self.taken[self.state[x] * self.width + (c >> 3)] >> (c & 7) & 1

    def _scanner(self) -> None:
        """Transitions by byte over the beginnings of all readable tokens: the next state, where there is none the state to
        fall back to, the longest token that ends in a state, and for each token the longest one that it ends with."""
        self.step: dict[int, int] = {}
        depth, own, self.fall = [0], [-1], [0]
        for i in self.readable:
            s = 0
            for b in self.labels[i]:
                key = s << 8 | b
                if key not in self.step:
                    self.step[key] = len(own)
                    depth.append(depth[s] + 1)
                    own.append(-1)
                    self.fall.append(0)
                s = self.step[key]
            own[s] = i
        self.ends, self.shorter = own, [-1] * len(self.labels)
        for key, s in sorted(self.step.items(), key=lambda x: depth[x[1]]):
            parent, b = key >> 8, key & 255
            if parent:
                back = self.fall[parent]
                while back and back << 8 | b not in self.step:
                    back = self.fall[back]
                self.fall[s] = self.step.get(back << 8 | b, 0)
            at_end = self.ends[self.fall[s]]
            if own[s] >= 0:
                self.shorter[own[s]] = at_end
            else:
                self.ends[s] = at_end

    def encode_word(self, word: bytes) -> list[int]:
        """One pass of transitions. Each beginning of a word has one accepted path, so one last token, and it is the one
        whose arc leads on from the state that the path of the rest has come to."""
        step, fall, ends, shorter, labels = self.step, self.fall, self.ends, self.shorter, self.labels
        state, label, width, taken = self.state, self.label, self.width, self.taken
        came, last, s = [state[-1]], [-1], 0
        for at, b in enumerate(word, 1):
            to = step.get(s << 8 | b)
            while to is None:
                s = fall[s]
                to = step.get(s << 8 | b)
            s, x = to, ends[to]
            c = label[x]
            while taken[came[at - len(labels[x])] * width + (c >> 3)] >> (c & 7) & 1:
                x = shorter[x]
                c = label[x]
            last.append(x)
            came.append(state[x])
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at -= len(labels[last[at]])
        out.reverse()
        return out

    def split(self, text: str) -> list[str]:
        if self.unsettled(text) is None:
            return self.words_of(text)
        return [text[a:b] for _, (a, b) in self.library(text)]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        word = self.words.__getitem__
        if self.added_split is None or not any(t in text for t in self.added):
            return b"".join(map(word, self.split(text)))
        parts = self.added_split.split(text)
        return b"".join(self.added[p] if k % 2 else b"".join(map(word, self.split(p))) for k, p in enumerate(parts))

    def decode(self, ids) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


def _bytes(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class _Words(dict):
    """Encodings of words seen; emptied when full, so that memory is bounded."""

    def __init__(self, automaton: Automaton, most: int):
        self.automaton, self.most = automaton, most

    def __missing__(self, word: str) -> bytes:
        ids = _bytes(self.automaton.encode_word(word.encode()))
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = ids
        return ids


def _sent(spark: SparkSession, path: str):
    """The compiled automaton of a vocabulary file, for all executors."""
    small_batches(spark)
    with open(path, "rb") as f:
        source = f.read()
    if len(source) > MAX_FILE_MB << 20:
        raise ValueError(f"{path} has over {MAX_FILE_MB} MB")
    return shared(spark, ("bpe", source), lambda: Automaton(source))


def _arrays(column, step: int = 64):
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with a column ids_col (array<int>) behind the others."""
    source, at = _sent(docs.sparkSession, tokenizer_path), docs.columns.index(text_col)
    out = T.StructType([*docs.schema.fields, T.StructField(column_name(docs, ids_col), T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        automaton = source.value
        for big in batches:
            for batch in _pieces(big):
                found = [automaton.encode(t) for t in _arrays(batch.column(at))]
                ends = np.r_[0, np.cumsum([len(x) // 4 for x in found])].astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))
                yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=out.names)

    return docs.mapInArrow(tidy(run), out)


def decode(rows: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """rows with a column text_col behind the others."""
    source, at = _sent(rows.sparkSession, tokenizer_path), rows.columns.index(ids_col)
    out = T.StructType([*rows.schema.fields, T.StructField(column_name(rows, text_col), T.StringType())])

    def run(batches):
        automaton = source.value
        for big in batches:
            for batch in _pieces(big):
                texts = pa.array([automaton.decode(x or ()) for x in _arrays(batch.column(at))], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=out.names)

    return rows.mapInArrow(tidy(run), out)


def _pieces(batch, step: int = 256):
    """Few rows at a time: with very long texts, ids of a whole batch could outgrow a worker."""
    for at in range(0, max(1, batch.num_rows), step):
        yield batch.slice(at, step)


def digest(docs: DataFrame, tokenizer_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with n_tokens, ids_sha256 and decoded_sha256: ids are encoded, then decoded again, and only
    digests leave the worker."""
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").cast("string").alias(column_name(docs, "_text")))
    source = _sent(docs.sparkSession, tokenizer_path)
    kinds = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    out = T.StructType([*rows.schema.fields[:-1], *(T.StructField(column_name(rows, n), k) for n, k in kinds.items())])

    def run(batches):
        automaton, sha = source.value, hashlib.sha256
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in _arrays(batch.column(batch.num_columns - 1)):
                ids = automaton.encode(text)
                n.append(len(ids) // 4)
                ids_sha.append(sha(ids).hexdigest())
                text_sha.append(sha(automaton.decode(np.frombuffer(ids, "<u4").tolist()).encode()).hexdigest())
            digests = [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *digests], names=out.names)

    return rows.mapInArrow(tidy(run), out)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and of the text decoded from them."""
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
