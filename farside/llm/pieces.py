"""SentencePiece encoding and decoding for merge-type models, by a table of prefixes' last tokens.

A merge-type encoding joins, again and again, the two neighbours whose joint piece scores best, the leftmost of equal ones.
What such a process leaves of a text's beginning is what the beginning alone gives, so every prefix that ends at a token has
one encoding and with it one last token. That token is a piece that ends there, found by an automaton over all pieces, and of
these pieces the only one that stands beside the last token of the prefix before it without being joined to it. Whether two
tokens can be neighbours is settled by playing both of their own processes in step, by score, and seeing whether the symbols
at their border are ever the best pair. The table of prefixes is filled from left to right, and words that begin alike share its rows;
ids are read off from the end. Characters that no piece knows stand alone and become byte pieces. Nothing is simulated on whole texts.

The text is cut into words where no piece reaches over: before a space mark that follows anything else, and between characters
that no chain of neighbours within pieces connects (letters and punctuation, scripts, figures). Words' ids are kept for their next appearance, in a table of bounded size.

Defined results: null text counts as empty and gives no ids; null ids decode to an empty text; a text is encoded whole, in
memory in proportion to it; rows repeat as they come; an empty table gives an empty result; all other columns are kept, and a
clash of names is avoided by leading underscores. Models of another type, or with settings that change texts otherwise than
by the space mark, are refused with a ValueError, and so are files of over MAX_FILE_MB.
"""

from __future__ import annotations

import codecs
import hashlib
import itertools
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import column_name, shared, small_batches, tidy

MARK = "▁"  # stands for a space
MAX_FILE_MB = 64
#: Kinds of pieces in a model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Entries of the tables of words seen, their prefixes and pairs settled, in a worker.
WORDS, PREFIXES, PAIRS = 250_000, 400_000, 1 << 19

# invalid bytes of byte pieces are replaced one by one
codecs.register_error("each-byte", lambda e: ("�", e.start + 1))


def _read(source: bytes):
    """(pieces, surface of unknown ones) of a model file; ValueError for settings that are not built here."""
    from sentencepiece import sentencepiece_model_pb2 as form

    model = form.ModelProto()
    model.ParseFromString(source)
    norm, train = model.normalizer_spec, model.trainer_spec
    wrong = ["model type"] if train.model_type != form.TrainerSpec.BPE else []
    wrong += ["normalisation"] if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix else []
    wrong += ["space marks at the end"] if train.treat_whitespace_as_suffix else []
    wrong += ["denormaliser"] if model.denormalizer_spec.precompiled_charsmap else []
    kinds = {p.type for p in model.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}
    wrong += [f"pieces of type {k}" for k in sorted(kinds)]
    if sum(p.type == BYTE for p in model.pieces) != 256:
        wrong.append("no byte pieces")
    pieces = [(p.piece, p.score, p.type) for p in model.pieces]
    known = {p for p, _, kind in pieces if kind == NORMAL}
    if any(c not in known for p in known for c in p):
        wrong.append("pieces of unknown characters")
    if any(MARK in p.lstrip(MARK) for p in known):
        wrong.append("pieces over the borders of words")
    if wrong:
        raise ValueError("unsupported settings of the model file: " + ", ".join(wrong))
    return pieces, train.unk_surface


def _kinds(pieces) -> list[list[str]]:
    """Characters by the company they keep: two are of a kind if they are neighbours in a piece, or joined by such ones.
    Those that keep none are left out."""
    root: dict[str, str] = {}

    def find(c):
        while (up := root.setdefault(c, c)) != c:
            root[c] = c = root[up]
        return c

    for p in pieces:
        inner = p.lstrip(MARK)
        for a, b in zip(inner, inner[1:]):
            root[find(a)] = find(b)
        if inner and len(p) > 1:
            find(inner[0])
    kinds: dict[str, list[str]] = {}
    for c in sorted(root):
        kinds.setdefault(find(c), []).append(c)
    return sorted(kinds.values(), key=len, reverse=True)


class _Prefixes:
    """Prefixes as rows: the row that each character leads on to, the last token (-1: a character that no piece knows, or the
    empty prefix; any token may follow), and the scanner's state."""

    def __init__(self):
        self.next: dict[int, int] = {}
        self.last, self.state = [-1], [0]


class Pieces:
    """Compiled once; pickles as its tables. What is learnt from texts (words, pairs) is made anew where it is used."""

    def __init__(self, source: bytes):
        pieces, unknown = _read(source)
        self.score = {p: s for p, s, kind in pieces if kind == NORMAL}
        self.bytes = [0] * 256
        self.labels, self.sizes = [], [len(p) for p, _, _ in pieces]
        ids = {}
        for i, (p, _, kind) in enumerate(pieces):
            if kind == NORMAL:
                ids[p] = i
            elif kind == BYTE:
                self.bytes[int(p[1:-1], 16)] = i
            self.labels.append({NORMAL: p.replace(MARK, " ").encode(), UNKNOWN: unknown.encode(), CONTROL: b""}.get(kind) if kind != BYTE else bytes([int(p[1:-1], 16)]))
        self.marked = {i for p, i in ids.items() if p.startswith(MARK)}
        self.silent = {i for i, (_, _, kind) in enumerate(pieces) if kind == CONTROL}
        # the way in which each piece is put together, if it is at all when it stands alone
        self.right: list[tuple | None] = [None] * len(pieces)
        self.left: list[tuple | None] = [None] * len(pieces)
        for p, i in ids.items():
            if (ways := self._alone(p)) is not None:
                self.right[i], self.left[i] = ways
        self._scanner({p: i for p, i in ids.items() if self.right[i] is not None})
        some = "|".join("[" + "".join(map(re.escape, kind)) + "]+" for kind in _kinds(ids)) or "(?!)"
        self.pattern = f"{MARK}+(?:{some})?|{some}|(?s:.)"
        self._ready()

    def _ready(self) -> None:
        self.words_of = re.compile(self.pattern).findall
        self.table = _Prefixes()
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.decimal = [str(i) for i in range(len(self.labels))]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("words_of", "table", "pairs", "words", "decimal")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def _alone(self, piece: str) -> tuple[tuple, tuple] | None:
        """What happens to a piece's characters alone: for its right and for its left end the symbol there at first, then
        (score of a step, symbol there after it). None if they don't end as the piece."""
        symbols, right, left = list(piece), [piece[-1]], [piece[0]]
        while len(symbols) > 1:
            # the first of the best pairs
            best, at = max(((self.score.get(a + b, -np.inf), -k) for k, (a, b) in enumerate(zip(symbols, symbols[1:]))))
            if best == -np.inf:
                return None
            symbols[-at : 2 - at] = [symbols[-at] + symbols[1 - at]]
            right.append((best, symbols[-1]))
            left.append((best, symbols[0]))
        return tuple(right), tuple(left)

    def neighbours(self, x: int, y: int) -> bool:
        """Whether tokens x and y stand side by side: both are put together in step, the better score first, the left one
        of equal scores, and the pair at the border must never be the best."""
        right, left, score = self.right[x], self.left[y], self.score
        a, b, i, j, found = right[0], left[0], 1, 1, True
        while True:
            own = right[i][0] if i < len(right) else -np.inf
            other = left[j][0] if j < len(left) else -np.inf
            between = score.get(a + b)
            if between is not None and between > own and between >= other:
                found = False
                break
            if own == other == -np.inf:
                break
            if own >= other:
                a = right[i][1]
                i += 1
            else:
                b = left[j][1]
                j += 1
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[x << 20 | y] = found
        return found

    def _scanner(self, ids: dict[str, int]) -> None:
        """Transitions by character over the beginnings of pieces: the next state, where there is none the state to fall back
        to, and the pieces that end in a state with their lengths, the longest first."""
        self.step: dict[int, int] = {}
        self.fall, own, depth = [0], [-1], [0]
        for p, i in ids.items():
            s = 0
            for c in p:
                key = s << 21 | ord(c)
                if key not in self.step:
                    self.step[key] = len(own)
                    self.fall.append(0)
                    own.append(-1)
                    depth.append(depth[s] + 1)
                s = self.step[key]
            own[s] = i
        self.ending: list[tuple] = [()] * len(own)
        for key, s in sorted(self.step.items(), key=lambda e: depth[e[1]]):
            parent, c = key >> 21, key & 0x1FFFFF
            if parent:
                back = self.fall[parent]
                while back and back << 21 | c not in self.step:
                    back = self.fall[back]
                self.fall[s] = self.step.get(back << 21 | c, 0)
            inner = self.ending[self.fall[s]]
            self.ending[s] = ((own[s], self.sizes[own[s]]), *inner) if own[s] >= 0 else inner

    def encode_word(self, word: str) -> list[int]:
        """Walks the table of prefixes, adding those it lacks, then reads ids off from the end. Long words, which hardly have
        company, get a table of their own that goes with them."""
        table = self.table
        if len(word) > 64:
            table = _Prefixes()
        elif len(table.last) >= PREFIXES:
            table = self.table = _Prefixes()
        next_, last, at_prefix = table.next.get, table.last, 0
        path = [0]
        for c in map(ord, word):
            to = next_(at_prefix << 21 | c)
            at_prefix = self._prefix(table, path, c) if to is None else to
            path.append(at_prefix)
        out, at = [], len(word)
        while at:
            if (x := last[path[at]]) >= 0:
                out.append(x)
                at -= self.sizes[x]
            else:
                at -= 1
                out.extend(self.bytes[b] for b in reversed(word[at].encode("utf-8", "surrogatepass")))
        out.reverse()
        return out

    def _prefix(self, table: _Prefixes, path: list[int], c: int) -> int:
        """A new row of the table: the prefix at the end of path, one character longer. Its last token is the one of the
        pieces that end here which can stand beside the last token of the prefix before it."""
        step, s, last, pairs = self.step.get, table.state[path[-1]], table.last, self.pairs
        to = step(s << 21 | c)
        while to is None and s:
            s = self.fall[s]
            to = step(s << 21 | c)
        x = -1
        if to is not None:
            for x, size in self.ending[to]:
                before = last[path[-size]]
                if before < 0:
                    break
                beside = pairs.get(before << 20 | x)
                if self.neighbours(before, x) if beside is None else beside:
                    break
        new = len(last)
        table.next[path[-1] << 21 | c] = new
        last.append(x)
        table.state.append(to or 0)
        return new

    def _word(self, word: str) -> bytes:
        ids = array("I", self.encode_word(word)).tobytes()
        if len(word) <= 64:
            if len(self.words) >= WORDS:
                self.words.clear()
            self.words[word] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """Ids (unsigned 32-bit)."""
        if not text:
            return np.empty(0, np.uint32)
        get, new = self.words.get, self._word
        return np.frombuffer(b"".join([get(w) or new(w) for w in self.words_of(MARK + text.replace(" ", MARK))]), np.uint32)

    def decode(self, ids: list[int]) -> str:
        if not self.silent.isdisjoint(ids):  # control pieces are nothing, but bytes on both their sides are no character
            parts = [list(part) for silent, part in itertools.groupby(ids, self.silent.__contains__) if not silent]
            return "".join(self._text(part, k == 0) for k, part in enumerate(parts))
        return self._text(ids, True)

    def _text(self, ids: list[int], first: bool) -> str:
        raw = b"".join(map(self.labels.__getitem__, ids))
        if first and ids and ids[0] in self.marked:  # the space mark that encoding put in front
            raw = raw[1:]
        return raw.decode("utf-8", "each-byte")


def _sent(spark: SparkSession, path: str):
    """The compiled model, for all executors."""
    small_batches(spark)
    with open(path, "rb") as f:
        source = f.read()
    if len(source) > MAX_FILE_MB << 20:
        raise ValueError(f"{path} has over {MAX_FILE_MB} MB")
    return shared(spark, ("pieces", source), lambda: Pieces(source))


def _few(batch, rows: int = 64):
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with a column ids_col (array<int>) behind the others."""
    source, at = _sent(docs.sparkSession, model_path), docs.columns.index(text_col)
    out = T.StructType([*docs.schema.fields, T.StructField(column_name(docs, ids_col), T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        model = source.value
        for big in batches:
            for batch in _few(big):
                found = [model.encode(t) for t in batch.column(at).to_pylist()]
                ends = pa.array(np.r_[0, np.cumsum([len(x) for x in found])], pa.int32())
                ids = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found).view(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=out.names)

    return docs.mapInArrow(tidy(run), out)


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """rows with a column text_col behind the others."""
    source, at = _sent(rows.sparkSession, model_path), rows.columns.index(ids_col)
    out = T.StructType([*rows.schema.fields, T.StructField(column_name(rows, text_col), T.StringType())])

    def run(batches):
        model = source.value
        for big in batches:
            for batch in _few(big):
                texts = pa.array([model.decode(x or []) for x in batch.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=out.names)

    return rows.mapInArrow(tidy(run), out)


def digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: ids are encoded, then decoded again, and only digests leave the
    worker."""
    source = _sent(docs.sparkSession, model_path)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches):
        model, sha = source.value, hashlib.sha256
        for big in batches:
            for batch in _few(big):
                n, ids_sha, text_sha = [], [], []
                for text in batch.column(1).to_pylist():
                    ids = model.encode(text).tolist()
                    n.append(len(ids))
                    ids_sha.append(sha(",".join(map(model.decimal.__getitem__, ids)).encode()).hexdigest())
                    text_sha.append(sha(model.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=names)

    return rows.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and of the text decoded from them."""
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())
