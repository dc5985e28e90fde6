"""Prefix trees of conversations, by Patricia construction over a distributed sort.

A conversation is a key: for each of its turns a digest of the whole sequence up to there, and the turn's words. Keys are
sorted by range, so that conversations that begin alike are neighbours, copies included, and a hot beginning is spread over as
many ranges as it needs. Each task reads its sorted keys once and builds the compressed tree of its range with a stack of the
points on the current path: branches (where neighbours part), ends and leaves. A point below which no more keys come is written
with the edge to the point above it and what its subtree sums up to; edges are expanded to their unary nodes at the end, in
SQL, with suffix sums along the edge.

Points on the first and the last path of a range may have more below them in other ranges. They are written node by node, as
parts that are added up by node; and where the last key of a range and the first of the next begin alike, what both have counted
for the common beginning is taken back. All sums (members, children, leaves, saved words) are plain additions in that form.
The parts are at most two paths a range. Parents' smallest members come by a join of points, where hot parents are broadcast.

Memory: a task holds one path and up to CHUNK ids of one end. A conversation's key, 20 bytes a turn, is one row.

Defined results: null role and text count as empty; a null turn comes first, equal turns are ordered by digest, repeated rows
are turns of their own; rows without a conversation's id belong to none and are left out; an empty table gives an empty
result; other columns are not used, whatever their names; texts of any length are digested whole (128 bits of SHA-256).
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .util import discard, hot_join, small_batches, stash, tidy

#: Ids of one end that a task holds at once.
CHUNK = 50_000
#: Bytes of a turn in a key: digest of the path, words.
DIGEST, TURN = 16, 20
EMPTY = hashlib.sha256(b"").hexdigest()
EDGE, PART, IDS, BOUND = range(4)
SCHEMA = "kind int, id binary, parent binary, depth long, below array<long>, conv_id long, n_convs long, n_children long, n_leaves long, saved long, ends string, first long, text binary"
_ARROW = pa.schema([("kind", pa.int32()), ("id", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("below", pa.list_(pa.int64())), *((n, pa.int64()) for n in ("conv_id", "n_convs", "n_children", "n_leaves", "saved")), ("ends", pa.string()), ("first", pa.int64()), ("text", pa.binary())])


def turns_of(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns: array of (turn, digest, words) in order), one row a conversation."""
    rows = conversations.select(
        F.col(f"`{id_col}`").cast("long").alias("conv_id"),
        F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    digest = F.substring(F.unhex(F.sha2(whole, 256)), 1, DIGEST)
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("int")
    one = F.struct("turn", digest.alias("digest"), words.alias("words"))
    return rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))


def _keys(batches):
    """(conv_id, turns) to (key, conv_id)."""
    for batch in batches:
        keys = []
        for turns in batch.column(1):
            path, key = b"", []
            for t in turns.as_py() or ():
                path = hashlib.blake2b(path + t["digest"], digest_size=DIGEST).digest()
                key.append(path + t["words"].to_bytes(TURN - DIGEST, "big"))
            keys.append(b"".join(key))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column(0)], names=["key", "conv_id"])


def _common(a: bytes, b: bytes) -> int:
    """Turns that two keys share at their beginnings."""
    low, high = 0, min(len(a), len(b)) // TURN
    if a[: high * TURN] == b[: high * TURN]:
        return high
    while low < high:  # the first difference lies in turn low..high
        middle = (low + high + 1) // 2
        if a[low * TURN : middle * TURN] == b[low * TURN : middle * TURN]:
            low = middle
        else:
            high = middle - 1
    return low


def _node(key: bytes, depth: int) -> bytes | None:
    """The node at a depth of a key's path; nothing is above the root, which is the empty one."""
    return None if depth < 0 else key[TURN * (depth - 1) : TURN * (depth - 1) + DIGEST] if depth else b""


def _words(key: bytes, top: int, bottom: int) -> list[int]:
    """Words of the turns at depths top..bottom."""
    return [int.from_bytes(key[TURN * d - 4 : TURN * d], "big") for d in range(top, bottom + 1)]


class _Point:
    """A branch, an end or a leaf on the current path, with the sums of what has been closed below it."""

    __slots__ = ("depth", "convs", "least", "leaves", "children", "saved", "ends")

    def __init__(self, depth: int):
        self.depth, self.convs, self.least, self.leaves, self.children, self.saved, self.ends = depth, 0, None, 0, 0, 0, None

    def add(self, convs: int, least: int) -> None:
        self.convs += convs
        self.least = least if self.least is None else min(self.least, least)


class _Tree:
    """The compressed tree of one range of keys that come in order."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.stack = [_Point(0)]
        self.key: bytes | None = None
        self.first: tuple[bytes, int] | None = None
        self.left = 0  # depth up to which the current path is that of the first key

    def put(self, key: bytes, conv_id: int) -> None:
        if key != self.key:
            self._turn_to(key, conv_id)
        top = self.stack[-1]
        top.add(1, conv_id)
        text = b"%d" % conv_id
        self.hash.update(b"," + text if self.any else text)
        self.any = True
        self.held.append(text)
        if len(self.held) == 1:
            self.held_first = conv_id
        if len(self.held) >= CHUNK:
            self._chunk()

    def _turn_to(self, key: bytes, conv_id: int) -> None:
        common, size = 0, len(key) // TURN
        if self.key is None:
            self.first, self.left = (key, conv_id), size
        else:
            common = _common(self.key, key)
            self._key_done(last=False)
            if common * TURN == len(self.key):
                self.stack[-1].leaves -= 1  # the key before goes on in this one
            self._close(common)
            self.left = min(self.left, common)
        if self.stack[-1].depth < size:
            self.stack.append(_Point(size))
        self.stack[-1].leaves += 1
        self.key, self.hash, self.any, self.held = key, hashlib.sha256(), False, []

    def _key_done(self, last: bool) -> None:
        """The first and the last key may have members in other ranges, so their ids are handed on."""
        if last or self.key == self.first[0]:
            self._chunk()
        else:
            self.stack[-1].ends = self.hash.hexdigest()

    def _chunk(self) -> None:
        if self.held:
            self._row(IDS, self._last(), first=self.held_first, text=b",".join(self.held))
            self.held = []

    def _last(self) -> bytes:
        return _node(self.key, len(self.key) // TURN)

    def _row(self, kind, id_, parent=None, depth=None, below=None, conv_id=None, convs=None, children=None, leaves=None, saved=None, ends=None, first=None, text=None):
        self.rows.append((kind, id_, parent, depth, below, conv_id, convs, children, leaves, saved, ends, first, text))

    def _close(self, depth: int) -> None:
        """Points deeper than depth get no more members in this range."""
        while self.stack[-1].depth > depth:
            point = self.stack.pop()
            if self.stack[-1].depth < depth:
                self.stack.append(_Point(depth))
            self._edge(point, self.stack[-1], spine=False)

    def _edge(self, p: _Point, above: _Point, spine: bool) -> None:
        """Write the edge that ends in p and add it to the point above. below: for each of its nodes the words of this and the
        following ones without the last."""
        words = _words(self.key, above.depth + 1, p.depth)
        below = list(accumulate(reversed([*words[:-1], 0])))[::-1]
        saved = p.saved + (p.convs - 1) * words[-1]
        if spine or p.depth <= self.left:
            for k, more in enumerate(below):
                d, end = above.depth + 1 + k, k == len(below) - 1
                self._row(PART, _node(self.key, d), _node(self.key, d - 1), d, [0], p.least, p.convs, p.children if end else 1, p.leaves, saved + (p.convs - 1) * more, p.ends if end else None)
        else:
            self._row(EDGE, _node(self.key, p.depth), _node(self.key, above.depth), p.depth, below, p.least, p.convs, p.children, p.leaves, saved, p.ends or EMPTY)
        above.add(p.convs, p.least)
        above.children += 1
        above.leaves += p.leaves
        above.saved += saved + (p.convs - 1) * below[0]

    def finish(self) -> None:
        if self.key is None:
            return
        self._key_done(last=True)
        while len(self.stack) > 1:
            point = self.stack.pop()
            self._edge(point, self.stack[-1], spine=True)
        root = self.stack[0]
        self._row(PART, b"", None, 0, [0], root.least, root.convs, root.children, root.leaves, root.saved, root.ends)
        self._row(BOUND, self.first[0], self.key, first=self.first[1])

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def _ranges(batches):
    """Sorted (key, conv_id) to the edges of their tree, parts, ids and the range's bounds."""
    tree = _Tree()
    for batch in batches:
        for key, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tree.put(key, conv_id)
            if len(tree.rows) >= 4096:
                yield tree.taken()
    tree.finish()
    if tree.rows:
        yield tree.taken()


def _seams(batches):
    """(first key of a range, last key of the range before) to what both ranges have counted for their common beginning."""
    for batch in batches:
        for first, last in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            common, rows = _common(last, first), []
            leaf = -1 if common * TURN == len(last) else 0
            words = [0, *_words(first, 1, common)]
            twice = list(accumulate(reversed(words)))[::-1]
            for d in range(common + 1):
                rows.append((PART, _node(first, d), _node(first, d - 1), d, [0], None, 0, -1 if d < common else 0, leaf, twice[d], None, None, None))
            for at in range(0, len(rows), 4096):
                yield _batch(rows[at : at + 4096])


def _joined(batches):
    """(id, text) in order of ids and of text within one to (id, SHA-256 of the texts joined by commas)."""
    now, sha, done = None, None, []
    for batch in batches:
        for id_, text in zip(batch.column(0), batch.column(1)):
            if (id_ := id_.as_py()) != now or sha is None:
                if sha is not None:
                    done.append((now, sha.hexdigest()))
                now, sha = id_, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(text.as_py())
    if sha is not None:
        done.append((now, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in done], pa.binary()), pa.array([s for _, s in done])], names=["id", "sha"])


def nodes(turns: DataFrame) -> DataFrame:
    """The prefix tree of (conv_id, turns) as turns_of() gives them: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256, one row a node."""
    small_batches(turns.sparkSession)
    keys = turns.mapInArrow(tidy(_keys), "key binary, conv_id long")
    found = stash(keys.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(tidy(_ranges), SCHEMA))
    # one row for each range
    bounds = found.where(F.col("kind") == BOUND).select("id", F.lag("parent").over(Window.orderBy("id", "first")).alias("before"))
    seams = bounds.where("before is not null").mapInArrow(tidy(_seams), SCHEMA)
    parts = found.where(F.col("kind") == PART).unionAll(seams).groupBy("id", "depth").agg(
        F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")), F.max("ends").alias("ends")
    )
    ids = found.where(F.col("kind") == IDS).select("id", "first", "text").repartition("id").sortWithinPartitions("id", "first").select("id", "text")
    ends = F.coalesce("sha", "ends", F.lit(EMPTY)).alias("ends")
    own = ["id", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved"]
    parts = stash(parts.join(ids.mapInArrow(tidy(_joined), "id binary, sha string"), "id", "left").select(*own, ends, F.array(F.lit(0).cast("long")).alias("below")))
    points = stash(found.where(F.col("kind") == EDGE).select(*own, "ends", "below").unionAll(parts))
    discard(found, parts)
    above = points.where("n_children > 0").select(F.col("id").alias("parent"), F.col("conv_id").alias("above"), F.col("n_children").alias("n"))
    under = hot_join(points.where("parent is not null"), above, "parent", "n")
    rows = under.unionByName(points.where("parent is null").withColumn("above", F.lit(None).cast("long")))
    size = F.size("below")
    one = rows.select("*", size.alias("size"), F.posexplode("below").alias("at", "more"))
    last = F.col("at") == F.col("size") - 1
    return one.select(
        "conv_id",
        (F.col("depth") - F.col("size") + 1 + F.col("at")).cast("long").alias("depth"),
        F.when(F.col("at") == 0, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(last, F.col("n_children")).otherwise(F.lit(1).cast("long")).alias("n_children"),
        "n_leaves",
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("more")).alias("saved_tokens"),
        F.when(last, F.col("ends")).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )


def rebuilt(turns: DataFrame) -> DataFrame:
    """The query's input: each conversation starts with up to three turns of the one whose id ends its stretch of twenty."""
    turns = stash(turns)
    heads = turns.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    both = turns.withColumns({"base": F.expr("conv_id - conv_id % 20"), "h": h}).join(heads, "base", "left")
    none = F.array().cast(turns.schema["turns"].dataType)
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))).otherwise(none)
    return both.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """nodes() of conversations (conv_id, turn, role, text) as they are."""
    return nodes(turns_of(conversations))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix tree of the rebuilt conversations."""
    return nodes(rebuilt(turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


#: CRC-32 by its definition: eight conditional shifts a byte, over the bytes of the decimal id.
_STEP = "list_reduce(list_concat([{x}], [0, 0, 0, 0, 0, 0, 0, 0]), lambda p, q: xor(p >> 1, 3988292384 * (p & 1)))"
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda c, b: " + _STEP.format(x="xor(c, b)") + "), 4294967295)"

SQL = f"""
WITH own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hashed AS (SELECT *, CAST({_CRC} % 4 AS BIGINT) AS h FROM own),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM hashed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
paths AS (
  SELECT conv_id, d, len(turns) = d AS ends, sha256(CAST(to_json(turns[1:d]) AS VARCHAR)) AS path,
    CASE WHEN d > 0 THEN len(regexp_extract_all(turns[d].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS words
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
node AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM paths GROUP BY path, d),
above AS (SELECT n.path, n.d, p.path AS parent FROM node n JOIN paths p ON p.conv_id = n.conv_id AND p.d = n.d - 1),
children AS (SELECT parent AS path, count(*) AS n FROM above GROUP BY parent),
counted AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM node n LEFT JOIN children c USING (path)),
sums AS (
  SELECT p.path, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((v.n_convs - 1) * v.words) AS saved_tokens
  FROM counted v JOIN paths p ON p.conv_id = v.conv_id AND p.d <= v.d GROUP BY p.path)
SELECT c.conv_id, c.d AS depth, q.conv_id AS parent_conv_id, c.n_convs, c.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN sums s USING (path) LEFT JOIN above a USING (path) LEFT JOIN node q ON q.path = a.parent
"""
