"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of rows. With a share w of the weights, block k of a source is released at slot floor(k/w)
and due at slot ceil((k+1)/w); in every slot the released block with the earliest deadline goes. One slot takes one block
and the shares add up to one, so every deadline is met and after any number of slots each source is within one block of
its target. Weights are whole numbers, so the schedule repeats after as many slots as they add up to: the driver works out
that one period, whose length is a parameter's sum, and every row finds its slot from its own rank.

Ranks come without a task that holds a whole source: rows are dealt by source and the leading digits of a hash, as many as
keep a cell below about CELL rows, ranked there, and moved up by the number of rows in earlier cells.

Where a source ends its later slots stay empty, and the others go on in the same proportions. No row is dropped.

Defined results: a null source is a source of its own; a source without a weight has the default weight, and sources with
weights but no rows take no slots; more than MAX_SOURCES sources are refused with a ValueError; null ids rank last, among
themselves by text; texts are only hashed, whatever their length; repeated rows follow each other; an empty table gives an
empty result; other columns are kept, and a clash of names with the new ones is avoided by leading underscores.
"""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import column_name

DIGITS, CELL, MAX_SOURCES = 3, 20_000, 100_000
#: Production parameters of the query and the pipeline's stage.
WEIGHTS, DEFAULT, BLOCK = {"src0": 8, "src1": 4, "src2": 4, "src3": 2, "src4": 2}, 1, 16
NO_SOURCE = "\u0000"


def period(weights: dict[str, int]) -> list[str]:
    """The source of every slot of one period, by earliest deadline first (ties: by name)."""
    total, slots = sum(weights.values()), []
    waiting = [(0, -(-total // w), s, 0) for s, w in sorted(weights.items()) if w > 0]  # release, deadline, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    for now in range(total):
        while waiting and waiting[0][0] <= now:
            _, due, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, k))
        _, s, k = heapq.heappop(ready)
        slots.append(s)
        w, k = weights[s], k + 1
        heapq.heappush(waiting, (k * total // w, -(-(k + 1) * total // w), s, k))
    return slots


def ranked(docs: DataFrame, source: str, rank: str, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", hash_col: str | None = None) -> DataFrame:
    """docs with the source (null made NO_SOURCE) and the row's rank in it, counted from 0 by a hash of the id. hash_col:
    XXH64 of the text, for rows that have it in place of the text."""
    h, in_cell, place = (column_name(docs, c) for c in ("_hash", "_cell", "_in"))
    its_source, its_cell, before = (column_name(docs, c) for c in ("_cell_source", "_cell_of", "_before"))
    name = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(NO_SOURCE))
    digest = F.coalesce(F.md5(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit("null"))
    n, digits = docs.count(), DIGITS
    while CELL * 16**digits < n and digits < 8:
        digits += 1
    cell = F.substring(digest, 1, digits)
    counts = docs.select(name.alias("s"), cell.alias("c")).groupBy("s", "c").count()
    earlier = counts.select(F.col("s").alias(its_source), F.col("c").alias(its_cell), (F.sum("count").over(Window.partitionBy("s").orderBy("c")) - F.col("count")).alias(before))
    rows = docs.withColumn(source, name).withColumn(h, digest).withColumn(in_cell, cell)
    own = Window.partitionBy(source, in_cell).orderBy(h, F.col(f"`{id_col}`"), F.col(hash_col) if hash_col else F.xxhash64(F.col(f"`{text_col}`")))
    dealt = rows.withColumn(place, F.row_number().over(own) - 1)
    out = dealt.join(earlier, (F.col(source) == F.col(its_source)) & (F.col(in_cell) == F.col(its_cell)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], source, (F.col(place) + F.col(before)).alias(rank))


def mix(docs: DataFrame, weights: dict[str, int] = WEIGHTS, default: int = DEFAULT, block: int = BLOCK, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", hash_col: str | None = None) -> DataFrame:
    """docs with source_rank, block, slot and position (slot * block + place in the block) behind the other columns;
    reading by position interleaves the sources."""
    spark = docs.sparkSession
    if any(not isinstance(w, int) or w < 1 for w in [*weights.values(), default]) or block < 1:
        raise ValueError("weights and the block size are whole numbers from 1")
    all_sources = docs.select(F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(NO_SOURCE)).alias("s")).distinct()
    present = [r[0] for r in all_sources.limit(MAX_SOURCES + 1).collect()]
    if len(present) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    own = {s: weights.get(s, default) for s in present}
    total, seen, slots = sum(own.values()), dict.fromkeys(own, 0), []
    for at, s in enumerate(period(own)):
        slots.append((s, own[s], seen[s], at))
        seen[s] += 1
    source, rank = column_name(docs, "_source"), column_name(docs, "source_rank")
    names = [column_name(docs, c) for c in ("block", "slot", "position")]
    its, share, turn, of, at = (column_name(docs, c) for c in ("_plan_source", "_plan_weight", "_plan_turn", "_turn", "_at"))
    # one row for each slot of a period, and so one for each source and turn
    plan = F.broadcast(spark.createDataFrame(slots, "s string, w int, k int, at int").toDF(its, share, turn, at))
    weight = F.broadcast(spark.createDataFrame(list(own.items()), "s string, w int").toDF(its, share))
    rows = ranked(docs, source, rank, id_col, source_col, text_col, hash_col).withColumn(names[0], F.floor(F.col(rank) / block).cast("long"))
    rows = rows.join(weight, F.col(source) == F.col(its)).withColumn(of, F.col(names[0]) % F.col(share)).drop(its)
    rows = rows.join(plan.drop(share), (F.col(source) == F.col(its)) & (F.col(of) == F.col(turn)))
    rows = rows.withColumn(names[1], F.floor(F.col(names[0]) / F.col(share)).cast("long") * total + F.col(at))
    rows = rows.withColumn(names[2], F.col(names[1]) * block + F.col(rank) % block)
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], rank, *names)


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """docs in the mixed order: files and rows within them follow each other by position; the columns stay as they are."""
    rows = mix(docs, **settings)
    position = rows.columns[-1]
    return rows.repartitionByRange(position).sortWithinPartitions(position).select(*[F.col(f"`{c}`") for c in docs.columns])


def in_order(docs: DataFrame, position_col: str = "position") -> DataFrame:
    """docs with a column position_col: the place, from 0, of each row of Parquet files in the order of the files' names and of
    the rows within them, which is the mixed order of what mixed() wrote. Other tables are taken in the order of their
    partitions."""
    names, position = [F.col(f"`{c}`") for c in docs.columns], column_name(docs, position_col)
    part, row, of, before = (column_name(docs, c) for c in ("_part", "_row", "_of", "_before"))
    try:
        placed = docs.select(*names, F.col("_metadata.file_path").alias(part), F.col("_metadata.row_index").alias(row))
    except AnalysisException:  # not files
        at = F.monotonically_increasing_id()
        placed = docs.withColumn(part, F.shiftright(at, 33)).withColumn(row, at.bitwiseAND(F.lit((1 << 33) - 1)))
    # one row for each file
    sizes = placed.groupBy(F.col(part).alias(of)).count()
    sizes = sizes.select(of, (F.sum("count").over(Window.orderBy(of)) - F.col("count")).alias(before))
    return placed.join(F.broadcast(sizes), F.col(part) == F.col(of)).select(*names, (F.col(row) + F.col(before)).alias(position))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """Place of every document in the mixed order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", F.col("text"))
    return mix(docs).select("doc_id", "source", "source_rank", "block", "slot", "position")


_CASES = " ".join(f"WHEN '{s}' THEN {w}" for s, w in WEIGHTS.items())
SQL = f"""
WITH RECURSIVE w AS (
  SELECT s, CASE s {_CASES} ELSE {DEFAULT} END AS a FROM (SELECT DISTINCT coalesce(source, chr(0)) AS s FROM documents)),
l AS (SELECT list(s ORDER BY s) AS names, list(a ORDER BY s) AS a, sum(a)::BIGINT AS d, count(*)::BIGINT AS n FROM w),
t AS (
  SELECT 0::BIGINT AS now, list_transform(names, lambda x: 0::BIGINT) AS k, NULL::BIGINT AS c, NULL::BIGINT AS turn FROM l
  UNION ALL
  SELECT now + 1, list_transform(range(1, n + 1), lambda i: k[i] + CASE WHEN i = pick THEN 1 ELSE 0 END), pick, k[pick]
  FROM (SELECT now, k, n, list_position(due, list_min(due))::BIGINT AS pick
        FROM (SELECT now, k, n, list_transform(range(1, n + 1), lambda i: CASE WHEN (k[i] * d) // a[i] <= now
                THEN ((k[i] + 1) * d + a[i] - 1) // a[i] ELSE 1000000000000 END) AS due
              FROM t, l WHERE now < d))),
plan AS (SELECT names[c] AS s, a[c] AS a, d, turn, now - 1 AS at FROM t, l WHERE c IS NOT NULL),
r AS (SELECT doc_id, source, coalesce(source, chr(0)) AS s,
        row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS source_rank FROM documents),
b AS (SELECT *, source_rank // {BLOCK} AS block FROM r)
SELECT b.doc_id, b.source, b.source_rank, b.block, (b.block // p.a) * p.d + p.at AS slot,
       ((b.block // p.a) * p.d + p.at) * {BLOCK} + b.source_rank % {BLOCK} AS position
FROM b JOIN plan p ON p.s = b.s AND p.turn = b.block % p.a
"""
