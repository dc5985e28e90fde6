"""Text files of scalars and triples, as positional tables, and sinks of the same kind.

A file is a sequence of tokens between white space, whatever its lines; rows are numbered from 0 in the order of the
file. Files are read twice: first the tokens of each split are counted, then each split, told where it begins, makes its rows
in place. Of the tokens themselves none is exchanged. A row that begins in one split and ends in another is made by the first,
from the other's first tokens, which the count has brought along. Reading stops before the first token that is not a number.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import Store

NUMBER = r"[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|nan|NaN|inf|Infinity|-?Infinity)"


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(part, start, value): every line with the file and the split it is in, in order within a split."""
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))


def _pieces(batches):
    """((part, start), tokens) of stretches of lines of one split, in their order."""
    for batch in batches:
        names = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        values = iter(batch.column(2).to_pylist())
        for split, lines in itertools.groupby(names):
            yield split, b" ".join(v for v in itertools.islice(values, sum(1 for _ in lines)) if v).split()


def _counter(heads: int, wrong: int):
    """Tokens of each split: their number, the first `heads` of them, and the places of the first `wrong` that are no numbers."""
    good = re.compile(NUMBER.encode()).fullmatch

    def run(batches):
        for split, pieces in itertools.groupby(_pieces(batches), key=lambda p: p[0]):
            n, head, bad = 0, [], []
            for _, tokens in pieces:
                head += tokens[: heads - len(head)]
                if len(bad) < wrong:
                    bad += itertools.islice((n + k for k, t in enumerate(tokens) if not good(t)), wrong - len(bad))
                n += len(tokens)
            yield pa.RecordBatch.from_arrays([pa.array([split[0]]), pa.array([split[1]], pa.int64()), pa.array([n], pa.int64()), pa.array([head], pa.list_(pa.binary())), pa.array([bad], pa.list_(pa.int64()))], names=["part", "start", "n", "head", "bad"])

    return run


@dataclass
class Scan:
    """What is known of some files of `width` numbers a row after `header` tokens: places of their splits, their first token
    and their rows. There is one entry for each split, as there is in the list of splits that Spark's driver keeps."""

    paths: list[str]
    header: int
    width: int
    splits: dict[tuple[str, int], tuple] = field(default_factory=dict)
    first: dict[int, bytes] = field(default_factory=dict)
    rows: dict[int, int] = field(default_factory=dict)

    def table(self, spark: SparkSession, names: list[str]) -> DataFrame:
        """(file, rn, *names)."""
        places = spark.sparkContext.broadcast(self.splits)
        kinds = "file long, rn long, " + ", ".join(f"`{n}` double" for n in names)
        return _lines(spark, self.paths).mapInArrow(_maker(places, self.header, self.width, ["file", "rn", *names]), kinds)


def scan(spark: SparkSession, paths: list[str], header: int, width: int, file_of=lambda part: 0) -> Scan:
    """Counts tokens. file_of: the number of the file that a part belongs to; parts of a file follow each other by name."""
    heads = max(width - 1, header, 1)
    # one row for each split
    kinds = "part string, start long, n long, head array<binary>, bad array<long>"
    found = _lines(spark, paths).mapInArrow(_counter(heads, header + 1), kinds).collect()
    files = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.part, r.start)):
        files[file_of(r.part)].append(r)
    out = Scan(paths, header, width)
    for number, splits in files.items():
        begins = list(itertools.accumulate((r.n for r in splits), initial=0))
        end = min((b + k for b, r in zip(begins, splits) for k in r.bad if b + k >= header), default=begins[-1])
        out.rows[number] = max(0, end - header) // width
        after: list[bytes] = []  # the first tokens that follow a split
        for begin, r in reversed(list(zip(begins, splits))):
            out.splits[r.part, r.start] = (number, begin, min(end, header + out.rows[number] * width), after)
            after = [*map(bytes, r.head), *after][:heads] if r.n <= heads else [bytes(t) for t in r.head]
        if after:
            out.first[number] = after[0]
    return out


def _maker(places, header: int, width: int, names: list[str]):
    """Rows that begin in a split, from its tokens and the first ones after it."""

    def rows(number: int, at: int, tokens: list[bytes]):
        values = np.fromiter(map(float, tokens), np.float64, len(tokens)).reshape(-1, width)
        rn = (at - header) // width + np.arange(len(values))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(values), number)), pa.array(rn), *(pa.array(values[:, k]) for k in range(width))], names=names)

    def run(batches):
        for split, pieces in itertools.groupby(_pieces(batches), key=lambda p: p[0]):
            number, at, end, after = places.value[split]
            held: list[bytes] = []
            for tokens in itertools.chain((t for _, t in pieces), [None]):
                last = tokens is None
                held += after[: width - 1] if last else tokens
                skip = max(header - at, 0) or (header - at) % width  # what is the header's, or a row's of the split before
                skip = min(skip, len(held))
                at, held = at + skip, held[skip:]
                if at < header or (at - header) % width:
                    continue  # not yet at the beginning of a row
                whole = max(0, min(len(held), end - at)) // width * width
                if whole:
                    yield rows(number, at, held[:whole])
                    at, held = at + whole, held[whole:]

    return run


def existing(spark: SparkSession, paths: list[str], on_missing: str = "error") -> list[str]:
    """Of the paths those that exist; a missing one is an error unless on_missing is "skip"."""
    store = Store(spark)
    there = [p for p in paths if store.exists(p)]
    if on_missing != "skip" and len(there) < len(paths):
        raise FileNotFoundError(", ".join(p for p in paths if p not in there))
    return there


def read_scalars(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """(rn, name) of a list without header: a file, or a folder as write_values() makes it."""
    return scan(spark, [path], 0, 1).table(spark, [name]).drop("file")


def read_counted(spark: SparkSession, path: str, name: str = "b") -> DataFrame:
    """(rn, name) of a list whose first token is its length; surplus values are left out, a short list is an error."""
    found = scan(spark, [path], 1, 1)
    if 0 not in found.first:
        raise ValueError(f"{path} has no length")
    size = int(float(found.first[0]))
    if found.rows[0] < size:
        raise ValueError(f"{path} has fewer than {size} values")
    return found.table(spark, [name]).drop("file").where(F.col("rn") < size)


def read_days(spark: SparkSession, pattern: str, days: list[int], names: list[str], header: int, on_missing: str = "error") -> DataFrame:
    """(day, rn, *names) of one file a day, or one folder as write_days() makes it; pattern has {day} in it. header: tokens
    to leave out at the start. An incomplete last row does not count. The rows of each day are known, see sizes()."""
    paths = existing(spark, [pattern.format(day=d) for d in days], on_missing)
    if not paths:
        return spark.createDataFrame([], "day int, rn long, " + ", ".join(f"{n} double" for n in names))
    prefix, suffix = map(re.escape, pattern.rsplit("/", 1)[-1].split("{day}"))
    inner = "/[^/]*" if Store(spark).is_folder(paths[0]) else ""
    day_of = lambda part: int(re.search(rf"/{prefix}(\d+){suffix}{inner}$", part)[1])
    found = scan(spark, paths, header, len(names), day_of)
    out = found.table(spark, names).withColumn("file", F.col("file").cast("int")).withColumnRenamed("file", "day")
    out._sizes = dict(found.rows)
    return out


def sizes(df: DataFrame) -> dict[int, int] | None:
    """Rows by day of a table from read_days(), without reading it; None of other tables."""
    return getattr(df, "_sizes", None)


def read_triples(spark: SparkSession, pattern: str, days: list[int], names: list[str], on_missing: str = "error") -> DataFrame:
    return read_days(spark, pattern, days, names, header=3, on_missing=on_missing)


def write_values(df: DataFrame, path: str, order: str, value: str, header: str | None = None) -> None:
    """One value a line in the given order, as a folder of files whose names sort in that order; header: a first line."""
    lines = df.orderBy(order).select(F.col(value).cast("string").alias("value"))
    if header is not None:
        lines = df.sparkSession.createDataFrame([(header,)], "value string").unionAll(lines)
    lines.write.mode("overwrite").text(path)


def write_days(rows: DataFrame, path: str, order: str, columns: list[str], header: str | None = None, files: int | None = None) -> None:
    """One folder day=... a day, its rows in the given order, one a line; header: a first line. Rows are cut by day and place,
    so many tasks write a day, and its files follow each other by name. files: how many in all, else as many as the session
    shuffles into."""
    body = rows.select("day", F.col(order).cast("long").alias("at"), F.concat_ws(" ", *(F.col(c).cast("string") for c in columns)).alias("value"))
    if header is not None:
        body = body.unionAll(rows.select("day").distinct().select("day", F.lit(-1).cast("long"), F.lit(header)))
    cut = body.repartitionByRange(*([files] if files else []), "day", "at")
    cut.sortWithinPartitions("day", "at").select("day", "value").write.partitionBy("day").text(path)


def write_images(images: DataFrame, path: str) -> None:
    """Real parts by day."""
    images.select("day", "ipix", "c_re").write.mode("overwrite").partitionBy("day").parquet(path)


def read_images(spark: SparkSession, path: str, days: list[int] | None = None) -> DataFrame:
    """(day, ipix, c_re) of a folder, of some days or all that are in it."""
    if days is None:
        return spark.read.parquet(path).select("day", "ipix", "c_re")
    if not days:
        return spark.createDataFrame([], "day int, ipix long, c_re double")
    return spark.read.option("basePath", path).parquet(*(f"{path}/day={d}" for d in days)).select("day", "ipix", "c_re")
