"""Materialisation boundaries: Parquet in the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only in local mode where that is unset (tests). On a
    cluster every machine has temporary folders of its own, so there an unset folder is an error."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), "farside-checkpoints")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """The session's setting has this value inside, and its own again afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


_scopes: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch():
    """Tables stashed inside, by whatever function, are deleted at the end; those taken out of the list that this gives stay.
    For work whose result is written or stashed inside."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        discard(*_scopes.pop())


def keep(df: DataFrame) -> DataFrame:
    """df, which stays when the innermost scratch() ends."""
    if _scopes:
        _scopes[-1][:] = [x for x in _scopes[-1] if x is not df]
    return df


def stash(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared checkpoint folder and read it back: lineage ends there, and a lost executor
    costs only the tasks it was running. Shuffle files of the write go with it. The path is kept on the result for
    discard()."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what stash() wrote for these; only for tables that no pending plan reads."""
    for df in tables:
        path = getattr(df, "_stash_path", None)
        if path:
            Store(df.sparkSession).delete(path)


class Store:
    """Small files and folders in whatever file system Spark reads, from the driver."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def is_folder(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.getFileStatus(p).isDirectory()

    def names(self, path: str) -> list[str]:
        """Of what is in a folder; none if there is no such folder."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def move(self, source: str, target: str) -> None:
        """A folder to a new name, whose parents are made."""
        fs, p = self._at(target)
        fs.mkdirs(p.getParent())
        if not fs.rename(self._at(source)[1], p):
            raise OSError(f"cannot move {source} to {target}")

    def write(self, path: str, content: str) -> None:
        """A small file, which appears whole or not at all."""
        fs, p = self._at(f"{path}.{uuid.uuid4().hex}.new")
        out = fs.create(p, True)
        try:
            out.write(bytearray(content.encode()))
        finally:
            out.close()
        self.move(p.toString(), path)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
