"""Day images as they arrive: an optional streaming form of the day sum.

The sum is kept in ranges of pixels. A batch of days is summed by itself, and only the ranges it touches are read, added to and
written anew, as files of that batch's version; an index, written last, says which version of each range counts. So a batch
that is run again finds its index and does nothing, or what it left without one and replaces it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.imaging import total
from ..plans.staging import Store, discard, stash

SCHEMA = "day int, ipix long, c_re double"
#: Pixels in a range: a file of about 16 MB, and 192 ranges of the largest sky.
RANGE = 1 << 20


def day_images(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the Parquet files that appear under path."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "false").parquet(path)


def _index(spark: SparkSession, root: str) -> tuple[int, dict[int, int]]:
    """(last batch, the version of each range) of what has been added up so far."""
    names = [int(n) for n in Store(spark).names(f"{root}/_index") if n.isdigit()]
    if not names:
        return -1, {}
    return max(names), {int(r): v for r, v in json.loads(Store(spark).read(f"{root}/_index/{max(names)}")).items()}


def _ranges(spark: SparkSession, root: str, versions: dict[int, int]) -> DataFrame:
    if not versions:
        return spark.createDataFrame([], "ipix long, c double")
    return spark.read.schema("ipix long, c double").parquet(*(f"{root}/v={v}/part={r}" for r, v in sorted(versions.items())))


def summed(spark: SparkSession, root: str) -> DataFrame:
    """(ipix, c): the sum so far."""
    return _ranges(spark, root, _index(spark, root)[1])


def add(batch: DataFrame, batch_id: int, root: str, size: int = RANGE) -> list[int]:
    """Adds a batch of day images to the sum under root; the ranges it touched. Of superseded files those of the index before
    stay, for readers that began with it."""
    spark = batch.sparkSession
    store, (last, versions) = Store(spark), _index(spark, root)
    if batch_id <= last:
        return []
    new = stash(total(batch).withColumn("part", F.floor(F.col("ipix") / size).cast("long")))
    touched = sorted(r.part for r in new.select("part").distinct().collect())  # ranges of the sky, a few hundred
    place = f"{root}/v={batch_id}"
    store.delete(place)  # of a run that was lost
    if touched:
        old = _ranges(spark, root, {r: versions[r] for r in touched if r in versions})
        both = new.unionByName(old.withColumn("part", F.floor(F.col("ipix") / size).cast("long")))
        sums = both.groupBy("part", "ipix").agg(F.sum("c").alias("c"))
        sums.repartition("part").write.partitionBy("part").parquet(place)
    current = versions | dict.fromkeys(touched, batch_id)
    store.write(f"{root}/_index/{batch_id}", json.dumps(current))
    for name in store.names(root):
        version = name.removeprefix("v=")
        if version.isdigit() and int(version) not in {*versions.values(), *current.values()}:
            store.delete(f"{root}/{name}")
    discard(new)
    return touched


def running_total(stream: DataFrame, name: str, root: str, checkpoint: str, size: int = RANGE) -> StreamingQuery:
    """The sum of all days so far under root, and as a view called name. Nothing but a list of ranges reaches the driver."""

    spark = stream.sparkSession  # batches come with a session of their own, which has other views

    def added(batch: DataFrame, batch_id: int) -> None:
        add(batch, batch_id, root, size)
        summed(spark, root).createOrReplaceTempView(name)

    out = stream.writeStream.outputMode("append").foreachBatch(added)
    return out.queryName(f"{name}-{uuid.uuid4().hex[:8]}").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
