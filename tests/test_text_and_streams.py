"""Text sources and sinks, and the stream of day images."""

import os
import random

import pytest
from pyspark.sql import functions as F

from farside.plans import job, queries, staging
from farside.sources import text
from farside.streaming import days


def test_counted_list(spark, tmp_path):
    p = tmp_path / "b.txt"
    p.write_text("3\n1.5 2\n-3e2 99\n")
    assert [(r.rn, r.b) for r in text.read_counted(spark, str(p)).orderBy("rn").collect()] == [(0, 1.5), (1, 2.0), (2, -300.0)]
    p.write_text("5\n1 2 3\n")
    with pytest.raises(ValueError):
        text.read_counted(spark, str(p))
    p.write_text("")
    with pytest.raises(ValueError):
        text.read_counted(spark, str(p))


def test_triples_over_lines_and_stop_at_words(spark, tmp_path):
    (tmp_path / "uvw1day1M.txt").write_text("u v w\n1 2\n3 4 5 6\n\n7 8 end 9\n")
    (tmp_path / "uvw2day1M.txt").write_text("u v w\n")
    pattern = f"file://{tmp_path}/uvw{{day}}day1M.txt"
    got = text.read_triples(spark, pattern, [1, 2], ["u", "v", "w"]).orderBy("rn").collect()
    assert [tuple(r) for r in got] == [(1, 0, 1.0, 2.0, 3.0), (1, 1, 4.0, 5.0, 6.0)]
    with pytest.raises(FileNotFoundError):
        text.read_triples(spark, pattern, [1, 3], ["u", "v", "w"])
    assert text.read_triples(spark, pattern, [3], ["u", "v", "w"], on_missing="skip").count() == 0


def test_rows_keep_their_order_over_splits(spark, tmp_path):
    p = tmp_path / "big.txt"
    p.write_text("".join(f"{k}\n" for k in range(50_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        df = text.read_scalars(spark, str(p))
        assert df.rdd.getNumPartitions() >= 1 and df.where("rn <> value").count() == 0 and df.count() == 50_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rows_over_lines_and_splits(spark, tmp_path):
    """Rows that begin in one split and end in a later one, splits with less than a row, words in the middle."""
    rng = random.Random(4)
    for width, header, size in ((3, 3, "16b"), (3, 3, "64b"), (5, 2, "8b"), (1, 1, "8b")):
        tokens, lines = [f"{k}.5" if k % 7 else f"-{k}e0" for k in range(400)], []
        left = ["head"] * header + tokens
        while left:
            n = rng.choice((0, 1, 1, 2, 5))
            lines.append(" ".join(left[:n]))
            left = left[n:]
        where = f"{tmp_path}/{width}{size}/uvw"
        os.makedirs(where)
        for day, upto in ((1, len(lines)), (2, 90)):
            with open(f"{where}{day}.txt", "w") as f:
                f.write("\n".join(lines[:upto]) + ("" if day == 1 else " stop 1 2 3 4 5 6 7 8 9"))
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            names = list("abcde")[:width]
            df = text.read_days(spark, f"file://{where}{{day}}.txt", [1, 2], names, header)
            got = sorted(map(tuple, df.collect()))
            assert df.rdd.getNumPartitions() > 20
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        want = []
        for day, upto in ((1, len(lines)), (2, 90)):
            values = [float(t) for t in " ".join(lines[:upto]).split()[header:]]
            want += [(day, k, *values[k * width : (k + 1) * width]) for k in range(len(values) // width)]
        assert got == want and text.sizes(df) == {d: sum(w[0] == d for w in want) for d in (1, 2)}


def test_no_token_is_exchanged(spark, tmp_path):
    (tmp_path / "uvw1.txt").write_text("u v w\n" + "1 2 3\n" * 50)
    df = text.read_triples(spark, f"file://{tmp_path}/uvw{{day}}.txt", [1], ["u", "v", "w"])
    assert df.count() == 50 and "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_many_tasks_write_a_day_in_order(spark, tmp_path):
    df = spark.createDataFrame([(d, k, k * 1.5, -k * 1.0, d + 0.25) for d in (1, 2) for k in range(4000)], "day int, rn long, u double, v double, w double").repartition(5)
    text.write_days(df, f"{tmp_path}/uvw", "rn", ["u", "v", "w"], "u v w", files=16)
    files = {d: sorted((tmp_path / f"uvw/day={d}").glob("part-*")) for d in (1, 2)}
    assert all(len(f) >= 7 for f in files.values()) and max(p.stat().st_size for f in files.values() for p in f) < 25_000
    back = text.read_triples(spark, f"file://{tmp_path}/uvw/day={{day}}", [1, 2], ["u", "v", "w"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(k, float(k)) for k in range(100)], "ipix long, theta double")
    text.write_values(df, f"{tmp_path}/theta", "ipix", "theta")
    lines = [x for p in sorted((tmp_path / "theta").glob("part-*")) for x in p.read_text().split()]
    assert [float(x) for x in lines] == [float(k) for k in range(100)]
    images = spark.createDataFrame([(1, 0, 1.0), (2, 0, 3.0)], "day int, ipix long, c_re double")
    text.write_images(images, f"{tmp_path}/images")
    assert sorted(tuple(r) for r in text.read_images(spark, f"{tmp_path}/images").collect()) == [(1, 0, 1.0), (2, 0, 3.0)]


def written(root):
    return {str(p.relative_to(root)) for p in root.glob("v=*/part=*")}


def test_running_total_writes_what_it_touches(spark, tmp_path):
    root = tmp_path / "sum"
    day = lambda d, pixels: spark.createDataFrame([(d, p, float(d)) for p in pixels], days.SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{d}")

    def go():
        query = days.running_total(days.day_images(spark, f"{tmp_path}/in/*", 1), "totals", f"file://{root}", f"{tmp_path}/state", size=4)
        query.awaitTermination(120)
        return {r.ipix: r.c for r in spark.sql("SELECT * FROM totals").collect()}

    day(1, range(12))
    assert go() == {p: 1.0 for p in range(12)} and written(root) == {f"v=0/part={r}" for r in range(3)}
    day(2, range(4, 8))  # one range
    assert go() == {p: 1.0 + 2.0 * (4 <= p < 8) for p in range(12)}
    assert written(root) - {f"v=0/part={r}" for r in range(3)} == {"v=1/part=1"}
    day(4, [0, 20])
    assert go() == {p: 1.0 + 2.0 * (4 <= p < 8) + 4.0 * (p == 0) for p in range(12)} | {20: 4.0}
    assert {w for w in written(root) if w.startswith("v=2")} == {"v=2/part=0", "v=2/part=5"}
    # a batch that comes again, and one that was lost before its index
    again = spark.createDataFrame([(9, 0, 100.0)], days.SCHEMA)
    assert days.add(again, 2, f"file://{root}", 4) == [] and days.summed(spark, f"file://{root}").where("ipix = 0").first().c == 5.0
    spark.range(3).write.parquet(f"{root}/v=3/part=0")
    assert days.add(again, 3, f"file://{root}", 4) == [0] and days.summed(spark, f"file://{root}").where("ipix = 0").first().c == 105.0


def test_running_total_takes_nan_as_zero(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 1.0), (2, 0, 2.0), (1, 1, float("nan"))], days.SCHEMA)
    days.add(df, 0, f"file://{tmp_path}/sum")
    days.add(df.limit(0), 1, f"file://{tmp_path}/sum")
    assert {r.ipix: r.c for r in days.summed(spark, f"file://{tmp_path}/sum").collect()} == {0: 3.0, 1: 0.0}


def test_a_job_goes_on_where_it_stopped(spark, sf_dir, monkeypatch):
    folder, _, all_days = queries._job_folder(spark, sf_dir)
    some = all_days[:3]
    whole = {tuple(r) for r in job.run(spark, folder, some, queries.OBSERVATION, f"{folder}/whole", together=3).collect()}
    target, asked, real = f"{folder}/C", [], job.images

    def spied(spark, folder, days, *a, **k):
        asked.append(days)
        if len(asked) == 2:
            raise RuntimeError("lost")
        return real(spark, folder, days, *a, **k)

    monkeypatch.setattr(job, "images", spied)
    with pytest.raises(RuntimeError):
        job.run(spark, folder, some, queries.OBSERVATION, target, together=1)
    assert job.done(spark, target) == some[:1] and asked == [[some[0]], [some[1]]]
    # what a lost run has left in a day's place is replaced
    spark.createDataFrame([(0, 99.0)], "ipix long, c_re double").write.parquet(f"{target}/day={some[1]}")
    got = {tuple(r) for r in job.run(spark, folder, some, queries.OBSERVATION, target, together=2).collect()}
    assert asked[2:] == [some[1:]] and got == whole and job.done(spark, target) == some
    assert {tuple(r) for r in job.run(spark, folder, some, queries.OBSERVATION, target).collect()} == whole and len(asked) == 3
    with pytest.raises(ValueError, match="other settings"):
        job.run(spark, folder, some, queries.OBSERVATION, target, masked=False)


def test_scratch_tables_go(spark):
    with staging.scratch():
        a = staging.stash(spark.range(3))
        b = staging.keep(staging.stash(a))
    assert b.count() == 3 and not staging.Store(spark).exists(a._stash_path)


def test_round_trip_has_every_day(spark, sf_dir, monkeypatch):
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    out = queries.text_roundtrip_all(spark, sf_dir).collect()
    assert len(out) == n and {r.day for r in out} == set(range(10)) and all(r.same for r in out)
    whole = queries._day_folders

    def spoilt(*a):  # a value of the last day
        df = whole(*a)
        return df.withColumn("y1", F.when((F.col("day") == 9) & (F.col("rn") == 0), 99.0).otherwise(F.col("y1"))) if "y1" in df.columns else df

    monkeypatch.setattr(queries, "_day_folders", spoilt)
    assert [(r.day, r.rn) for r in queries.text_roundtrip_all(spark, sf_dir).where("not same").collect()] == [(9, 0)]
    with pytest.raises(ValueError):
        queries.text_roundtrip(spark, sf_dir)
