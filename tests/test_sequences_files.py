"""Sequences against plain slices, sorted files and their pruned scan, chunks behind a manifest."""
import datetime
import glob
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from veldt.operators import relational as RL
from veldt.sources import chunks as CH
from veldt.sources import sorted_files as SO
from veldt.streaming.daily import fresh_base

DAY = datetime.date(2020, 1, 1)


@pytest.mark.parametrize("length", [1, 3, 7])
def test_sequences_are_the_slices_of_each_entity(spark, length):
    rng = random.Random(length)
    rows = [(e, DAY + datetime.timedelta(days=2 * i), float(i), float(hash(e) % 97), rng.random() < 0.6)
            for e, n in (("a", 20), ("b", 7), ("c", 2), ("d", 1), ("e", 14)) for i in range(n)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "entity string, day date, x double, y double, ok boolean").repartition(5)
    blocks = RL.sequence_blocks(df, ["x", "y"], length, targets=F.col("ok"), keep=["x"])
    got = {(r["entity"], r["day"]): (r["x"], r["seq"]) for r in RL.expand_sequences(blocks, length).collect()}
    want = {}
    for e in "abcde":
        own = [r for r in rows if r[0] == e]
        for i in range(length - 1, len(own)):
            if own[i][4]:
                want[e, own[i][1]] = (own[i][2], [[r[2], r[3]] for r in own[i - length + 1:i + 1]])
    assert got == want
    held = blocks.select(F.sum(F.size("cur")), F.sum(F.coalesce(F.size("prev"), F.lit(0)))).first()
    assert sum(v or 0 for v in held) <= 2 * len(rows)


def test_null_targets_and_no_rows(spark):
    df = spark.createDataFrame([("a", DAY, None, None), ("a", DAY + datetime.timedelta(days=1), 2.0, True)], "entity string, day date, x double, ok boolean")
    got = RL.expand_sequences(RL.sequence_blocks(df, ["x"], 2, targets=F.col("ok")), 2).collect()
    assert [(r["day"], r["seq"]) for r in got] == [(DAY + datetime.timedelta(days=1), [[None], [2.0]])]
    assert RL.expand_sequences(RL.sequence_blocks(df.limit(0), ["x"], 2), 2).count() == 0


@pytest.fixture(scope="module")
def written(spark):
    rng = random.Random(3)
    rows = [(f"e{rng.randrange(12):02d}", DAY + datetime.timedelta(days=rng.randrange(900)), rng.random(), rng.choice([1.0, None])) for _ in range(30_000)]
    path = fresh_base(spark, "sorted-test")
    SO.write(spark.createDataFrame(rows, "entity string, day date, v double, w double").repartition(6), path, ["entity", "day"], files=5, group_bytes=32 << 10)
    return rows, path


def test_files_lie_in_order(spark, written):
    rows, path = written
    assert SO.order_report(spark.read.parquet(path), ["entity", "day"]).first().asDict() == {"n_rows": len(rows), "rows_out_of_order": 0, "files_that_overlap": 0}
    mixed = fresh_base(spark, "unsorted-test")
    spark.read.parquet(path).repartition(3).write.mode("overwrite").parquet(mixed)
    bad = SO.order_report(spark.read.parquet(mixed), ["entity", "day"]).first()
    assert bad["rows_out_of_order"] > 0 and bad["files_that_overlap"] == 2


def test_scan_reads_only_the_row_groups_that_can_match(spark, written):
    rows, path = written
    lo, hi = datetime.date(2020, 6, 1), datetime.date(2020, 9, 1)
    expected = 0
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            e, d = (meta.row_group(g).column(k).statistics for k in (0, 1))
            if any(e.min <= x <= e.max for x in ("e03", "e08")) and d.min <= hi and d.max >= lo:
                expected += meta.row_group(g).num_rows
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = SO.scan(spark.read.parquet(path), {"entity": ["e03", "e08"]}, ("day", "2020-06-01", "2020-09-01"), ["w"])
        kept = [(r["entity"], r["day"]) for r in got.collect()]
        read = got._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().get("numOutputRows").get().value()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert kept == sorted(kept)
    assert sorted(kept) == sorted((r[0], r[1]) for r in rows if r[0] in ("e03", "e08") and lo <= r[1] <= hi and r[3] is not None)
    assert len(kept) <= read / 2 <= expected < len(rows) / 4  # a global sort reads its input twice: ranges first


def test_open_ended_scan(spark, written):
    rows, path = written
    df = spark.read.parquet(path)
    assert SO.scan(df, {}, ("day", None, "2020-02-01")).count() == sum(r[1] <= datetime.date(2020, 2, 1) for r in rows)
    assert SO.scan(df, {"entity": []}).count() == 0


def test_broken_and_failed_chunks_are_reported_and_left_out(spark):
    base = fresh_base(spark, "chunk-test")
    df = spark.range(10).select("id", F.lit("x").alias("t"))
    assert CH.land(base, "a", df) and CH.land(base, "b", df.limit(4)) and CH.land(base, "e", df.limit(0))
    assert not CH.land(base, "c", df.where(F.raise_error(F.lit("gone")).isNull()))
    assert CH.land(base, "d", df.repartition(3))
    broken = sorted(glob.glob(f"{CH.folder(base, 'd')}/*.parquet"))[0]
    spark.range(1).select(F.lit("zzz").alias("value")).write.mode("overwrite").text(CH.folder(base, "b"))
    p = spark._jvm.org.apache.hadoop.fs.Path(broken)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True).close()  # an empty file, no Parquet
    rows, report = CH.read(spark, base, "id bigint, t string")
    got = {r["chunk"]: (r["state"], r["expected"], r["found"]) for r in report.collect()}
    assert got["a"] == ("complete", 10, 10) and got["b"] == ("corrupt", 4, 0) and got["c"] == ("failed", None, 0) and got["d"][0] == "corrupt"
    assert got["e"] == ("complete", 0, 0) and 0 < got["d"][2] < 10
    assert "gone" in report.where("chunk = 'c'").first()["error"]
    assert sorted((r["chunk"], r["id"]) for r in rows.collect()) == [("a", i) for i in range(10)]
    assert CH.land(base, "c", df) and CH.read(spark, base, "id bigint, t string")[0].count() == 20  # fetched again
