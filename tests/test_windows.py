"""Hand-made frames for the panel window operators (FIXTURES section 5)."""
import datetime as dt

from pyspark.sql import functions as F

from veldt.operators import labels, windows as W


def frame(spark, values, col="x", start=dt.date(2000, 1, 1), entity="E"):
    rows = [(entity, start + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"entity string, day date, {col} double")


def col(df, name):
    return [r[name] for r in df.orderBy("day").collect()]


def test_ffill_limit_7_and_8(spark):
    vals = [1.0] + [None] * 7 + [2.0] + [None] * 8
    out = col(frame(spark, vals).withColumn("f", W.ffill(F.col("x"), 7)), "f")
    assert out[:8] == [1.0] * 8                       # gap of exactly 7 is filled
    assert out[8:16] == [2.0] * 8 and out[16] is None  # 8th missing row stays NULL


def test_rolling_min_periods(spark):
    vals = [1.0, None, 1.0, 1.0, 1.0, None, 1.0]
    out = col(frame(spark, vals).withColumn("s", W.rolling_sum(F.col("x"), 7, 4)), "s")
    assert out[:4] == [None, None, None, None]        # only 3 observations so far
    assert out[4] == 4.0 and out[6] == 5.0


def test_forward_label_flag_only_on_day_t(spark):
    n, t = 80, 40
    df = frame(spark, [0.0] * n).withColumn("flag", F.col("day") == F.lit(dt.date(2000, 1, 1) + dt.timedelta(days=t)))
    out = col(df.withColumn("lab", W.forward_any(F.col("flag"), 30)), "lab")
    assert out[t] == 0                                  # today excluded
    assert all(out[i] == 1 for i in range(t - 30, t))   # t-30 .. t-1 see it
    assert out[t - 31] == 0
    assert all(v is None for v in out[-30:])            # incomplete horizon


def test_days_since_cap_and_first_event(spark):
    vals = [0.0] * 3 + [1.0] + [0.0] * 400
    df = frame(spark, vals)
    out = col(df.withColumn("d", W.days_since(F.col("x") > 0, F.col("day"), 365)), "d")
    assert out[:3] == [365, 365, 365] and out[3] == 0 and out[4] == 1 and out[-1] == 365


def test_drought_zero_expectation_is_not_drought(spark):
    # all-zero rain: expectation 0 -> ratio NULL -> no drought flag
    rows = [("E", dt.date(2001, 6, 1) + dt.timedelta(days=i), 0, [11, 12, 1, 2, 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "entity string, day date, precip_units long, dry_months array<int>")
    out = labels.drought_flag(df)
    assert out.where("drought_flag").count() == 0


def test_empty_input(spark):
    df = spark.createDataFrame([], "entity string, day date, x double")
    assert df.withColumn("s", W.rolling_sum(F.col("x"), 7, 4)).count() == 0
