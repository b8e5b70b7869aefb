"""Inputs that are dear to make are made once; full ISO texts are read as the rewritten ones are."""

import pytest
from pyspark.sql import functions as F

from tempolog.functions.scalars import parse_time
from tempolog.operators import features, gaps


def test_events_are_made_once_for_threshold_statistics_and_sessions(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def dear(t):
        made.add(1)
        return t

    raw = spark.range(200).select(F.col("id").alias("idx"), (F.col("id") % 7).cast("string").alias("uid"), F.lit("view").alias("op"),
                                  dear(F.col("id") * F.col("id") * 1_000_000).alias("ts_us"))
    rows = features.deltify(gaps.auto_sessions(raw, ["idx"])).rows.collect()
    assert len(rows) == 200 and made.value == 200


@pytest.mark.parametrize("zone", ["Z", "+09:00", "-05:30", "+18:00", "+19:00", "+99:99"])
def test_full_iso_is_read_as_rewritten_iso(spark, zone):
    starts = ["2024-01-31T23:59:59", "2024-01-31 00:00:00", "2024-02-30T00:00:00", "2023-02-29T10:00:00", "2024-13-01T00:00:00",
              "2024-01-01T24:00:00", "2024-01-01T10:60:00", "2024-01-01T10:00:61", "0001-01-01T00:00:00", "0000-01-01T00:00:00", "9999-12-31T23:59:59"]
    # Seven digits of a fraction are cut to six, which is the same time by the longer way.
    pairs = [(f"{s}.{f}{zone}", f"{s}.{f}{'0' * (7 - len(f))}{zone}") for s in starts for f in ("1", "000", "123456")]
    pairs += [(f"{s}{zone}", f"{s}.0000000{zone}") for s in starts]
    df = spark.createDataFrame(pairs, "full string, other string")
    got = df.select("full", F.unix_micros(parse_time("full")).alias("a"), F.unix_micros(parse_time("other")).alias("b")).collect()
    assert all(r.a == r.b for r in got), [r for r in got if r.a != r.b][:3]
    assert zone in ("+19:00", "+99:99") or sum(r.a is not None for r in got) >= 12
