from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from loomspark.operators.timestamps import known_zones, record_instants, with_utc_micros

US = 1_000_000


def utc(*parts, us=0):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * US + us


CASES = [
    ("2025-02-24T05:36:08.116Z", None, utc(2025, 2, 24, 5, 36, 8, us=116000)),
    ("2025-02-24T05:59:51.117861999Z", None, utc(2025, 2, 24, 5, 59, 51, us=117861)),
    ("\t2025/02/24 05:36:08 ", "UTC", utc(2025, 2, 24, 5, 36, 8)),
    ("2025-02-24 05:36:08,577", "Asia/Kolkata", utc(2025, 2, 24, 0, 6, 8, us=577000)),
    ("2025-05-05t01:54:11+05", "Asia/Tokyo", utc(2025, 5, 4, 20, 54, 11)),
    ("2025-05-05 01:54:11.5-0330", None, utc(2025, 5, 5, 5, 24, 11, us=500000)),
    ("20250725T055703Z", None, utc(2025, 7, 25, 5, 57, 3)),
    ("20250725055703", "Europe/Berlin", utc(2025, 7, 25, 3, 57, 3)),
    ("22.08.2025 15:43:40", "UTC", utc(2025, 8, 22, 15, 43, 40)),
    ("13.05.2025 16:08:40 UTC+5:30", None, utc(2025, 5, 13, 10, 38, 40)),
    ("Thu, 05 Mar 2026 23:34:39 +0900", None, utc(2026, 3, 5, 14, 34, 39)),
    ("Mon Feb  2 12:17:42 2026", "UTC", utc(2026, 2, 2, 12, 17, 42)),
    ("Mar 31, 2025 12:37:16 AM", "UTC", utc(2025, 3, 31, 0, 37, 16)),
    ("Mar 31, 2025 12:37:16 PM", "UTC", utc(2025, 3, 31, 12, 37, 16)),
    ("7. März 2026 23:42:19", "UTC", utc(2026, 3, 7, 23, 42, 19)),
    ("17 Apr 2025, 21:17:24", "UTC", utc(2025, 4, 17, 21, 17, 24)),
    ("2025-09-20 17:30:06 PST", "Asia/Tokyo", utc(2025, 9, 21, 1, 30, 6)),
    ("2025-09-20 17:30:06 Europe/Berlin", None, utc(2025, 9, 20, 15, 30, 6)),
    ("1755845032", None, 1755845032 * US),
    ("1761425513.3851239", None, 1761425513 * US + 385123),
    ("1756564340748", None, 1756564340748000),
    ("1746410262325875", None, 1746410262325875),
    ("1740376075519086003", None, 1740376075519086),
    ("2025-10-26 02:30:00", "Europe/Berlin", utc(2025, 10, 26, 0, 30, 0)),  # twice: the first
    ("2025-03-30 02:30:00", "Europe/Berlin", utc(2025, 3, 30, 1, 30, 0)),  # skipped: forward by the gap
    ("2024-02-29T00:00:00Z", None, utc(2024, 2, 29)),
    ("2025-02-29T00:00:00Z", None, None),
    ("2026-13-05 09:10:11Z", None, None),
    ("2026-05-11T25:61:00Z", None, None),
    ("2025-11-31 08:00:00+01:00", None, None),
    ("Mar 31, 2025 13:37:16 PM", "UTC", None),
    ("2025-02-24 05:36:08", None, None),
    ("2025-02-24 05:36:08", "Mars/Olympus", None),
    ("2025-02-24 05:36:08 XYZ", "UTC", None),
    ("123", "UTC", None),
    ("yesterday 09:14", "UTC", None),
    ("", "UTC", None),
    (None, "UTC", None),
    ("x" * 200_000, "UTC", None),
]


def test_notations(spark):
    rows = spark.createDataFrame([(i, t, z) for i, (t, z, _) in enumerate(CASES)], "i int, t string, z string")
    found = {r.i: r.utc_us for r in with_utc_micros(rows, F.col("t"), F.col("z"), known_zones(spark)).collect()}
    wrong = [(CASES[i], got) for i, got in found.items() if got != CASES[i][2]]
    assert not wrong


def test_every_day_matches_the_calendar(spark):
    days = spark.range(0, 60_000, 7).select(F.date_add(F.lit("1901-01-01"), F.col("id").cast("int")).alias("d"))
    rows = with_utc_micros(days.withColumn("t", F.concat(F.col("d").cast("string"), F.lit("T00:00:00Z"))), F.col("t"), F.lit(None).cast("string"), known_zones(spark))
    assert rows.filter(F.col("utc_us") != F.unix_date("d").cast("bigint") * 86_400 * US).count() == 0 and rows.filter("utc_us IS NULL").count() == 0


def test_records(spark):
    schema = "event_id string, timestamp string, metadata map<string,string>, utc_us string, record_id int"
    rows = [("a", "1755845032", None, "clash", 1), ("a", "1755845032", {}, "clash", 2), ("b", "2025-01-01 00:00:00", {"tz": "UTC"}, None, 3), ("c", "2025-01-01 00:00:00", {"tz": None}, None, 4), (None, "1755845032", None, None, 5)]
    out = record_instants(spark, {"t": (spark.createDataFrame(rows, schema), "event_id")}).collect()
    assert sorted((r.record_table, r.record_id, r.utc_us) for r in out) == [("t", "a", 1755845032 * US), ("t", "b", utc(2025, 1, 1))]
    assert record_instants(spark, {"t": (spark.createDataFrame([], schema), "event_id")}).count() == 0


@pytest.mark.parametrize("zone", ["America/New_York", "Australia/Sydney", "Asia/Kolkata"])
def test_against_zoneinfo(spark, zone):
    from zoneinfo import ZoneInfo

    local = [datetime(2025, m, d, h, 30) for m in range(1, 13) for d in (1, 9, 15, 30 if m != 2 else 28) for h in (0, 1, 2, 3, 13)]
    rows = spark.createDataFrame([(i, t.strftime("%Y-%m-%d %H:%M:%S")) for i, t in enumerate(local)], "i int, t string")
    got = {r.i: r.utc_us for r in with_utc_micros(rows, F.col("t"), F.lit(zone), known_zones(spark)).collect()}
    assert got == {i: int(t.replace(tzinfo=ZoneInfo(zone), fold=0).timestamp()) * US for i, t in enumerate(local)}
