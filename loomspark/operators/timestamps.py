"""Mixed timestamp notations to one UTC instant.

Every notation is one branch of a single regular expression with named groups.  One ``regexp_replace`` pulls all
components out of a value at once; the rest is calendar validation and integer day arithmetic, so the whole
operator stays inside generated code: no Python, no shuffle.

Rules
* outer white space is ignored; null, blank or unreadable text has no instant;
* a zone or offset in the text holds, else ``fallback_zone``, else there is no instant;
* digits alone (also with decimals) count seconds, milli-, micro- or nanoseconds since 1970, whichever unit puts
  them in ``EPOCH_YEARS``; otherwise 12, 14 or more digits are a date and time without separators;
* dotted dates start with the day, dates with slashes with the year;
* a local time that occurs twice is the earlier one, one that is skipped moves forward by the gap;
* dates and times that do not exist, unknown zones and offsets beyond 18 hours give null;
* fractions below a microsecond are cut off.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month names (en, de, fr, es) and zone abbreviations.
MONTHS = {
    1: "jan january januar jän jänner janv janvier ene enero",
    2: "feb february februar févr fév février febrero fevr fevrier",
    3: "mar march mär märz mrz maerz mars marzo",
    4: "apr april avr avril abr abril",
    5: "may mai mayo",
    6: "jun june juni juin junio",
    7: "jul july juli juil juillet julio",
    8: "aug august août aout ago agosto",
    9: "sep sept september septembre septiembre",
    10: "oct october okt oktober octobre octubre",
    11: "nov november novembre noviembre",
    12: "dec december dez dezember déc décembre decembre dic diciembre",
}
ABBREVIATIONS = {"Z": 0, "UTC": 0, "GMT": 0, "CET": 60, "CEST": 120, "EST": -300, "EDT": -240, "PST": -480, "PDT": -420, "JST": 540}
EPOCH_YEARS = (1704067200, 1830297600)  # 2024-01-01 up to, not including, 2028-01-01

_CLOCK = r"(?<h{n}>\d{{1,2}}):(?<i{n}>\d{{2}})(?::(?<s{n}>\d{{2}})(?:[.,](?<f{n}>\d+))?)?"
_HALF = r"(?:\s?(?<p{n}>[ap])\.?m\.?)?"
_ZONE = r"(?:\s*\[?(?<z{n}>z|[a-z]{{3,4}}|[a-z]+(?:/[a-z_+\-0-9]+)+|(?:utc|gmt)?\s?[+\-−]\d{{1,2}}(?::?\d{{2}})?)\]?)?"
_WEEKDAY = r"(?:\p{{L}}{{2,10}}\.?,?\s+)?"
_NAME = r"(?<b{n}>\p{{L}}{{3,10}})\.?"
_TIME = r"(?:T|,?\s+|,)" + _CLOCK + _HALF + _ZONE
#: One branch for each notation; {n} numbers its groups.  y m d b: year, month, day, month name; h i s f p: clock; z: zone; e g: epoch digits and decimals.
BRANCHES = [
    r"(?<y{n}>\d{{4}})[-/](?<m{n}>\d{{1,2}})[-/](?<d{n}>\d{{1,2}})" + _TIME,
    r"(?<y{n}>\d{{4}})(?<m{n}>\d{{2}})(?<d{n}>\d{{2}})(?:T|\s)(?<h{n}>\d{{2}}):?(?<i{n}>\d{{2}})(?::?(?<s{n}>\d{{2}})(?:[.,](?<f{n}>\d+))?)?" + _ZONE,
    r"(?<d{n}>\d{{1,2}})\.(?<m{n}>\d{{1,2}})\.(?<y{n}>\d{{4}})" + _TIME,
    _WEEKDAY + r"(?<d{n}>\d{{1,2}})\.?[\s\-]+(?:de\s+)?" + _NAME + r",?[\s\-]+(?:de\s+)?(?<y{n}>\d{{4}})" + _TIME,
    _WEEKDAY + _NAME + r"\s+(?<d{n}>\d{{1,2}})\s+" + _CLOCK + _ZONE + r"\s+(?<y{n}>\d{{4}})",
    _WEEKDAY + _NAME + r"\s+(?<d{n}>\d{{1,2}}),?\s+(?<y{n}>\d{{4}})" + _TIME,
    r"(?<e{n}>\d{{9,20}})(?:[.,](?<g{n}>\d+))?(?<z{n}>z)?",
]
PARTS = "ymdbhisfpzeg"


def _compiled() -> tuple[str, str]:
    branches = [b.format(n=n) for n, b in enumerate(BRANCHES, 1)]
    pattern = r"(?iu)^\s*(?:" + "|".join(branches) + r")\s*$"
    out = "\u001e".join("".join(f"${{{part}{n}}}" for n, b in enumerate(branches, 1) if f"<{part}{n}>" in b) for part in PARTS)
    return pattern, "\u001d" + out


PATTERN, REPLACEMENT = _compiled()


def _lookup(key: Column, entries: dict[str, int]) -> Column:
    flat = [F.lit(x) for pair in entries.items() for x in pair]
    return F.element_at(F.create_map(*flat), key)


def _int(c: Column) -> Column:
    return F.when(c != "", c).try_cast("bigint")


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, in integer arithmetic (years from 1 on)."""
    floor = lambda a, b: F.floor(a / F.lit(b)).cast("bigint")
    y = F.when(m <= 2, y - 1).otherwise(y)
    doy = floor(153 * F.when(m > 2, m - 3).otherwise(m + 9) + 2, 5) + d - 1
    return 365 * y + floor(y, 4) - floor(y, 100) + floor(y, 400) + doy - 719468


def known_zones(spark: SparkSession) -> list[str]:
    """Names of the region zones this JVM knows: a few hundred, fixed by its time zone database."""
    names = spark._jvm.java.time.ZoneId.getAvailableZoneIds().toArray()
    return sorted(n for n in names if "/" in n or n in ("UTC", "GMT"))


def with_utc_micros(df: DataFrame, text: Column, fallback_zone: Column, zones: list[str], out: str = "utc_us") -> DataFrame:
    """``df`` with the column ``out``: microseconds since 1970-01-01 UTC denoted by ``text``, or null; see the module's rules.

    The steps are separate projections, each naming what the next ones use more than once, so that no component
    is extracted or computed twice.
    """
    step = lambda df, **new: df.withColumns({f"_ts_{k}": v for k, v in new.items()})
    c = lambda name: F.col(f"_ts_{name}")
    df = step(df, packed=F.regexp_replace(text, PATTERN, REPLACEMENT), fallback=F.trim(fallback_zone))
    df = step(df, parts=F.when(c("packed").startswith("\u001d"), F.split(F.expr("substring(_ts_packed, 2)"), "\u001e", -1)))
    df = step(df, **{p: F.get(c("parts"), F.lit(k)) for k, p in enumerate(PARTS)})

    number, (low, high) = c("number"), EPOCH_YEARS
    df = step(df, number=_int(c("e")), decimals=F.rpad(F.substring(c("g"), 1, 6), 6, "0"))
    df = step(
        df,
        epoch=F.when(number.between(low, high - 1), number * 1_000_000 + c("decimals").cast("bigint"))
        .when(number.between(low * 1000, high * 1000 - 1), number * 1000 + F.substring(c("decimals"), 1, 3).cast("bigint"))
        .when(number.between(low * 1_000_000, high * 1_000_000 - 1), number)
        .when(number.between(low * 1_000_000_000, high * 1_000_000_000 - 1), F.expr("_ts_number div 1000")),
    )
    digits = c("e")
    df = step(df, run=F.coalesce((digits != "") & c("epoch").isNull() & F.length(digits).isin(12, 14, 17, 20), F.lit(False)))
    pick = lambda name, at, n: _int(F.when(c("run"), F.substring(digits, at, n)).otherwise(c(name)))
    names = {w: m for m, words in MONTHS.items() for w in words.split()}
    fraction = F.when(c("run"), F.concat(F.substring(digits, 15, 6), c("g"))).otherwise(c("f"))
    df = step(
        df,
        year=pick("y", 1, 4),
        month=F.coalesce(pick("m", 5, 2), _lookup(F.lower(c("b")), names).cast("bigint")),
        day=pick("d", 7, 2),
        hour=pick("h", 9, 2),
        minute=pick("i", 11, 2),
        second=F.coalesce(pick("s", 13, 2), F.lit(0).cast("bigint")),
        fraction=F.rpad(F.substring(fraction, 1, 6), 6, "0").cast("bigint"),
        zone=F.upper(F.trim(c("z"))),
    )
    hour, half = c("hour"), F.lower(c("p"))
    df = step(df, hour=F.when(half == "", hour).when(hour.between(1, 12), F.pmod(hour, F.lit(12)) + F.when(half == "p", 12).otherwise(0)))
    year, month, day = c("year"), c("month"), c("day")
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    month_days = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    exists = (year >= 1) & month.between(1, 12) & day.between(1, month_days) & hour.between(0, 23) & c("minute").between(0, 59) & c("second").between(0, 59)
    df = step(df, days=F.when(exists, days_from_civil(year, month, day)))
    sign_at = r"^(?:UTC|GMT)?\s?([+\-−])(\d{1,2}):?(\d{2})?$"
    df = step(
        df,
        local=(((c("days") * 24 + hour) * 60 + c("minute")) * 60 + c("second")) * 1_000_000 + c("fraction"),
        sign=F.regexp_extract(c("zone"), sign_at, 1),
        off_h=_int(F.regexp_extract(c("zone"), sign_at, 2)),
        off_m=F.coalesce(_int(F.regexp_extract(c("zone"), sign_at, 3)), F.lit(0).cast("bigint")),
        region=F.when(c("zone") == "", c("fallback")).when(c("zone").contains("/"), F.trim(c("z"))),
    )
    offset = F.when((c("off_h") <= 18) & (c("off_m") <= 59), (c("off_h") * 60 + c("off_m")) * F.when(c("sign") == "+", 1).otherwise(-1))
    df = step(df, offset=F.coalesce(_lookup(c("zone"), ABBREVIATIONS).cast("bigint"), offset), region=F.when(c("region").isin(zones), c("region")))
    in_region = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(c("local")), F.coalesce(c("region"), F.lit("UTC"))))
    df = df.withColumn(out, F.coalesce(c("epoch"), c("local") - c("offset") * 60_000_000, F.when(c("region").isNotNull(), in_region)))
    return df.drop(*[x for x in df.columns if x.startswith("_ts_")])


def record_instants(spark: SparkSession, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """One row per record whose timestamp denotes an instant: record_table, record_id, utc_us.

    ``tables`` maps a record table's name to (DataFrame, id column).  Needed columns: the id, ``timestamp`` and
    ``metadata`` (a map with the optional key ``tz``); all others are never read.  Rows delivered again under one id
    count once; should copies differ, the earliest instant is taken.  Null ids are no records.  Empty tables
    give no rows.
    """
    zones = known_zones(spark)
    parts = []
    for name, (df, key) in tables.items():
        rows = df.select(F.lit(name).alias("record_table"), F.col(key).cast("string").alias("record_id"), F.col("timestamp").alias("text"), F.col("metadata")["tz"].alias("tz"))
        rows = with_utc_micros(rows, F.col("text"), F.col("tz"), zones).select("record_table", "record_id", "utc_us")
        parts.append(rows.filter("record_id IS NOT NULL"))
    both = reduce(lambda a, b: a.unionByName(b), parts)
    # filtered after the aggregation: a filter on utc_us would be pushed through the steps and inline them all
    return both.groupBy("record_table", "record_id").agg(F.min("utc_us").alias("utc_us")).filter("utc_us IS NOT NULL")
