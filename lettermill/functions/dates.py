"""Mixed timestamp spellings to one UTC instant (problem 2).

All spellings sit in one anchored alternation with named groups. A single
``regexp_replace`` rewrites a matching text into a separator-joined component
list, so the expression is matched once per row; the rest is integer arithmetic
inside code generation. No Python runs per row.
"""

from __future__ import annotations

import zoneinfo
from datetime import UTC, datetime, timedelta
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Month names and abbreviations, by language.
MONTHS = {
    1: "january jan januar jän janvier janv enero ene janeiro",
    2: "february feb februar février févr fév febrero fevereiro fev",
    3: "march mar märz mär mrz mars marzo março",
    4: "april apr avril avr abril abr",
    5: "may mai mayo maio",
    6: "june jun juni juin junio junho",
    7: "july jul juli juillet juil julio julho",
    8: "august aug août aoû agosto ago",
    9: "september sep sept septembre septiembre setembro set",
    10: "october oct oktober okt octobre octubre outubro out",
    11: "november nov novembre noviembre novembro",
    12: "december dec dezember dez décembre déc diciembre dic dezembro",
}

# Minutes east of UTC of the zone abbreviations in use.
ABBREVIATIONS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120,
    "ist": 330, "jst": 540, "aest": 600, "aedt": 660, "brt": -180, "brst": -120,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}

FIRST_YEAR, LAST_YEAR = 2020, 2024
DAY_US = 86_400_000_000
SEP = "\u0001"

_ZONE = r"[+-]\d{2}:?\d{2}|[+-]\d{2}|\p{L}{1,5}(?![\p{L}/])"

def _clock(k: str, mark: str = ":") -> str:
    return rf"(?<h{k}>\d{{1,2}}){mark}(?<n{k}>\d{{2}})(?::(?<s{k}>\d{{2}})(?:[.,](?<f{k}>\d{{1,12}}))?)?"

#: One branch per family of spellings. Group names: y year, m month number, b month name, d day,
#: p and q the two ambiguous numbers, h n s f clock, a half of day, z offset, i zone name, u bare number.
_BRANCHES = (
    # [weekday,] 18 Mar 2022 20:44[:05] +0530 (comment); also "16. Juni 2024" and "14 de fevereiro de 2022"
    rf"(?:(?<wa>[\p{{L}}-]+)[.,]{{0,2}} ?)?(?<da>\d{{1,2}})\.?[ -](?:de )?(?<ba>\p{{L}}+)\.?[ -](?:de )?(?<ya>\d{{4}}|\d{{2}}),? {_clock('a')}(?: ?(?<za>{_ZONE}))?(?: ?\([^()]*\))?",
    # Wed Dec 20 02:40:08 CET 2023
    rf"(?:(?<wb>\p{{L}}+)[.,]{{0,2}} )?(?<bb>\p{{L}}+) (?<db>\d{{1,2}}) {_clock('b')}(?: (?<zb>{_ZONE}))? (?<yb>\d{{4}})",
    # 2021-10-31T02:03:26.859Z, with an offset, an abbreviation or a zone name
    rf"(?<yc>\d{{4}})[-/.](?<mc>\d{{1,2}})[-/.](?<dc>\d{{1,2}})(?: ?t ?| ){_clock('c')}(?: ?(?<ac>[ap])\.?m\.?(?!\p{{L}}))?(?: ?(?<zc>{_ZONE}))?(?: ?\[?(?<ic>\p{{L}}+/[\p{{L}}_/+-]+)\]?)?",
    # 20230403T000800Z
    rf"(?<yd>\d{{4}})(?<md>\d{{2}})(?<dd>\d{{2}})t(?<hd>\d{{2}})(?<nd>\d{{2}})(?<sd>\d{{2}})(?<zd>z|[+-]\d{{4}})?",
    # 30/07/2023 23:10:50, 18.10.2022 14:08, 13-07-2022 07h08, 4/16/23 9:20am
    rf"(?<pe>\d{{1,2}})(?<te>[-/.])(?<qe>\d{{1,2}})\k<te>(?<ye>\d{{4}}|\d{{2}}),? {_clock('e', '[:h]')}(?: ?(?<ae>[ap])\.?m\.?(?!\p{{L}}))?(?: ?(?<ze>[+-]\d{{2}}:?\d{{2}}|z|\p{{L}}{{2,5}}))?",
    # Thursday, November 10, 2022 4:02 AM
    rf"(?:(?<wg>\p{{L}}+)[.,]{{0,2}} )?(?<bg>\p{{L}}+)\.? (?<dg>\d{{1,2}}),? (?<yg>\d{{4}}),? (?:at )?{_clock('g')}(?: ?(?<ag>[ap])\.?m\.?(?!\p{{L}}))?(?: ?(?<zg>[+-]\d{{2}}:?\d{{2}}|z|\p{{L}}{{2,5}}))?",
    # a bare count
    r"(?<uh>\d{5}|\d{9,19})",
)
PATTERN = "^(?:" + "|".join(_BRANCHES) + ")$"
_PARTS = {"y": "abcdeg", "m": "cd", "b": "abg", "d": "abcdg", "p": "e", "q": "e", "h": "abcdeg", "n": "abcdeg", "s": "abcdeg", "f": "abceg", "a": "ceg", "z": "abcdeg", "i": "c", "u": "h"}
_REPLACEMENT = SEP + SEP.join("".join(f"${{{part}{k}}}" for k in keys) for part, keys in _PARTS.items())

#: Bare counts: (units per second as a power of ten, seconds from 1970 to the epoch). A count is read by
#: the one unit that puts it between 2020 and 2024; the ranges don't overlap.
_COUNTS = (
    (0, 0),  # seconds
    (3, 0),
    (6, 0),
    (9, 0),
    (7, -11_644_473_600),  # 100 ns since 1601
    (7, -62_135_596_800),  # 100 ns since year 1
    (0, 978_307_200),  # seconds since 2001
    (0, -2_082_844_800),  # seconds since 1904
)

def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, by integer arithmetic."""
    yy = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    mp = F.when(m > 2, m - 3).otherwise(m + 9)
    doy = F.floor((mp * 153 + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return (era * 146_097 + doe - 719_468).cast("long")

def month_length(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)

def _literal_map(pairs: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])

@cache
def _zone_rows(first: int, last: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    rows = []
    for name in sorted(zoneinfo.available_timezones()):
        zone = zoneinfo.ZoneInfo(name)
        offset = lambda t, z=zone: int(t.astimezone(z).utcoffset().total_seconds())
        at, end = datetime(first, 1, 1, tzinfo=UTC), datetime(last + 1, 1, 1, tzinfo=UTC)
        periods, begun = [], int(at.timestamp())
        while at < end:
            nxt = at + timedelta(days=7)
            if offset(at) != offset(nxt):
                lo, hi = at, nxt
                while hi - lo > timedelta(seconds=1):
                    mid = lo + (hi - lo) // 2
                    mid = mid.replace(microsecond=0)
                    lo, hi = (mid, hi) if offset(mid) == offset(at) else (lo, mid)
                periods.append((begun * 1_000_000, int(hi.timestamp()) * 1_000_000, offset(at) * 1_000_000))
                begun = int(hi.timestamp())
            at = nxt
        periods.append((begun * 1_000_000, int(end.timestamp()) * 1_000_000, offset(end) * 1_000_000))
        rows.append((name.lower(), periods))
    return rows


def zone_periods(spark: SparkSession, first: int = FIRST_YEAR - 1, last: int = LAST_YEAR + 1) -> DataFrame:
    """Offset periods of every IANA zone between two years: (zone, periods), one row a zone.

    About 600 rows whatever the data, made once per process from the system's zone files.
    """
    return spark.createDataFrame(_zone_rows(first, last), "zone string, periods array<struct<since:bigint,until:bigint,off:bigint>>")

def components(date: Column) -> Column:
    """Array of text components of a date spelling, or null if no spelling matches."""
    tidy = F.lower(F.trim(F.regexp_replace(date, r"[\s\x00-\x1f]+", " ")))
    hit = F.regexp_replace(tidy, PATTERN, _REPLACEMENT)
    return F.when(F.startswith(hit, F.lit(SEP)), F.split(hit, SEP, -1))

def normalise_dates(rows: DataFrame, sources: DataFrame, date: str = "date", source: str = "source_pst_path") -> DataFrame:
    """Add ``epoch_us`` (bigint, nullable): the one UTC instant each ``date`` denotes, in microseconds.

    ``sources`` holds ``source_pst_path``, ``time_zone`` and ``date_order`` per archive. A text without a zone
    is wall time of its archive. Null results: null, empty or blank text, unknown spelling, impossible calendar
    date or clock, a year outside 2020 to 2024, an unknown zone, a numeric day and month in an archive without
    date order, and wall times that the zone skipped or showed twice. Other columns of ``rows`` stay as they
    are, duplicates included; an archive listed twice in ``sources`` counts once, and contradicting listings
    count as unknown. Empty tables give an empty result.
    """
    spark = rows.sparkSession
    # the settings of an archive; contradicting ones are unknown
    own = sources.groupBy(F.col("source_pst_path").alias("__src")).agg(
        F.when(F.countDistinct("time_zone") == 1, F.lower(F.min("time_zone"))).alias("__tz"),
        F.when(F.countDistinct("date_order") == 1, F.min("date_order")).alias("__order"),
    )
    c = rows.withColumn("__c", components(F.col(date)))
    names = list(_PARTS)
    part = lambda k: F.col("__c")[names.index(k) + 1]
    number = lambda k: F.when(part(k) != "", part(k).cast("int"))
    months = _literal_map({name: n for n, words in MONTHS.items() for name in words.split()})
    c = c.join(own, F.col(source) == F.col("__src"), "left")
    p, q = number("p"), number("q")
    c = c.withColumns(
        {
            "__y": F.when(F.length(part("y")) == 2, number("y") + 2000).otherwise(number("y")),
            "__m": F.coalesce(number("m"), F.element_at(months, part("b")), F.when(F.col("__order") == "dmy", q).when(F.col("__order") == "mdy", p)),
            "__d": F.coalesce(number("d"), F.when(F.col("__order") == "dmy", p).when(F.col("__order") == "mdy", q)),
            "__h": F.when(part("a") == "", number("h")).when(number("h").between(1, 12), number("h") % 12 + F.when(part("a") == "p", 12).otherwise(0)),
            "__n": number("n"),
            "__s": F.coalesce(number("s"), F.lit(0)),
            "__f": F.rpad(F.substring(part("f"), 1, 6), 6, "0").cast("long"),
            "__z": part("z"),
            "__zone": F.when(part("i") != "", part("i")).when(part("z") == "", F.col("__tz")),
            "__u": F.when(part("u") != "", part("u").cast("decimal(20,0)")),
        }
    )
    valid = F.col("__y").between(FIRST_YEAR, LAST_YEAR) & F.col("__m").between(1, 12) & (F.col("__d") >= 1) & (F.col("__d") <= month_length(F.col("__y"), F.col("__m"))) & (F.col("__h") < 24) & (F.col("__n") < 60) & (F.col("__s") < 60)
    wall = F.when(valid, days_from_civil(F.col("__y"), F.col("__m"), F.col("__d")) * DAY_US + (F.col("__h") * 3600 + F.col("__n") * 60 + F.col("__s")).cast("long") * 1_000_000 + F.col("__f"))
    z = F.col("__z")
    signed = F.when(F.substring(z, 1, 1) == "-", -1).otherwise(1)
    zh, zm = F.substring(z, 2, 2).cast("int"), F.coalesce(F.try_to_number(F.regexp_extract(z, r"^[+-]\d\d:?(\d\d)$", 1), F.lit("99")).cast("int"), F.lit(0))
    minutes = F.when(z.rlike(r"^[+-]"), F.when((zh <= 15) & (zm < 60), signed * (zh * 60 + zm))).otherwise(F.element_at(_literal_map(ABBREVIATIONS), z))
    counts = []
    for power, epoch in _COUNTS:

        low, high = ((int(datetime(y, 1, 1, tzinfo=UTC).timestamp()) - epoch) * 10**power for y in (FIRST_YEAR, LAST_YEAR + 1))
        us = F.col("__u") * (10 ** (6 - power)) if power <= 6 else F.floor(F.col("__u") / (10 ** (power - 6)))

        counts.append(F.when((F.col("__u") >= F.lit(low).cast("decimal(20,0)")) & (F.col("__u") < F.lit(high).cast("decimal(20,0)")), us.cast("long") + F.lit(epoch * 1_000_000)))
    c = c.withColumns({"__wall": wall, "__off": minutes.cast("long") * 60_000_000, "__count": F.coalesce(*counts)})
    c = c.join(zone_periods(spark).withColumnRenamed("zone", "__zname"), F.col("__zone") == F.col("__zname"), "left")
    fits = F.filter(F.transform("periods", lambda x: F.when((F.col("__wall") - x["off"] >= x["since"]) & (F.col("__wall") - x["off"] < x["until"]), F.col("__wall") - x["off"])), lambda x: x.isNotNull())
    zoned = F.when(F.col("__wall").isNotNull() & F.col("periods").isNotNull(), F.array_distinct(fits))
    instant = F.coalesce(F.col("__count"), F.when(F.col("__z") != "", F.col("__wall") - F.col("__off")).when(F.size(zoned) == 1, zoned[0]))
    return c.withColumn("epoch_us", instant).drop("__c", "__src", "__tz", "__order", "__y", "__m", "__d", "__h", "__n", "__s", "__f", "__z", "__zone", "__u", "__wall", "__off", "__count", "__zname", "periods")

def found(manifest: DataFrame, sources: DataFrame) -> DataFrame:
    """p2_found: (seq, epoch_us) of every row whose date denotes exactly one instant."""
    slim = manifest.select("seq", "date", "source_pst_path").where(F.col("date").isNotNull())
    return normalise_dates(slim, sources).where(F.col("epoch_us").isNotNull() & F.col("seq").isNotNull()).select(F.col("seq").cast(T.LongType()), "epoch_us")
