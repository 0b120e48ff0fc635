from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lettermill.functions import dates

SOURCES = [("a", "Europe/Berlin", "dmy"), ("b", "America/New_York", "mdy"), ("c", "Asia/Kolkata", "dmy")]
SCHEMA = "seq bigint, date string, source_pst_path string, epoch_us string"  # a clashing name, on purpose


def run(spark, rows):
    src = spark.createDataFrame(SOURCES, "source_pst_path string, time_zone string, date_order string")
    return {r.seq: r.epoch_us for r in dates.found(spark.createDataFrame([(k, d, s, "x") for k, (d, s) in enumerate(rows)], SCHEMA), src).collect()}


def us(*args, tz=UTC):
    t = datetime(*args, tzinfo=tz).astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)
    return (t.days * 86_400 + t.seconds) * 1_000_000 + t.microseconds


def test_spellings(spark):
    berlin, york = ZoneInfo("Europe/Berlin"), ZoneInfo("America/New_York")
    cases = [
        ("Wed, 12 May 2021 17:10:00 +0530", "a", us(2021, 5, 12, 11, 40)),
        (" Sat, 18 Nov 2023 18:11:03 -0000\r", "a", us(2023, 11, 18, 18, 11, 3)),
        ("18 Mar 22 20:44 +0530", "a", us(2022, 3, 18, 15, 14)),
        ("Thu, 29 Aug 2024 06:49:18 CEST", "b", us(2024, 8, 29, 4, 49, 18)),
        ("Sun, 06 Oct 2024 08:06:36 +0100 (BST)", "b", us(2024, 10, 6, 7, 6, 36)),
        ("Wed Dec 20 02:40:08 CET 2023", "a", us(2023, 12, 20, 1, 40, 8)),
        ("Wed May 12 05:46:43 2021", "a", us(2021, 5, 12, 3, 46, 43)),
        ("2020-03-03 07:16:07", "b", us(2020, 3, 3, 7, 16, 7, tz=york)),
        ("2024-03-10T06:53:48.8993751Z", "b", us(2024, 3, 10, 6, 53, 48, 899375)),
        ("2021-02-14 12:22:12,703 +11:00", "a", us(2021, 2, 14, 1, 22, 12, 703000)),
        ("2022-04-17 17:03:03 Europe/Berlin", "b", us(2022, 4, 17, 17, 3, 3, tz=berlin)),
        ("2020-05-11T09:12[America/New_York]", "a", us(2020, 5, 11, 9, 12, tz=york)),
        ("20230403T000800Z", "a", us(2023, 4, 3, 0, 8)),
        ("30/07/2023 23:10:50", "a", us(2023, 7, 30, 23, 10, 50, tz=berlin)),
        ("8/3/2024 4:03:08 PM", "b", us(2024, 8, 3, 16, 3, 8, tz=york)),
        ("4/16/23 12:20am", "b", us(2023, 4, 16, 0, 20, tz=york)),
        ("18.10.2022 14:08", "a", us(2022, 10, 18, 14, 8, tz=berlin)),
        ("13-07-2022 07h08", "a", us(2022, 7, 13, 7, 8, tz=berlin)),
        ("Sonntag, 16. Juni 2024 02:17", "a", us(2024, 6, 16, 2, 17, tz=berlin)),
        ("segunda-feira, 14 de fevereiro de 2022 10:25", "a", us(2022, 2, 14, 10, 25, tz=berlin)),
        ("jeudi 18 juillet 2024 04:35", "a", us(2024, 7, 18, 4, 35, tz=berlin)),
        ("Thursday, November 10, 2022 4:02 AM", "b", us(2022, 11, 10, 4, 2, tz=york)),
        ("1651020293", "a", 1651020293 * 10**6),
        ("1680726183126", "a", 1680726183126 * 10**3),
        ("133021230316050500", "a", (133021230316050500 - 11644473600 * 10**7) // 10),
        ("29 Feb 2024 10:00:00 +0000", "a", us(2024, 2, 29, 10)),
    ]
    got = run(spark, [(d, s) for d, s, _ in cases])
    assert {k: got.get(k) for k in range(len(cases))} == {k: e for k, (_, _, e) in enumerate(cases)}


def test_no_case(spark):
    rows = [None, "", "  \r", "Invalid Date", "31/09/2022 12:30", "30 Feb 2024 10:00 +0000", "29 Feb 2023 10:00 +0000", "24 Nov 2023 57:11:10 +0000", "2020-16-01 17:32:00", "2022-01-01 10:60:00Z", "13/13/2022 10:00", "1/1/2022 13:00 PM", "2019-05-05T10:00:00Z", "2022-05-05 10:00 XYZ", "2022-05-05 10:00 No/Where", "99", "2022-05-05", "x" * 200_000]
    assert run(spark, [(d, "a") for d in rows]) == {}
    # skipped and repeated wall times, an unknown archive, and numbers without an order
    assert run(spark, [("2024-03-31 02:30:00", "a"), ("2024-10-27 02:30:00", "a"), ("2024-10-27 02:30:00 Europe/Berlin", "c"), ("2022-05-05 10:00:00", "zz"), ("05/06/2022 10:00", "zz")]) == {}
    assert run(spark, [("2024-03-31 02:30:00", "c"), ("2022-05-05 10:00:00Z", None)]) == {0: us(2024, 3, 30, 21), 1: us(2022, 5, 5, 10)}


def test_empty_and_repeated(spark):
    assert run(spark, [("1651020293", "a")] * 2) == {0: 1651020293 * 10**6, 1: 1651020293 * 10**6}
    src = spark.createDataFrame([], "source_pst_path string, time_zone string, date_order string")
    assert dates.found(spark.createDataFrame([], SCHEMA), src).count() == 0


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 1826 * 86_400 - 1), st.sampled_from(["a", "b", "c"])), min_size=20, max_size=60))
def test_wall_times_against_zoneinfo(spark, times):
    zones = {s: ZoneInfo(z) for s, z, _ in SOURCES}
    rows, expected = [], {}
    for k, (t, s) in enumerate(times):
        wall = datetime(2020, 1, 1) + timedelta(seconds=t)
        rows.append((f"{wall:%Y-%m-%d %H:%M:%S}", s))
        instants = {w.astimezone(UTC) for fold in (0, 1) if (w := wall.replace(tzinfo=zones[s], fold=fold)).astimezone(UTC).astimezone(zones[s]).replace(tzinfo=None) == wall}
        if len(instants) == 1:
            expected[k] = int(instants.pop().timestamp()) * 10**6
    assert run(spark, rows) == expected
