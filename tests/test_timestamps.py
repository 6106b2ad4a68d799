import random
import zoneinfo
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkivist.operators import timestamps as ts


def us(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp() * 1e6)


@pytest.mark.parametrize(
    "value, utc",
    [
        ("2022-01-05T19:37:55z", us(2022, 1, 5, 19, 37, 55)),
        ("2022-01-03T04:41:12.676231+00:00", us(2022, 1, 3, 4, 41, 12, 676231)),
        ("2022-01-06 08:31:16+1100", us(2022, 1, 5, 21, 31, 16)),
        ("2022-02-05 08:35:33-03", us(2022, 2, 5, 11, 35, 33)),
        ("2022-01-11T08:17:22+10:30[Australia/Adelaide]", us(2022, 1, 10, 21, 47, 22)),
        ("Wed, 05 Jan 2022 13:46:25 +0000", us(2022, 1, 5, 13, 46, 25)),
        ("8 January 2022, 19:58 UTC", us(2022, 1, 8, 19, 58)),
        ("2022-07-01 12:00:00 CEST", us(2022, 7, 1, 10)),
        ("20220103T142003Z", us(2022, 1, 3, 14, 20, 3)),
        ("1641249177", us(2022, 1, 3, 22, 32, 57)),
        ("1641752365025", 1641752365025000),
        ("1642194030602162", 1642194030602162),
        ("1641498360.570199", 1641498360570199),
    ],
)
def test_instants(value, utc):
    assert ts.read_notation(value) == {"utc": utc}


@pytest.mark.parametrize(
    "value, wall",
    [
        ("2022年2月14日 凌晨1:39", us(2022, 2, 14, 1, 39)),
        ("2022年3月29日 下午4点24分", us(2022, 3, 29, 16, 24)),
        ("2022年2月17日 中午12:26", us(2022, 2, 17, 12, 26)),
        ("2022年1月6日11时58分", us(2022, 1, 6, 11, 58)),
        ("２０２３-１１-０５ ０１：４４", us(2023, 11, 5, 1, 44)),
        ("Jan 4, 2022 6:08 AM", us(2022, 1, 4, 6, 8)),
        ("12/12/2022 12:05 AM", us(2022, 12, 12, 0, 5)),
        ("2022.1.11 12:18", us(2022, 1, 11, 12, 18)),
        (" 2022-02-01　", us(2022, 2, 1)),
    ],
)
def test_wall_clock(value, wall):
    r = ts.read_notation(value)
    assert r["wall"] == wall and r["zone"] is None


@pytest.mark.parametrize("value", [None, "", " ", "unknown", "2025-13-40 25:99", "2024-02-30 10:00", "0000-00-00 00:00:00", "21:03", "yesterday 9pm", "刚刚", "2025/00/12 08:11", "-", "x" * 5000])
def test_no_instant(value):
    assert ts.read_notation(value) is None


def test_numeric_dates_keep_both_readings():
    r = ts.read_notation("03/10/2024 1:56 AM")
    assert (r["dmy"], r["mdy"]) == (us(2024, 10, 3, 1, 56), us(2024, 3, 10, 1, 56))
    assert ts.read_notation("23/10/2024 10:00")["mdy"] is None


def resolved(offsets, wall):
    """Offset of a wall-clock second by the rule of the join, and how many intervals hold it."""
    hits = [o for lo, hi, o in offsets if lo + o <= wall < hi + o]
    return (max(hits) if hits else [o for lo, hi, o in offsets if hi + o <= wall][-1]), len(hits)


@pytest.mark.parametrize("letter", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
def test_all_zones_agree_with_the_tz_database(letter):
    rnd, epoch = random.Random(letter), datetime(1970, 1, 1)
    for name in sorted(z for z in zoneinfo.available_timezones() if z.upper().startswith(letter)):
        zone, offsets = zoneinfo.ZoneInfo(name), ts._constant_offsets(name)
        near = [lo + o for (lo, _, _), (_, _, o) in zip(offsets[1:], offsets)]
        walls = [w + d for w in rnd.sample(near, min(10, len(near))) for d in (-7200, -1, 0, 1800, 3599, 7200)] + [rnd.randrange(-2_200_000_000, 4_100_000_000) for _ in range(10)]
        for w in walls:
            local = epoch + timedelta(seconds=w)
            off, n = resolved(offsets, w)
            # fold=0 is the earlier of two instants and, in a gap, the offset before it; the folds differ in both.
            first, second = (round(local.replace(tzinfo=zone, fold=f).utcoffset().total_seconds()) for f in (0, 1))
            assert off == first, (name, local)
            assert n == (1 if first == second else 2 if first > second else 0), (name, local)


def test_status_and_far_years(spark):
    data = [
        ("a", us(2025, 3, 30, 2, 30), "Europe/Berlin"), ("b", us(2025, 10, 26, 2, 30), "Europe/Berlin"), ("c", us(2025, 6, 1), "Europe/Berlin"), ("d", us(2011, 12, 30, 12), "Pacific/Apia"), ("e", us(2250, 3, 31, 2, 30), "Europe/Berlin"),
        ("f", us(2250, 10, 27, 2, 30), "Europe/Berlin"), ("g", us(1850, 6, 1), "Europe/Berlin"), ("h", us(2025, 6, 1), "No/Where"), ("i", us(2300, 6, 1), "No/Where"), ("j", us(2100, 12, 31, 23, 59), "America/New_York"), ("k", us(1900, 1, 1), "Asia/Tokyo"),
    ]
    w = spark.createDataFrame(data, "id string, wall_us long, zone string")
    got = {r["id"]: (r["utc_us"], r["status"]) for r in ts.resolve_wall_clock(w, ts.zone_intervals(w.select("zone"))).collect()}
    assert {k: v[1] for k, v in got.items()} == {"a": "nonexistent", "b": "ambiguous", "c": "unique", "d": "nonexistent", "e": "nonexistent", "f": "ambiguous", "g": "unique", "j": "unique", "k": "unique"}
    for i, wall, zone in data:
        if i in got:
            local = datetime(1970, 1, 1) + timedelta(microseconds=wall)
            assert got[i][0] == wall - round(local.replace(tzinfo=zoneinfo.ZoneInfo(zone)).utcoffset().total_seconds()) * 1_000_000


def test_no_value_is_too_long_or_too_far():
    assert ts.read_notation("1899-05-01T10:00:00Z") == {"utc": us(1899, 5, 1, 10)} and ts.read_notation("2101-01-01T00:00:00Z") == {"utc": us(2101, 1, 1)}
    assert ts.read_notation(" " * 200 + "2024-01-01T00:00:00Z" + "\u3000" * 90) == {"utc": us(2024, 1, 1)}
    assert ts.read_notation("2024-01-01 10:00" + " " * 100 + "Europe/Berlin") == {"wall": us(2024, 1, 1, 10), "zone": "Europe/Berlin"}


def test_entries(spark):
    src = spark.createDataFrame([("a", "Europe/Berlin", 1), ("b", None, 1), ("u", "America/New_York", 1)], "source_id string, zone string, utc_us int")
    rows = [
        (1, "a", "2025-03-30 02:30", "import"),  # skipped: moved on
        (2, "a", "2025-10-26 02:30", None),  # occurs twice: the earlier
        (3, "b", "2025-10-26 02:30", None),  # no zone
        (4, "b", "2025-10-26T02:30Z", None),
        (5, "a", "1641249177", " MTIME "),
        (6, "u", "03/04/2024 10:00", None),
        (7, "u", "12/25/2024 10:00", None),  # shows that months come first
        (8, "a", "03/04/2024 10:00", None),  # nothing shows the order
        (9, "a", "04/04/2024 10:00", None),
        (10, None, "2024-01-01 00:00", None),
        (11, "a", None, None),
        (4, "b", "2025-10-26T02:30Z", None),
    ]
    e = spark.createDataFrame(rows, "entry_id long, source_id string, timestamp string, timestamp_source string")
    got = {r[0]: r[1] for r in ts.normalise_timestamps(e, src).collect()}
    assert got == {
        1: us(2025, 3, 30, 1, 30) // 1000, 2: us(2025, 10, 26, 0, 30) // 1000, 4: us(2025, 10, 26, 2, 30) // 1000, 6: us(2024, 3, 4, 15) // 1000, 7: us(2024, 12, 25, 15) // 1000, 9: us(2024, 4, 4, 8) // 1000,
    }
    assert ts.normalise_timestamps(e.limit(0), src.limit(0)).count() == 0


@pytest.mark.parametrize("zone, at", [("America/Fortaleza", (2000, 10, 15, 12)), ("America/Noronha", (2000, 10, 10, 12)), ("Europe/Vienna", (1945, 4, 7, 12))])
def test_changes_that_undo_each_other_within_weeks(zone, at):
    wall = us(*at)
    want = datetime(*at, tzinfo=zoneinfo.ZoneInfo(zone)).utcoffset()
    assert [timedelta(seconds=o) for lo, hi, o in ts._constant_offsets(zone) if lo + o <= wall / 1e6 < hi + o] == [want]
