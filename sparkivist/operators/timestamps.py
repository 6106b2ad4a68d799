"""Mixed timestamp notations to one UTC instant, through an as-of join with zone offsets.

Stages, all of them row-local or joins on bounded tables:

1. ``parse_notations`` reads each value into an instant, or into wall-clock time with a zone
   (its own or the source's). Numeric day/month values with the year last keep both readings.
2. ``date_orders`` aggregates, per source, what the unambiguous values show about the order.
3. ``zone_intervals`` explodes the tz database into one row per zone and year, with the
   intervals of constant offset of that year.
4. ``resolve_wall_clock`` joins wall-clock times to the intervals by zone and year: two matching
   intervals mean the time occurs twice (the earlier instant is taken), none means it was skipped
   (moved on by the gap), one gives the offset. Years beyond the table ask the database itself.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Years of the interval table; times outside are resolved one by one, to the same rules.
FIRST_YEAR, LAST_YEAR = 1900, 2100
_EPOCH_DAY = date(1970, 1, 1).toordinal()
_US = 1_000_000

# Month names of the notations that spell the month out.
MONTHS = {
    m: i + 1
    for i, names in enumerate(
        "jan january januar,feb february februar,mar march märz mrz,apr april,may mai,jun june juni,"
        "jul july juli,aug august,sep sept september,oct october oktober okt,nov november,dec december dezember dez".split(",")
    )
    for m in names.split()
}

# Zone abbreviations and the minutes they lie ahead of UTC.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660,
    "NZST": 720, "NZDT": 780, "BRT": -180, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

_CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?"
_OFFSET = rf"(?P<z>[Zz]|(?:UTC|GMT)?[+-]\d{{2}}(?::?\d{{2}})?|(?i:{'|'.join(ABBREVIATIONS)})\b(?!/))"
_ZONE = r"(?P<zone>[A-Za-z]+(?:/[A-Za-z0-9_+-]+)+)"
_TAIL = rf"(?:\s*{_OFFSET})?(?:\s*\[(?P<br>[A-Za-z0-9_/+-]+)\]|\s+{_ZONE})?"
_AMPM = r"(?:\s*(?P<ap>[AaPp])\.?[Mm]\.?)?"
_YMD = re.compile(rf"(?P<y>\d{{4}})(?P<sep>[-/.])(?P<mo>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}})(?:(?:[Tt]|\s+){_CLOCK}{_AMPM}{_TAIL})?")
_COMPACT = re.compile(rf"(?P<y>\d{{4}})(?P<mo>\d{{2}})(?P<d>\d{{2}})[Tt](?P<h>\d{{2}})(?P<mi>\d{{2}})(?:(?P<s>\d{{2}})(?:[.,](?P<f>\d{{1,9}}))?)?{_TAIL}")
_HAN = re.compile(
    r"(?P<y>\d{4})\s*年\s*(?P<mo>\d{1,2})\s*月\s*(?P<d>\d{1,2})\s*[日号]"
    r"(?:\s*(?P<part>凌晨|清晨|早上|早晨|上午|中午|下午|傍晚|晚上|夜里)?\s*(?P<h>\d{1,2})\s*[:点时]\s*(?:(?P<mi>\d{1,2})\s*分?)?(?:[:\s]*(?P<s>\d{1,2})\s*秒?)?"
    rf"{_TAIL})?"
)
_NUMERIC = re.compile(rf"(?P<a>\d{{1,2}})(?P<sep>[/.-])(?P<b>\d{{1,2}})(?P=sep)(?P<y>\d{{4}})(?:,?\s+{_CLOCK}{_AMPM}{_TAIL})?")
_MONTH_FIRST = re.compile(rf"(?:[A-Za-z]+,?\s+)??(?P<mon>[^\W\d]+)\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}})(?:,?\s+(?:at\s+)?{_CLOCK}{_AMPM}{_TAIL})?")
_DAY_FIRST = re.compile(rf"(?:[A-Za-z]+,?\s+)?(?P<d>\d{{1,2}})(?:st|nd|rd|th|\.)?\s+(?P<mon>[^\W\d]+)\.?,?\s+(?P<y>\d{{4}})(?:,?\s+(?:at\s+|um\s+)?{_CLOCK}{_AMPM}{_TAIL})?")
_NUMBER = re.compile(r"[+-]?\d+(?:\.\d*)?")


def _wall_us(y: int, mo: int, d: int, h: int = 0, mi: int = 0, s: int = 0, frac: str | None = None) -> int | None:
    """Microseconds of a wall-clock time as if it were UTC; None if it is no valid time."""
    try:
        day = date(y, mo, d).toordinal() - _EPOCH_DAY
    except ValueError:
        return None
    if h > 23 or mi > 59 or s > 59:
        return None
    return ((day * 24 + h) * 60 + mi) * 60 * _US + s * _US + (int(frac[:6].ljust(6, "0")) if frac else 0)


def _offset_us(z: str) -> int | None:
    z = z.upper()
    if z == "Z":
        return 0
    if z in ABBREVIATIONS:
        return ABBREVIATIONS[z] * 60 * _US
    z = z.removeprefix("UTC").removeprefix("GMT")
    h, mi = int(z[1:3]), int(z[3:].lstrip(":") or 0)
    if h > 18 or mi > 59:
        return None
    return (-1 if z[0] == "-" else 1) * (h * 60 + mi) * 60 * _US


def _clock(g: dict) -> tuple[int, int, int, str | None] | None:
    if g.get("h") is None:
        return 0, 0, 0, None
    h, mi, s = int(g["h"]), int(g.get("mi") or 0), int(g.get("s") or 0)
    if ap := g.get("ap"):
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if ap in "Pp" else 0)
    part = g.get("part")
    if part in ("下午", "傍晚", "晚上") and h < 12:
        h += 12
    elif part == "中午" and h < 3:
        h += 12
    return h, mi, s, g.get("f")


def read_notation(value: str | None) -> dict | None:
    """One value as {utc} | {wall, zone} | {dmy, mdy, zone, first, second, off}; None if it states no instant.

    Numbers are seconds, milliseconds, microseconds or nanoseconds since 1970 by their size.
    Null, blank, relative, incomplete and impossible dates give None.
    """
    if value is None:
        return None
    v = unicodedata.normalize("NFKC", value).strip().strip("​﻿").strip()
    if not v:
        return None
    if _NUMBER.fullmatch(v):
        whole, _, frac = v.lstrip("+-").partition(".")
        n, sign = int(whole), -1 if v[0] == "-" else 1
        if n < 10**11:
            us = n * _US + int((frac or "0")[:6].ljust(6, "0"))
        else:
            us = n * 1000 if n < 10**14 else n if n < 10**17 else n // 1000
        return {"utc": sign * us} if us < 2**62 else None
    for rx in (_YMD, _COMPACT, _HAN, _NUMERIC, _DAY_FIRST, _MONTH_FIRST):
        if m := rx.fullmatch(v):
            g = m.groupdict()
            break
    else:
        return None
    clock = _clock(g)
    if clock is None:
        return None
    y, off, zone = int(g["y"]), None, g.get("zone") or g.get("br")
    if g.get("z") and (off := _offset_us(g["z"])) is None:
        return None
    if rx is _NUMERIC:
        a, b = int(g["a"]), int(g["b"])
        dmy, mdy = _wall_us(y, b, a, *clock), _wall_us(y, a, b, *clock)
        if dmy is None and mdy is None:
            return None
        if dmy != mdy:
            return {"dmy": dmy, "mdy": mdy, "zone": zone, "off": off}
        wall = dmy
    else:
        mon = g.get("mon")
        mo = MONTHS.get(mon.lower()) if mon else int(g["mo"])
        wall = _wall_us(y, mo, int(g["d"]), *clock) if mo else None
        if wall is None:
            return None
    if off is not None:
        return {"utc": wall - off}
    return {"wall": wall, "zone": zone}


_PARSED = T.StructType(
    [T.StructField("utc_us", T.LongType()), T.StructField("dmy_us", T.LongType()), T.StructField("mdy_us", T.LongType()), T.StructField("off_us", T.LongType()), T.StructField("own_zone", T.StringType())]
)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for v in b.column(b.schema.get_field_index("timestamp")).to_pylist():
            r = read_notation(v)
            if r is None:
                out.append((None,) * 5)
            elif "utc" in r:
                out.append((r["utc"], None, None, None, None))
            elif "wall" in r:
                out.append((None, r["wall"], r["wall"], None, r["zone"]))
            else:
                out.append((None, r["dmy"], r["mdy"], r["off"], r["zone"]))
        cols = list(zip(*out)) if out else [[]] * 5
        new = [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string()])]
        keep = [i for i, n in enumerate(b.schema.names) if n != "timestamp"]
        yield pa.RecordBatch.from_arrays([b.column(i) for i in keep] + new, names=[b.schema.names[i] for i in keep] + _PARSED.names)


def parse_notations(df: DataFrame) -> DataFrame:
    """Replace the string column ``timestamp`` by its readings; rows keep their other columns.

    utc_us: the value states an instant. dmy_us/mdy_us: wall-clock readings, equal unless day and
    month are numbers with the year last; off_us, own_zone: an offset or zone beside such a value.
    All null: the value states nothing.
    """
    kept = [f for f in df.schema.fields if f.name != "timestamp"]
    return df.mapInArrow(_parse_batches, T.StructType(kept + _PARSED.fields))


def date_orders(parsed: DataFrame, source: str = "source_id") -> DataFrame:
    """(source, day_first): the order that the values of each source show.

    A value counts if only one of its readings is a valid date. Sources without such a value, or
    with values of both kinds, have no row: their ambiguous values stay unresolved.
    """
    differs = F.col("utc_us").isNull() & (F.col("dmy_us").isNull() != F.col("mdy_us").isNull())
    return (
        parsed.where(differs)
        .groupBy(source)
        .agg(F.max(F.col("dmy_us").isNotNull()).alias("day_first"), F.max(F.col("mdy_us").isNotNull()).alias("month_first"))
        .where(F.col("day_first") != F.col("month_first"))
        .select(source, "day_first")
    )


def _file_changes(name: str) -> list[int]:
    """Seconds since 1970 of the changes that the zone's TZif file lists; none if there is no such file."""
    import zoneinfo
    from importlib import resources
    from pathlib import Path

    at = next((p for d in zoneinfo.TZPATH if (p := Path(d, name)).is_file()), None)
    try:
        raw = (at or resources.files("tzdata.zoneinfo").joinpath(name)).read_bytes()
    except (OSError, ImportError):
        return []
    if raw[:4] != b"TZif":
        return []
    begin, width = 0, 4
    counts = struct.unpack(">6l", raw[20:44])  # of flags (2), leap seconds, changes, types, characters
    if raw[4] >= ord("2"):
        begin, width = 44 + counts[3] * 5 + counts[4] * 6 + counts[5] + counts[2] * 8 + counts[1] + counts[0], 8
        counts = struct.unpack(">6l", raw[begin + 20 : begin + 44])
    return list(struct.unpack(f">{counts[3]}{'q' if width == 8 else 'l'}", raw[begin + 44 : begin + 44 + counts[3] * width]))


def _offset_at(zone, second: int) -> int:
    """Seconds ahead of UTC at an instant; instants outside the calendar take the nearest inside."""
    at = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=min(max(second, _EARLIEST), _LATEST))
    return round(at.astimezone(zone).utcoffset().total_seconds())


_EARLIEST, _LATEST = -62_135_510_400, 253_402_214_400  # 0001-01-02 and 9999-12-31, seconds


def _constant_offsets(name: str) -> list[tuple[int, int, int]]:
    """(from, to, offset), in seconds of UTC, of the intervals of constant offset between FIRST_YEAR and LAST_YEAR."""
    import zoneinfo

    zone, utc = zoneinfo.ZoneInfo(name), timezone.utc
    start = int(datetime(FIRST_YEAR - 1, 12, 30, tzinfo=utc).timestamp())
    end = int(datetime(LAST_YEAR + 1, 1, 3, tzinfo=utc).timestamp())
    # Between listed changes the offset is constant; the rule that goes on after them is followed by days.
    listed = sorted({s for s in _file_changes(name) if start < s < end})
    at, off, out, begin = start, _offset_at(zone, start), [], start
    for nxt in (*listed, *range((listed or [start])[-1] + 86400, end, 86400), end):
        if (new := _offset_at(zone, nxt)) != off:
            lo, hi = at, nxt
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if _offset_at(zone, mid) == off else (lo, mid)
            out.append((begin, hi, off))
            begin, off = hi, new
        at = nxt
    return [*out, (begin, end, off)]


def _interval_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(zone, year, intervals): those that touch the year or the two days on either side of it, in wall-clock microseconds."""
    for b in batches:
        rows: list[tuple] = []
        for name in b.column(0).to_pylist():
            walls = [((lo + o) * _US, (hi + o) * _US, o * _US) for lo, hi, o in _constant_offsets(name)]
            for y in range(FIRST_YEAR, LAST_YEAR + 1):
                lo, hi = (_wall_us(y, 1, 1) or 0) - 2 * 86400 * _US, (_wall_us(y, 12, 31) or 0) + 3 * 86400 * _US
                rows.append((name, y, [{"lo": a, "hi": z, "off": o} for a, z, o in walls if a < hi and z > lo]))
        cols = list(zip(*rows)) if rows else [[]] * 3
        kinds = (pa.string(), pa.int32(), pa.list_(pa.struct([(n, pa.int64()) for n in ("lo", "hi", "off")])))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["zone", "year", "intervals"])


def zone_intervals(zones: DataFrame) -> DataFrame:
    """(zone, year, intervals) of the zones in column ``zone``, intervals being an array of (lo, hi, off).

    The tz database bounds the result: some six hundred names, two hundred years and a handful of
    intervals each, whatever the data. Names it doesn't hold are left out.
    """
    import zoneinfo

    known = sorted(zoneinfo.available_timezones())
    wanted = zones.where(F.col("zone").isin(known)).select("zone").distinct()
    return wanted.mapInArrow(_interval_batches, "zone string, year int, intervals array<struct<lo:long,hi:long,off:long>>")


def _by_database(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """offset and status of (wall_us, zone) rows, the last two columns, asked of the tz database one by one."""
    import zoneinfo

    known = zoneinfo.available_timezones()
    for b in batches:
        offsets, states = [], []
        for wall, name in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
            if name not in known:
                offsets.append(None), states.append(None)
                continue
            zone, local = zoneinfo.ZoneInfo(name), wall // _US
            # An offset is right if the instant that it gives has it; days around hold all offsets in question.
            near = {_offset_at(zone, local + d * 3600) for d in range(-30, 31)}
            right = [o for o in near if _offset_at(zone, local - o) == o]
            offsets.append((max(right) if right else _offset_at(zone, local - max(near))) * _US)
            states.append("unique" if len(right) == 1 else "ambiguous" if right else "nonexistent")
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(offsets, pa.int64()), pa.array(states, pa.string())], names=[*b.schema.names, "_off", "status"])


def resolve_wall_clock(walls: DataFrame, intervals: DataFrame) -> DataFrame:
    """utc_us and status of rows with ``wall_us`` and ``zone``, by an as-of join on (zone, year).

    status tells how many intervals hold the wall-clock time: unique is one; ambiguous is two, of
    which the earlier instant counts; nonexistent is none, a time in a gap, for which the offset
    before the gap applies, so that it is moved on by the gap's length. Unknown zones give no rows.
    The intervals are bounded by the tz database and broadcast; ``wall_us`` and ``zone`` must not be null.
    """
    others = [c for c in walls.columns if c not in ("wall_us", "zone")]
    w = walls.select(*others, "wall_us", "zone", F.year(F.timestamp_micros("wall_us")).alias("_y"))
    inside = F.col("_y").between(FIRST_YEAR, LAST_YEAR)
    i = intervals.select(F.col("zone").alias("_zone"), F.col("year").alias("_year"), "intervals")
    joined = w.where(inside).join(F.broadcast(i), (w["zone"] == i["_zone"]) & (F.col("_y") == i["_year"]))
    holding = F.filter("intervals", lambda x: (x["lo"] <= F.col("wall_us")) & (F.col("wall_us") < x["hi"]))
    before = F.filter("intervals", lambda x: x["hi"] <= F.col("wall_us"))
    status = F.when(F.size("_hit") == 1, "unique").when(F.size("_hit") > 1, "ambiguous").otherwise("nonexistent")
    # Of two matches the greater offset is the earlier instant; in a gap the last interval before it counts.
    offset = F.when(F.size("_hit") > 0, F.array_max(F.transform("_hit", lambda x: x["off"]))).otherwise(F.element_at(F.col("_before"), -1)["off"])
    near = joined.select(*others, "wall_us", "zone", holding.alias("_hit"), before.alias("_before")).select(*others, "wall_us", "zone", offset.alias("_off"), status.alias("status"))
    far = w.where(~inside).select(*others, "wall_us", "zone")
    far = far.mapInArrow(_by_database, T.StructType([*far.schema.fields, T.StructField("_off", T.LongType()), T.StructField("status", T.StringType())]))
    return near.unionByName(far.where("status IS NOT NULL")).withColumn("utc_us", F.col("wall_us") - F.col("_off")).drop("_off")


def instants(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """(entry_id, utc_us, status) of every reading that states an instant.

    status is stated where the value has an offset or is a number, else that of its wall-clock
    time: unique, ambiguous or nonexistent. See ``normalise_timestamps`` for the rules.
    """
    from sparkivist.plans.session import cut_lineage

    mtime = F.lower(F.trim(F.coalesce("timestamp_source", F.lit("")))) == "mtime"
    rows = entries.where(F.col("timestamp").isNotNull() & ~mtime).select("entry_id", "source_id", "timestamp").distinct()
    parsed = parse_notations(rows).where("utc_us IS NOT NULL OR dmy_us IS NOT NULL OR mdy_us IS NOT NULL")
    parsed = cut_lineage(parsed)  # read by the order evidence, the zone list and the result

    order = date_orders(parsed).withColumnRenamed("source_id", "_source")
    zone = sources.where("zone IS NOT NULL").groupBy("source_id").agg(F.min("zone").alias("source_zone")).withColumnRenamed("source_id", "_source2")
    walls = parsed.where("utc_us IS NULL")
    walls = walls.join(order, walls["source_id"] == order["_source"], "left").join(zone, walls["source_id"] == zone["_source2"], "left")
    reading = F.when(F.col("dmy_us") == F.col("mdy_us"), F.col("dmy_us")).when(F.col("day_first"), F.col("dmy_us")).when(~F.col("day_first"), F.col("mdy_us"))
    walls = walls.select("entry_id", reading.alias("wall_us"), "off_us", F.trim(F.coalesce("own_zone", "source_zone")).alias("zone")).where("wall_us IS NOT NULL")

    names = zone.select(F.trim("source_zone").alias("zone")).union(parsed.where("own_zone IS NOT NULL").select("own_zone")).distinct()
    stated = F.lit("stated").alias("status")
    fixed = walls.where("off_us IS NOT NULL").select("entry_id", (F.col("wall_us") - F.col("off_us")).alias("utc_us"), stated)
    local = resolve_wall_clock(walls.where("off_us IS NULL AND zone IS NOT NULL").select("entry_id", "wall_us", "zone"), zone_intervals(names)).select("entry_id", "utc_us", "status")
    return parsed.where("utc_us IS NOT NULL").select("entry_id", "utc_us", stated).unionByName(fixed).unionByName(local)


def normalise_timestamps(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """(entry_id, utc_ms), one row per entry whose timestamp states an instant.

    entries: entry_id, source_id, timestamp, timestamp_source; sources: source_id, zone. An offset
    or zone in the value decides, else the zone of the source; without either a wall-clock value
    is no case, nor is an entry whose timestamp_source is mtime. Repeated entries come out once;
    an entry_id whose copies disagree keeps its earliest instant. Empty inputs give no rows;
    further columns are ignored.
    """
    return instants(entries, sources).groupBy("entry_id").agg(F.floor(F.min("utc_us") / F.lit(1000)).cast("long").alias("utc_ms"))


def timestamps_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_found over the whole of memory_entries."""
    from sparkivist.plans.session import table

    return normalise_timestamps(table(spark, sf_dir, "memory_entries"), table(spark, sf_dir, "import_sources"))


def status_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_status: how many entries of memory_entries state an instant in each way."""
    from sparkivist.plans.session import table

    found = instants(table(spark, sf_dir, "memory_entries"), table(spark, sf_dir, "import_sources"))
    return found.groupBy("status").agg(F.count_distinct("entry_id").alias("entries"))
