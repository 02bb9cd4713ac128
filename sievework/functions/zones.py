"""Times in a named zone as they are told: with offset, in seconds, and as a sentence."""

from __future__ import annotations

import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F


def offset_names(zones: list[str], since: int = 1970, until: int = 2050) -> dict[str, str]:
    """``zone|offset in seconds`` -> the zone's short name at that offset, the latest one where there were several (looked up every ten days)."""
    out = {}
    for zone in zones:
        info, day = ZoneInfo(zone), datetime.datetime(since, 1, 1, tzinfo=datetime.UTC)
        while day.year < until:
            local = day.astimezone(info)
            out[f"{zone}|{int(local.utcoffset().total_seconds())}"] = local.tzname()
            day += datetime.timedelta(days=10)
    return out


def told(ts: Column, zone: Column, zones: list[str]) -> dict[str, Column]:
    """``iso, unix, readable`` of a time (a timestamp, session in UTC) in the zone of its row, one of ``zones``; an unknown zone gives an error text, as a null time gives nulls."""
    names = offset_names(zones)
    known = zone.isin(zones)
    local = F.from_utc_timestamp(ts, F.when(known, zone).otherwise("UTC"))
    offset = F.unix_seconds(local) - F.unix_seconds(ts)
    minutes = F.abs(offset) / 60
    sign = F.when(offset < 0, "-").otherwise("+")
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    part = F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise("")
    iso = F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), part, sign, two(minutes / 60), F.lit(":"), two(minutes % 60))
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    name = F.element_at(table, F.concat_ws("|", zone, offset.cast("string")))
    readable = F.concat(F.date_format(local, "EEEE, MMMM dd, yyyy 'at' hh:mm:ss a "), F.coalesce(name, zone))
    wrong = F.concat(F.lit("Error: no time zone found with key "), zone)
    return {"iso": F.when(known, iso).otherwise(wrong), "unix": F.unix_seconds(ts), "readable": F.when(known, readable).otherwise(wrong)}
