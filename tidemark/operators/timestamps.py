"""Timestamps of mixed formats, precisions and zones as one UTC instant.

An ordered cascade of anchored patterns: the first pattern that matches a whole value decides
its reading, and every part is then checked strictly (real day, hour, minute, second, known
zone). A value no pattern matches, or one whose parts fail, denotes no instant.

Zone: one written in the value is taken literally; otherwise the value is wall time in the
default zone given by a lookup. Wall times around a change of offset follow an explicit policy.
All of it is built-in expressions, so it stays inside generated code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month names and their usual short forms, English and Spanish.
MONTHS = {
    1: ("january", "jan", "enero", "ene"),
    2: ("february", "feb", "febrero"),
    3: ("march", "mar", "marzo"),
    4: ("april", "apr", "abril", "abr"),
    5: ("may", "mayo"),
    6: ("june", "jun", "junio"),
    7: ("july", "jul", "julio"),
    8: ("august", "aug", "agosto", "ago"),
    9: ("september", "sept", "sep", "septiembre", "setiembre"),
    10: ("october", "oct", "octubre"),
    11: ("november", "nov", "noviembre"),
    12: ("december", "dec", "diciembre", "dic"),
}

# Offsets from UTC, in minutes, of the zone letters that may follow a time.
ZONE_LETTERS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "akst": -540, "akdt": -480, "hst": -600, "ast": -240, "adt": -180,
}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?"
_HALF = r"(?:\s*([ap])\.?\s?m\.?)?"
_ZONE = r"(?:\s*([a-z]{1,4}|[+-]\d{2}(?::?\d{2})?))?"


@dataclass(frozen=True)
class Pattern:
    """A whole-value pattern; ``parts`` names the groups in order."""

    name: str
    regex: str
    parts: tuple[str, ...]


_CLOCK = ("hour", "minute", "second")

#: Tried in this order.
CASCADE = (
    Pattern("iso", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:(?:t|\s+){_TIME}{_ZONE})?$", ("year", "month", "day", *_CLOCK, "zone")),
    Pattern("compact", rf"^((?:19|20|21)\d{{2}})(\d{{2}})(\d{{2}})(?:[t\s]?(\d{{2}})(\d{{2}})(\d{{2}})?(?:\.\d+)?{_ZONE})?$", ("year", "month", "day", *_CLOCK, "zone")),
    Pattern("epoch_seconds", r"^(\d{9,10})(?:\.\d+)?$", ("seconds",)),
    Pattern("epoch_millis", r"^(\d{9,10})\d{3}(?:\.\d+)?$", ("seconds",)),
    Pattern("slashes", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}})(?:,?\s+{_TIME}{_HALF}{_ZONE})?$", ("month", "day", "year", *_CLOCK, "half", "zone")),
    Pattern("day_month", rf"^(?:[a-z]{{3,9}}\.?,?\s+)?(\d{{1,2}})\s+([a-z]{{3,10}})\.?,?\s+(\d{{4}})(?:,?\s+(?:at\s+)?{_TIME}{_HALF}{_ZONE})?$", ("day", "month_name", "year", *_CLOCK, "half", "zone")),
    Pattern("month_day", rf"^(?:[a-z]{{3,9}}\.?,\s+)?([a-z]{{3,10}})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?:,?\s+(?:at\s+)?{_TIME}{_HALF}{_ZONE})?$", ("month_name", "day", "year", *_CLOCK, "half", "zone")),
    Pattern("day_de_month", rf"^(?:[a-záéíóú]{{4,9}},?\s+)?(\d{{1,2}})\s+de\s+([a-z]{{3,10}})\s+(?:de|del)\s+(\d{{4}})(?:,?\s+(?:a\s+las?\s+)?{_TIME}{_HALF}{_ZONE})?$", ("day", "month_name", "year", *_CLOCK, "half", "zone")),
)

_PARTS = ("year", "month", "month_name", "day", "hour", "minute", "second", "half", "zone", "seconds")


def cleaned(text: str | Column) -> Column:
    """The text in lower case without white space, no-break spaces and byte order marks around it."""
    return F.lower(F.regexp_replace(F.col(text) if isinstance(text, str) else text, "^[\\s\u00a0\ufeff]+|[\\s\u00a0\ufeff]+$", ""))


def read_parts(text: Column) -> Column:
    """The array of pattern name and text parts, in the order of _PARTS, of the first pattern that matches a cleaned text; null if none does.

    A match is rewritten once, as its parts with a control character between them; the patterns let none through.
    """
    chosen = None
    for p in CASCADE:
        groups = {part: f"${i + 1}" for i, part in enumerate(p.parts)}
        parted = F.regexp_replace(text, p.regex, "\x01".join([p.name, *[groups.get(part, "") for part in _PARTS]]))
        chosen = F.when(text.rlike(p.regex), parted) if chosen is None else chosen.when(text.rlike(p.regex), parted)
    return F.split(chosen, "\x01")


def _month(parts: Column) -> Column:
    names = F.create_map(*[F.lit(x) for number, words in MONTHS.items() for w in words for x in (w, number)])
    return F.coalesce(parts["month"].cast("int"), F.try_element_at(names, parts["month_name"]))


def _zone_seconds(zone: Column) -> Column:
    letters = F.create_map(*[F.lit(x) for name, minutes in ZONE_LETTERS.items() for x in (name, minutes)])
    digits = F.regexp_replace(zone, r"[+:-]", "")
    hours, minutes = F.substring(digits, 1, 2).cast("int"), F.coalesce(F.nullif(F.substring(digits, 3, 2), F.lit("")).cast("int"), F.lit(0))
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    numeric = F.when((hours <= 15) & (minutes <= 59), sign * (hours * 60 + minutes))
    return F.when(zone.rlike(r"^[+-]\d"), numeric).otherwise(F.try_element_at(letters, zone)) * 60


def wall_to_utc(wall: Column, zone: Column, ambiguous: str = "earlier", nonexistent: str = "before") -> Column:
    """UTC seconds of wall-clock seconds in a named zone.

    ``ambiguous`` (a wall time that occurs twice): 'earlier' or 'later' instant, or 'null'.
    ``nonexistent`` (a skipped one): read with the offset 'before' or 'after' the change, or 'null'.
    """
    to_utc = lambda w: F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(w), zone))
    to_wall = lambda u: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(u), zone))
    first = to_utc(wall)  # the earlier of two; the offset before the change in a gap
    if (ambiguous, nonexistent) == ("earlier", "before"):
        return first
    shift = to_wall(first) - wall  # the length of the gap, or zero
    day = 86400
    repeat = (to_wall(first) - first) - (to_wall(first + day) - (first + day))  # how far clocks go back within a day
    later = F.when((repeat > 0) & (to_wall(first + repeat) == wall), first + repeat)
    skipped = {"before": first, "after": first - shift, "null": F.lit(None).cast("long")}[nonexistent]
    twice = {"earlier": first, "later": later, "null": F.lit(None).cast("long")}[ambiguous]
    return F.when(shift != 0, skipped).when(later.isNotNull(), twice).otherwise(first)


def wall_seconds(p: Column) -> Column:
    """Seconds since 1970 on the wall clock that the parts show, null unless each of them is valid."""
    year = F.when(F.length(p["year"]) == 2, p["year"].cast("int") + 2000).otherwise(p["year"].cast("int"))
    day = F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(_month(p).cast("string"), 2, "0"), F.lpad(p["day"], 2, "0")), "yyyy-MM-dd")
    said = p["hour"].cast("int")
    hour = F.when(p["half"].isNull(), F.when(said <= 23, said)).when(said.between(1, 12), said % 12 + F.when(p["half"] == "p", 12).otherwise(0))
    minute, second = p["minute"].cast("int"), F.coalesce(p["second"].cast("int"), F.lit(0))
    clock = F.when(p["hour"].isNull(), F.lit(0)).when((minute <= 59) & (second <= 59), hour * 3600 + minute * 60 + second)
    return F.unix_date(day).cast("long") * 86400 + clock


def utc_seconds(df: DataFrame, text: str, zone: str, first_year: int = 2000, last_year: int = 2100, ambiguous: str = "earlier", nonexistent: str = "before") -> DataFrame:
    """``df`` with pattern and utc_seconds: whole seconds since 1970 of the instant ``text`` denotes.

    Null if it denotes none. The column ``zone`` names the zone for values without one; where
    it is null, such values denote no instant. Fractions are cut off; a bare date is its
    midnight; instants outside the years given, in UTC, are none.
    """
    # The generator keeps the parts from being computed again for each use and in pushed-down filters.
    parts = df.withColumn("_text", cleaned(text)).select("*", F.explode(F.array(read_parts(F.col("_text")))).alias("_r"))
    named = F.struct(*[F.nullif(F.get("_r", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(("pattern", *_PARTS))])
    parts = parts.select(*df.columns, F.explode(F.array(named)).alias("_p"))
    p = F.col("_p")
    placed = parts.withColumns({"_wall": wall_seconds(p), "_offset": _zone_seconds(p["zone"])})
    local = wall_to_utc(F.col("_wall"), F.col(zone), ambiguous, nonexistent)
    instant = F.when(p["seconds"].isNotNull(), p["seconds"].cast("long")).when(p["zone"].isNotNull(), F.col("_wall") - F.col("_offset")).otherwise(local)
    read = placed.withColumn("_at", instant)
    low, high = (F.unix_seconds(F.lit(f"{y}-01-01T00:00:00Z").cast("timestamp")) for y in (first_year, last_year + 1))
    valid = F.when((F.col("_at") >= low) & (F.col("_at") < high), F.col("_at"))
    return read.select(*df.columns, p["pattern"].alias("pattern"), valid.alias("utc_seconds"))


def usable_zones(spark: SparkSession, lookup: DataFrame, key: str, zone: str) -> DataFrame:
    """``lookup`` as (zone_key, zone), one row per key, with names that are no zone dropped."""
    names = sorted(str(z) for z in spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds().toArray())
    known = lookup.select(F.col(key).alias("zone_key"), F.trim(F.col(zone)).alias("zone")).filter(F.col("zone").isin(names))
    return known.filter("zone_key is not null").groupBy("zone_key").agg(F.min("zone").alias("zone"))


def normalise_fields(df: DataFrame, row_id: str, fields: dict[str, str | None], zone_key: str, zones: DataFrame, **policy: str) -> DataFrame:
    """row_id, field, text, pattern, utc_seconds: one row per distinct row and field.

    ``fields`` names the text columns and their fixed zone, or None for the zone looked up by
    ``zone_key`` in ``zones`` (zone_key, zone). Null texts stay, with null results.
    """
    rows = df.select(F.col(row_id).alias("row_id"), F.col(zone_key).alias("zone_key"), *[F.col(f).alias(f"_f{i}") for i, f in enumerate(fields)]).distinct()
    placed = rows.join(zones, "zone_key", "left")
    cases = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_f{i}").alias("text"), (F.lit(z) if z else F.col("zone")).alias("zone")) for i, (f, z) in enumerate(fields.items())])
    long = placed.select("row_id", F.explode(cases).alias("c")).select("row_id", "c.*")
    return utc_seconds(long, "text", "zone", **policy).drop("zone")
