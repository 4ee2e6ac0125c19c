"""A small closed question language over weekly shares: text -> Question -> plan.

Parsing is driver-side and total: what a question does not say falls to a default and a note.
Everything that touches data is a plan; the driver holds names of places and one date at most.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import injection_mark, squeeze
from tidemark.operators.stats import quantiles

# Words that name a signal, a direction or a measure.
SIGNALS = {"ed_covid": ("covid", "coronavirus"), "ed_flu": ("flu", "influenza"), "ed_rsv": ("rsv",)}
UPWARD = ("rising", "rise", "increase", "increasing", "up", "growing", "surge", "climbing", "worst", "highest", "most")
DOWNWARD = ("falling", "fall", "decrease", "decreasing", "down", "declining", "drop", "lowest", "least", "best")
CHANGE = ("rising", "rise", "increase", "increasing", "growing", "surge", "climbing", "falling", "fall", "decrease", "decreasing", "declining", "drop", "change", "changed", "trend")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
NUMBERS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "twelve": 12}
HOLIDAYS = {"christmas": (12, 25), "xmas": (12, 25), "new year's eve": (12, 31), "new year": (1, 1), "halloween": (10, 31), "independence day": (7, 4), "fourth of july": (7, 4), "thanksgiving": None}
PARTS = {"first week": 7, "early": 7, "beginning": 7, "start": 7, "second week": 14, "mid": 15, "middle": 15, "third week": 21}
#: Percent over three weeks beyond which a trend rises or falls.
TREND_PCT = 15.0


@dataclass(frozen=True)
class Question:
    """What is asked: all fields are from closed sets or dates."""

    signal: str = "ed_resp"
    measure: str = "level"
    direction: str = "high"
    top: int = 5
    place: str | None = None
    week_end: dt.date | None = None
    peak: bool = False
    season: str | None = None
    notes: tuple[str, ...] = field(default=())


def saturday(day: dt.date) -> dt.date:
    """The Saturday on or after a day."""
    return day + dt.timedelta(days=(5 - day.weekday()) % 7)


def last_day(year: int, month: int) -> int:
    return (dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)).day


def holiday(name: str, year: int) -> dt.date:
    """The day of a holiday; Thanksgiving is the fourth Thursday of November."""
    fixed = HOLIDAYS[name]
    first = dt.date(year, 11, 1)
    return dt.date(year, *fixed) if fixed else first + dt.timedelta(days=(3 - first.weekday()) % 7 + 21)


def season_of(day: dt.date) -> str:
    """The season of a day, October to September, such as 2025-26."""
    year = day.year if day.month >= 10 else day.year - 1
    return f"{year}-{(year + 1) % 100:02}"


def season_span(season: str) -> tuple[dt.date, dt.date]:
    """The first and last day of a season."""
    year = int(season[:4])
    return dt.date(year, 10, 1), dt.date(year + 1, 9, 30)


def _recent(make, latest: dt.date) -> dt.date:
    """``make(year)`` for the most recent year in which the data reaches it."""
    year = latest.year
    while make(year) > latest + dt.timedelta(days=6):
        year -= 1
    return make(year)


def _month(text: str) -> int:
    return next(i for i, m in enumerate(MONTHS, 1) if m.startswith(text[:3]))


_NAMED = rf"(?P<month>{'|'.join(sorted({*MONTHS, *(m[:3] for m in MONTHS), 'sept'}, key=len, reverse=True))})\.?"
_YEAR = r"(?P<year>20\d\d)"
#: Ways to name a time, tried in this order; groups say what is known of it.
WHEN = tuple(re.compile(p) for p in (
    rf"\b{_YEAR}-(?P<number>\d{{1,2}})-(?P<day>\d{{1,2}})\b",
    r"\b(?P<number>\d{1,2})/(?P<day>\d{1,2})(?:/(?P<year>20\d\d|\d\d))?\b",
    rf"\b{_NAMED}\s+(?P<day>\d{{1,2}})(?:st|nd|rd|th)?\b(?:,?\s*{_YEAR})?",
    rf"\b(?P<day>\d{{1,2}})(?:st|nd|rd|th)?\s+{_NAMED}\b(?:,?\s*{_YEAR})?",
    rf"\b(?P<holiday>{'|'.join(sorted(HOLIDAYS, key=len, reverse=True))})(?:'?s)?(?: day)?\b(?:\s*(?:of\s*)?{_YEAR})?",
    rf"\b(?:(?P<part>{'|'.join(PARTS)})\b(?:[- ](?:of|in))?[- ]?\s*)?\b{_NAMED}(?:\s+(?:of|in))?,?\s+{_YEAR}\b",
    rf"\bin\s+{_NAMED}\b(?!\s*\d)",
    rf"\b(?P<count>\d+|{'|'.join(NUMBERS)})\s+(?P<unit>week|month|year)s?\s+ago\b",
    r"\b(?P<last>last|previous|prior) (?P<span>week|month|year)\b",
))


def _read_when(found: dict, latest: dt.date) -> dt.date:
    """The day that the groups of a pattern of WHEN name; ValueError if there is no such day."""
    weeks = {"week": 1, "month": 4, "year": 52}
    if found.get("count"):
        n = int(found["count"]) if found["count"].isdigit() else NUMBERS[found["count"]]
        return latest - dt.timedelta(weeks=weeks[found["unit"]] * n)
    if found.get("last"):
        return latest - dt.timedelta(weeks=weeks[found["span"]])
    year = int(found["year"]) % 100 + 2000 if found.get("year") else None
    if found.get("holiday"):
        return holiday(found["holiday"], year) if year else _recent(lambda y: holiday(found["holiday"], y), latest)
    month = int(found["number"]) if found.get("number") else _month(found["month"])
    if found.get("day"):
        day = int(found["day"])
        return dt.date(year, month, day) if year else _recent(lambda y: dt.date(y, month, min(day, last_day(y, month))), latest)
    if year is None:
        year = latest.year if month <= latest.month else latest.year - 1
    end = dt.date(year, month, PARTS[found["part"]] if found.get("part") else last_day(year, month))
    return end if found.get("part") else end - dt.timedelta(days=(end.weekday() - 5) % 7)


def parse(text: str, places: dict[str, str], latest: dt.date) -> Question:
    """A question from its words. ``places`` maps lower-case names to keys; the longest name found wins.

    'may' alone is a verb more often than a month, and counts only with a day or year.
    """
    clean = " ".join(text.replace("’", "'").split())
    if not 1 <= len(clean) <= 500:
        raise ValueError("a question has 1 to 500 characters")
    low = clean.lower()
    words = set(re.findall(r"[a-z]+", low))
    notes: list[str] = []
    named = [s for s, keys in SIGNALS.items() if words & set(keys)]
    if len(named) > 1:
        notes.append("several illnesses are named; all respiratory visits are shown")
    top = 5
    if m := re.search(r"\b(?:top|first|worst|best)\s+(\d{1,3})\b|\b(\d{1,3})\s+(?:counties|places|areas|sites|highest|worst|most|biggest)\b", low):
        top = max(1, min(int(m[1] or m[2]), 50))
        low = low[: m.start()] + "#" * (m.end() - m.start()) + low[m.end() :]  # "top 10 Dec 2025" is not Dec 10
    hits = sorted((n for n in places if re.search(rf"\b{re.escape(n)}\b", low)), key=len, reverse=True)
    season = None
    if (m := re.search(r"\b(20\d\d)\s*[-–/]\s*(20\d\d|\d\d)\b(?!-)", low)) and int(m[2][-2:]) == (int(m[1]) + 1) % 100:
        season, low = f"{m[1]}-{m[2][-2:]}", low[: m.start()] + low[m.end() :]
    elif re.search(r"\blast (?:flu |respiratory )?season\b", low):
        season = season_of(latest.replace(year=latest.year - 1, day=min(latest.day, 28)))
    day = None
    for pattern in WHEN:
        m = pattern.search(low)
        if m is None or m.groupdict().get("month") == "may" and not (m.groupdict().get("day") or m.groupdict().get("year")):
            continue
        try:
            day = _read_when(m.groupdict(), latest)
        except ValueError:
            notes.append(f"{m[0]} is no date; the latest week is shown")
        break
    down = bool(words & set(DOWNWARD) and not words & set(UPWARD))
    peak = "peak" in words or bool(re.search(r"\b(?:worst|highest) week\b", low))
    return Question(named[0] if len(named) == 1 else "ed_resp", "change" if words & set(CHANGE) else "level", "low" if down else "high", top, places[hits[0]] if hits else None, saturday(day) if day else None, peak, season, tuple(notes))


def gazetteer(counties: DataFrame, metros: DataFrame) -> dict[str, str]:
    """Lower-case names of counties, with and without their ending, and of metros -> keys, for :func:`parse`; a name that several places share is left out.

    The driver holds names of places: a fixed table.
    """
    bare = F.trim(F.regexp_replace("county_name", r"(?i)\s+(city and borough|census area|municipality|municipio|borough|county|parish)$", ""))
    rows = counties.select(F.explode(F.array_distinct(F.array(F.lower("county_name"), F.lower(bare), F.lower(F.concat_ws(", ", bare, "state"))))).alias("name"), F.col("fips").alias("key"))
    rows = rows.unionByName(metros.select(F.lower("metro_name").alias("name"), F.col("metro").alias("key")))
    alone = rows.filter("name is not null and name <> ''").groupBy("name").agg(F.count_distinct("key").alias("n"), F.min("key").alias("key")).filter("n = 1")
    return {r["name"]: r["key"] for r in alone.collect()}


def from_fields(data: dict, text: str, latest: dt.date) -> Question:
    """A question from a model's fields; any field outside its closed set is an error, so the caller falls back to :func:`parse`."""
    allowed = {"signal": {"ed_resp", *SIGNALS}, "measure": {"level", "change"}, "direction": {"high", "low"}}
    unknown = set(data) - {*allowed, "top", "place", "week_end", "peak", "season"}
    if unknown or any(k in data and data[k] not in v for k, v in allowed.items()):
        raise ValueError(f"fields outside the schema for {text[:40]!r}")
    week = data.get("week_end")
    return Question(data.get("signal", "ed_resp"), data.get("measure", "level"), data.get("direction", "high"), max(1, min(int(data.get("top", 5)), 50)), data.get("place"), saturday(min(dt.date.fromisoformat(week), latest)) if week else None, bool(data.get("peak", False)), data.get("season"))


def resolve(q: Question, values: DataFrame) -> Question:
    """The question with a week the data has: the peak of the place's mean, else the last week on or before the one asked.

    ``values``: fips, metro, week_end and the signals. Two scalars come to the driver.
    """
    mine = values if q.place is None else values.filter((F.col("metro") == q.place) | (F.col("fips") == q.place))
    known = mine.filter(F.col(q.signal).isNotNull())
    if q.season:
        known = known.filter(F.col("week_end").between(*(F.lit(d) for d in season_span(q.season))))
    if q.peak:
        weekly = known.groupBy("week_end").agg(F.avg(q.signal).alias("m"))
        week = weekly.agg(F.max_by("week_end", F.struct("m", "week_end"))).first()[0]
    else:
        before = known if q.week_end is None else known.filter(F.col("week_end") <= F.lit(q.week_end))
        week = before.agg(F.max("week_end")).first()[0]
        if week is None:
            week = known.agg(F.min("week_end")).first()[0]
    notes = q.notes if q.week_end in (None, week) else (*q.notes, f"the nearest week with data ends {week}")
    return replace(q, week_end=week, notes=notes)


def answer(q: Question, values: DataFrame) -> DataFrame:
    """place, week_end, value, before, change: each county of the question's week with the week before it."""
    mine = values if q.place is None else values.filter((F.col("metro") == q.place) | (F.col("fips") == q.place))
    two = mine.filter(F.col("week_end").isin(q.week_end, q.week_end - dt.timedelta(days=7)))
    now = F.col("week_end") == F.lit(q.week_end)
    wide = two.groupBy(F.col("fips").alias("place")).agg(F.max(F.when(now, F.col(q.signal))).alias("value"), F.max(F.when(~now, F.col(q.signal))).alias("before"))
    return wide.filter("value is not null").select("place", F.lit(q.week_end).alias("week_end"), "value", "before", (F.col("value") - F.col("before")).alias("change"))


def top_places(q: Question, answered: DataFrame) -> DataFrame:
    """The question's ``top`` places in its direction: a top-k report."""
    by = F.col("value" if q.measure == "level" else "change")
    order = by.desc_nulls_last() if q.direction == "high" else by.asc_nulls_last()
    return answered.filter(by.isNotNull()).orderBy(order, "place").limit(q.top)


def counts(answered: DataFrame) -> DataFrame:
    """One row: places, how many rose and fell, median value and change."""
    whole = answered.agg(F.count("*").alias("places"), F.count_if(F.col("change") > 0).alias("rose"), F.count_if(F.col("change") < 0).alias("fell")).withColumn("_all", F.lit(1))
    for c in ("value", "change"):
        whole = whole.join(quantiles(answered.withColumn("_all", F.lit(1)), ["_all"], c, {f"median_{c}": 0.5}), "_all", "left")
    return whole.drop("_all")


def sentences(q: Question, top: list, total) -> list[str]:
    """The written answer from the top places and the counts, both a few rows."""
    name = {"ed_resp": "respiratory", "ed_covid": "COVID", "ed_flu": "flu", "ed_rsv": "RSV"}[q.signal]
    out = [f"In the week ending {q.week_end}, {total['places']} places had {name} data; {total['rose']} rose and {total['fell']} fell."]
    out += [f"{r['place']}: {r['value']:.1f}%" + (f" ({r['change']:+.1f} pts)" if r["change"] is not None else "") for r in top]
    return [*out, *q.notes]


# Parts of a regional report


def regional_series(values: DataFrame, weights: DataFrame, region: str, signals: list[str]) -> DataFrame:
    """region, week_end and population-weighted means; an unknown population counts as one."""
    joined = values.join(weights, "fips", "left").withColumn("_w", F.coalesce(F.col("population").cast("double"), F.lit(1.0)))
    means = [(F.sum(F.col(s) * F.col("_w")) / F.sum(F.when(F.col(s).isNotNull(), F.col("_w")))).alias(s) for s in signals]
    return joined.groupBy(region, "week_end").agg(*means)


def trend(series: DataFrame, region: str, value: str) -> DataFrame:
    """Each region's last week: value, change in percent over three weeks (or from its first), trend and severity."""
    by = Window.partitionBy(region).orderBy("week_end")
    base = F.coalesce(F.lag(value, 3).over(by), F.first(value).over(by))
    last = series.filter(F.col(value).isNotNull()).withColumns({"base": base, "_rn": F.row_number().over(Window.partitionBy(region).orderBy(F.desc("week_end")))}).filter("_rn = 1")
    pct = F.when(F.col("base") > 0, (F.col(value) / F.when(F.col("base") > 0, F.col("base")) - 1) * 100)
    kind = F.when(pct > TREND_PCT, "rising").when(pct < -TREND_PCT, "falling").otherwise("roughly flat")
    severity = F.least(F.lit(0.95), 0.15 + F.col(value) / 15 + F.greatest(F.coalesce(pct, F.lit(0.0)), F.lit(0.0)) / 200)
    return last.select(region, "week_end", F.col(value).alias("value"), pct.alias("change_pct"), kind.alias("trend"), severity.alias("severity"))


def arrows(series: DataFrame, region: str, value: str, flat: float = 0.1) -> DataFrame:
    """Each region's last week against two weeks earlier: up, down or flat."""
    earlier = series.select(F.col(region).alias("_r"), F.date_add("week_end", 14).alias("_w"), F.col(value).alias("_v"))
    last = series.filter(F.col(value).isNotNull()).groupBy(region).agg(F.max("week_end").alias("week_end"))
    now = series.join(last, [region, "week_end"])
    both = now.join(earlier, (F.col(region) == F.col("_r")) & (F.col("week_end") == F.col("_w")), "left")
    move = F.col(value) - F.col("_v")
    return both.select(region, "week_end", F.col(value).alias("value"), F.when(move > flat, "up").when(move < -flat, "down").when(move.isNotNull(), "flat").alias("arrow"))


def gate(findings: DataFrame, claim: str, known: str, as_of: str | Column, url: str | None = None) -> DataFrame:
    """``findings`` with ok and reason: known in time, a claim of 1 to 700 characters without instructions, a web address if any."""
    text = F.coalesce(squeeze(claim), F.lit(""))
    late = F.col(known).isNull() | (F.col(known) > (F.col(as_of) if isinstance(as_of, str) else as_of))
    reason = F.when(late, "not known by then").when(text == "", "no claim").when(F.length(text) > 700, "claim too long").when(injection_mark(claim).isNotNull(), "instructions in the claim")
    if url:
        reason = reason.when((F.coalesce(F.col(url), F.lit("")) != "") & ~F.coalesce(F.rlike(F.col(url), F.lit(r"^https?://[^\s/]+")), F.lit(False)), "no web address")
    return findings.withColumns({"ok": reason.isNull(), "reason": reason})
