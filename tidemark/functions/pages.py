"""Publication dates of pages, and labels in JSON, by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.functions.text import bound

# Names of meta tags that carry the first publication time, most trusted first.
META_KEYS = (
    "article:published_time", "og:article:published_time", "datepublished", "parsely-pub-date", "sailthru.date", "publish-date", "publish_date",
    "pubdate", "publishdate", "dc.date.issued", "dcterms.created", "date", "cxenseparse:recs:publishtime", "article.published",
)


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def local_day(text: Column, zone: str = "America/Chicago") -> Column:
    """The day of an ISO time in a zone: a time with an offset is moved there, one without is taken as it is; years 2000 to 2100."""
    t = F.trim(text)
    moved = F.to_date(F.from_utc_timestamp(F.try_to_timestamp(F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2")), zone))
    plain = F.try_to_date(F.nullif(F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")), "yyyy-MM-dd")
    day = F.when(t.rlike(r"T.*(?:Z|[+-]\d{2}:?\d{2})$"), moved).otherwise(plain)
    return F.when(F.year(day).between(2000, 2100), day)


def published(html: str | Column, zone: str = "America/Chicago") -> Column:
    """day and source: structured data first, then meta tags in order of trust, a dated property, and the first time tag.

    The first of each kind that is a date counts; without any, the source is 'none'. Needs a
    session in UTC.
    """
    h = _c(html)
    linked = F.regexp_extract_all(h, F.lit(r'"datePublished"\s*:\s*"([^"]+)"'), F.lit(1))
    day = lambda pattern: local_day(F.nullif(F.regexp_extract(h, pattern, 1), F.lit("")), zone)
    tiers = [("jsonld", F.when(F.size(linked) > 0, F.try_element_at(F.filter(F.transform(linked, lambda v: local_day(v, zone)), lambda d: d.isNotNull()), F.lit(1))))]
    for key in META_KEYS:
        name = key.replace(".", r"\.")
        tiers.append((f"meta:{key}", F.coalesce(day(rf'(?i)<meta\b[^>]*(?:property|name|itemprop)="{name}"[^>]*content="([^"]+)"'), day(rf'(?i)<meta\b[^>]*content="([^"]+)"[^>]*(?:property|name|itemprop)="{name}"'))))
    tiers.append(("itemprop", F.coalesce(day(r'(?i)itemprop="datePublished"[^>]*(?:datetime|content)="([^"]+)"'), day(r'(?i)(?:datetime|content)="([^"]+)"[^>]*itemprop="datePublished"'))))
    tiers.append(("time_tag", day(r'(?i)<time\b[^>]*datetime="([^"]+)"')))
    cases = F.filter(F.array(*[F.struct(d.alias("day"), F.lit(s).alias("source")) for s, d in tiers]), lambda x: x["day"].isNotNull())
    return bound(cases, lambda found: F.coalesce(F.try_element_at(found, F.lit(1)), F.struct(F.lit(None).cast("date").alias("day"), F.lit("none").alias("source"))))


def json_label(text: str | Column) -> Column:
    """relevant, illness, concern and error from a model's JSON answer; a bad field is null, a bad document an error."""
    schema = "relevant string, illness string, concern string"
    parsed = F.from_json(_c(text), schema, {"mode": "PERMISSIVE"})
    broken = F.coalesce(~F.rlike(F.trim(_c(text)), F.lit(r"(?s)^\{.*\}$")), F.lit(True)) | (parsed.isNull())
    return F.struct(
        labels.relevant_answer(parsed["relevant"]).alias("relevant"), labels.illness_answer(parsed["illness"]).alias("illness"), labels.concern_answer(parsed["concern"]).alias("concern"),
        F.when(broken, "not a JSON object").alias("error"),
    )
