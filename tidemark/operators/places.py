"""Names of states and counties as codes, by joins with a reference of counties.

An unknown or ambiguous name gives no code rather than a guess, and says which it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import county_key, fold

# Names of states and territories, folded, and their postal codes.
STATE_CODES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "district of columbia": "DC",
    "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME",
    "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV",
    "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR",
    "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA",
    "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY", "puerto rico": "PR", "guam": "GU", "american samoa": "AS", "northern mariana islands": "MP",
    "us virgin islands": "VI", "united states virgin islands": "VI", "virgin islands": "VI",
}

# The first two digits of county codes outside the contiguous states.
OUTSIDE_CONTIGUOUS = ("02", "15", "60", "66", "69", "72", "78")


def state_code(text: str | Column) -> Column:
    """The postal code of a code or full name in any spelling of case, accents and signs; null if unknown."""
    folded = fold(text)
    names = F.create_map(*[F.lit(x) for name, code in STATE_CODES.items() for x in (name, code)])
    return F.when(F.upper(folded).isin(*sorted(set(STATE_CODES.values()))), F.upper(folded)).otherwise(F.try_element_at(names, folded))


def contiguous(fips: str | Column) -> Column:
    """Whether a county code lies in the contiguous states; null for null."""
    return ~F.substring(fips, 1, 2).isin(*OUTSIDE_CONTIGUOUS)


def county_index(reference: DataFrame, fips: str, state: str, name: str, known_states: bool = False) -> DataFrame:
    """st, key, fips, n: the counties of a name key in each state; ``known_states``: states are codes of any kind already."""
    st = F.col(state) if known_states else state_code(state)
    return reference.select(st.alias("st"), county_key(name).alias("key"), F.col(fips).alias("fips")).groupBy("st", "key").agg(F.min("fips").alias("fips"), F.count_distinct("fips").alias("n"))


def lookup_counties(names: DataFrame, state: str, name: str, index: DataFrame, known_states: bool = False) -> DataFrame:
    """``names`` with fips and lookup: 'found', 'ambiguous' or 'unknown'.

    The key as it is comes first, then the key without 'city' at its end, then the key with it.
    Each distinct pair of state and name is looked up once.
    """
    st = F.col(state) if known_states else state_code(state)
    key = county_key(name)
    tiers = F.array(F.struct(F.lit(1).alias("tier"), key.alias("key")), F.struct(F.lit(2).alias("tier"), F.when(key.endswith("city"), F.regexp_replace(key, "city$", "")).alias("key")), F.struct(F.lit(3).alias("tier"), F.concat(key, F.lit("city")).alias("key")))
    pairs = names.select(F.col(state).alias("_s"), F.col(name).alias("_n"), st.alias("_st"), tiers.alias("_tiers")).distinct()
    asked = pairs.select("_s", "_n", "_st", F.explode("_tiers").alias("t")).select("_s", "_n", "_st", "t.tier", F.col("t.key").alias("_key"))
    hits = asked.join(index, (F.col("_st") == F.col("st")) & (F.col("_key") == F.col("key")), "left")
    best = hits.groupBy("_s", "_n").agg(F.min(F.when(F.col("fips").isNotNull(), F.struct("tier", "fips", "n"))).alias("b"))
    found = best.select("_s", "_n", F.when(F.col("b.n") == 1, F.col("b.fips")).alias("fips"), F.when(F.col("b").isNull(), "unknown").when(F.col("b.n") > 1, "ambiguous").otherwise("found").alias("lookup"))
    return names.join(found, F.col(state).eqNullSafe(F.col("_s")) & F.col(name).eqNullSafe(F.col("_n")), "left").drop("_s", "_n")


def served_counties(sites: DataFrame, site: str, state: str, served: str, index: DataFrame, known_states: bool = False) -> DataFrame:
    """site, position, name, fips, how ('own', 'elsewhere' or 'unmapped') of every county in a list with commas.

    Names are looked up in the site's own state; one that is not there, but in one other state
    only, is that state's county; any other is kept as unmapped. Blank names are left out, and
    of a county named twice the first position counts; null lists give no rows.
    """
    names = sites.select(F.col(site).alias("site"), F.col(state).alias("state"), F.posexplode(F.split(served, ",")).alias("position", "_name"))
    names = names.select("site", "state", "position", F.trim("_name").alias("name")).filter("name <> ''").distinct()
    own = lookup_counties(names, "state", "name", index, known_states)
    alone = index.groupBy(F.col("key").alias("_k")).agg(F.count("*").alias("_states"), F.min("fips").alias("_fips"), F.max("n").alias("_n")).filter("_states = 1 and _n = 1")
    both = own.withColumn("_key", county_key("name")).join(alone, F.col("_key") == F.col("_k"), "left")
    mapped = both.select("site", "position", "name", F.coalesce("fips", "_fips").alias("fips"), F.when(F.col("fips").isNotNull(), "own").when(F.col("_fips").isNotNull(), "elsewhere").otherwise("unmapped").alias("how"))
    first = F.min(F.struct("position", "name", "how"))
    known = mapped.filter("fips is not null").groupBy("site", "fips").agg(first.alias("f")).select("site", "f.position", "f.name", "fips", "f.how")
    return known.unionByName(mapped.filter("fips is null"))


def one_of_two(text: str | Column, first: str, second: str, codes: tuple[str, str]) -> Column:
    """The code of the pattern that alone occurs in a text, whatever its case; blank if both do or neither."""
    t = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    a, b = F.regexp_count(t, F.lit(first)) > 0, F.regexp_count(t, F.lit(second)) > 0
    return F.when(a & ~b, codes[0]).when(b & ~a, codes[1]).otherwise("")


def region_label(names: DataFrame, region: str, name: str, size: str) -> DataFrame:
    """region, label: the largest member's name, and how many others there are."""
    per = names.groupBy(region).agg(F.max_by(name, F.struct(size, name)).alias("_first"), F.count("*").alias("_n"))
    rest = F.col("_n") - 1
    more = F.when(rest == 0, "").when(rest == 1, " and 1 nearby county").otherwise(F.concat(F.lit(" and "), rest.cast("string"), F.lit(" nearby counties")))
    return per.select(region, F.concat("_first", more).alias("label"))


def rounded_ring(ring: str | Column, digits: int = 3) -> Column:
    """A ring, or another array of arrays of coordinates, with each number rounded."""
    return F.transform(ring, lambda point: F.transform(point, lambda x: F.round(x, digits)))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with the characters of ``spans`` (array of struct start, length; from 1) replaced by #."""
    return F.aggregate(spans, text, lambda t, s: F.overlay(t, F.repeat(F.lit("#"), s["length"]), s["start"], s["length"]))
