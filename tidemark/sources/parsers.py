"""Sources: exports, feeds and reports as typed frames; every reader takes paths and stays lazy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.calendar import week_end
from tidemark.sources.tables import fips_text

SNAPSHOT = T.StructType([T.StructField("geo", T.StringType()), T.StructField("time", T.DateType()), T.StructField("value", T.DoubleType()), T.StructField("issue", T.DateType())])
CATALOG = ("article_id", "url", "outlet", "published", "metro", "fips_guess", "title", "found_via", "fetched_ok", "n_words", "dup_of", "date_source", "gdelt_seendate", "stratum")


def text_number(column: str | Column) -> Column:
    """A number in a text with blanks and thousands commas; null if it is none."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.trim(F.replace(c, F.lit(","), F.lit(""))), F.lit("")).try_cast("double")


def strings_csv(spark: SparkSession, paths, columns: tuple[str, ...], sep: str = ",") -> DataFrame:
    """A delimited file with a header, all columns as text; columns that the file lacks are null, others are left out.

    Reading the header is one small job; the rest is lazy.
    """
    df = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(paths)
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def catalog(spark: SparkSession, paths) -> DataFrame:
    """Article catalogues: every column as text, blanks trimmed."""
    return strings_csv(spark, paths, CATALOG).withColumns({c: F.trim(c) for c in CATALOG})


def eligible(df: DataFrame) -> DataFrame:
    """Articles that were fetched and are no duplicates."""
    return df.filter((F.lower(F.trim("fetched_ok")) == "true") & (F.coalesce(F.trim("dup_of"), F.lit("")) == ""))


def tidy_headers(df: DataFrame) -> DataFrame:
    """Column names in lower case with blanks and slashes as underscores."""
    return df.toDF(*[c.strip().lower().replace("/", "_").replace(" ", "_") for c in df.columns])


def site_export(spark: SparkSession, paths, known: tuple[str, ...] | None = None) -> DataFrame:
    """A wastewater export, plain or gzip: site, state, counties, population, value, week_end, pathogen, issue.

    With ``known`` pathogens, a row of any other is an error when it is read.
    """
    pathogen = F.lower(F.trim("pathogen_target"))
    if known:
        pathogen = F.when(pathogen.isin(*known), pathogen).otherwise(F.raise_error(F.concat(F.lit("unknown pathogen "), F.coalesce(pathogen, F.lit("(none)")))))
    raw = tidy_headers(spark.read.option("header", True).csv(paths))
    return raw.select(
        F.trim("site").alias("site"), F.trim("state_territory").alias("state"), F.trim("counties_served").alias("counties"), text_number("population_served").alias("population"),
        text_number("site_wval").alias("value"), F.try_to_date("week_end", "yyyy-MM-dd").alias("week_end"), pathogen.alias("pathogen"), F.try_to_date("date_updated", "yyyy-MM-dd").alias("issue"),
    )


def wide_export(spark: SparkSession, paths, signals: dict[str, str], issue: str) -> DataFrame:
    """A wide weekly table as one snapshot row per signal: rollup rows, blanks and codes that are none are left out."""
    raw = spark.read.option("header", True).csv(paths).filter("county <> 'All'")
    named = raw.select(fips_text("fips").alias("geo"), F.date_sub(F.col("week_end").cast("date"), 6).alias("time"), *[text_number(c).alias(s) for c, s in signals.items()])
    long = named.unpivot(["geo", "time"], list(signals.values()), "signal", "value")
    return long.filter("value is not null and geo is not null").withColumn("issue", F.lit(issue).cast("date"))


def station_days(spark: SparkSession, paths, fields: tuple[str, ...]) -> DataFrame:
    """Daily station records from JSON arrays: every field is there, absent ones null, padded numbers read."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("STATION", "DATE", *fields)])
    raw = spark.read.schema(schema).option("multiLine", True).json(paths)
    return raw.select(F.col("STATION").alias("station"), F.try_to_date(F.substring("DATE", 1, 10), "yyyy-MM-dd").alias("day"), *[text_number(f).alias(f.lower()) for f in fields])


def hourly_days(spark: SparkSession, paths, time: str, values: tuple[str, ...], least: int = 0) -> DataFrame:
    """Hourly rows as daily means with the hours that had a value; days with fewer than ``least`` are null."""
    raw = spark.read.option("header", True).option("nullValue", "M").csv(paths)
    first = text_number(values[0])
    means = [F.when(F.count(first) >= least, F.avg(text_number(v))).alias(v) for v in values]
    return raw.groupBy(F.to_date(F.substring(time, 1, 10)).alias("day")).agg(*means, F.count(first).alias("hours"))


def parallel_hours(df: DataFrame, key: str, times: str, values: dict[str, str], least: int = 18) -> DataFrame:
    """Parallel hourly arrays as daily means; a day with fewer than ``least`` hours of the first value has none."""
    names = list(values)
    zipped = F.arrays_zip(F.col(times).alias("t"), *[F.col(v).alias(n) for n, v in values.items()])
    long = df.select(key, F.inline(zipped))
    full = F.count(names[0]) >= least
    return long.groupBy(key, F.to_date(F.substring(F.col("t").cast("string"), 1, 10)).alias("day")).agg(*[F.when(full, F.avg(n)).alias(n) for n in names], F.count(names[0]).alias("hours"))


def feed_lines(lines: DataFrame, hosts: list[str], theme: str) -> DataFrame:
    """Tab-separated feed records of listed hosts on a theme: url, host, stamp, title.

    A host counts by equality or as a suffix after a dot; records of fewer than 27 fields are left out.
    """
    f = F.split("value", "\t")
    rows = lines.filter(F.size(f) >= 27).select(f[1].alias("stamp"), F.lower(f[3]).alias("host"), f[4].alias("url"), f[7].alias("themes"), f[26].alias("extra"))
    mine = F.col("host").isin(hosts)
    for h in hosts:
        mine = mine | F.col("host").endswith(f".{h}")
    title = F.regexp_extract("extra", r"<PAGE_TITLE>(.*?)</PAGE_TITLE>", 1)
    return rows.filter(mine & F.rlike("themes", F.lit(theme))).select("url", "host", "stamp", unescape(title).alias("title"))


def unescape(x: Column) -> Column:
    """The five named entities and those of apostrophes and dashes as characters; the ampersand last."""
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&#8211;", "–"), ("&#8217;", "’"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(sign))
    return x


def feed_files(spark: SparkSession, start: str, end: str, stride: int = 1) -> DataFrame:
    """Stamps of quarter-hour files between two moments, every ``stride``-th."""
    q = spark.range(1).select(F.posexplode(F.expr(f"sequence(timestamp_ntz'{start}', timestamp_ntz'{end}', interval 15 minutes)")).alias("i", "t"))
    return q.filter(F.col("i") % stride == 0).select(F.date_format("t", "yyyyMMddHHmmss").alias("stamp"))


def census_counties(spark: SparkSession, paths) -> DataFrame:
    """County reference with bars: state, fips, name."""
    raw = spark.read.option("header", True).option("sep", "|").csv(paths)
    return raw.select(F.col("STATE").alias("state"), F.concat(F.lpad("STATEFP", 2, "0"), F.lpad("COUNTYFP", 3, "0")).alias("fips"), F.col("COUNTYNAME").alias("name"))


def populations(new: DataFrame, old: DataFrame) -> DataFrame:
    """fips, population: counties of the new estimate, and of the old one where the new lacks them. Both have SUMLEV, STATE, COUNTY, population."""
    one = lambda df: df.filter(F.col("SUMLEV").cast("int") == 50).select(F.concat(F.lpad("STATE", 2, "0"), F.lpad("COUNTY", 3, "0")).alias("fips"), F.col("population").cast("long"))
    n, o = one(new), one(old)
    return n.unionByName(o.join(n, "fips", "left_anti"))


def article_texts(spark: SparkSession, ids: DataFrame, folder: str) -> DataFrame:
    """article_id, body: the text file named after each id; a missing file is an empty body."""
    files = spark.read.text(f"{folder}/*.txt", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("article_id"), F.col("value").alias("body"))
    return ids.select("article_id").distinct().join(files, "article_id", "left").fillna("", ["body"])


def report_clusters(lines: DataFrame) -> DataFrame:
    """Cluster blocks of a scan report: report, cluster, ids, and a map of its 'Label....: value' fields.

    ``lines``: report, line_no, value. A cluster begins at a line '1.Location IDs included.: ...';
    lines without a label go on with the field before. Blocks are found by running sums.
    """
    from pyspark.sql import Window

    by = Window.partitionBy("report").orderBy("line_no")
    start = F.rlike("value", F.lit(r"^\s*\d+\.\s*Location IDs included"))
    field = F.rlike("value", F.lit(r"^\s*(?:\d+\.)?\s*[A-Za-z][A-Za-z /()\-]*\.+:"))
    numbered = lines.withColumns({"cluster": F.sum(start.cast("int")).over(by), "part": F.sum(field.cast("int")).over(by)}).filter("cluster > 0 and trim(value) <> ''")
    label = F.regexp_extract("value", r"^\s*(?:\d+\.)?\s*([A-Za-z][A-Za-z /()\-]*?)\.+:", 1)
    content = F.trim(F.when(field, F.regexp_replace("value", r"^\s*(?:\d+\.)?\s*[A-Za-z][A-Za-z /()\-]*\.+:\s*", "")).otherwise(F.col("value")))
    fields = numbered.groupBy("report", "cluster", "part").agg(F.max(F.when(field, F.trim(label))).alias("label"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", content.alias("c")))), lambda x: x["c"]), " ").alias("text"))
    whole = fields.filter("label is not null").groupBy("report", "cluster").agg(F.map_from_entries(F.collect_list(F.struct("label", "text"))).alias("fields"))
    ids = F.filter(F.split(F.coalesce(F.try_element_at("fields", F.lit("Location IDs included")), F.lit("")), r"[,\s]+"), lambda s: s != "")
    return whole.select("report", "cluster", ids.alias("ids"), "fields")


def case_lines(df: DataFrame, geo: str, cases: str, day: str) -> DataFrame:
    """Lines '<geo> <cases> <yyyy/MM/dd>' of positive counts, for a scan program's case file."""
    return df.filter(F.col(cases) > 0).select(F.concat_ws(" ", F.col(geo), F.col(cases).cast("long").cast("string"), F.date_format(day, "yyyy/MM/dd")).alias("value"))


def population_lines(df: DataFrame, geo: str, population: str, year: int) -> DataFrame:
    """Lines '<geo> <year> <population>', for a scan program's population file; unknown populations are left out."""
    return df.filter(F.col(population).isNotNull()).select(F.concat_ws(" ", F.col(geo), F.lit(str(year)), F.col(population).cast("long").cast("string")).alias("value"))


def coordinate_lines(df: DataFrame, geo: str, lat: str, lon: str) -> DataFrame:
    """Lines '<geo> <latitude> <longitude>', for a scan program's coordinates file."""
    return df.select(F.concat_ws(" ", F.col(geo), F.format_string("%.6f", F.col(lat).cast("double")), F.format_string("%.6f", F.col(lon).cast("double"))).alias("value"))


# Numbers of a scan program's probability models, and the keys of a session for space and time.
SCAN_MODELS = {"poisson": 0, "permutation": 2}
SCAN_KEYS = {
    "Input": ("CaseFile", "PrecisionCaseTimes", "StartDate", "EndDate", "PopulationFile", "CoordinatesFile", "UseGridFile", "CoordinatesType"),
    "Analysis": ("AnalysisType", "ModelType", "ScanAreas", "TimeAggregationUnits", "TimeAggregationLength"),
    "Output": ("ResultsFile", "MostLikelyClusterEachCentroidASCII", "CensusAreasReportedClustersASCII", "OutputShapefiles", "OutputGoogleEarthKML"),
    "Spatial Window": ("MaxSpatialSizeInPopulationAtRisk", "SpatialWindowShapeType"),
    "Temporal Window": ("MinimumTemporalClusterSize", "MaxTemporalSizeInterpretation", "MaxTemporalSize"),
    "Inference": ("MonteCarloReps",),
}


def scan_parameters(case_file: str, coordinates_file: str, results_file: str, start, end, model: str = "permutation", population_file: str = "", rounds: int = 999, spatial_pct: float = 10, temporal_pct: float = 50) -> str:
    """The session of a scan program: retrospective clusters of high rates in space and time, in blocks of weeks."""
    if model not in SCAN_MODELS:
        raise ValueError(f"model is one of {sorted(SCAN_MODELS)}, not {model!r}")
    if model == "poisson" and not population_file:
        raise ValueError("the Poisson model needs a population file")
    values = {
        "CaseFile": case_file, "PrecisionCaseTimes": 3, "StartDate": f"{start:%Y/%m/%d}", "EndDate": f"{end:%Y/%m/%d}", "PopulationFile": population_file, "CoordinatesFile": coordinates_file, "UseGridFile": "n", "CoordinatesType": 1,
        "AnalysisType": 3, "ModelType": SCAN_MODELS[model], "ScanAreas": 1, "TimeAggregationUnits": 3, "TimeAggregationLength": 7, "ResultsFile": results_file, "MostLikelyClusterEachCentroidASCII": "y",
        "CensusAreasReportedClustersASCII": "y", "OutputShapefiles": "n", "OutputGoogleEarthKML": "n", "MaxSpatialSizeInPopulationAtRisk": f"{spatial_pct:g}", "SpatialWindowShapeType": 0, "MinimumTemporalClusterSize": 1,
        "MaxTemporalSizeInterpretation": 0, "MaxTemporalSize": f"{temporal_pct:g}", "MonteCarloReps": rounds,
    }
    return "\n".join(f"[{section}]\n" + "".join(f"{k}={values[k]}\n" for k in keys) for section, keys in SCAN_KEYS.items())


# Columns of a scan program's cluster file where it has no header.
COLUMN_FILE = ("CLUSTER", "LOC_ID", "LATITUDE", "LONGITUDE", "RADIUS", "START_DATE", "END_DATE", "NUMBER_LOC", "LLR", "P_VALUE", "OBSERVED", "EXPECTED", "ODE")


def column_file(spark: SparkSession, path: str) -> DataFrame:
    """A scan program's cluster file, fields apart by blanks, with or without a header: columns are numbers where every value is one.

    The widest line and the first one reach the driver; further columns are COL13 and on.
    """
    lines = spark.read.text(path).filter("trim(value) <> ''").withColumn("f", F.split(F.trim("value"), r"\s+"))
    first = lines.select("f").first()
    if first is None:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in COLUMN_FILE))
    header = not first["f"][0].lstrip("-").replace(".", "", 1).isdigit()
    body = lines.filter(F.col("f") != F.array(*[F.lit(x) for x in first["f"]])) if header else lines
    width = body.agg(F.max(F.size("f"))).first()[0] or len(first["f"])
    names = list(first["f"]) if header else [*COLUMN_FILE, *[f"COL{i}" for i in range(len(COLUMN_FILE), width)]][:width]
    texts = body.select(*[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)])
    bad = texts.agg(*[F.count_if(F.col(f"`{n}`").isNull() | F.col(f"`{n}`").try_cast("double").isNull()).alias(n) for n in names]).first().asDict()
    return texts.select(*[F.col(f"`{n}`").cast("double").alias(n) if not bad[n] else F.col(f"`{n}`") for n in names])


def weekly_means(days: DataFrame, key: str, day: str, values: list[str]) -> DataFrame:
    """Weekly means per key of daily records, with the days that had the first value."""
    return days.groupBy(key, week_end(day).alias("week_end")).agg(*[F.avg(v).alias(v) for v in values], F.count(values[0]).alias("days"))
