"""Sources: delimited files, archives, map and search answers, byte bodies, and checks of what was read."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.selection import first_wins

#: Columns of the city and postal code files, in their order.
CITY_FIELDS = "geonameid name asciiname alternatenames latitude longitude feature_class feature_code country cc2 admin1 admin2 admin3 admin4 population elevation dem timezone modified".split()
POSTAL_FIELDS = "country postal_code place admin1_name admin1 admin2_name admin2 admin3_name admin3 latitude longitude accuracy".split()


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """RFC 4180: quoted fields may hold separators, doubled quotes and line breaks. Gzip files are read by their name."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')


def read_register(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """A register of organizations by column names, whatever their order: ``ein`` (9 digits), name, city, state, subsection (2 digits), sort_name; and the rows that were skipped.

    A number that comes again counts once, the first file and row first; header lines inside the files are skipped.
    """
    raw = None
    for i, path in enumerate(paths):
        part = read_csv(spark, path).select("EIN", "NAME", "CITY", "STATE", "SUBSECTION", "SORT_NAME").withColumn("file", F.lit(i)).withColumn("row", F.monotonically_increasing_id())
        raw = part if raw is None else raw.unionByName(part)
    trimmed = raw.select("file", "row", *(F.trim(c).alias(c.lower()) for c in ("EIN", "NAME", "CITY", "STATE", "SUBSECTION", "SORT_NAME")))
    good = F.coalesce(F.col("ein").rlike(r"^\d{1,9}$") & (F.col("name") != ""), F.lit(False))
    rows = trimmed.where(good).select("file", "row", F.lpad("ein", 9, "0").alias("ein"), "name", "city", F.upper("state").alias("state"), F.lpad("subsection", 2, "0").alias("subsection"), F.when(F.col("sort_name") != "", F.col("sort_name")).alias("sort_name"))
    return first_wins(rows, ["ein"], ["file", "row"]).drop("file", "row"), trimmed.where(~good)


def read_cities(spark: SparkSession, path: str, states: list[str] | None = None) -> DataFrame:
    """City rows with a place and a state; of one state and name the most populous."""
    raw = spark.read.csv(path, sep="\t", quote="", schema=", ".join(f"{c} string" for c in CITY_FIELDS))
    rows = raw.select("name", F.col("admin1").alias("state"), F.col("latitude").try_cast("double").alias("lat"), F.col("longitude").try_cast("double").alias("lng"), F.coalesce(F.col("population").try_cast("long"), F.lit(0)).alias("population"), F.col("timezone").alias("time_zone"))
    rows = rows.where("lat between -90 and 90 and lng between -180 and 180 and name <> '' and state <> ''")
    if states is not None:
        rows = rows.where(F.col("state").isin(*states))
    return first_wins(rows, ["state", "name"], [F.col("population").desc(), "lat", "lng"])


def read_postal_codes(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, sep="\t", quote="", schema=", ".join(f"{c} string" for c in POSTAL_FIELDS))
    rows = raw.select(F.col("postal_code").alias("zip"), F.col("place").alias("city"), F.col("admin1").alias("state"), F.col("latitude").try_cast("double").alias("lat"), F.col("longitude").try_cast("double").alias("lng"))
    return first_wins(rows.where("zip rlike '^[0-9]{5}$' and lat is not null and lng is not null"), ["zip"], ["city", "lat", "lng"])


def map_features(answers: DataFrame, column: str = "json") -> DataFrame:
    """Features of map answers: ``ref``, ``lat``, ``lng``, ``tags``; the centre, else the node's own place; those without one go."""
    element = "struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>"
    e = answers.select(F.explode(F.from_json(column, f"struct<elements:array<{element}>>")["elements"]).alias("e"))
    out = e.select(F.concat_ws("/", "e.type", F.col("e.id").cast("string")).alias("ref"), F.coalesce("e.center.lat", "e.lat").alias("lat"), F.coalesce("e.center.lon", "e.lon").alias("lng"), F.coalesce("e.tags", F.create_map().cast("map<string,string>")).alias("tags"))
    return out.where("lat is not null and lng is not null")


def search_results(answers: DataFrame, column: str = "json") -> DataFrame:
    """Organic results of search answers: ``query``, ``rank``, ``url``, ``title``, ``description``."""
    item = "struct<type:string,rank_group:int,url:string,title:string,description:string>"
    tasks = answers.select("query", F.explode(F.from_json(column, f"struct<tasks:array<struct<result:array<struct<items:array<{item}>>>>>>")["tasks"]).alias("t"))
    items = tasks.select("query", F.explode("t.result").alias("r")).select("query", F.explode("r.items").alias("i"))
    return items.where("i.type = 'organic' and i.url is not null").select("query", F.col("i.rank_group").alias("rank"), "i.url", "i.title", "i.description")


def zip_entries(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Entries of zip archives: ``path``, ``entry``, ``content``. An archive is read by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                with zipfile.ZipFile(io.BytesIO(row.content)) as archive:
                    for name in archive.namelist():
                        if name.endswith(suffix):
                            yield pd.DataFrame({"path": [row.path], "entry": [name], "content": [archive.read(name)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, entry string, content binary")


#: Bytes 128 to 159, which ISO-8859-1 reads as control characters, in windows-1252, which browsers take for both names.
_CONTROLS = "".join(chr(c) for c in range(0x80, 0xA0) if bytes([c]).decode("cp1252", "ignore"))
_WINDOWS = "".join(bytes([ord(c)]).decode("cp1252") for c in _CONTROLS)


def decoded_body(body: Column, content_type: Column) -> Column:
    """Text of a body by the charset of its header, else of a <meta> in its first 2 KB, else UTF-8. ISO-8859-1 is read as windows-1252, as browsers do; charsets that Spark does not know are read as UTF-8."""
    head = F.decode(F.substring(body, 1, 2048), "ISO-8859-1")
    named = F.upper(F.coalesce(F.nullif(F.regexp_extract(content_type, r"(?i)charset=[\"']?([\w-]+)", 1), F.lit("")), F.regexp_extract(head, r"(?i)<meta[^>]+charset=[\"']?([\w-]+)", 1)))
    return F.when(named.isin("ISO-8859-1", "LATIN1", "WINDOWS-1252"), F.translate(F.decode(body, "ISO-8859-1"), _CONTROLS, _WINDOWS)).when(named == "UTF-16", F.decode(body, "UTF-16")).otherwise(F.decode(body, "UTF-8"))


def split_valid(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all checks, and the others with ``problem``, the first check that failed."""
    problem = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()))
    marked = df.withColumn("problem", problem)
    return marked.where("problem is null").drop("problem"), marked.where("problem is not null")


def newest_month(months: list[str], current: str) -> str | None:
    """The snapshot to use: this month's, else the newest older one."""
    return max((m for m in months if m <= current), default=None)


#: Override files and the lists that each may hold; entries are texts or maps of texts.
OVERRIDE_LISTS = {
    "course-types": ["overrides"], "exclusions": ["domains", "url_patterns"], "removals": ["outing_ids", "urls"], "notable-courses": ["courses"], "series": ["series"],
    "access-operators": ["domains"], "tournament-operators": ["domains"], "js-platforms": ["hosts"], "registration-hosts": ["hosts"], "platforms": ["platforms"],
}


def read_overrides(spark: SparkSession, folder: str) -> DataFrame:
    """Hand-kept YAML lists as rows: ``file``, ``list``, ``ord``, ``entry`` (map of texts; a plain text under "value").

    The files are configuration, read whole by the driver as their authors' editors do. An unknown file or list, an entry that is no text or map, and a platform that is
    allowed without the day on which its terms were read (``terms_checked``) are errors that name the place. An empty list gives no rows.
    """
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading override files takes the package yaml") from e
    rows = []
    for path, text in spark.read.text(f"{folder.rstrip('/')}/*.yaml", wholetext=True).select("_metadata.file_name", "value").collect():
        name = path.removesuffix(".yaml")
        if name not in OVERRIDE_LISTS:
            raise ValueError(f"{path}: no such override file")
        for key, entries in (yaml.safe_load(text) or {}).items():
            if key not in OVERRIDE_LISTS[name] or not isinstance(entries or [], list):
                raise ValueError(f"{path}: {key} is none of its lists")
            for i, entry in enumerate(entries or []):
                found = entry if isinstance(entry, dict) else {"value": entry}
                if any(isinstance(v, (list, dict)) or v is None for v in found.values()):
                    raise ValueError(f"{path}: entry {i + 1} of {key} is neither a text nor a map of texts")
                if name == "platforms" and found.get("allowed") is True and not found.get("terms_checked"):
                    raise ValueError(f"{path}: entry {i + 1} is allowed, but its terms were not read")
                rows.append((name, key, i, {str(k): str(v).lower() if isinstance(v, bool) else str(v) for k, v in found.items()}))
    return spark.createDataFrame(rows, "file string, list string, ord int, entry map<string,string>")
