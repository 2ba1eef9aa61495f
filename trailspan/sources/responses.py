"""Landed responses of map, search and geocoding services, and failure logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import ELEMENTS, FAILURES, GEOCODE_RESPONSE, SEARCH_RESPONSE


def osm_elements(responses: DataFrame, json: str = "json", *keys: str) -> DataFrame:
    """One row per element of ``{"elements": [...]}`` texts, with its position."""
    fields = ELEMENTS.replace("type string", "type:string")
    schema = "elements array<struct<" + ", ".join(
        part if ":" in part.split(" ")[0] else part.replace(" ", ":", 1) for part in fields.split(", ")
    ) + ">>"
    parsed = responses.select(*keys, F.from_json(json, schema).alias("r"))
    return parsed.select(*keys, F.posexplode("r.elements").alias("pos", "e")).select(*keys, "pos", "e.*")


def read_osm(spark: SparkSession, path: str) -> DataFrame:
    """Elements of response files, one JSON document per file."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    return osm_elements(files, "value", "file")


def search_results(responses: DataFrame, json: str = "json", *keys: str) -> DataFrame:
    """One row per result; ``pos`` keeps the engine's order."""
    parsed = responses.select(*keys, F.from_json(json, SEARCH_RESPONSE).alias("r"))
    return parsed.select(*keys, F.posexplode("r.results").alias("pos", "s")).select(
        *keys, "pos", F.coalesce("s.title", F.lit("")).alias("title"), "s.url", "s.content",
        F.coalesce(T.blank_to_null(F.col("s.engine")), F.lit("unknown")).alias("engine"),
    )


def unresponsive_engines(responses: DataFrame, json: str = "json", *keys: str) -> DataFrame:
    """One row per engine that gave no answer, with the reason."""
    parsed = responses.select(*keys, F.from_json(json, SEARCH_RESPONSE).alias("r"))
    return parsed.select(*keys, F.posexplode("r.unresponsive_engines").alias("pos", "u")).select(
        *keys, "pos", F.get("u", F.lit(0)).alias("engine"), F.get("u", F.lit(1)).alias("reason")
    )


def geo_context(json: Column) -> Column:
    """Struct of locality, county, state, country and country code."""
    a = F.from_json(json, GEOCODE_RESPONSE)["address"]
    steps = ("city", "town", "village", "hamlet", "municipality", "county")
    return F.when(
        a.isNotNull(),
        F.struct(
            F.coalesce(*[T.blank_to_null(a[s]) for s in steps]).alias("locality"), a["county"].alias("county"),
            a["state"].alias("state"), a["country"].alias("country"), F.lower(a["country_code"]).alias("country_code"),
        ),
    )


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """Failure log, one JSON object per line."""
    return spark.read.schema(FAILURES).json(path)


_BROKEN = "_broken"


def read_failures_stream(spark: SparkSession, path: str) -> DataFrame:
    """The failure log as a stream over a folder: its columns, and ``_broken`` with the text of lines that don't fit."""
    return spark.readStream.schema(f"{FAILURES}, {_BROKEN} string").option("columnNameOfCorruptRecord", _BROKEN).json(path)


def sound_failures(stream: DataFrame) -> DataFrame:
    """Rows of whole lines."""
    return stream.filter(F.col(_BROKEN).isNull()).drop(_BROKEN)


def rescued_failures(stream: DataFrame) -> DataFrame:
    """What can be read of lines that don't fit: each field that has its type, and the line itself as ``line``.

    A line that is no JSON object gives nulls alone.
    """
    fields = [f.strip().rsplit(" ", 1) for f in FAILURES.split(",")]
    loose = F.from_json(_BROKEN, ", ".join(f"{name} string" for name, _ in fields))
    return stream.filter(F.col(_BROKEN).isNotNull()).select(
        *[F.coalesce(F.col(name), loose[name].try_cast(kind)).alias(name) for name, kind in fields], F.col(_BROKEN).alias("line"))


def parse_failures(lines: DataFrame, json: str = "value") -> DataFrame:
    return lines.select(F.from_json(json, FAILURES).alias("f")).filter("f IS NOT NULL").select("f.*")
