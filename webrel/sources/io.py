"""Sources and sinks.

All readers return DataFrames with fixed schemas; all writers are plain
DataFrameWriter calls (partitioned output instead of file-name slugs).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webrel.sources.store import SnapshotStore

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

RULE_SCHEMA = T.StructType([
    T.StructField("field", T.StringType()),
    T.StructField("selector", T.StringType()),
    T.StructField("multiple", T.BooleanType()),
    T.StructField("regex", T.StringType()),
    T.StructField("attr", T.StringType()),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_pages(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Captured pages ``(page_id, url, html)`` from parquet (batch or stream)."""
    if stream:
        schema = "page_id BIGINT, url STRING, html STRING"
        return spark.readStream.schema(schema).parquet(path)
    return spark.read.parquet(path)


def read_rules(spark: SparkSession, path: str, profile: str | None = None) -> DataFrame:
    """Rule profiles below ``path``: ``NAME.json`` with a JSON array of rules, or
    a folder ``profile=NAME`` as ``write_rules`` leaves it.  A file that does not
    parse gives one row whose rule columns are null (see S03).  ``profile``: only
    that one; it is an error if there is none of that name."""
    files = (spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(path)
             .select("value", F.col("_metadata.file_path").alias("file")))
    folder = F.url_decode(F.regexp_extract("file", r"profile=([^/]+)/[^/]*$", 1))
    name = F.when(folder != "", folder).otherwise(F.url_decode(F.regexp_extract("file", r"([^/]+?)(?:\.json)?$", 1)))
    rules = F.from_json("value", T.ArrayType(RULE_SCHEMA))
    out = files.select(name.alias("profile"), F.explode_outer(rules).alias("rule"), F.when(rules.isNull(), F.col("value")).alias("_corrupt_record"))
    out = out.select("rule.*", "_corrupt_record", "profile")
    if profile is None:
        return out
    out = out.where(F.col("profile") == profile)
    if out.isEmpty():
        raise ValueError(f"no rule profile {profile!r} below {path}")
    return out


def write_rules(rules: DataFrame, path: str) -> None:
    """Save rules, one JSON array per profile in a folder ``profile=NAME``."""
    rule = F.struct(*[F.col(f.name) for f in RULE_SCHEMA.fields])
    numbered = rules.select("profile", F.struct(F.monotonically_increasing_id().alias("k"), rule.alias("rule")).alias("r"))
    arrays = numbered.groupBy("profile").agg(F.to_json(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["rule"])).alias("value"))
    arrays.write.mode("overwrite").partitionBy("profile").text(path)   # a profile is configuration: a few rules


def profile_summary(rules: DataFrame) -> DataFrame:
    """Per profile, number of rules; '?' for a profile that did not parse."""
    bad = F.max(F.col("_corrupt_record").isNotNull().cast("int")) if "_corrupt_record" in rules.columns else F.lit(0)
    return rules.groupBy("profile").agg(
        F.when(bad == 1, F.lit("?")).otherwise(F.count("field").cast("string")).alias("rules"))


CAPTURE_SCHEMAS = {
    "requests": "event_id BIGINT, ts TIMESTAMP, page_url STRING, method STRING, url STRING, "
                "resource_type STRING, headers MAP<STRING,STRING>, post_data STRING",
    "responses": "event_id BIGINT, url STRING, status INT, content_type STRING, body STRING",
    "ws_messages": "url STRING, ts TIMESTAMP, data STRING",
    "cookies": "name STRING, domain STRING, value STRING",
}


def read_capture_log(spark: SparkSession, path: str, kind: str, stream: bool = False) -> DataFrame:
    """Request / response / websocket / cookie records (JSON lines)."""
    r = (spark.readStream if stream else spark.read).schema(CAPTURE_SCHEMAS[kind])
    return r.json(path)


def _lines(spark: SparkSession, path: str, stream: bool) -> DataFrame:
    """Lines with any text, and the file they stand in."""
    lines = (spark.readStream if stream else spark.read).text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file")).filter(F.trim("value") != "")


def _quarantined(rows: DataFrame) -> DataFrame:
    return rows.filter("reason is not null").select("file", "reason", F.col("value").alias("record"))


def read_capture_log_checked(spark: SparkSession, path: str, kind: str, stream: bool = False) -> tuple[DataFrame, DataFrame]:
    """S04 with quarantine: (the records that can be read whole, ``file, reason, record`` of the
    others).  A line is in exactly one of the two, blank lines are in none."""
    schema = f"{CAPTURE_SCHEMAS[kind]}, _corrupt STRING"
    value = F.try_parse_json("value")
    rows = _lines(spark, path, stream).withColumn("r", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_corrupt"}))
    reason = (F.when(value.isNull(), F.lit("no JSON")).when(F.try_variant_get(value, "$", "map<string,variant>").isNull(), F.lit("no object"))
              .when(F.col("r._corrupt").isNotNull(), F.lit("a field of another type")))
    rows = rows.withColumn("reason", reason)
    return rows.filter("reason is null").select("r.*").drop("_corrupt"), _quarantined(rows)


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """One raw JSON payload per line -> ``payload`` VARIANT (tolerant)."""
    return spark.read.text(path).select(F.try_parse_json("value").alias("payload"))


def read_entities_checked(spark: SparkSession, path: str, stream: bool = False) -> tuple[DataFrame, DataFrame]:
    """S05 with quarantine: (``payload`` of the lines that are JSON objects or lists, the others as S04)."""
    v = F.try_parse_json("value")
    nested = F.coalesce(F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), F.lit(False)) | F.try_variant_get(v, "$", "array<variant>").isNotNull()
    rows = _lines(spark, path, stream).withColumn("payload", v)
    rows = rows.withColumn("reason", F.when(v.isNull(), F.lit("no JSON")).when(~nested, F.lit("no object or list")))
    return rows.filter("reason is null").select("payload"), _quarantined(rows)


def _flat(df: DataFrame) -> DataFrame:
    """Nested values become JSON text."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        elif f.dataType.typeName() == "variant":
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """UTF-8 JSON lines (non-ASCII and null fields kept)."""
    w = df.write.mode(mode).option("ignoreNullFields", "false")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON array per part file.  Every file is opened and closed by its own
    first and last row, so the arrays are written in parallel and no row is moved."""
    row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})

    def array(rows):
        first = True
        for batch in rows:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array([("[" if first else ",") + text.as_py()], pa.string())], ["value"])
                first = False
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"], pa.string())], ["value"])

    df.select(row.alias("value")).mapInArrow(array, "value string").write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header, nested values as JSON text; schema is fixed (Q14)."""
    _flat(df).write.mode(mode).option("header", True).csv(path)


def write_all(df: DataFrame, path: str, fmt: str = "all") -> list[str]:
    """``all`` = json + jsonl + csv; unknown format writes nothing."""
    written = []
    targets = {"json": ["json"], "jsonl": ["jsonl"], "csv": ["csv"], "all": ["json", "jsonl", "csv"]}.get(fmt, [])
    if len(targets) > 1:
        df = df.persist()
    for t in targets:
        out = f"{path.rstrip('/')}/{t}"
        {"csv": write_csv, "json": write_json, "jsonl": write_jsonl}[t](df, out)
        written.append(out)
    if len(targets) > 1:
        df.unpersist()
    return written


def output_slug(url: Column, ts: Column) -> Column:
    """Host without ``www.``, dots -> ``_``, plus ``_YYYYmmdd_HHMMSS``."""
    host = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"\.", "_")
    return F.concat(host, F.lit("_"), F.date_format(ts, "yyyyMMdd_HHmmss"))


def append_snapshot(records: DataFrame, path: str, batch: str | None = None) -> None:
    """Add snapshot records to the store at ``path`` as one generation."""
    SnapshotStore(records.sparkSession, path).append(records, batch)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame | None:
    """All snapshots of the store's newest generation (None: no store yet)."""
    return SnapshotStore(spark, path).history()
