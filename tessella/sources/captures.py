"""Captured pages, files by extension, data URIs, result pages as JSON, and the cookie file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Content types by file extension.
CONTENT_TYPES = {
    "html": "text/html", "htm": "text/html", "js": "application/javascript", "mjs": "application/javascript", "css": "text/css", "json": "application/json",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "txt": "text/plain", "xml": "application/xml",
}


def spread(table: DataFrame) -> DataFrame:
    """A scan with fewer partitions than cores, dealt out evenly, as readers never split a row group; others stay as they are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/pages.parquet"))


def content_type(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in CONTENT_TYPES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit("application/octet-stream"))


def read_files(spark: SparkSession, paths: str) -> DataFrame:
    """path, content_type and body of files."""
    return spark.read.format("binaryFile").load(paths).select("path", content_type(F.col("path")).alias("content_type"), F.col("content").alias("body"))


def about_pages(urls: DataFrame, url: str = "url") -> DataFrame:
    """url, content_type and html of about: addresses: each is a blank page."""
    return urls.where(F.startswith(F.lower(url), F.lit("about:"))).select(F.col(url).alias("url"), F.lit("text/html").alias("content_type"), F.lit("<html><head></head><body></body></html>").alias("html"))


def data_uri(uri: Column) -> tuple[Column, Column]:
    """Content type and body of a data: URI; the body is null where it can't be decoded."""
    head = F.regexp_extract(uri, r"(?s)^data:([^,]*),", 1)
    payload = F.regexp_replace(uri, r"(?s)^data:[^,]*,", "")
    plain = F.to_binary(F.try_url_decode(F.replace(payload, F.lit("+"), F.lit("%2B"))), F.lit("utf-8"))
    coded = F.try_to_binary(F.regexp_replace(payload, r"\s", ""), F.lit("base64"))
    is_data = F.startswith(uri, F.lit("data:")) & F.contains(uri, F.lit(","))
    kind = F.regexp_replace(head, r";base64$", "")
    return F.when(is_data, F.when(kind == "", "text/plain").otherwise(kind)), F.when(is_data, F.when(F.endswith(head, F.lit(";base64")), coded).otherwise(plain))


def result_json(results: DataFrame, json_col: str, path: str, fields: dict[str, str], engine: str) -> DataFrame:
    """Rows of a result page in JSON, a row for each entry: pos, score (entries left, this one too) and fields."""
    entry = ", ".join(f"{k}: STRING" for k in fields.values())
    array = F.from_json(F.get_json_object(json_col, f"$.{path}"), f"ARRAY<STRUCT<{entry}>>")
    keep = [c for c in results.columns if c != json_col]
    rows = results.select(*keep, F.size(array).alias("__n"), F.posexplode(array).alias("pos", "__entry"))
    return rows.select(*keep, F.lit(engine).alias("engine"), "pos", (F.col("__n") - F.col("pos")).cast("double").alias("score"), *(F.col(f"__entry.{v}").alias(k) for k, v in fields.items()))


def write_cookies(jar: DataFrame, path: str, as_of: Column) -> None:
    """The jar as JSON lines, without what has expired."""
    jar.where(F.col("expires").isNull() | (F.col("expires") > as_of)).write.mode("overwrite").json(path)


def read_cookies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("domain string, name string, path string, value string, host_only boolean, secure boolean, http_only boolean, expires bigint, same_site string").json(path)
