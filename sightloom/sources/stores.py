"""Segment stores, view files and query sets: reading and writing through Spark's own readers and writers."""

from __future__ import annotations

import ast
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Caption fields by precedence.
CAPTION_FIELDS = ("fine_caption_15f", "caption_15f", "visual_description_15f", "fine_caption", "caption")
_SEGMENT = "struct<time:string,transcript:string,asr:string,content:string,frame_times:array<double>," + ",".join(f"{c}:string" for c in CAPTION_FIELDS) + ">"


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """video, idx, time, caption, transcript and frame_times of a store {video: {idx: segment}}, one JSON document a file."""
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,map<string,{_SEGMENT}>>").alias("m"))
    rows = docs.select(F.explode("m").alias("video", "s")).select("video", F.explode("s").alias("idx", "x"))
    some = lambda c: F.when(F.trim(F.col(f"x.{c}")) != "", F.trim(F.col(f"x.{c}")))
    content = F.coalesce(F.col("x.content"), F.lit(""))
    inside = lambda pattern: F.nullif(F.trim(F.regexp_extract(content, pattern, 1)), F.lit(""))
    caption = F.coalesce(*map(some, CAPTION_FIELDS), inside(r"(?is)Caption:\s*(.*?)\s*Transcript:"), F.lit(""))
    said = F.coalesce(some("transcript"), some("asr"), inside(r"(?is)Transcript:\s*(.*)$"), F.lit(""))
    return rows.select("video", "idx", F.col("x.time").alias("time"), caption.alias("caption"), said.alias("transcript"), "x.frame_times")


def read_rows(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON lines file with a declared schema; a missing one has no rows, a broken line is an error."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_index(views: dict[str, DataFrame], path: str) -> None:
    """Views as Parquet below path, each clustered by video so that a filter on videos skips files."""
    for name, df in views.items():
        rows = df.repartition("video").sortWithinPartitions("video") if "video" in df.columns else df
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def read_view(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def export_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


# --- query sets: small files, read on the driver
#: Other names of a query's fields, by precedence.
ALIASES = {
    "query_id": ("query_id", "id", "qid", "question_id"),
    "query": ("query", "question", "query_text", "text"),
    "video_id": ("video_id", "video", "video_name", "vid"),
    "dataset": ("dataset", "dataset_name"),
}
CONTAINERS = ("queries", "data", "items", "records", "questions")
_LINE = re.compile(r"^\s*(?:q?(\d{1,4})\s*[).:-]\s*)?(.+?)\s*$", re.I)


def parse_queries(text: str, dataset: str = "", *, name: str = "") -> list[dict]:
    """Queries of a file's text: JSON (a list, or a list in a container), a Python literal, JSON lines, or numbered lines."""
    text = text.lstrip("﻿")
    rows: list | None = None
    for load in (json.loads, ast.literal_eval, lambda s: [json.loads(x) for x in s.splitlines() if x.strip()]):
        try:
            found = load(text)
        except (ValueError, SyntaxError):
            continue
        if isinstance(found, dict):
            found = next((found[k] for k in CONTAINERS if isinstance(found.get(k), list)), [found])
        if isinstance(found, list):
            rows = found
            break
    if rows is None:
        rows = [{"query_id": m[1] and f"q{m[1]}", "query": m[2]} for line in text.splitlines() if line.strip() and (m := _LINE.match(line))]
    out = []
    for k, row in enumerate(rows, 1):
        row = row if isinstance(row, dict) else {"query": str(row)}
        first = {field: next((str(row[a]) for a in names if row.get(a) not in (None, "")), "") for field, names in ALIASES.items()}
        first["dataset"] = first["dataset"] or dataset
        known = {a for names in ALIASES.values() for a in names}
        first["query_id"] = first["query_id"] or f"{(first['dataset'] or name or 'query').lower()}_{k:03d}"
        meta = row.get("metadata") if isinstance(row.get("metadata"), dict) else {}
        extra = {k2: json.dumps(v) if not isinstance(v, str) else v for k2, v in {**meta, **{a: b for a, b in row.items() if a not in known and a != "metadata"}}.items() if v is not None}
        out.append({**first, "metadata": extra})
    return out


def query_frame(spark: SparkSession, queries: list[dict]) -> DataFrame:
    return spark.createDataFrame(queries, "query_id string, dataset string, video_id string, query string, metadata map<string,string>")
