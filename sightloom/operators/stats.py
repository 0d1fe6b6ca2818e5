"""Statistics of views for the planner, text chunks, and checks of query sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightloom.functions import text as T


def label_counts(rows: DataFrame, col: str, order: str) -> DataFrame:
    """Values by count, ties by first appearance."""
    return rows.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first")


def view_stats(rows: DataFrame, *, text: str | None = None, tokens: str | None = None, count_cols: tuple[str, ...] = ()) -> DataFrame:
    """One row: row_count, mean tokens, mean duration, and counts of the values of count_cols as maps.

    tokens, where given, is a column that holds the number of tokens of each text.
    """
    n = F.col(tokens) if tokens else F.size(T.tokenize(F.col(text))) if text else F.lit(None)
    tokens = F.avg(n.cast("double"))
    span = F.avg(F.greatest(F.lit(0.0), F.col("end_time") - F.col("start_time"))) if {"start_time", "end_time"} <= set(rows.columns) else F.lit(None).cast("double")
    out = rows.agg(F.count("*").alias("row_count"), F.coalesce(tokens, F.lit(0.0)).alias("avg_text_tokens"), F.coalesce(span, F.lit(0.0)).alias("avg_duration"))
    for c in count_cols:
        values = rows.select(F.explode(c).alias(c)) if dict(rows.dtypes)[c].startswith("array") else rows.select(c)
        m = values.filter(F.col(c).isNotNull()).groupBy(c).count().agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(c), "count")))).alias(f"{c}_counts"))
        out = out.join(m)
    return out


def chunks(segments: DataFrame, most: int = 1200) -> DataFrame:
    """Texts of a video's segments packed in order into chunks of at most `most` words; a longer text is cut.

    segments: video, segment_id, ord, text. A chunk's fill depends on those before: a fold over a video's segments.
    """
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\S+"), F.lit(0))
    rows = segments.select("video", "segment_id", "ord", F.when(F.size(words) > most, F.array_join(F.slice(words, 1, most), " ")).otherwise(F.coalesce("text", F.lit(""))).alias("t"), F.least(F.size(words), F.lit(most)).alias("n"))
    xs = rows.groupBy("video").agg(F.array_sort(F.collect_list(F.struct("ord", "segment_id", "t", "n"))).alias("xs"))
    start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("used"), F.expr("cast(array() as array<int>)").alias("at"))

    def step(acc, x):
        new = (F.size(acc["at"]) > 0) & (acc["used"] + x["n"] > most)
        k = acc["k"] + new.cast("int")
        return F.struct(k.alias("k"), F.when(new, x["n"]).otherwise(acc["used"] + x["n"]).alias("used"), F.concat(acc["at"], F.array(k)).alias("at"))

    placed = xs.select("video", F.explode(F.arrays_zip("xs", F.aggregate("xs", start, step, lambda acc: acc["at"]).alias("k"))).alias("z"))
    placed = placed.select("video", F.col("z.k").alias("k"), F.col("z.xs").alias("x"))
    out = placed.groupBy("video", "k").agg(F.array_sort(F.collect_list("x")).alias("xs"), F.sum("x.n").alias("tokens"))
    content = F.trim(F.array_join(F.filter(F.transform("xs", lambda x: x["t"]), lambda t: t != ""), "\n"))
    out = out.withColumn("content", content).filter("content <> ''")
    return out.select("video", (F.row_number().over(Window.partitionBy("video").orderBy("k")) - 1).alias("chunk_order_index"), F.concat(F.lit("chunk-"), F.md5("content")).alias("chunk_id"), "tokens", "content", F.transform("xs", lambda x: x["segment_id"]).alias("segment_ids"))


def query_errors(queries: DataFrame) -> DataFrame:
    """Rule and number of violations over a query set (query_id, dataset, video_id, query)."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    one = queries.agg(F.count_if(blank("query_id")).alias("missing_query_id"), F.count_if(blank("dataset")).alias("missing_dataset"), F.count_if(blank("query")).alias("missing_query"), F.count_if(blank("video_id")).alias("missing_video_id"), (F.count("query_id") - F.count_distinct("query_id")).alias("duplicate_query_id"))
    return one.selectExpr("stack(5, 'missing_query_id', missing_query_id, 'missing_dataset', missing_dataset, 'missing_query', missing_query, 'missing_video_id', missing_video_id, 'duplicate_query_id', duplicate_query_id) as (rule, violations)").filter("violations > 0")


def exact_match(predicted: str, expected: str):
    """1.0 where both are the same but for case and outer white space."""
    return (F.lower(F.trim(predicted)) == F.lower(F.trim(expected))).cast("double")
