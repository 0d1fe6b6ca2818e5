"""Adaptive events: change between neighbouring segments, boundaries by a fold over each video, and roll-up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightloom import lexicons as L
from sightloom.functions import geometry as G
from sightloom.functions import text as T

SIGNALS = tuple(L.SIGNAL_WEIGHTS)


@dataclass(frozen=True)
class Config:
    min_seconds: float = L.MIN_SECONDS
    max_seconds: float = L.MAX_SECONDS
    threshold: float = L.CHANGE_THRESHOLD
    merge_gap: float = L.MERGE_GAP


def timeline(scope: DataFrame, target: DataFrame, track: DataFrame, relation: DataFrame | None = None) -> DataFrame:
    """One point per segment: caption tokens, label counts, actions, and signatures of tracks and spatial relations.

    relation, where given: segment_id, relation_type, target_id, related_id. Each side is aggregated by segment before
    the joins, so that no join multiplies rows.
    """
    label = target.groupBy("segment_id", F.lower(F.trim("label")).alias("label")).agg(F.count("*").cast("int").alias("n"))
    counts = label.filter("label <> ''").groupBy("segment_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("object_counts"))
    sig = F.concat_ws(" ", *[F.when(c != "", c) for c in (F.lower(F.trim("label")), F.array_join("action_tags", " "), F.array_join("direction_keywords", " "), F.lower(F.trim("motion_summary")))])
    moves = track.select(F.explode("segment_ids").alias("segment_id"), sig.alias("sig"), "action_tags").groupBy("segment_id").agg(F.array_sort(F.collect_set("sig")).alias("track_signatures"), F.array_distinct(F.flatten(F.collect_list("action_tags"))).alias("track_actions"))
    points = scope.select("video", "segment_id", "ord", "start_time", "end_time", "caption", "text", "scene_tags", "tokens").join(counts, "segment_id", "left").join(moves, "segment_id", "left")
    none = F.array().cast("array<string>")
    if relation is not None:
        parts = F.concat_ws("|", *[F.when(F.trim(c) != "", F.trim(c)) for c in ("relation_type", "target_id", "related_id")])
        rel = relation.select("segment_id", parts.alias("r")).groupBy("segment_id").agg(F.array_sort(F.collect_set("r")).alias("relation_signatures"))
        points = points.join(rel, "segment_id", "left")
    else:
        points = points.withColumn("relation_signatures", none)
    said = F.when(F.col("caption") != "", F.col("caption")).otherwise(F.col("text"))
    own = T.action_tags(T.tokenize(F.col("text")), L.ACTION_HINTS)
    return points.select("video", "segment_id", "ord", "start_time", "end_time", "caption", "scene_tags", T.keywords(said).alias("caption_tokens"), F.coalesce("object_counts", F.create_map().cast("map<string,int>")).alias("object_counts"), F.array_sort(F.array_union(own, F.coalesce("track_actions", none))).alias("action_tags"), F.coalesce("track_signatures", none).alias("track_signatures"), F.coalesce("relation_signatures", none).alias("relation_signatures"))


def changes(points: DataFrame, config: Config = Config()) -> DataFrame:
    """points with signals (struct of five), change_score and dominant (at most three) against the point before."""
    w = Window.partitionBy("video").orderBy(F.col("start_time").asc_nulls_last(), "ord")
    names = ("caption_tokens", "object_counts", "action_tags", "track_signatures", "relation_signatures", "end_time")
    rows = points.withColumn("p", F.lag(F.struct(*names)).over(w))
    time = lambda c: F.coalesce(c, F.lit(0.0))
    gap = F.greatest(F.lit(0.0), time(F.col("start_time")) - time(F.col("p.end_time")))
    motion = lambda a, t: F.array_union(F.col(a), F.col(t))
    values = {
        "caption_change": G.set_distance(F.col("p.caption_tokens"), F.col("caption_tokens")),
        "object_distribution_change": G.histogram_distance(F.col("p.object_counts"), F.col("object_counts")),
        "track_motion_change": G.set_distance(motion("p.action_tags", "p.track_signatures"), motion("action_tags", "track_signatures")),
        "relation_change": G.set_distance(F.col("p.relation_signatures"), F.col("relation_signatures")),
        "time_gap_signal": F.least(F.lit(1.0), gap / max(config.merge_gap, 1.0)),
    }
    rows = rows.withColumn("raw", F.when(F.col("p").isNotNull(), F.struct(*[v.alias(k) for k, v in values.items()])))
    score = sum((L.SIGNAL_WEIGHTS[k] * F.col(f"raw.{k}") for k in SIGNALS), F.lit(0.0))
    ranked = F.array_sort(F.filter(F.array(*[F.struct((-F.col(f"raw.{k}")).alias("v"), F.lit(i).alias("i"), F.lit(k).alias("name")) for i, k in enumerate(SIGNALS)]), lambda s: s["v"] <= -0.15))
    dominant = F.transform(F.slice(ranked, 1, 3), lambda s: s["name"])
    signals = F.struct(*[F.round(F.col(f"raw.{k}"), 6).alias(k) for k in SIGNALS])
    return rows.withColumns({"change_score": F.round(score, 6), "signals": signals, "dominant": F.when(F.col("raw").isNotNull(), dominant), "time_gap": gap}).drop("p", "raw")


_EVENT = "struct<start:double,finish:double,reason:string,score:double,dominant:array<string>,first:int,last:int>"


def _events(config: Config) -> Column:
    """The windows of xs, an ordered array of points: cut where content changes or a window is long, then short ones merged.

    Both steps depend on the windows before, so they are folds over the array.
    """
    xs = F.col("xs")
    span = lambda w: F.greatest(F.lit(0.0), w["finish"] - w["start"])
    empty = F.expr(f"cast(array() as array<{_EVENT}>)")
    none = F.array().cast("array<string>")

    def window(a: Column, b: Column, reason: Column, score: Column, dominant: Column) -> Column:
        finish = F.array_max(F.transform(F.slice(xs, a + 1, b - a), lambda p: p["finish"]))
        return F.struct(F.get(xs, a)["start"].alias("start"), finish.alias("finish"), reason.alias("reason"), score.alias("score"), dominant.alias("dominant"), a.alias("first"), (b - 1).alias("last"))

    def cut(acc: Column, i: Column) -> Column:
        here = F.get(xs, i)
        so_far = F.greatest(F.lit(0.0), here["start"] - F.get(xs, acc["from"])["start"])
        long = so_far >= config.max_seconds
        split = long | ((F.coalesce(here["score"], F.lit(0.0)) >= config.threshold) & (so_far >= config.min_seconds))
        done = window(acc["from"], i, F.when(long, "max_duration").otherwise("content_change"), F.coalesce(here["score"], F.lit(0.0)), F.coalesce(here["dominant"], none))
        return F.struct(F.when(split, i).otherwise(acc["from"]).alias("from"), F.when(split, F.concat(acc["out"], F.array(done))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("from"), empty.alias("out"))
    rest = F.when(F.size(xs) > 1, F.sequence(F.lit(1), F.size(xs) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    windows = F.aggregate(rest, start, cut, lambda acc: F.concat(acc["out"], F.array(window(acc["from"], F.size(xs), F.lit("end_of_video"), F.lit(0.0), none))))

    def merge(acc: Column, w: Column) -> Column:
        last = F.element_at(acc, -1)
        gap = F.greatest(F.lit(0.0), w["start"] - last["finish"])
        join = (span(w) < config.min_seconds) | ((gap > 0) & (gap <= config.merge_gap) & (span(last) < config.min_seconds))
        both = F.struct(F.least(last["start"], w["start"]).alias("start"), F.greatest(last["finish"], w["finish"]).alias("finish"), F.concat(last["reason"], F.lit("+merged_short_event")).alias("reason"), F.greatest(last["score"], w["score"]).alias("score"), F.slice(F.array_union(last["dominant"], w["dominant"]), 1, 3).alias("dominant"), last["first"].alias("first"), w["last"].alias("last"))
        return F.when(F.size(acc) == 0, F.array(w)).when(join, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(both))).otherwise(F.concat(acc, F.array(w)))

    return F.aggregate(windows, empty, merge)


def adaptive_events(changed: DataFrame, config: Config = Config()) -> DataFrame:
    """One row per adaptive event of each video, with tags, label counts and segments. changed: changes()'s rows."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    point = F.struct(F.coalesce("start_time", F.lit(1e12)).alias("at"), "ord", zero("start_time").alias("start"), zero("end_time").alias("finish"), F.col("change_score").alias("score"), "dominant", "segment_id", "scene_tags", "action_tags", F.map_entries("object_counts").alias("objects"), "caption")
    videos = changed.groupBy("video").agg(F.array_sort(F.collect_list(point)).alias("xs"))
    rows = videos.select("video", "xs", F.posexplode(_events(config)).alias("k", "e"))
    part = F.slice("xs", F.col("e.first") + 1, F.col("e.last") - F.col("e.first") + 1)
    rows = rows.withColumn("ps", part)
    tags = lambda f: F.array_sort(F.array_distinct(F.flatten(F.transform("ps", lambda p: p[f]))))
    objects = F.aggregate(F.flatten(F.transform("ps", lambda p: p["objects"])), F.create_map().cast("map<string,int>"), lambda m, o: F.map_concat(F.map_filter(m, lambda k, v: k != o["key"]), F.create_map(o["key"], F.coalesce(F.element_at(m, o["key"]), F.lit(0)) + o["value"])))
    return rows.select(
        F.concat_ws(":", F.lit("adaptive_event"), T.slug(F.col("video")), (F.col("k") + 1).cast("string")).alias("id"),
        "video",
        (F.col("k") + 1).alias("ordinal"),
        F.col("e.start").alias("start_time"),
        F.col("e.finish").alias("end_time"),
        F.greatest(F.lit(0.0), F.col("e.finish") - F.col("e.start")).alias("duration"),
        F.col("e.reason").alias("boundary_reason"),
        F.round("e.score", 6).alias("change_score"),
        F.col("e.dominant").alias("dominant_signals"),
        tags("scene_tags").alias("scene_tags"),
        tags("action_tags").alias("action_tags"),
        objects.alias("object_counts"),
        F.array_distinct(F.transform("ps", lambda p: p["segment_id"])).alias("related_segment_ids"),
        F.array_join(F.transform(F.slice("ps", 1, 2), lambda p: T.shorten(p["caption"], 160)), " ").alias("sample"),
    )


def statistics(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("row_count"), F.coalesce(F.avg("duration"), F.lit(0.0)).alias("avg_duration"), F.coalesce(F.avg("change_score"), F.lit(0.0)).alias("avg_change_score"))
