"""Scope, target, track and event views of captioned segments, and their evidence graph.

Every operator maps DataFrames to DataFrames; a video's rows meet by key, never on the driver. Segments have the columns
video, idx (text), time (text like 0-5), caption and transcript.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightloom import lexicons as L
from sightloom.functions import text as T


def segment_order() -> list[Column]:
    """Numeric indexes by number, others after them by text."""
    n = F.when(F.col("idx").rlike(r"^[+-]?[0-9]+$"), F.col("idx").cast("long"))
    return [F.coalesce(n, F.lit(10**9)), F.col("idx")]


def scopes(segments: DataFrame) -> DataFrame:
    """One row per segment: ids, times, text, tokens and scene tags. ord is the segment's place in its video."""
    caption, transcript = F.trim(F.coalesce("caption", F.lit(""))), F.trim(F.coalesce("transcript", F.lit("")))
    rows = segments.select("video", "idx", T.time_range(F.col("time")).alias("t"), caption.alias("caption"), transcript.alias("transcript"))
    rows = rows.withColumn("text", T.unified_text(F.col("caption"), F.col("transcript")))
    sid = F.concat_ws("_", "video", "idx")
    return rows.select(
        F.concat(F.lit("scope:"), sid).alias("id"),
        F.concat(F.lit("segment:"), sid).alias("node_id"),
        "video",
        sid.alias("segment_id"),
        "idx",
        F.row_number().over(Window.partitionBy("video").orderBy(*segment_order())).alias("ord"),
        F.col("t.start").alias("start_time"),
        F.col("t.end").alias("end_time"),
        T.scene_tags(F.col("text")).alias("scene_tags"),
        "caption",
        "transcript",
        "text",
        T.tokenize(F.col("text")).alias("tokens"),
    )


#: Labels that are no objects, as normalized words.
BLOCKED = frozenset(T.singular(w) for w in L.ACTION_TERMS | L.MOTION_KEYWORDS | L.STATE_KEYWORDS | L.DIRECTION_KEYWORDS | L.FUNCTION_WORDS | L.MONTHS | L.ABSTRACT_WORDS | L.COLOR_TERMS | L.DETERMINERS | L.DESCRIPTORS | L.GENERIC_BLACKLIST | L.OTHER_NON_OBJECTS)
ANCHORS = frozenset(T.singular(w) for w in L.ACTION_TERMS | L.MOTION_KEYWORDS | L.STATE_KEYWORDS | L.DIRECTION_KEYWORDS | L.POSITION_TERMS | L.QUANTITY_TERMS | L.ATTRIBUTE_TERMS)
DOMAIN_LABELS = {d: frozenset(map(T.singular, t)) for d, t in L.DOMAIN_TARGETS.items()}


def _domains() -> Column:
    """The domains of a text: its scene tags, and those with a trigger in it."""
    hits = F.array(*[F.when(T.has_terms(F.col("text"), sorted(t)) | F.arrays_overlap(F.col("tokens"), T.literal(t)), F.lit(d)) for d, t in L.DOMAIN_TRIGGERS.items()])
    return F.array_union("scene_tags", F.filter(hits, lambda x: x.isNotNull()))


def _around(label: Column, window: int, wanted: Column) -> Column:
    """Whether a wanted word stands within a window of words around any place where the label's words stand in norm."""
    parts = F.split(label, " ")
    k = F.size(parts)
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("norm") - k + 1)), lambda i: F.slice(F.col("norm"), i, k) == parts)
    near = lambda i: F.slice(F.col("norm"), F.greatest(F.lit(1), i - window), F.least(i - 1, F.lit(window)) + k + window)
    return (F.size("norm") >= k) & F.exists(places, lambda i: F.arrays_overlap(near(i), wanted))


def target_labels(scope: DataFrame, most: int = 8) -> DataFrame:
    """segment_id, label, count and ordinal (by count, then order of appearance in lexicon and text) of each segment."""
    rows = scope.select("video", "segment_id", "text", "tokens", "scene_tags").withColumn("norm", F.filter(F.transform(T.words(F.col("text")), T.normalize_label), lambda w: w != ""))
    rows = rows.withColumn("domains", _domains())
    rows = rows.withColumn("wanted", F.array_distinct(F.flatten(F.transform("domains", lambda d: F.coalesce(F.create_map(*[x for k, v in DOMAIN_LABELS.items() for x in (F.lit(k), T.literal(v))])[d], F.array().cast("array<string>"))))))
    anchors = T.literal(ANCHORS)
    in_domain = lambda label: F.array_contains("wanted", label) | _around(label, 6, F.array_union(F.col("wanted"), anchors)) & (F.size("domains") > 0)
    table = [(alias, T.singular(label), k, T.singular(label) in L.WHITELIST) for k, (label, names) in enumerate(L.OBJECT_ALIASES.items()) for alias in names if T.singular(label) not in BLOCKED]
    any_alias = "|".join(re.escape(x[0]) for x in table)
    found = rows.select("video", "segment_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"\b({any_alias})\b"), F.lit(1))).alias("alias"))
    lexicon = rows.sparkSession.createDataFrame(table, "alias string, label string, place int, sure boolean")
    # The lexicon's size is fixed.
    seeded = found.join(F.broadcast(lexicon), "alias").groupBy("video", "segment_id", "label", "place", "sure").agg(F.count("*").alias("n"))
    sure = F.col("sure") | (F.col("n") >= 2)
    unsure = seeded.filter(~sure).join(rows.select("segment_id", "norm", "domains", "wanted"), "segment_id").filter(_around(F.col("label"), 4, anchors) | in_domain(F.col("label")))
    first = seeded.filter(sure).unionByName(unsure.select(*seeded.columns)).select("video", "segment_id", "label", "place", (F.col("n") + F.when(F.col("sure"), 0.5).otherwise(0.0)).alias("count"))
    known = {T.singular(a) for k, v in L.OBJECT_ALIASES.items() for a in (k, *v)}
    open_ = rows.select("*", F.posexplode("norm").alias("pos", "label")).filter((F.length("label") >= 4) & ~F.col("label").isin(*sorted(BLOCKED | known)) & ~F.col("label").rlike("(ing|ed)$"))
    open_ = open_.groupBy("video", "segment_id", "label").agg(F.count("*").alias("n"), F.min("pos").alias("pos"), F.first("norm").alias("norm"), F.first("domains").alias("domains"), F.first("wanted").alias("wanted"))
    word = F.col("label")
    targets = sorted(frozenset().union(*DOMAIN_LABELS.values()))
    worth = (
        F.when(word.isin(*sorted(L.WHITELIST)), F.greatest(F.lit(1.0), F.col("n").cast("double")) + 0.5)
        .when(word.isin(*targets) & in_domain(word), F.greatest(F.lit(0.6), F.col("n") * 0.5))
        .when((F.col("n") >= 3) & _around(word, 4, anchors) & ~word.endswith("ly"), F.greatest(F.lit(0.4), F.col("n") * 0.35))
    )
    tail = open_.withColumn("count", worth).filter("count is not null").select("video", "segment_id", "label", (F.col("pos") + 1000).alias("place"), "count")
    both = first.unionByName(tail).groupBy("video", "segment_id", "label").agg(F.sum("count").alias("count"), F.min("place").alias("place"))
    ranked = both.withColumn("ordinal", F.row_number().over(Window.partitionBy("video", "segment_id").orderBy(F.desc("count"), "place")))
    return ranked.filter(F.col("ordinal") <= most).select("video", "segment_id", "label", F.greatest(F.lit(1.0), "count").alias("count"), "ordinal")


def attribute_patterns(spark) -> DataFrame:
    """label, attribute and the pattern that binds them: as many rows as the vocabularies have pairs."""
    names = sorted({T.singular(k) for k in L.OBJECT_ALIASES} | {T.singular(w) for w in L.WHITELIST})
    return spark.createDataFrame([(n, a, T.bound_pattern(n, a)) for n in names for a in sorted(L.ATTRIBUTE_TERMS)], "label string, attribute string, pattern string")


def attributes(mentions: DataFrame) -> DataFrame:
    """segment_id, label and attributes (sorted) of mentions with any. mentions: segment_id, label, text, tokens.

    Only attributes that stand in the text are tried, each by its label's pattern from a table of fixed size.
    """
    low = F.regexp_replace(F.lower("text"), r"\s+", " ")
    present = F.array_intersect(T.literal(L.ATTRIBUTE_TERMS), F.col("tokens"))
    rows = mentions.select("segment_id", "label", low.alias("low"), T.signal_colors(F.col("text")).alias("signals"), F.explode(present).alias("attribute"))
    rows = rows.join(F.broadcast(attribute_patterns(mentions.sparkSession)), ["label", "attribute"], "left")
    state = F.col("label").isin(*L.SIGNAL_TARGETS) & F.array_contains("signals", F.col("attribute"))
    name = F.when(state, F.when(F.col("attribute").isin(*sorted(L.COLOR_TERMS)), F.concat(F.lit("signal_state_"), "attribute"))).when(F.col("pattern").isNotNull() & F.expr("low rlike pattern"), F.col("attribute"))
    return rows.withColumn("a", name).filter("a is not null").groupBy("segment_id", "label").agg(F.array_sort(F.collect_set("a")).alias("attributes"))


def mentions(scope: DataFrame, most: int = 8) -> DataFrame:
    """text and items (ordinal, label, count, attributes) of every different text with any label.

    All of these follow from the text alone, so that segments with one text share the work.
    """
    text = F.col("text")
    rows = scope.select("text").distinct().select(F.lit("").alias("video"), text.alias("segment_id"), "text", T.tokenize(text).alias("tokens"), T.scene_tags(text).alias("scene_tags")).persist()
    labels = target_labels(rows, most).join(rows.select("segment_id", "text", "tokens"), "segment_id")
    labels = labels.join(attributes(labels), ["segment_id", "label"], "left").withColumn("attributes", F.coalesce("attributes", F.array().cast("array<string>")))
    return labels.groupBy(F.col("segment_id").alias("text")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "label", "count", "attributes"))).alias("items"))


def targets(scope: DataFrame, most: int = 8) -> DataFrame:
    """One row per object mention, with its attributes, confidence, text and that text's tokens (in any order)."""
    # What follows from text and caption is made once for all segments that have both; tokens is all but the segment's id.
    listed = lambda x: F.when(F.size(x["attributes"]) > 0, F.concat(F.lit(" attributes="), F.array_join(x["attributes"], ", "))).otherwise("")
    said = lambda x: T.tokenize(F.concat(F.lit("Object evidence: "), x["label"], F.lit(" appears in segment"), listed(x), F.lit(" Caption: "), T.shorten(F.col("caption"), 360)))
    found = scope.select("text", "caption").distinct().join(mentions(scope, most), "text").withColumn("items", F.transform("items", lambda x: x.withField("words", said(x)))).persist()
    rows = scope.select("video", "segment_id", "text", "caption", "start_time", "end_time", "ord").join(found, ["text", "caption"])
    rows = rows.select("video", "segment_id", "caption", "start_time", "end_time", "ord", T.tokenize(F.col("segment_id")).alias("own"), "items")
    rows = rows.select("video", "segment_id", "caption", "start_time", "end_time", "ord", "own", F.inline("items"))
    tail = F.concat_ws(":", "segment_id", F.regexp_replace("label", " ", "_"), "ordinal")
    attrs = F.when(F.size("attributes") > 0, F.concat(F.lit(" attributes="), F.array_join("attributes", ", "), F.lit("."))).otherwise("")
    said = F.concat(F.lit("Object evidence: "), F.col("label"), F.lit(" appears in segment "), F.col("segment_id"), F.lit(" ("), T.format_seconds(F.col("start_time")), F.lit("-"), T.format_seconds(F.col("end_time")), F.lit(")."), attrs, F.lit(" Caption: "), T.shorten(F.col("caption"), 360))
    aliases = F.create_map(*[x for k, v in L.OBJECT_ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return rows.select(F.concat(F.lit("target:"), tail).alias("id"), F.concat(F.lit("object:"), tail).alias("node_id"), "video", "segment_id", "ord", "label", "ordinal", F.coalesce(aliases[F.col("label")], F.array("label")).alias("aliases"), "attributes", F.least(F.lit(0.95), 0.55 + 0.1 * F.col("count")).alias("confidence"), said.alias("text"), "start_time", "end_time", F.concat("words", "own").alias("tokens"))


def sessions(rows: DataFrame, keys: list[str], order: list[str], gap: float = L.TRACK_GAP) -> DataFrame:
    """rows with session: a new one where a start lies more than gap after the end of the row before (not of all before).

    Null starts come last and never begin a session.
    """
    w = Window.partitionBy(*keys).orderBy(F.col("start_time").asc_nulls_last(), *order)
    before = F.lag(F.coalesce("end_time", "start_time")).over(w)
    new = F.when(F.col("start_time") - before > gap, 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("session", 1 + F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def tracks(target: DataFrame, scope: DataFrame, gap: float = L.TRACK_GAP) -> DataFrame:
    """Runs of mentions of one movable label in a video, cut at gaps, with what their texts say of motion."""
    rows = target.filter(T.normalize_label(F.col("label")).isin(*sorted(L.MOVABLE))).select("video", "label", "node_id", "segment_id", "ord", "ordinal", "start_time", "end_time")
    rows = sessions(rows, ["video", "label"], ["ord", "ordinal"], gap).join(scope.select("segment_id", F.col("text").alias("t")), "segment_id")
    at = F.coalesce("start_time", F.lit(1e12)).alias("at")
    item, said = F.struct(at, "ord", "ordinal", "node_id", "segment_id", "start_time", "end_time"), F.struct(at, "ord", "ordinal", "node_id", "segment_id", "t")
    # Texts stand apart, so that they do not move where only ids are asked for.
    rows = rows.groupBy("video", "label", "session").agg(F.array_sort(F.collect_list(item)).alias("items"), F.array_sort(F.collect_list(said)).alias("told"), F.min(F.struct("ord", "ordinal")).alias("place"))
    # Tracks of a video stand in the order in which their labels come up first.
    rows = rows.withColumn("place", F.min("place").over(Window.partitionBy("video", "label")))
    evidence = F.array_join(F.array_distinct(F.transform("told", lambda x: F.concat_ws("\x00", x["segment_id"], x["t"]))), "\x01")
    texts = F.array_join(F.transform(F.split(evidence, "\x01"), lambda x: F.element_at(F.split(x, "\x00", 2), 2)), " ")
    rows = rows.withColumns({"object_ids": F.transform("items", lambda x: x["node_id"]), "segment_ids": F.array_distinct(F.transform("items", lambda x: x["segment_id"])), "said": texts})
    actions = T.action_tags(T.tokenize(F.col("said")))
    tid = F.concat_ws(":", F.lit("track"), "video", F.regexp_replace("label", " ", "_"), "session")
    out = rows.select(tid.alias("id"), "video", "label", "session", "place", "object_ids", "segment_ids", F.element_at("items", 1)["start_time"].alias("start_time"), F.element_at("items", -1)["end_time"].alias("end_time"), actions.alias("action_tags"), T.lexicon_words(F.col("said"), L.MOTION_KEYWORDS).alias("action_keywords"), T.lexicon_words(F.col("said"), L.DIRECTION_KEYWORDS).alias("direction_keywords"), T.lexicon_words(F.col("said"), L.STATE_KEYWORDS).alias("state_keywords"), T.shorten(F.col("said"), 900).alias("evidence_text"))
    some = F.array_join(F.slice("segment_ids", 1, 8), ", ")
    where = F.concat(some, F.when(F.size("segment_ids") > 8, ", ...").otherwise(""))
    acted = F.when(F.size("action_tags") > 0, F.concat(F.lit(" Actions observed: "), F.array_join("action_tags", ", "), F.lit("."))).otherwise("")
    summary = F.concat(F.lit("Pseudo-track for "), F.col("label"), F.lit(" from "), T.format_seconds(F.col("start_time")), F.lit(" to "), T.format_seconds(F.col("end_time")), F.lit(", observed across "), F.size("segment_ids").cast("string"), F.lit(" segments ("), where, F.lit(")."), acted)
    return out.withColumn("motion_summary", summary)


def windows(scope: DataFrame, width: float = L.EVENT_WINDOW) -> DataFrame:
    """scope with window: the tumbling window of the start; rows without start go by their place."""
    w = Window.partitionBy("video").orderBy(F.col("start_time").asc_nulls_last(), "ord")
    place = F.row_number().over(w) - 1
    return scope.withColumn("place", place).withColumn("window", F.when(F.col("start_time").isNull(), F.floor(F.col("place") / max(1, int(width) // 30))).otherwise(F.floor(F.col("start_time") / width)).cast("long"))


def events(scope: DataFrame, target: DataFrame, track: DataFrame, width: float = L.EVENT_WINDOW) -> DataFrame:
    """Tumbling windows of a video with their state: tags, label counts, actions, related ids and neighbours in time."""
    seg = windows(scope, width)
    item, said = F.struct("place", "segment_id", "start_time", "end_time"), F.struct("place", "text", "caption", "scene_tags", "transcript")
    base = seg.groupBy("video", "window").agg(F.array_sort(F.collect_list(item)).alias("xs"), F.array_sort(F.collect_list(said)).alias("told"))
    where = seg.select("segment_id", "window", "place")
    seen = target.join(where, "segment_id")
    by_label = seen.groupBy("video", "window", "label").agg(F.count("*").alias("n"), F.min(F.struct("place", "ordinal")).alias("first"))
    counts = by_label.groupBy("video", "window").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "first", "label", "n"))), lambda x: F.struct(x["label"].alias("label"), x["n"].cast("int").alias("n"))).alias("object_counts"))
    objects = seen.groupBy("video", "window").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "ordinal", "node_id"))), lambda x: x["node_id"]).alias("related_object_ids"))
    on = track.select("video", "id", F.explode("segment_ids").alias("segment_id")).join(where, "segment_id").select("video", "window", "id").distinct()
    along = on.groupBy("video", "window").agg(F.array_sort(F.collect_list("id")).alias("related_track_ids"))
    e = base.join(counts, ["video", "window"], "left").join(objects, ["video", "window"], "left").join(along, ["video", "window"], "left")
    empty = F.expr("cast(array() as array<struct<label:string,n:int>>)")
    none = F.array().cast("array<string>")
    text = F.array_join(F.transform("told", lambda x: x["text"]), " ")
    e = e.withColumns({"object_counts": F.coalesce("object_counts", empty), "scene_tags": F.array_sort(F.array_distinct(F.flatten(F.transform("told", lambda x: x["scene_tags"])))), "action_tags": T.action_tags(T.tokenize(text))})
    calm, talks = T.literal({"stop", "slow", "wait", "change"}), T.literal({"talk", "speak", "discuss", "present"})
    kind = (
        F.when(F.array_contains("scene_tags", "traffic"), F.when(F.arrays_overlap("action_tags", calm), "traffic_state_change").otherwise("traffic_activity"))
        .when(F.array_contains("scene_tags", "conversation") | F.arrays_overlap(F.col("action_tags"), talks), "conversation_or_presentation")
        .when(F.size("object_counts") > 0, "object_activity")
        .otherwise("fixed_window")
    )
    or_ = lambda c, other: F.when(c != "", c).otherwise(other)
    e = e.withColumns({"id": F.concat_ws(":", F.lit("event"), "video", "window"), "start_time": F.element_at("xs", 1)["start_time"], "end_time": F.element_at("xs", -1)["end_time"], "event_type": kind})
    listed = F.array_join(F.transform(F.slice("object_counts", 1, 8), lambda x: F.concat_ws("=", x["label"], x["n"])), ", ")
    sample = F.array_join(F.transform(F.slice("told", 1, 2), lambda x: T.shorten(x["caption"], 180)), " ")
    summary = F.trim(F.concat(F.lit("Event window in "), F.col("video"), F.lit(" from "), T.format_seconds(F.col("start_time")), F.lit(" to "), T.format_seconds(F.col("end_time")), F.lit(". Scene tags: "), or_(F.array_join("scene_tags", ", "), "unspecified scene"), F.lit(". Object evidence: "), or_(listed, "no explicit targets"), F.lit(". Action tags: "), or_(F.array_join("action_tags", ", "), "no explicit action tags"), F.lit(". Representative visual evidence: "), sample))
    w = Window.partitionBy("video").orderBy("window")
    return e.select("id", "video", "window", "start_time", "end_time", "event_type", "scene_tags", "object_counts", "action_tags", F.size("xs").alias("segment_count"), F.exists("told", lambda x: F.trim(x["transcript"]) != "").alias("transcript_present"), F.transform("xs", lambda x: x["segment_id"]).alias("related_segment_ids"), F.coalesce("related_object_ids", none).alias("related_object_ids"), F.coalesce("related_track_ids", none).alias("related_track_ids"), F.lag("id").over(w).alias("previous_event_id"), F.lead("id").over(w).alias("next_event_id"), summary.alias("summary"))


def neighbors(track: DataFrame) -> DataFrame:
    """source, target: tracks of one video with different labels that share a segment, each pair once, in the tracks' order
    (place, then id)."""
    seg = track.select("video", "label", "place", "id", F.explode("segment_ids").alias("segment_id"))
    a, b = (seg.select("video", "segment_id", *[F.col(c).alias(f"{x}_{c}") for c in ("label", "place", "id")]) for x in "ab")
    first = F.struct("a_place", "a_id") < F.struct(F.col("b_place").alias("a_place"), F.col("b_id").alias("a_id"))
    return a.join(b, ["video", "segment_id"]).filter((F.col("a_label") != F.col("b_label")) & first).select(F.col("a_id").alias("source"), F.col("b_id").alias("target")).distinct()


def relations(scope: DataFrame, target: DataFrame, track: DataFrame, event: DataFrame) -> DataFrame:
    """Edges (source, target, relation) of the evidence graph."""
    edge = lambda df, a, b, name: df.select(F.col(a).alias("source"), F.col(b).alias("target"), F.lit(name).alias("relation"))
    contains = edge(target.select(F.concat(F.lit("segment:"), F.col("segment_id")).alias("s"), "node_id"), "s", "node_id", "contains")
    belongs = edge(track.select("id", F.explode("object_ids").alias("o")), "o", "id", "belongs_to_track")
    located = edge(event.select("id", F.explode("related_segment_ids").alias("g")).select("id", F.concat(F.lit("segment:"), "g").alias("s")), "id", "s", "located_in")
    supports = edge(event.select("id", F.explode("related_object_ids").alias("o")), "id", "o", "supports_object")
    joins_in = edge(event.select("id", F.explode("related_track_ids").alias("t")), "t", "id", "participates_in")
    after = edge(event.filter("previous_event_id is not null"), "previous_event_id", "id", "followed_by")
    beside = neighbors(track).withColumn("relation", F.lit("neighbor_of"))
    out = contains
    for more in (belongs, located, supports, joins_in, after, beside):
        out = out.unionByName(more)
    return out


def nodes(scope: DataFrame, target: DataFrame, track: DataFrame, event: DataFrame) -> DataFrame:
    """Vertices (id, type, view_id, text) of the evidence graph."""
    node = lambda df, i, kind, view, text: df.select(F.col(i).alias("id"), F.lit(kind).alias("type"), F.col(view).alias("view_id"), text.alias("text"))
    seg = node(scope, "node_id", "segment", "id", F.concat(F.lit("Segment "), F.col("segment_id"), F.lit(": "), T.shorten(F.col("text"), 620)))
    return seg.unionByName(node(target, "node_id", "object", "id", F.col("text"))).unionByName(node(track, "id", "track", "id", F.col("motion_summary"))).unionByName(node(event, "id", "event", "id", F.col("summary")))


def subgraph(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Edges whose ends are both selected (id), each once."""
    ids = selected.select("id").distinct()
    kept = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return kept.select("source", "target", "relation").distinct()
