"""Scores and top rows of each view for a question, executed view by view until the evidence is good enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightloom.functions import text as T
from sightloom.plans import cost as C
from sightloom.plans.planner import QueryPlan

#: Words that give a view's rows a bonus.
SPEECH = frozenset("say said speak speech talk transcript".split())
MOVES = frozenset("after before track move trajectory".split())
WHEN = frozenset("after before when then first last happen event".split())
TURNS = frozenset("change transition then after before".split())


def _hits(array: str, words: frozenset[str]) -> Column:
    return F.arrays_overlap(F.col(array), T.literal(words)) if words else F.lit(False)


def score(view: str, words: frozenset[str], tokens: str | None = None) -> Column:
    """The score of a view's row for the words of a question: overlap of words, and what stands in certain columns.

    tokens, where given, is a column that holds the tokens of a target's text.
    """
    bonus = lambda condition, v: F.when(condition, F.lit(v)).otherwise(0.0)
    joined = lambda *cs: T.tokenize(F.concat_ws(" ", *cs))
    if view == "scope":
        text = F.array_distinct(F.concat("tokens", T.tokenize(F.array_join("scene_tags", " "))))
        return T.overlap_score(words, text) + (bonus(F.trim("transcript") != "", 0.35) if words & SPEECH else F.lit(0.0)) + bonus(_hits("scene_tags", words), 0.25)
    if view == "target":
        parts = ("label", F.array_join("aliases", " "), F.array_join("attributes", " "))
        text = F.concat(joined(*parts), F.col(tokens)) if tokens else joined(*parts, "text")
        return T.overlap_score(words, text) + bonus(F.col("label").isin(*words) | _hits("aliases", words), 0.75)
    if view == "track":
        text = joined("label", F.array_join("action_tags", " "), "motion_summary")
        moves = bonus(F.size("segment_ids") > 1, 0.35) if words & MOVES else F.lit(0.0)
        return T.overlap_score(words, text) + bonus(F.col("label").isin(*words), 0.55) + bonus(_hits("action_tags", words), 0.45) + moves
    if view == "event":
        text = joined("event_type", "summary", F.array_join("action_tags", " "), F.array_join("scene_tags", " "), F.array_join(F.transform("object_counts", lambda o: o["label"]), " "))
        return T.overlap_score(words, text) + (0.25 if words & WHEN else 0.0) + bonus(_hits("action_tags", words), 0.35)
    text = joined(F.array_join("action_tags", " "), F.array_join("scene_tags", " "), "boundary_reason", "sample", F.array_join(F.map_keys("object_counts"), " "))
    turns = bonus(F.size("dominant_signals") > 0, 0.2) if words & TURNS else F.lit(0.0)
    return T.overlap_score(words, text) + (0.35 if words & WHEN else 0.0) + bonus(_hits("action_tags", words), 0.35) + turns + F.least(F.lit(0.2), F.coalesce("change_score", F.lit(0.0)) * 0.2)


def top(view: str, rows: DataFrame, words: frozenset[str], limit: int, videos: list[str] | None = None) -> DataFrame:
    """The best rows of a view: view, id, video, score; ties by id. One ordered limit, so each task sends few rows."""
    if videos is not None:
        rows = rows.filter(F.col("video").isin(videos))
    return best(view, rows.select("id", "video", scored(view, words)), limit)


def scored(view: str, words: frozenset[str], tokens: str | None = None) -> Column:
    return F.round(score(view, words, tokens), 9).alias("score")


def best(view: str, rows: DataFrame, limit: int) -> DataFrame:
    """top() of rows that have their score."""
    return rows.filter("score > 0").select(F.lit(view).alias("view"), "id", "video", "score").orderBy(F.desc("score"), "id").limit(limit)


def top_for_all(view: str, rows: DataFrame, questions: DataFrame, limit: int) -> DataFrame:
    """The best rows of a view for many questions at once (query_id, words array): shared words by an equi-join.

    Of a scope with scene_tags or transcript these count as in score(); other views' rows count by words alone.
    """
    tagged, spoken = (view == "scope" and c in rows.columns for c in ("scene_tags", "transcript"))
    q = questions.select("query_id", F.size("words").alias("q"), F.explode(F.array_distinct("words")).alias("word"))
    tokens = F.concat("tokens", T.tokenize(F.array_join("scene_tags", " "))) if tagged else F.col("tokens")
    words = rows.select("id", F.explode(F.array_distinct(tokens)).alias("word"))
    both = words.join(q, "word").groupBy("query_id", "id").agg((F.count("*") / F.max("q")).alias("score"))
    if tagged:
        tags = rows.select("id", F.explode(F.array_distinct("scene_tags")).alias("word"))
        hit = tags.join(q, "word").select("query_id", "id", F.lit(0.25).alias("score")).distinct()
        both = both.unionByName(hit).groupBy("query_id", "id").agg(F.sum("score").alias("score"))
    if spoken:
        asked = questions.filter(F.arrays_overlap("words", T.literal(SPEECH))).select("query_id").distinct()
        said = rows.filter(F.trim("transcript") != "").select("id")
        # Rows that have nothing but the transcript tie, so that of these the first by id are enough.
        first = asked.join(F.broadcast(said.orderBy("id").limit(limit)), how="cross").select("query_id", "id", F.lit(0.0).alias("score"))
        both = both.unionByName(first).groupBy("query_id", "id").agg(F.sum("score").alias("score"))
        both = both.join(asked.withColumn("_asked", F.lit(True)), "query_id", "left").join(said.withColumn("_said", F.lit(True)), "id", "left")
        both = both.select("query_id", "id", (F.col("score") + F.when(F.col("_asked") & F.col("_said"), 0.35).otherwise(0.0)).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    if tagged or spoken:
        both = both.withColumn("score", F.round("score", 9))
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select(F.lit(view).alias("view"), "query_id", "id", "score", "rank")


def prioritized(hits: DataFrame, plan: QueryPlan) -> DataFrame:
    """Hits by weighted score, each id once. hits: view, id, score, role_match, provenance and temporal (0 to 1)."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in plan.weights.items() for x in kv])[F.col("view")], F.lit(0.5))
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    w = 0.40 * clamp(F.col("score")) + 0.25 * clamp(weight) + 0.20 * F.col("role_match") + 0.10 * F.col("provenance") + 0.05 * F.col("temporal")
    rows = hits.withColumn("weighted", F.round(w, 9))
    best = Window.partitionBy("id").orderBy(F.desc("weighted"), "view")
    return rows.withColumn("n", F.row_number().over(best)).filter("n = 1").drop("n").orderBy(F.desc("weighted"), "id")


def videos_matching(identities: DataFrame, names: list[str]) -> list[str]:
    """Videos of identities (video, variants) that one of the names means; none is an error, not an empty result."""
    found = [r["video"] for r in identities.filter(F.arrays_overlap("variants", T.literal({n.strip().lower() for n in names}))).select("video").distinct().orderBy("video").collect()]
    if not found:
        raise ValueError(f"no video matches {names}")
    return found


def execute(views: dict[str, DataFrame], plan: QueryPlan, chosen: C.CostPlan, videos: list[str] | None = None) -> tuple[DataFrame | None, list[str]]:
    """Reads the chosen views in order until the scores are confident; the hits, and the views that were read.

    A boundary question goes on until an event view was read. Driver-side rows are at most the plan's row budget.
    """
    words, scores, read, out = frozenset(plan.terms), [], [], None
    boundary = plan.intents["temporal_ordering"] or plan.intents["transition"]
    for view in chosen.order:
        if view not in views or not chosen.rows.get(view):
            continue
        hits = top(view, views[view], words, chosen.rows[view], videos).collect()
        read.append(view)
        if hits:
            df = views[view].sparkSession.createDataFrame([tuple(h) for h in hits], "view string, id string, video string, score double")
            out = df if out is None else out.unionByName(df)
            scores += [h["score"] for h in hits]
        done_boundary = not boundary or any(v in ("adaptive_event", "event", "visual_event") for v in read)
        if C.confidence(scores) >= chosen.min_confidence and done_boundary:
            break
    return out, read
