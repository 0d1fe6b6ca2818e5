"""The evidence engine: functions and folds against plain Python, views on a worked example, plans and packing."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from sightloom import lexicons as L
from sightloom.functions import geometry as G
from sightloom.functions import text as T
from sightloom.operators import adaptive, packing, retrieval, stats, temporal, views, visual
from sightloom.plans import cost, planner
from sightloom.sources import stores
from sightloom.streaming import windows

DEMO = [("demo_video", "001", "0-5", "A red car waits near a traffic light at an intersection.", ""), ("demo_video", "002", "5-10", "The red car moves forward while a person stands on the sidewalk.", "")]
SEGMENT = "video string, idx string, time string, caption string, transcript string"


@pytest.fixture(scope="module")
def index(spark):
    s = views.scopes(spark.createDataFrame(DEMO, SEGMENT)).persist()
    t = views.targets(s).persist()
    k = views.tracks(t, s).persist()
    e = views.events(s, t, k).persist()
    return s, t, k, e


def test_worked_example(index):
    s, t, k, e = index
    assert [r.scene_tags for r in s.orderBy("ord").collect()] == [["traffic"], ["traffic"]]
    got = {(r.segment_id, r.label): (round(r.confidence, 2), r.attributes) for r in t.collect()}
    assert got == {
        ("demo_video_001", "car"): (0.7, ["red"]),
        ("demo_video_001", "intersection"): (0.7, []),
        ("demo_video_001", "traffic light"): (0.7, []),
        ("demo_video_002", "person"): (0.7, []),
        ("demo_video_002", "car"): (0.7, ["red"]),
        ("demo_video_002", "sidewalk"): (0.7, []),
    }
    tracks = {r.id: (r.segment_ids, r.start_time, r.end_time, r.action_tags) for r in k.collect()}
    assert tracks["track:demo_video:car:1"] == (["demo_video_001", "demo_video_002"], 0.0, 10.0, ["move", "stand", "wait"])
    event = e.first()
    assert (event.event_type, event.segment_count, event.start_time, event.end_time) == ("traffic_state_change", 2, 0.0, 10.0)
    edges = {r["relation"]: r["count"] for r in views.relations(s, t, k, e).groupBy("relation").count().collect()}
    assert edges == {"contains": 6, "belongs_to_track": 3, "located_in": 2, "supports_object": 6, "participates_in": 2, "neighbor_of": 1}
    assert views.nodes(s, t, k, e).count() == 11


def test_adaptive_example(index):
    s, t, k, _ = index
    ch = adaptive.changes(adaptive.timeline(s, t, k))
    assert ch.filter("change_score is not null").first().signals.caption_change == pytest.approx(0.846154, abs=1e-6)
    only = adaptive.adaptive_events(ch).collect()
    assert len(only) == 1 and (only[0].start_time, only[0].end_time, only[0].boundary_reason) == (0.0, 10.0, "end_of_video")


def fold(points, c=adaptive.Config()):
    """Windows of (start, end, score or None): cut, then merged."""
    out, first = [], 0
    for i in range(1, len(points)):
        span = max(0.0, points[i][0] - points[first][0])
        if span >= c.max_seconds or (points[i][2] >= c.threshold and span >= c.min_seconds):
            out.append([points[first][0], max(p[1] for p in points[first:i])])
            first = i
    out.append([points[first][0], max(p[1] for p in points[first:])])
    merged = [out[0]]
    for w in out[1:]:
        last = merged[-1]
        gap = max(0.0, w[0] - last[1])
        if max(0.0, w[1] - w[0]) < c.min_seconds or (0 < gap <= c.merge_gap and max(0.0, last[1] - last[0]) < c.min_seconds):
            merged[-1] = [min(last[0], w[0]), max(last[1], w[1])]
        else:
            merged.append(w)
    return merged


def test_adaptive_folds(spark):
    r = random.Random(2)
    rows, want = [], {}
    for v in range(12):
        at, points = 0.0, []
        for i in range(r.randint(1, 30)):
            end = at + r.choice([1.0, 4.0, 7.999, 8.0, 30.0])
            score = r.choice([0.0, 0.349, 0.35, 0.9])
            points.append((at, end, score))
            rows.append((f"v{v}", i, at, end, score if i else None, f"s{i}"))
            at = end + r.choice([0.0, 0.0, 3.0, 5.0, 6.0])
        want[f"v{v}"] = fold(points)
    df = spark.createDataFrame(rows, "video string, ord int, start_time double, end_time double, change_score double, segment_id string")
    none = F.array().cast("array<string>")
    df = df.withColumns({"dominant": none, "scene_tags": none, "action_tags": none, "object_counts": F.create_map(F.lit("x"), F.lit(1)), "caption": F.lit("")})
    got = {}
    for e in adaptive.adaptive_events(df).orderBy("video", "ordinal").collect():
        got.setdefault(e.video, []).append([e.start_time, e.end_time])
    assert got == want


def test_text_functions(spark):
    rows = ["", None, "The cars' time-table: THE red\xa0 light  turns Green", "a b cd efg efg", "x" * 900, "people stop"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = df.select("i", T.tokenize(F.col("t")).alias("k"), T.shorten(F.col("t"), 20).alias("s"), T.scene_tags(F.col("t")).alias("g"), T.signal_colors(F.coalesce("t", F.lit(""))).alias("c")).orderBy("i").collect()
    for t, g in zip(rows, got, strict=True):
        assert g.k == [w for w in re.findall(r"[A-Za-z][A-Za-z0-9_-]*", (t or "").lower()) if len(w) > 2 and w not in L.STOPWORDS]
        flat = re.sub(r"\s+", " ", t or "").strip()
        assert g.s == (flat if len(flat) <= 20 else flat[:17].rstrip() + "...")
    assert got[2].c == ["green"] and got[5].g == ["crowd"]
    labels = ["buses", "children", "glasses", "boss", "Stories", "bus", "men", "cars"]
    out = spark.createDataFrame([(x,) for x in labels], "x string").select("x", T.normalize_label(F.col("x")).alias("y")).collect()
    assert [r.y for r in out] == [T.singular(x) for x in labels] == ["bus", "child", "glasse", "boss", "story", "bus", "man", "cars"[:4] if len("cars") <= 4 else "car"]
    times = spark.createDataFrame([("5-10",), ("0:00-0:30",), ("-1-3",), (None,), ("1.5-2",)], "t string").select(T.time_range(F.col("t")).alias("r")).collect()
    assert [(r.r.start, r.r.end) for r in times] == [(5.0, 10.0), (None, None), (None, None), (None, None), (1.5, 2.0)]


def test_sessions_cut_by_the_end_before(spark):
    rows = [("v", 0.0, 5.0, 1), ("v", 125.0, 126.0, 2), ("v", 246.0, 247.0, 3), ("v", None, None, 4)]
    out = views.sessions(spark.createDataFrame(rows, "video string, start_time double, end_time double, o int"), ["video"], ["o"])
    assert [r.session for r in out.orderBy("o").collect()] == [1, 1, 1, 1]
    rows[2] = ("v", 246.001, 247.0, 3)
    out = views.sessions(spark.createDataFrame(rows, "video string, start_time double, end_time double, o int"), ["video"], ["o"])
    assert [r.session for r in out.orderBy("o").collect()] == [1, 1, 2, 2]


def test_geometry_borders(spark):
    df = spark.createDataFrame([([0.0, 0.0, 10.0, 10.0], [0.0, 0.0, 10.0, 10.0], 12.0, 0.0), ([0.0, 0.0, 0.0, 0.0], [5.0, 5.0, 5.0, 5.0], 11.99, 0.0), ([0.0, 0.0, 10.0, 10.0], [5.0, 0.0, 15.0, 10.0], -20.0, 20.0)], "a array<double>, b array<double>, dx double, dy double")
    got = df.select(G.iou(F.col("a"), F.col("b")).alias("i"), G.direction(F.col("dx"), F.col("dy")).alias("d")).collect()
    assert [(round(r.i, 4), r.d) for r in got] == [(1.0, "right"), (0.0, "stationary"), (0.3333, "left")]


def test_keyframes_keep_ends_and_changes(spark):
    rows = [("v", i, float(t), {"car": n}, ["car"], []) for i, (t, n) in enumerate([(0, 1), (1, 5), (3, 1), (9, 1), (13, 1), (14, 1)])]
    df = spark.createDataFrame(rows, "video string, frame int, time double, object_counts map<string,int>, dominant array<string>, relation_types array<string>")
    assert [r.frame for r in visual.thin_keyframes(df).orderBy("frame").collect()] == [0, 4, 5]


def test_tracks_follow_boxes(spark):
    rows = [("v", "car", f, f"{f}{k}", 0.9 - k / 10, [100.0 * k + 3 * int(f), 0.0, 100.0 * k + 3 * int(f) + 50, 50.0]) for f in ("1", "2", "3") for k in range(2)]
    rows.append(("v", "car", "4", "far", 0.5, [900.0, 900.0, 950.0, 950.0]))
    df = spark.createDataFrame(rows, "video string, label string, frame string, object_id string, confidence double, box array<double>")
    got = {r.object_id: r.track for r in visual.assign_tracks(df).collect()}
    assert got == {"10": 1, "20": 1, "30": 1, "11": 2, "21": 2, "31": 2, "far": 3}


def test_plans():
    p = planner.plan("Which vehicle appears near the traffic light?")
    assert set(p.terms) >= {"appear", "appears", "light", "near", "traffic", "vehicle"}
    assert p.query_type == "instance_spatial_temporal" and [k for k, v in p.intents.items() if v] == ["spatial_relation"]
    assert p.required_views == ("visual_object", "visual_track", "visual_event")
    kinds = {"Summarize the whole video": "general_description", "What did they say?": "speech", "Describe the setting": "general_description", "Where do the cars wait behind each other?": "instance_spatial_temporal", "xyz": "default"}
    for question, kind in kinds.items():
        assert planner.plan(question).query_type == kind, question
    chosen = cost.choose(p, {"scope": {"row_count": 10}, "target": {"row_count": 30, "label_counts": {"vehicle": 3}}})
    assert chosen.order[0] == "target" and sum(chosen.rows.values()) <= 16
    assert cost.confidence([]) == 0.0 and cost.confidence([1.0]) == pytest.approx(0.475)


def test_packing_keeps_budgets(spark):
    rows = [("q", f"i{k}", ["scope", "target", "event"][k % 3], "word " * (10 + 40 * (k % 4)), [f"w{k}", f"w{k // 2}"], ["w1", "w2"], k / 20) for k in range(20)]
    df = spark.createDataFrame(rows, "query_id string, id string, view string, text string, words array<string>, query_words array<string>, confidence double")
    config = packing.Config(token_budget=200, char_budget=2000, max_items=8)
    items = packing.layered(packing.without_duplicates(packing.scored(df, config)), "target", {}, config)
    got = packing.packed(items, config).orderBy("rank").collect()
    assert len(got) <= 8 and len({r.id for r in got}) == len(got) and [r.rank for r in got] == list(range(1, len(got) + 1))
    free = [r for r in got if r.reason in packing.LAYERS[1:]]
    assert not free or sum(r.token_cost for r in got) <= 200
    same = spark.createDataFrame([("q", "a", "scope", "t", ["x", "y", "z"], ["x"], 0.9), ("q", "b", "scope", "t", ["x", "y", "z"], ["x"], 0.1)], df.schema)
    assert [r.id for r in packing.without_duplicates(packing.scored(same)).collect()] == ["a"]


def test_chunks(spark):
    rows = [("v", f"s{i}", i, " ".join(["w"] * n)) for i, n in enumerate([3, 4, 2, 20, 0, 5])]
    got = stats.chunks(spark.createDataFrame(rows, "video string, segment_id string, ord int, text string"), most=8).orderBy("chunk_order_index").collect()
    assert [(r.tokens, r.segment_ids) for r in got] == [(7, ["s0", "s1"]), (2, ["s2"]), (8, ["s3", "s4"]), (5, ["s5"])]


def test_ranges_have_no_nested_loops(spark):
    a = spark.createDataFrame([("v", "a", 1.0)], "video string, anchor_id string, time double")
    r = spark.createDataFrame([("v", "x", 2.0), ("v", "y", 9.0)], "video string, id string, time double")
    for df in (temporal.nearby(a, r), temporal.around(a, r)):
        plan = df._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert [x.id for x in temporal.nearby(a, r).collect()] == ["x"]
    assert {x.id: x.bucket for x in temporal.around(a, r).collect()} == {"x": "focal", "y": "after"}


def test_sources(spark, tmp_path):
    store = {"v": {"001": {"time": "0-5", "caption": "", "fine_caption": " hi ", "transcript": "", "frame_times": [0.0]}, "002": {"time": "5-10", "content": "Caption: so\nTranscript: yes"}}}
    (tmp_path / "s.json").write_text(json.dumps(store))
    got = {r.idx: (r.caption, r.transcript) for r in stores.read_segments(spark, str(tmp_path / "s.json")).collect()}
    assert got == {"001": ("hi", ""), "002": ("so", "yes")}
    assert stores.read_rows(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a": oops}\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        stores.read_rows(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    for text in ('{"items": [{"qid": "a", "query_text": "Why?", "video_name": "m", "start_time": 3}]}', "[{'qid': 'a', 'query_text': 'Why?', 'video_name': 'm', 'start_time': 3}]", '{"qid": "a", "query_text": "Why?", "video_name": "m", "start_time": 3}'):
        assert stores.parse_queries(text, "D") == [{"query_id": "a", "query": "Why?", "video_id": "m", "dataset": "D", "metadata": {"start_time": "3"}}]
    assert [q["query_id"] for q in stores.parse_queries("q7. What?\nWho?", "Set")] == ["q7", "set_002"]
    errors = {r.rule: r.violations for r in stats.query_errors(stores.query_frame(spark, stores.parse_queries("1) a\n1) b", ""))).collect()}
    assert errors == {"missing_dataset": 2, "missing_video_id": 2, "duplicate_query_id": 1}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", "v", "a" if m % 2 else "b") for m in (0, 1, 3, 9, 30)]
    df = spark.createDataFrame(rows, "ts string, video string, kind string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    windows.run_to_table(windows.tumbling(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    done = {(r.start, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {(r.start, r.n) for r in windows.tumbling(df).collect()}
    assert done < batch and len(batch) - len(done) == 1


def test_many_questions_rank_as_one(spark):
    r = random.Random(4)
    rows = [(f"scope:{k:02d}", "v", r.choices(["red", "car", "say", "stage"], k=3), r.sample(["traffic", "stage", "crowd"], r.randint(0, 2)), r.choice(["", " ", "well then"])) for k in range(40)]
    df = spark.createDataFrame(rows, "id string, video string, tokens array<string>, scene_tags array<string>, transcript string")
    asked = {"a": ["red", "car"], "b": ["say", "crowd", "dog"], "c": ["said", "unseen"], "d": ["traffic", "stage", "talk"]}
    got = retrieval.top_for_all("scope", df, spark.createDataFrame(list(asked.items()), "query_id string, words array<string>"), 6).collect()
    for q, words in asked.items():
        one = [(x.id, x.score) for x in retrieval.top("scope", df, frozenset(words), 6).collect()]
        assert one and [(x.id, x.score) for x in sorted(got, key=lambda x: x["rank"]) if x.query_id == q] == one


def test_targets_of_segments_with_one_text(spark):
    """Segments that share a text share its mentions' work; tokens are those of each target's own text."""
    segments = [*DEMO, ("other-car_video", "007", "5-10", DEMO[0][3], ""), ("third", "1", "0-5", DEMO[0][3], "")]
    s = views.scopes(spark.createDataFrame(segments, SEGMENT))
    assert views.mentions(s).count() == 2
    rows = views.targets(s).withColumn("want", T.tokenize(F.col("text"))).collect()
    assert len(rows) == 12 and all(sorted(r.tokens) == sorted(r.want) for r in rows)
    assert "other-car_video_007" in {w for r in rows for w in r.tokens}
    words = frozenset({"car", "light", "other-car_video_007"})
    both = views.targets(s).select(retrieval.scored("target", words).alias("a"), retrieval.scored("target", words, "tokens").alias("b")).collect()
    assert len(both) == 12 and all(r.a == r.b for r in both)
