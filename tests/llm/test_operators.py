"""Each operator against a plain version of its contract, on documents with nulls, empty and long texts, ties and copies."""

import base64
import hashlib
import json
import random
import re
import time
import weakref
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sightloom.llm import bpe, chat_format, exact_dedup, jaccard, mixing, pii, quality, suffix_dedup, toxicity, warc
from sightloom.llm.common import SLICE, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, size long, cut string, rid long, hi string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau ypsilon".split()


def texts() -> list:
    r = random.Random(5)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    base, shared = say(120), say(60)
    near = base.split()
    near[60] = "changed"
    out = [None, "", " \n\t", base, base, " ".join(near), base.upper(), shared + " " + say(40), say(30) + " " + shared, say(3), say(3), "one two", "one two", "é" * 300, "ab" * 400, say(5000), base + " tail", "x\x1cy ß İ 中文 <|endoftext|>"]
    return out + [say(r.randint(1, 50)) for _ in range(25)]


def frame(spark, rows=None):
    rows = list(enumerate(texts())) if rows is None else rows
    return spark.createDataFrame([(i, t, "en", None if i % 5 == 4 else f"s{i % 3}", len(t or ""), "x", 1, "y", 7, "z") for i, t in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 4
def test_exact_duplicates(spark):
    rows = [*enumerate(texts()), (4, texts()[4])]
    for options in ({}, {"hash_bits": 3, "min_chunk": 5, "max_chunk": 20}):
        got = exact_dedup.exact_duplicates(frame(spark, rows), **options).collect()
        assert len(got) == len(rows)
        group = defaultdict(list)
        for i, t in rows:
            group[t or ""].append(i)
        by = {i: t or "" for i, t in rows}
        for r in got:
            ids = group[by[r.doc_id]]
            assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), r.doc_id == max(ids))
            assert r.text_sha256 == hashlib.sha256(by[r.doc_id].encode()).hexdigest()
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0
    assert sorted(r.doc_id for r in exact_dedup.keep_one(frame(spark)).collect()) == sorted(max(i for i, t in enumerate(texts()) if (t or "") == u) for u in {t or "" for t in texts()})


def test_exact_null_id(spark):
    df = spark.createDataFrame([(None, "a"), (3, "a"), (None, "b")], "doc_id long, text string")
    got = {(r.doc_id, r.group_size): r.kept for r in exact_dedup.exact_duplicates(df).collect()}
    assert got == {(None, 2): False, (3, 2): True, (None, 1): True}


def test_exact_copies_go_by_id_and_text(spark):
    rows = [(1, "a"), (1, "own"), (2, "a"), (None, "a"), (None, "alone"), (3, None), (4, ""), (4, "b")]
    got = exact_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, "own"), (2, "a"), (None, "alone"), (4, ""), (4, "b")]))


def test_chunks_follow_the_content(spark):
    r = random.Random(8)
    say = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) + r.choice(["", "", "", "", "."]) for _ in range(n))
    a, odd = say(3000), "x\x01\x02y\x01z" + say(300)
    rows = [a, "Put before. " + a, a[:5000] + "put within" + a[5000:], odd, "b" * 20_000, ""]
    cut = exact_dedup._chunks(F.col("t"), 256, 8192)
    got = [x.c for x in spark.createDataFrame([(t,) for t in rows], "t string").select(cut.alias("c")).collect()]
    assert ["".join(c)[:-1].replace("\x01\x04", "\x02").replace("\x01\x03", "\x01") for c in got] == rows
    assert len(got[0]) > 30
    for other in got[1:3]:  # an insertion changes the chunk that it falls into, and the next at most
        assert len(set(got[0]) - set(other)) <= 2
    assert exact_dedup.exact_duplicates(spark.createDataFrame([(1, "x\x01y"), (2, "x\x01\x03y"), (3, "xy"), (4, "x\x01\x02y"), (5, "x\x01\x04y"), (6, ""), (7, "."), (8, "..")], "doc_id long, text string")).filter("kept").count() == 8


# --- 3
def brute_jaccard(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = set(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard(spark):
    r = random.Random(9)
    rows = list(enumerate(texts()))
    seed = [r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(200)]
    for k in range(40):  # chains of near copies, some just below and some just above the threshold
        words = list(seed)
        for _ in range(r.randint(0, 5)):
            words[r.randrange(200)] = f"new{k}"
        rows.append((100 + k, " ".join(words)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.linked(frame(spark, rows)).collect()}
    assert got == brute_jaccard(rows)
    assert jaccard.linked(empty(spark)).count() == 0


def test_one_of_each_with_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(100)) for x in "abc")
    rows = [(1, a), (2, a + " tail"), (2, b), (None, b + " tail"), (None, c), (None, a), (5, c + " " + b), (1, None)]
    got = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [rows[0], rows[2], rows[4], rows[6], rows[7]]))


def test_prefix_filter_keeps_every_link():
    """Sets that link share as many prefix tokens as the filter asks for, under every order."""
    r = np.random.default_rng(3)
    for _ in range(200):
        n = int(r.integers(1, 300))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) > 0.1], r.integers(0, 2**63, max(0, n // 12)).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
            for order in jaccard.ORDERS:
                shared = len(np.intersect1d(jaccard.prefix(a, order), jaccard.prefix(b, order)))
                assert shared >= min(jaccard.reserve(len(a)), jaccard.reserve(len(b)))
            x, y = jaccard.sketch(a), jaccard.sketch(b)
            bits = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64).tolist())
            assert 180 * bits <= 20 * (len(a) + len(b))
            off = jaccard.differ(jaccard.wide_sketch(a), jaccard.wide_sketch(b))
            assert off == jaccard.differ(jaccard.wide_sketch(b), jaccard.wide_sketch(a)) <= len(np.setxor1d(a, b))


# --- 6
def test_warc(spark):
    record = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "u", "hello"), (2, "u", "hello"), (3, None, None), (4, "x", "WARC/1.1\r\n in " + record + "tail" + record), (5, "y\r\nz", ""), (6, "z", record * 2), (7, "q", "é" * 10 + "\r\n\r\n"), (8, "u", "hello"), (9, "u", record * 2), (10, "l", "long " * 40_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    got = {r.page_id: r for r in warc.archive_round_trip(pages).collect()}
    assert sorted(got) == [r[0] for r in rows]
    for i, _, h in rows:
        body = (h or "").encode()
        top = max(j for j, _, g in rows if (g or "") == (h or ""))
        assert got[i].payload_bytes == len(body)
        assert got[i].payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if i == top else ("revisit", top))
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_warc_with_repeated_and_null_ids(spark):
    rows = [(1, "x"), (5, "x"), (5, "x"), (1, "yyy"), (None, "x"), (None, "own"), (None, "own"), (2, "yyy"), (5, "other"), (7, None), (8, ""), (1, "x")]
    got = warc.archive_round_trip(spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")).collect()
    want = []
    for i, h in rows:
        body = (h or "").encode()
        top = max((j for j, g in rows if (g or "") == (h or "") and j is not None), default=None)
        again = top is not None and i != top
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", top if again else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_warc_least_bytes(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    rows = {r.id: r.refers_to for r in warc.records(pages, "page_id", "url", "html", 4).collect()}
    assert rows == {1: None, 2: None, 3: 4, 4: None}


# --- 7
def test_bpe_matches_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    with open(path, encoding="utf-8") as f:
        source = f.read()
    tool, other = bpe.Bpe(source), Tokenizer.from_file(path)
    r = random.Random(1)
    parts = ["a", "b", "th", "e", " ", "\n", "'s", "é", "中", "Σ", "́", "<|", "|>", "<|endoftext|>", "1", "²", "!!", "🙂", " ", "\x1c", "K", "ﬁ", "ǆ", "İ", "LONGER", ".", ","]
    for _ in range(1500):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        e = other.encode(s, add_special_tokens=False)
        assert tool.encode(s).tolist() == e.ids
        assert tool.decode(e.ids) == other.decode(e.ids, skip_special_tokens=False)
    rows = list(enumerate(texts()))
    got = {x.doc_id: x for x in bpe.round_trip(frame(spark, rows), path).collect()}
    for i, t in rows:
        ids = other.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(other.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(empty(spark), path).count() == 0


def test_bpe_cache_generations():
    made = []
    words = bpe._Words(lambda w: made.append(w) or w.encode(), 2)
    assert [words[w] for w in "abcab"] == [b"a", b"b", b"c", b"a", b"b"]
    assert made == ["a", "b", "c"]


def test_bpe_decodes_in_slices(spark):
    with open(tokenizer_path(), encoding="utf-8") as f:
        tool = bpe.Bpe(f.read())
    rows = [(i, None if i % 7 == 0 else " ".join(WORDS[: i % 6])) for i in range(2 * SLICE + 3)]
    got = {x.doc_id: x for x in bpe.round_trip(frame(spark, rows).coalesce(1), tokenizer_path()).collect()}
    for i, t in rows:
        assert got[i].decoded_sha256 == hashlib.sha256(tool.decode(tool.encode(t or "").tolist()).encode()).hexdigest()


# --- shared Python workers
def test_operators_release_what_others_keep():
    class Source:
        id = -1

    with open(tokenizer_path(), encoding="utf-8") as f:
        Source.value = f.read()
    tool = weakref.ref(bpe._tool(Source))
    tool().encode(" ".join(WORDS))
    batch = pa.RecordBatch.from_pylist([{"doc_id": 1, "text": " ".join(WORDS)}])
    (out,) = jaccard._profiles(iter([batch]))
    assert out.column("n").to_pylist() == [len(WORDS) - jaccard.SHINGLE + 1]
    assert tool() is None and not bpe._loaded and not jaccard._words
    # Another file of the same operator takes the place of the one before.
    tool, Source.id = weakref.ref(bpe._tool(Source)), -2
    assert bpe._tool(Source).encode("alpha").size and tool() is None and len(bpe._loaded) == 1


def test_sets_come_in_slices():
    rows = [f"{i} " + " ".join(WORDS[: 4 + i % 9]) for i in range(2 * SLICE + 3)]
    sids = jaccard._fingerprints([jaccard.tokens(t) for t in rows])[0]
    batch = pa.RecordBatch.from_arrays([pa.array(sids), pa.array(rows)], ["sid", "text"])
    out = list(jaccard._sets(iter([batch, batch.slice(0, 1), batch.slice(0, 0)])))
    assert max(b.num_rows for b in out) <= SLICE
    assert [x for b in out for x in b.column("sid").to_pylist()] == [*sids.tolist(), sids[0]]
    assert [np.array(x).view(np.uint64).tolist() for b in out for x in b.column("toks").to_pylist()] == [jaccard.tokens(t).tolist() for t in [*rows, rows[0]]]


# --- 8
def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, out = sum(sizes.values()), {}
    left = set(names)
    while left:
        rest = total - sum(out.values())
        w = sum(weight[s] for s in left)
        full = {s for s in left if rest * weight[s] / w > 3 * sizes[s] + 1e-9}
        if not full:
            return out | {s: rest * weight[s] / w for s in left}
        out |= {s: 3.0 * sizes[s] for s in full}
        left -= full
    return out


def test_mixing(spark):
    rows = [*enumerate(texts())]
    df = frame(spark, rows)
    got = mixing.mix_shares(df, block_words=4).collect()
    again = mixing.mix_shares(df.repartition(3), block_words=4).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    source = {r.doc_id: r.source for r in df.collect()}
    sizes = Counter()
    for i, t in rows:
        sizes[source[i]] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    for s, words in taken.items():
        assert abs(words - want[s]) <= 8
    assert mixing.mix_shares(empty(spark)).count() == 0


def test_mixed_documents_hold_the_words_taken(spark):
    for rows in ([*enumerate(texts())], [*enumerate(texts()), (3, texts()[3])]):
        df = frame(spark, rows)
        shares, texts_out = Counter(), Counter()
        for r in mixing.mix_shares(df, block_words=4).collect():
            shares[r.doc_id] += r.taken
        out = mixing.mixed_documents(df, block_words=4)
        assert out.columns == df.columns
        for r in out.collect():
            texts_out[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
            assert r.n_chars == len(r.text)
        if len(rows) == len(texts()):
            assert +shares == +texts_out
        assert sum(shares.values()) == pytest.approx(sum(texts_out.values()), abs=8)
    assert mixing.mixed_documents(empty(spark)).count() == 0


def test_permutation(spark):
    for n in (1, 2, 97):
        got = [r.p for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), 5).alias("p")).collect()]
        assert sorted(got) == list(range(n))


def test_shard_counts_add_up(spark):
    plan = mixing.targets(mixing.sized(frame(spark)), 4)
    mix = mixing.slots(plan, 64)
    counts = mixing.shard_counts(mix)
    assert counts.agg(F.sum("n")).first()[0] == plan.agg(F.sum("slots")).first()[0]
    assert counts.groupBy("shard").agg(F.sum("n").alias("n")).filter("n > 64").isEmpty()
    # Each shard's slots are those it drew, at places of its own; each source's go through its blocks pass by pass.
    draws = {(x.shard, x.pos): x.n for x in mixing.drawn(plan, 64).collect()}
    rows = mix.collect()
    assert draws == dict(Counter((x.shard, x.pos) for x in rows))
    of = {x.pos: x for x in plan.collect()}
    for pos, p in of.items():
        passes = Counter(x["pass"] for x in rows if x.pos == pos)
        assert len({(x["pass"], x.block) for x in rows if x.pos == pos}) == p.slots
        assert all(n == p.blocks for k, n in passes.items() if k < max(passes))
    for shard in {x.shard for x in rows}:
        assert sorted(x.place for x in rows if x.shard == shard) == list(range(sum(x.shard == shard for x in rows)))


def test_mixed_blocks(spark):
    df = frame(spark, [*enumerate(texts()), (3, texts()[3])])
    got = mixing.mixed_blocks(df, block_words=8, shard_slots=32).collect()
    plan = mixing.targets(mixing.sized(df), 8)
    assert len(got) == plan.agg(F.sum("slots")).first()[0]
    words, sizes, per = Counter(), Counter(), defaultdict(Counter)
    for x in df.collect():
        words[x.source] += len(re.findall(r"[^\x20\x09-\x0D]+", x.text or ""))
    for x in got:
        n = len(x.text.split(" "))
        assert n == 8 or (x.block + 1) * 8 > words[x.source]
        per[(x.source, x.block)][x.text] += 1
    assert all(len(c) == 1 and sum(c.values()) <= 3 for c in per.values())
    for (source, _), c in per.items():
        sizes[source] += len(next(iter(c)).split(" "))
    for x in plan.filter("slots >= blocks").collect():
        assert sizes[x.source] == words[x.source]
    assert mixing.mixed_blocks(empty(spark)).count() == 0


# --- 9
def test_chat_format(spark):
    rows = [(1, 0, "user", "a\\<|turn|>b"), (1, 1, "assistant", "</s>[INST] ok [/INST] \\\\|"), (1, 2, None, None), (2, 0, "assistant", "<|<|end|>\\"), (3, None, "assistant", "x"), (3, 1, "assistant", "é\n<s>"), (3, 1, "assistant", "é\n<s>"), (None, 0, "us<|body|>er", "\\")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("xs", F.lit(1))
    out = chat_format.format_conversations(df)
    got = {r.conv_id: r for r in chat_format.digests(out).collect()}
    formatted = {r.conv_id: r for r in out.collect()}
    by = defaultdict(list)
    for c, n, role, text in rows:
        by[c].append((n is not None, n or 0, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars, got[c].formatted_chars) == (len(turns), len(loss), len(formatted[c].formatted))
        assert got[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.digests(chat_format.format_conversations(df.limit(0))).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see <|image:1|>", None, None), ("image", None, "a.png", 256), ("text", " and ", None, None), ("audio", None, "b.wav", 4), ("scan", None, "c.pdf", None), (None, None, "d", 1)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {chat_format.PARTS}")
    r = chat_format.format_conversations(df, "parts").first()
    assert "see <\\|image:1|><|image:1|> and <|audio:2|><|document:3|><|document:4|>" in r.formatted
    assert [(a.ordinal, a.kind, a.ref, a.tokens) for a in r.attachments[0]] == [(1, "image", "a.png", 256), (2, "audio", "b.wav", 100), (3, "document", "c.pdf", 600), (4, "document", "d", 600)]
    assert r.attachment_tokens == 1556


def test_chat_text_parts_join(spark):
    parts = [("text", "<", None, None), ("text", None, None, None), ("text", "|end|>", None, None), ("image", None, "a", 1), ("text", "[", None, None), ("text", "INST]\\", None, None)]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", parts[:1])], f"conv_id long, turn long, role string, parts {chat_format.PARTS}")
    out = chat_format.format_conversations(df, "parts")
    r = out.select(chat_format.parse(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [(t.role, t.text) for t in r.turns] == [("assistant", "<|end|><|image:1|>[INST]\\"), ("user", "<")]
    assert r.loss == "<|end|><|image:1|>[INST]\\"


def test_chat_query_visits_parts(spark, monkeypatch):
    from sightloom.llm import registry

    seen, visit = [], chat_format.visit
    monkeypatch.setattr(chat_format, "visit", lambda parts: seen.append(parts) or visit(parts))
    got = registry.op9_chat_format(spark, "/root/testdata/sf0.001")
    assert seen and not got.isEmpty()


def test_chat_ties_go_by_text(spark):
    rows = [(1, 0, "user", "<|x"), (1, 0, "user", "<a"), (1, 0, "user", None), (1, None, "assistant", "\\"), (1, 0, None, "[INST]"), (1, 0, "user", "<a")]
    got = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    turns = got.select(chat_format.parse(F.col("formatted")).alias("t")).first()["t"]
    key = lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")
    assert [(t.role, t.text) for t in turns] == [(x[2] or "", x[3] or "") for x in sorted(rows, key=key)]


# --- 5
def brute_repeats(text):
    w = text.encode().split()
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = [False] * len(w)
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            hit[i : i + 8] = [True] * 8
    return sum(hit)


def test_quality_statistics(spark):
    r = random.Random(2)
    rows = [*enumerate(texts()), *((100 + k, " ".join(r.choice(["a", "b", "c#", "d\n", "d\n"]) for _ in range(r.randint(0, 90)))) for k in range(30))]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows] + [(None, 1, 0), (0, None, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.judged(frame(spark, rows), labels).collect()}
    for i, t in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), brute_repeats(t))
        g = got[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (len(words) < 20 or 100 * want[4] > 30 * len(words))
        assert not (g.base_failed and g.kept)
    assert quality.judged(empty(spark), labels).count() == 0
    alone = quality.judged(frame(spark), labels.limit(0)).filter("kept = base_failed")
    assert alone.isEmpty()


def test_decision_list_learns_thresholds():
    r = np.random.default_rng(1)
    n = 600
    x = {f: r.random(n) for f in quality.FEATURES}
    bad = (x["symbols_per_word"] > 0.8) | ((x["upper_share"] > 0.7) & (x["mean_word"] < 0.4))
    rules = quality.learn(x, bad, np.arange(n) % 3 != 0)
    said = np.zeros(n, bool)
    for rule in rules:
        said |= quality._covered(rule, x)
    assert (said == bad).mean() > 0.97 and len(rules) >= 2


# --- 1
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")


def brute_report(t):
    """The contract's counts and digest of one text."""
    t = t or ""
    spans = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    spans += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    spans += [(m.start(), 2, m.end()) for m in pii.CARD.finditer(t) if 14 <= len(pii._digits(m[0])) <= 19 and pii.luhn(pii._digits(m[0]))]
    spans += [(m.start(), 3, m.end()) for m in pii.PHONE.finditer(t) if 10 <= len(pii._digits(m[0])) <= 15]
    said = ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{s}:{e}" for s, k, e in sorted(spans))
    return (*(sum(k == x for _, x, _ in spans) for k in range(4)), hashlib.sha256(said.encode()).hexdigest())


def test_pii_report(spark):
    r = random.Random(14)
    parts = ["a.b@c.de", "@", "4111 1111 1111 1111", "+1 (624) 555-2408", "10.0.0.1", "300.1.1.1", "0" * 30 + "9.1.2.3", ".", "é", "\n", "token=abcd1234efgh5678", "plain words"]
    rows = [(k % 30, r.choice(["", " "]).join(r.choice(parts) for _ in range(r.randint(0, 12)))) for k in range(60)]
    rows += [(None, "mail x@y.zz"), (None, None), (3, ""), rows[5], (7, "0" * 5000 + ".1.1.1")]
    got = pii.reported(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    mine = sorted(((x.doc_id, x.n_email, x.n_ip, x.n_card, x.n_phone, x.base_sha256) for x in got), key=str)
    assert mine == sorted(((i, *brute_report(t)) for i, t in rows), key=str)
    for x in got:  # the field adds spans; base ones stay
        base = [s for s in x.spans.split(",") if s and not s.startswith("secret")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == x.base_sha256


def test_pii_takes_time_in_proportion():
    n = 200_000
    crf = pii.Crf(np.zeros((pii.FEATURES, pii.LABELS)), np.zeros((pii.LABELS, pii.LABELS)))
    long = ["a" * n + "@", "1" * n, "1." * n, "+" * n, "+1" + "(" * n, "a@" * n, "a1" * n, "x" * n + " 1", "password=" + "!" * n, "a@b.c " * (n // 6), "token=abcd1234 " * (n // 20)]
    began = time.process_time()
    for t in long:
        pii.base_spans(t)
        pii.windows(t)
    pii.secret_spans([long[8], "token=abcd1234"], crf)
    assert time.process_time() - began < 30


def test_base_spans_match_the_patterns():
    r = random.Random(4)
    parts = ["a.b@c.de", "@", "x@y", " ", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (624) 555-2408", "+", "10.0.0.1", "300.1.1.1", "1.2.3.4.5", "12", ".", "-", "é", "\n", "foo"]
    for _ in range(1500):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        want = [(m.start(), 0, m.end()) for m in EMAIL.finditer(s)]
        want += [(m.start(), 1, m.end()) for m in IP.finditer(s) if all(int(p) <= 255 for p in m[0].split("."))]
        want += [(m.start(), 2, m.end()) for m in pii.CARD.finditer(s) if 14 <= len(pii._digits(m[0])) <= 19 and pii.luhn(pii._digits(m[0]))]
        want += [(m.start(), 3, m.end()) for m in pii.PHONE.finditer(s) if 10 <= len(pii._digits(m[0])) <= 15]
        assert pii.base_spans(s) == sorted(want)


def test_crf(spark):
    crf = pii.default_crf()
    held = pii.labelled_table(seed=99)
    right = 0
    for tokens, labels in held:
        scores = crf.scores(pii.feature_ids(tokens))
        got = pii.viterbi(scores[None], np.array([len(tokens)]), crf.move)[0]
        right += list(got) == labels
    assert right / len(held) > 0.97
    texts_ = [None, "", "mail a@b.cd then password=135299847ac0e0f0dc and so on", 'the token = "0641917ea4e9feb9cda83477b57ac2654884f485" here', "call +1 (624) 555-2408 or 10.0.0.1", "plain words only, 12 of them"]
    df = frame(spark, list(enumerate(texts_)))
    got = {r.doc_id: r for r in pii.reported(df, crf).collect()}
    assert (got[2].n_email, got[2].n_secret) == (1, 1) and "secret:" in got[2].spans
    assert got[3].n_secret == 1 and got[4].n_phone == 1 and got[4].n_ip == 1
    assert got[0].spans == got[5].spans == ""
    assert got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.reported(empty(spark), crf).count() == 0


def test_every_key_word_gives_candidates():
    for key in sorted(pii.KEYS):
        for sep in ("=", ": "):
            text = f"so {key}{sep}correcthorse, then"
            assert [t for w in pii.windows(text) for t, s, _ in w if s == text.index("correct")] == ["correcthorse"], text
    crf = pii.default_crf()
    texts_ = ["the password=pass!word9 is it", "my password: abcde#fgh77.", "password=hunter99 and token=abcd1234efgh5678"]
    got = [[t[s:e] for s, e in x] for t, x in zip(texts_, pii.secret_spans(texts_, crf), strict=True)]
    assert got == [["pass!word9"], ["abcde#fgh77"], ["hunter99", "abcd1234efgh5678"]]
    assert pii._widened("x ### y", [(2, 5)]) == []


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(0)
    scores, move = r.normal(size=(1, 5, 3)), r.normal(size=(3, 3))
    from itertools import product

    worth = lambda p: sum(scores[0, i, y] for i, y in enumerate(p)) + pii._START[p[0]] + sum((move + pii._BAN)[a, b] for a, b in zip(p, p[1:], strict=False))
    assert tuple(pii.viterbi(scores, np.array([5]), move)[0]) == max(product(range(3), repeat=5), key=worth)


# --- 2
def test_automaton_finds_one_edit():
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    terms = ["moron", "idiot", "scum", "lowei*", "trash"]
    trie = toxicity.Trie(terms)
    r = random.Random(8)
    words = {"".join(r.choice("moronidtscuwe") for _ in range(r.randint(3, 8))) for _ in range(3000)} | {"m0ron", "mooron", "mron", "morons", "idiots", "idoit", "loweiß", "lowi", "scum", "scums"}
    for w in words:
        want = {}
        for k, t in enumerate(terms):
            stem, fuzzy = t.rstrip("*"), len(t.rstrip("*")) >= 5
            d = min(edits(stem, w[:n]) for n in range(len(w) + 1)) if t.endswith("*") else edits(stem, w)
            if d == 0 or d == 1 and fuzzy:
                want[k] = d
        assert trie.matches(w) == want, w


def test_lexicon_keeps_all_terms():
    counts = [(a + b + c + "x", 10, 0, 10) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    assert len(toxicity.lexicon(counts, 100, 100)) == len(counts) == 512


def test_masked_words():
    m = toxicity.Model(["stupid", "lowei*"])
    assert m.look('"st*pid,') == [(0, 1)] and m.look("l@weib") == [(1, 1)]
    assert m.look("stupid-stupid") == [(0, 0), (0, 0)] and m.look("lowei-x") == [(1, 0)] and m.look("well-known") == []


def test_toxicity_learns_and_scores(spark):
    r = random.Random(6)
    rows, labels = [(0, None), (1, ""), (2, "x " * 30_000)], []
    for i in range(10, 410):
        bad = i % 4 == 0
        words = [r.choice(WORDS) for _ in range(30)]
        if bad:
            for w in r.sample(["vilegrub", "rotwurm", "snotface"], 2):
                words[r.randrange(30)] = w
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    df = frame(spark, rows)
    got = {x.doc_id: x for x in toxicity.scored(df, lab).collect()}
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got.values())
    assert all(got[i].predicted == y for i, _, y in labels)
    import zlib

    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, x in got.items())
    assert toxicity.scored(empty(spark), lab).count() == 0
    assert all(x.score < 0.5 for x in toxicity.scored(df.limit(3), lab.limit(0)).collect())
    kept = {x.doc_id for x in toxicity.without_toxic(df, lab).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _, y in labels if y}


# --- 10
def brute_spans(texts_, width=200):
    seen = Counter(t[i : i + width] for t in texts_ for i in range(len(t) - width + 1))
    out = []
    for t in texts_:
        m = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                m[i : i + width] = b"\1" * width
        kept = bytes(x for x, y in zip(t, m, strict=True) if not y)
        out.append((len(t), sum(m), len([x for x in bytes(m).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(spark):
    r = random.Random(3)
    base = "".join(r.choice("abcdé ") for _ in range(900))
    some = ["a" * 1000, base, base[:400] + "X" + base[401:], base[100:350] + "zz" + base[300:520], "q" * 150, "", None, "ab" * 300 + "c", base, "é" * 120, "k" + "é" * 99, base[:199], base[5:205], "xy" * 90 + "z" * 300, *texts()]
    got = {x.doc_id: tuple(x)[1:] for x in suffix_dedup.without_repeats(frame(spark, list(enumerate(some)))).collect()}
    assert [got[i] for i in range(len(some))] == brute_spans([(t or "").encode() for t in some])
    assert suffix_dedup.without_repeats(empty(spark)).count() == 0


def test_suffix_dedup_with_null_ids(spark):
    r = random.Random(12)
    base, tail, other = ("".join(r.choice("abcdefgh ") for _ in range(n)) for n in (900, 300, 700))
    rows = [(None, base), (1, base), (2, base[100:500] + "X" + tail), (None, other), (None, other[:450] + "Y"), (3, other[200:600] + "Z"), (4, tail[:250])]
    want = brute_spans([t.encode() for _, t in rows])
    assert want[2][1] >= 400 and want[5][1] >= 250
    got = suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=str)


@pytest.mark.parametrize(("key_bytes", "ids"), [(500_000, 500_000), (400, 3)])
def test_suffix_dedup_of_a_frequent_passage(spark, monkeypatch, key_bytes, ids):
    """One passage in all texts, at different places and in surroundings that partly repeat; as small keys, and as large."""
    monkeypatch.setattr(suffix_dedup, "KEY_BYTES", key_bytes)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_IDS", ids)
    r = random.Random(21)
    say = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    passage, lead, tail = say(420), [say(40) for _ in range(4)], [say(25) for _ in range(3)]
    rows = [(f"d{k // 2}", say(r.randint(0, 150)) + r.choice(lead)[r.randint(0, 39) :] + passage[r.randint(0, 9) :] + r.choice(tail)[: r.randint(0, 25)] + say(r.randint(0, 90))) for k in range(60)]
    rows += [rows[3], (None, passage), (None, "ab" * 200 + passage), ("long", say(30_000) + passage + "x" * 3000)]
    want = brute_spans([t.encode() for _, t in rows])
    got = suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=str)


def test_merge_of_shards_in_small():
    r = random.Random(1)
    for _ in range(30):
        segments = [bytes(r.choice(b"ab") for _ in range(r.randint(8, 30))) for _ in range(r.randint(1, 6))]
        keys = [r.randint(0, 1) for _ in segments]
        got = suffix_dedup.merged_repeats(segments, keys, [r.randint(0, 3) for _ in segments], 8, r.choice([1, 2, 4, 8]))
        seen = Counter((k, s[i : i + 8]) for s, k in zip(segments, keys, strict=True) for i in range(len(s) - 7))
        for s, k, g in zip(segments, keys, got, strict=True):
            assert g.tolist() == [seen[(k, s[i : i + 8])] > 1 for i in range(len(s) - 7)]


# --- pipeline
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t) for i, t in enumerate(texts())]
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
        kept.write.parquet(f"{tmp_path}/{name}.parquet")
        kept = spark.read.parquet(f"{tmp_path}/{name}.parquet")
    unique = {t or "" for _, t in rows}
    assert spark.read.parquet(f"{tmp_path}/exact_dedup.parquet").count() == len(unique)
    near = brute_jaccard([(r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/exact_dedup.parquet").collect()])
    assert {r.doc_id for r in spark.read.parquet(f"{tmp_path}/jaccard_join.parquet").collect()} == {c for _, c in near.values()}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(got) == kept.count() and all(r.n_tokens == len(r.ids) for r in got)


def test_vocabulary_is_json():
    with open(tokenizer_path(), encoding="utf-8") as f:
        assert json.load(f)["model"]["type"] == "BPE"


def test_jaccard_hot_groups(spark):
    r = random.Random(5)
    common = [f"c{k}" for k in range(40)]
    base = [f"b{k}" for k in range(120)]
    rows = []
    for k in range(260):  # near copies of one text, some too far from each other; a passage that all documents hold
        if k % 2:
            words = [w if r.random() > 0.004 * (k % 9) else f"x{r.randrange(99)}" for w in base]
        else:
            words = [f"u{k % 40}-{i}" for i in range(60)] + common
        rows.append((k, " ".join(words)))
    rows += [(None, " ".join(base)), (7, "other words under a number that is there already"), (7, "other words under a number that is there already")]
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert len(got) == len(rows)
    numbered = [(k, t) for k, (_, t) in enumerate(rows)]
    brute = brute_jaccard(numbered)
    low = {}
    for k, (i, _) in enumerate(rows):
        c = brute[k][1]
        if i is not None:
            low[c] = min(low.get(c, i), i)
    assert got == sorted(((i, brute[k][0], low.get(brute[k][1])) for k, (i, _) in enumerate(rows)), key=str)
