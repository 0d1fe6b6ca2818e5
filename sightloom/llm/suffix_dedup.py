r"""Repeated byte strings by merged Burrows-Wheeler transforms.

Bytes covered by a string of WIDTH bytes that starts anywhere else too are found exactly:

1. Every text is cut into runs of window starts: all windows of WIDTH bytes whose smallest GRAM-byte hash has one value
   are a run, and its segment is the bytes they cover. Equal windows have equal smallest hashes, so only segments of one
   key (that hash) can share a window. Keys with one segment are over: nothing in them repeats.
2. Segments that occur twice or more as a whole repeat in all their windows.
3. The other segments of keys with several go, one representative of each, to the tasks of their keys. A task takes keys
   of BATCH_BYTES together. Documents belong to SHARDS shards; a task sorts each shard's suffixes once into its
   Burrows-Wheeler transform (eight bytes are one symbol), and merges the shards' transforms by refining their interleave
   (Holt and McMillan, 2014): in round k a stable distribution by symbol of what precedes each suffix orders the merged
   suffixes by 8k bytes, while block borders give the common prefixes. After WIDTH / 8 rounds the blocks with two
   suffixes or more are the repeated intervals. Suffixes alone in their block leave; no suffix is compared or sorted again.
4. A key whose segments are more than KEY_BYTES (a passage in very many surroundings) goes to no task whole. Windows of a
   key fall into blocks by their distance to the key's place, and all windows of a block have a core of bytes in common:
   blocks with a core of their own are over, blocks that are equal as a whole repeat, and of what is left, windows meet
   by their own hashes. All of these are aggregations with rows in proportion to the segments, and exact as 2 is.

Edge cases: a null text is empty; texts below WIDTH bytes lose nothing; windows never cross documents; overlapping
repeats of one text with itself count; equal rows are documents of their own, so both lose all that they share; ids may
be of any type, null or repeated; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightloom.llm.common import Stashes, stash, whole

WIDTH, GRAM = 200, 32
BATCH_BYTES, KEY_BYTES = 500_000, 500_000
SHARDS, BLOCK, SYMBOL = 4, 16, 8
BROADCAST_IDS = 500_000
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
RUNS = "k long, tk long, at long, starts long, v long, twice long, seg long"


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place, by doubling."""
    h = b.astype(np.uint64) + np.uint64(1)
    step = 1
    while step < GRAM:
        h = h[:-step] * MIX[0] + (h[step:] ^ (h[step:] >> np.uint64(29))) * MIX[1]
        step *= 2
    h ^= h >> np.uint64(32)
    h *= MIX[1]
    return h ^ (h >> np.uint64(29))


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of width values from each place, by doubling."""
    m, step = h, 1
    while 2 * step <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    rest = width - step
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def runs(data: bytes, width: int = WIDTH) -> list[tuple[int, int, int, int, int]]:
    """(first start, number of starts, key, whether the key stands in it twice, hash of the segment) of each run of a text.

    Only a run whose key stands in it twice can have equal windows of its own.
    """
    if len(data) < width:
        return []
    h = gram_hashes(np.frombuffer(data, np.uint8))
    v = window_minima(h, width - GRAM + 1)
    edges = np.flatnonzero(v[1:] != v[:-1]) + 1
    first = np.concatenate([[0], edges])
    last = np.concatenate([edges, [len(v)]])
    keys = v[first].view(np.int64)
    twice = [int(np.count_nonzero(h[a : b + width - GRAM] == v[a]) > 1) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    seg = [xxhash.xxh3_64_intdigest(data[a : b + width - 1]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    return list(zip(first.tolist(), (last - first).tolist(), keys.tolist(), twice, np.array(seg, np.uint64).view(np.int64).tolist(), strict=True))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, cols = [], [[], [], [], [], []]
        for k, t in enumerate(b.column("text")):
            found = runs((t.as_py() or "").encode("utf-8", "surrogatepass"))
            ids += [k] * len(found)
            for col, values in zip(cols, zip(*found, strict=True), strict=False):
                col += values
        at = pa.array(ids, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("k").take(at), b.column("tk").take(at), *[pa.array(c, pa.int64()) for c in cols]], [x.split()[0] for x in RUNS.split(", ")])


def sorted_shard(text: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """A shard's suffixes in the order of their first width bytes; ends: where each one's segment ends.

    Seven bytes at once, then by doubling; only suffixes that are equal so far are looked at again. A rank is the place
    of the first suffix that is equal so far.
    """
    n, step = len(text), 7
    left = ends - np.arange(n, dtype=np.int32)
    padded = np.concatenate([text, np.zeros(step, text.dtype)])
    key = np.zeros(n, np.int64)
    for i in range(step):
        key = key << 9 | np.where(left > i, padded[i : n + i], 0)
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    rank = np.empty(n, np.int32)
    at = np.arange(n, dtype=np.int32)
    while len(at):
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        first = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        rank[order[at]] = first
        if step >= width:
            break
        same = ~new
        same[:-1] |= ~new[1:]
        at, first = at[same], first[same]
        some = order[at]
        after = np.zeros(len(at), np.int64)
        far = left[some] > step
        after[far] = rank[some[far] + step] + 1
        key = first.astype(np.int64) * (n + 1) + after
        move = np.argsort(key, kind="stable")
        order[at], key = some[move], key[move]
        step *= 2
    return order


def _by_symbol(symbols: np.ndarray) -> np.ndarray:
    """A stable order by symbols, 16 bits at a time."""
    move = np.argsort(symbols.astype(np.uint16), kind="stable")
    if len(symbols) and int(symbols.max()) >> 16:
        move = move[np.argsort((symbols[move] >> 16).astype(np.uint16), kind="stable")]
    return move


def merged_repeats(segments: list[bytes], keys: list[int], shards: list[int], width: int = WIDTH, wide: int = SYMBOL) -> list[np.ndarray]:
    """For each segment, which window starts have the same width (a multiple of wide) bytes as another start of a segment of its key.

    shards: each segment's. Shards' transforms stand one after another, and are merged.
    """
    order = sorted(range(len(segments)), key=lambda k: shards[k])
    # Every segment is followed by a mark, whose suffix is where its last window's round ends. Bytes are numbered from 2.
    sizes = np.array([len(segments[k]) + 1 for k in order])
    raw = np.frombuffer(b"".join(segments[k] + b"\0" for k in order), np.uint8)
    text = raw.astype(np.uint16) + np.uint16(2)
    stop = np.cumsum(sizes).astype(np.int32)
    text[stop - 1] = 1
    n, first = len(text), stop - sizes.astype(np.int32)
    ends = np.repeat(stop, sizes)
    # Each shard's suffix order; merged suffixes are numbered by shard and rank, as entries of the transforms.
    own = np.array([shards[k] for k in order])
    borders = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    suffix = np.empty(n, np.int32)
    for a, b in zip(first[borders].tolist(), [*first[borders[1:]].tolist(), n], strict=True):
        suffix[a:b] = a + sorted_shard(text[a:b], ends[a:b] - a, width)
    number = np.empty(n, np.int32)
    number[suffix] = np.arange(n, dtype=np.int32)
    # The transform: the symbol before each suffix (wide bytes, numbered), and the suffix that starts with it.
    has = suffix - np.repeat(first, sizes)[suffix] >= wide
    before = np.full(n, -1, np.int32)
    before[has] = number[suffix[has] - wide]
    packed = np.zeros(n, np.uint64)
    for i in range(wide):
        packed[: n - i] = packed[: n - i] << np.uint64(8) | raw[i:]
    symbol = np.zeros(n, np.uint32)
    symbol[has] = np.unique(packed[suffix[has] - wide], return_inverse=True)[1]
    del number, has, packed
    _, ranks = np.unique(np.array([keys[k] for k in order], np.int64), return_inverse=True)
    group = np.repeat(ranks.astype(np.int32), sizes)[suffix]
    # Depth 0: the interleave is shard after shard, and a key's suffixes are one block.
    inter = np.argsort(group, kind="stable").astype(np.int32)
    block = group[inter]
    del group
    for _ in range(width // wide):
        go = before[inter] >= 0
        prior, sym, blk = before[inter[go]], symbol[inter[go]], block[go]
        move = _by_symbol(sym)
        # Blocks of a key stay apart as the blocks of their suffixes do.
        prior, sym, blk = prior[move], sym[move], blk[move]
        border = np.ones(len(prior), bool)
        border[1:] = (sym[1:] != sym[:-1]) | (blk[1:] != blk[:-1])
        ids = np.cumsum(border, dtype=np.int32) - 1
        many = np.bincount(ids, minlength=1)[ids] > 1 if len(ids) else border
        inter, block = prior[many], ids[many]
        if not len(inter):
            break
    hit = np.zeros(n, bool)
    hit[suffix[inter]] = True
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(segments)
    for k, a, b in zip(order, first.tolist(), stop.tolist(), strict=True):
        out[k] = hit[a : b - width]
    return out


BLOCKS = "v long, core long, same long, k long, tk long, lo long, starts long, wins array<long>"


def blocks(seg: bytes, v: int, width: int = WIDTH) -> list[tuple[int, int, int, int, list[int]]]:
    """(core, whole, first start, starts, windows' hashes) of the blocks of a segment of key v.

    A window belongs to the first place of v within it, and to a block by its distance to that place. All windows that a
    block can have hold its core, so equal windows are in blocks with equal cores.
    """
    b = np.frombuffer(seg, np.uint8)
    places = np.flatnonzero(gram_hashes(b).view(np.int64) == v)
    starts = np.arange(len(seg) - width + 1)
    place = places[np.searchsorted(places, starts)]
    near = (place - starts) // BLOCK
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (near[1:] != near[:-1])])).tolist()
    out = []
    for s, e in zip(first, [*first[1:], len(starts)], strict=True):
        at = int(place[s] - near[s] * BLOCK)
        core = xxhash.xxh3_64_intdigest(seg[at : at + width - BLOCK + 1], int(near[s]))
        wins = [xxhash.xxh3_64_intdigest(seg[o : o + width]) for o in range(s, e)]
        out.append((core, xxhash.xxh3_64_intdigest(seg[s : e + width - 1]), s, e - s, wins))
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    signed = lambda x: np.array(x, np.uint64).view(np.int64)
    for b in batches:
        for i in range(0, b.num_rows, 1000):
            part = b.slice(i, 1000)
            rows = [(k, *x) for k, (seg, v) in enumerate(zip(part.column("seg"), part.column("v").to_pylist(), strict=True)) for x in blocks(seg.as_py(), v)]
            if not rows:
                continue
            of, cores, same, lo, starts, wins = zip(*rows, strict=True)
            of = pa.array(of, pa.int64())
            ends = np.concatenate([[0], np.cumsum([len(w) for w in wins])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(signed([h for w in wins for h in w])))
            at = part.column("at").take(of).to_numpy() + np.array(lo)
            cols = [part.column("v").take(of), pa.array(signed(cores)), pa.array(signed(same)), part.column("k").take(of), part.column("tk").take(of), pa.array(at), pa.array(starts, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in BLOCKS.split(", ")])


def _hot_spans(cut: DataFrame, tables: Stashes) -> DataFrame:
    """As the merge finds them, for the segments (k, tk, at, v, seg) of large keys."""
    rows = tables.put("blocks", cut.mapInArrow(_blocks, BLOCKS))
    key = ["v", "core", "same"]
    own = rows.groupBy(*key).agg(F.count("*").alias("c"), F.min(F.struct("k", "tk", "lo")).alias("r"), F.first("wins").alias("wins"))
    own = tables.put("cores", own)
    span = lambda starts: (F.col("lo") + starts + WIDTH - 1).alias("hi")
    equal = rows.join(own.filter("c > 1").select(*key), key, "left_semi").select("k", "tk", "lo", span(F.col("starts")))
    ragged = own.join(own.groupBy("v", "core").agg(F.count("*").alias("d")).filter("d > 1").select("v", "core"), ["v", "core"])
    wins = ragged.select("v", "r.k", "r.tk", F.posexplode("wins").alias("i", "win"), F.col("r.lo").alias("at"))
    wins = tables.put("windows", wins.select("v", "win", "k", "tk", (F.col("at") + F.col("i")).alias("lo")))
    twice = wins.groupBy("v", "win").agg(F.count("*").alias("c")).filter("c > 1").select("v", "win")
    return equal.unionByName(wins.join(twice, ["v", "win"], "left_semi").select("k", "tk", "lo", span(F.lit(1))))


def _spans(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Runs of bytes covered by windows from starts (true where one is repeated)."""
    at = np.flatnonzero(np.diff(np.concatenate([[0], starts.view(np.int8), [0]])))
    return [(int(a), int(b) + width - 1) for a, b in zip(at[::2], at[1::2], strict=True)]


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeated windows. Rows come by key; a batch ends between keys."""
    rows: list[tuple] = []
    size = 0

    def done() -> pa.RecordBatch:
        found = merged_repeats([r[5] for r in rows], [r[3] for r in rows], [r[4] for r in rows])
        spans = [(r[0], r[1], r[2] + a, r[2] + b) for r, f in zip(rows, found, strict=True) for a, b in _spans(f, WIDTH)]
        return pa.RecordBatch.from_arrays([pa.array([s[i] for s in spans], pa.int64()) for i in range(4)], ["k", "tk", "lo", "hi"])

    for b in batches:
        for row in zip(*(b.column(c) for c in ("k", "tk", "at", "v", "shard", "seg")), strict=True):
            row = tuple(x.as_py() for x in row)
            if size >= BATCH_BYTES and row[3] != rows[-1][3]:
                yield done()
                rows, size = [], 0
            rows.append(row)
            size += len(row[5])
    if rows:
        yield done()


def _numbered(docs: DataFrame) -> DataFrame:
    """docs' id, k and tk (hashes of id and text, which tell rows apart as far as spans go) and text."""
    return docs.select("doc_id", F.xxhash64("doc_id").alias("k"), whole("text").alias("text")).withColumn("tk", F.xxhash64("text"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """k, tk (hashes of id and text), lo, hi: byte spans that repeated strings cover. Spans may overlap."""
    tables = Stashes(docs.sparkSession, "suffix")
    texts = _numbered(docs).select("k", "tk", "text")
    found = tables.put("runs", texts.filter(F.octet_length("text") >= WIDTH).mapInArrow(_runs, RUNS))
    segs = found.groupBy("v", "seg").agg(F.count("*").alias("c"), F.min(F.struct("k", "tk", "at", "starts", "twice")).alias("r"))
    segs = tables.put("segs", segs.select("v", "seg", "c", "r.*"))
    several = segs.groupBy("v").agg(F.count("*").alias("d"), F.max("twice").alias("twice"), (F.sum(F.col("starts") + WIDTH - 1) > KEY_BYTES).alias("hot"))
    several = several.filter("d > 1 or twice = 1").select("v", "hot")
    equal = segs.filter("c > 1").select("v", "seg")
    spans = found.join(equal, ["v", "seg"], "left_semi").select("k", "tk", F.col("at").alias("lo"), (F.col("at") + F.col("starts") + WIDTH - 1).alias("hi"))
    spans = stash(spans, "suffix-equal")
    ragged = segs.join(several, "v").groupBy("k", "tk").agg(F.collect_list(F.struct("at", "starts", "v", "hot")).alias("cuts"))
    ragged = tables.put("ragged", ragged)
    tables.drop("runs", "segs")
    ids = ragged.select("k").distinct()
    some = texts.join(F.broadcast(ids), "k", "left_semi") if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else texts
    data = F.col("text").cast("binary")
    cut = some.dropDuplicates(["k", "tk"]).join(ragged, ["k", "tk"]).select("k", "tk", "text", F.explode("cuts").alias("c"))
    seg = F.substring(data, (F.col("c.at") + 1).cast("int"), (F.col("c.starts") + WIDTH - 1).cast("int"))
    cut = tables.put("cut", cut.select("k", "tk", F.col("c.at").alias("at"), F.col("c.v").alias("v"), F.col("c.hot").alias("hot"), seg.alias("seg")))
    tables.drop("ragged")
    shard = F.pmod(F.xxhash64("tk"), F.lit(SHARDS)).alias("shard")
    cold = cut.filter(~F.col("hot")).select("k", "tk", "at", "v", shard, "seg").repartition("v").sortWithinPartitions("v")
    more = stash(cold.mapInArrow(_repeats, "k long, tk long, lo long, hi long"), "suffix-merged")
    hot = cut.filter("hot").drop("hot")
    if not hot.isEmpty():
        more = more.unionByName(stash(_hot_spans(hot, tables), "suffix-hot"))
    tables.drop()
    return spans.unionByName(more)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256; a row for each row of docs."""
    spans = repeated_spans(docs)
    # Maximal runs: a span begins one where it starts after the end of all before it.
    w = Window.partitionBy("k", "tk").orderBy("lo", "hi")
    top = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.distinct().withColumn("new", (top.isNull() | (F.col("lo") > top)).cast("int"))
    marked = marked.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole_runs = marked.groupBy("k", "tk", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    per = stash(whole_runs.groupBy("k", "tk").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("gone")), "suffix-spans")
    rows = _numbered(docs)
    n = F.octet_length("text").cast("long")
    ids = per.select("k").distinct()
    none = lambda df: df.select("doc_id", n.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        # Texts that lose nothing need not move.
        clean, some = rows.join(F.broadcast(ids), "k", "left_anti"), rows.join(F.broadcast(ids), "k", "left_semi")
    else:
        clean, some = None, rows
    data = F.col("text").cast("binary")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("gone", lambda x: x["hi"]))
    stops = F.concat(F.transform("gone", lambda x: x["lo"]), F.array(F.octet_length("text").cast("long")))
    kept = F.zip_with(starts, stops, lambda a, b: F.substring(data, (a + 1).cast("int"), (b - a).cast("int")))
    joined = some.join(per, ["k", "tk"], "left")
    hit = joined.filter("gone is not null").select("doc_id", n.alias("n_bytes"), F.aggregate("gone", F.lit(0).cast("long"), lambda a, x: a + x["hi"] - x["lo"]).alias("n_removed"), F.size("gone").cast("long").alias("n_spans"), F.sha2(F.unhex(F.array_join(F.transform(kept, F.hex), "")), 256).alias("kept_sha256"))
    out = hit.unionByName(none(joined.filter("gone is null")))
    return out if clean is None else out.unionByName(none(clean))
