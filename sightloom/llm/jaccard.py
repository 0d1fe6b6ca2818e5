r"""N-gram Jaccard join by prefix filtering under several global token orders.

A document's set is its distinct word shingles. In any order of all tokens, two sets of Jaccard similarity t or more
share at least L tokens among their first n - ceil(t n) + L (n: a set's size; L: the smaller of both sets' reserves), so
a document whose prefix holds fewer shared tokens than that has no partner. Orders are pseudorandom bijections of the
64-bit token hashes.

1. Every text gives the prefix of its set under the first order, and the set's size and fingerprint. Equal sets are one
   class from here on. A task knows the tokens that several classes of its batch have; of each such token it sends one
   entry on, so that no token has more entries in a shuffle than there are batches.
2. Tokens that only one class has in its prefix go, then classes with too few tokens left.
3. The survivors' sets are made from their texts, once, with what later steps look at: prefixes under the other orders,
   parity sketches, and heads (keys of the first tokens under several orders each).
4. Candidates come in rounds, and are pairs of different components only. Rounds of heads: classes with one head are a
   star, so that m near copies give m - 1 candidates. Then tokens whose classes are all in one component are done; of
   the others, a pair needs one among its first n - ceil(t n) + 1. Rounds of first tokens: classes meet by one open
   token each, another one each round, and of each pair of components one pair is a candidate. They go on while they join
   components in number. What is left then are pairs of different components that share an open token, and all of these
   are looked at, a few of each pair of components at a time. Pairs within a component never come up, which keeps large groups of near copies linear.
5. A candidate must pass the bounds of sizes and parity sketches (two sets differ in at least as many tokens as their
   sketches in bits), and share L tokens in its prefixes under every other order too: the orders' filters are intersected
   on these short columns, before any set moves.
6. A pair that is left is verified on whole sets: 100 * intersection >= 100 t * union.

Rows with equal sets are never expanded into pairs; a row's component is its class's.

Edge cases: a null or empty text has the empty set, and is linked with nothing; with fewer words than a shingle the whole
sequence is the only token; repeated rows are one class; a null id takes part and has null for smallest id only if its
component has no other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightloom.llm.common import Stashes, give_back, slices, stash, take_over
from sightloom.llm.components import merge

SHINGLE, PERCENT = 5, 80
#: The reserve L of a set of n tokens is n * RESERVE // 100 + 1.
RESERVE = 8
#: Odd factors: each is a bijection of 64-bit numbers, and so a global order.
ORDERS = (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
PLACES = tuple(pow(0x5851F42D4C957F2D, k + 1, 1 << 64) | 1 for k in range(16))
SKETCH_LONGS = 8
MIX_STEP = np.uint64(0x9E3779B97F4A7C15)
#: How many heads each of the first rounds looks at.
HEADS = (2, 4, 8)
#: Orders of one head.
HEAD_ORDERS = 3
FURTHER = [np.uint64(pow(0xD1342543DE82EF95, k + 1, 1 << 64)) for k in range(HEAD_ORDERS * sum(HEADS))]
#: Rounds of first tokens go on while they join one in so many of the open components.
WORTH = 1000
BROADCAST_IDS = 500_000
KNOWN_WORDS = 500_000

_words: dict[bytes, int] = {}


def _word(w: bytes) -> int:
    h = _words.get(w)
    if h is None:
        if len(_words) >= KNOWN_WORDS:
            _words.clear()
        h = _words[w] = xxhash.xxh64_intdigest(w)
    return h


def _begin() -> None:
    take_over("jaccard", _words.clear)


def _end() -> None:
    _words.clear()
    give_back()


def _mixed(h: np.ndarray) -> np.ndarray:
    for m in MIX:
        h = (h ^ (h >> np.uint64(33))) * np.uint64(m)
    return h ^ (h >> np.uint64(33))


def tokens(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's distinct shingles, ascending."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(size, len(words))
    h = np.fromiter(map(_word, words), np.uint64, len(words))
    sums = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        sums += h[i : len(h) - k + 1 + i] * np.uint64(PLACES[i])
    return np.unique(_mixed(sums + np.uint64(k)))


def reserve(n: int) -> int:
    return n * RESERVE // 100 + 1


def needed(n: int) -> int:
    """ceil(t n): what a set of n tokens shares with a partner at least."""
    return -(-n * PERCENT // 100)


def prefix(toks: np.ndarray, order: int) -> np.ndarray:
    """The first tokens of a set under an order, as many as the filter asks for."""
    n = len(toks)
    q = min(n, n - needed(n) + reserve(n))
    if order == 1:
        return toks[:q]
    ranked = toks * np.uint64(order)
    return toks[np.argpartition(ranked, q - 1)[:q]] if 0 < q < n else toks


def sketch(toks: np.ndarray) -> np.ndarray:
    """Parities of the tokens in 64 * SKETCH_LONGS bins, as longs."""
    odd = np.bincount((toks >> np.uint64(20)).astype(np.int64) % (64 * SKETCH_LONGS), minlength=64 * SKETCH_LONGS) % 2
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_sketch(toks: np.ndarray) -> bytes:
    """As sketch, in twice as many bins as tokens or more (a power of two): long sets would fill a sketch of fixed size."""
    bins = 512
    while bins < 2 * len(toks):
        bins *= 2
    odd = np.bincount((toks >> np.uint64(20)).astype(np.int64) % bins, minlength=bins) % 2
    return np.packbits(odd.astype(np.uint8)).tobytes()


def differ(a: bytes, b: bytes) -> int:
    """In how many bins two wide sketches differ; the longer is folded, which adds parities of bins."""
    x, y = (np.frombuffer(s, np.uint8) for s in (a, b))
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def rest_of_order(toks: np.ndarray, order: int) -> bytes:
    """The prefix under an order, as sorted 32-bit remainders of its tokens."""
    return np.sort((prefix(toks, order) >> np.uint64(16)).astype(np.uint32)).tobytes()


def shared_at_most(a: bytes, b: bytes) -> int:
    """How many tokens two prefixes share, at most: those of one whose remainder the other has."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if not len(x) or not len(y):
        return 0
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def heads(toks: np.ndarray) -> np.ndarray:
    """sum(HEADS) keys; each is of the first tokens under HEAD_ORDERS further orders."""
    firsts = np.array([(toks * m).min() for m in FURTHER], np.uint64).reshape(-1, HEAD_ORDERS)
    out = np.arange(len(firsts), dtype=np.uint64)
    for first in firsts.T:
        out = _mixed(out * MIX_STEP + first)
    return out


def orders_allow(n: tuple[int, int], *others: tuple[bytes, bytes]) -> bool:
    """Whether the prefix filters of all other orders allow a link of two sets of sizes n."""
    least = min(map(reserve, n))
    return all(shared_at_most(x, y) >= least for x, y in others)


def sketches_allow(n: tuple[int, int], wide: tuple[bytes, bytes]) -> bool:
    """Whether the wide sketches do."""
    return differ(*wide) * (100 + PERCENT) <= (100 - PERCENT) * sum(n)


def _told(allow: Callable[..., bool]) -> Callable[..., Column]:
    """An Arrow function of allow, given the two sets' values side by side."""

    def of(*cols: pa.Array) -> pa.Array:
        _begin()
        pairs = [zip(a.to_pylist(), b.to_pylist(), strict=True) for a, b in zip(cols[::2], cols[1::2], strict=True)]
        return pa.array([allow(*row) for row in zip(*pairs, strict=True)], pa.bool_())

    return F.arrow_udf(of, "boolean")


def _longs(lists: list[np.ndarray]) -> pa.Array:
    ends = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *lists]).view(np.int64)))


PROFILE = "n long, sid long, check long, shared array<long>, sent array<long>"


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row's prefix: shared, the tokens that several sets of the batch have; sent, one row's of each of these,
    and all others."""
    _begin()
    for b in batches:
        sizes, marks, pre = [], [], []
        for some in slices(b.column("text")):
            sets = [tokens(t.as_py()) for t in some]
            sizes += map(len, sets)
            marks.append(_fingerprints(sets))
            # Copies, or each would keep its whole set.
            pre += [prefix(s, ORDERS[0]).copy() for s in sets]
        f1, f2 = np.hstack([np.zeros((2, 0), np.int64), *marks])
        flat = np.concatenate([np.zeros(0, np.uint64), *pre])
        owner = np.repeat(np.arange(len(pre)), [len(x) for x in pre])
        order = np.argsort(flat, kind="stable")
        start = np.ones(len(flat), bool)
        start[1:] = flat[order][1:] != flat[order][:-1]
        run = np.cumsum(start) - 1
        first = f1[owner[order]][np.flatnonzero(start)]
        many = np.zeros(len(first), bool)
        np.logical_or.at(many, run, f1[owner[order]] != first[run])
        several, lead = np.zeros(len(flat), bool), np.zeros(len(flat), bool)
        several[order], lead[order] = many[run], start
        # Copies of one set in a batch send its tokens once, too.
        ends = np.cumsum([len(x) for x in pre])[:-1]
        shared = [x[m] for x, m in zip(pre, np.split(several, ends), strict=True)] if pre else []
        sent = [x[m] for x, m in zip(pre, np.split(lead, ends), strict=True)] if pre else []
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(f1), pa.array(f2), _longs(shared), _longs(sent)], ["doc_id", *[x.split()[0] for x in PROFILE.split(", ")]])
    _end()


SETS = "sid long, n long, cut long, toks array<long>, bits array<long>, heads array<long>, wide binary, second binary, third binary"


def _fingerprints(sets: list[np.ndarray]) -> list[np.ndarray]:
    return [np.array([int(_mixed(s * np.uint64(m)).sum(dtype=np.uint64)) ^ len(s) for s in sets], np.uint64).view(np.int64) for m in ORDERS[1:]]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _begin()
    for b in (some for batch in batches for some in slices(batch)):
        sets = [tokens(t.as_py()) for t in b.column("text")]
        # Rows that share an id need not share a set.
        own = np.flatnonzero(_fingerprints(sets)[0] == b.column("sid").to_numpy())
        sets = [sets[k] for k in own]
        # cut: the last of the tokens one of which a partner has among its own such tokens.
        cuts = np.array([s[len(s) - needed(len(s))] for s in sets], np.uint64).view(np.int64)
        cols = [b.column("sid").take(pa.array(own)), pa.array([len(s) for s in sets], pa.int64()), pa.array(cuts), _longs(sets)]
        cols += [_longs([sketch(s).view(np.uint64) for s in sets]), _longs([heads(s) for s in sets]), pa.array([wide_sketch(s) for s in sets], pa.binary())]
        cols += [pa.array([rest_of_order(s, o) for s in sets], pa.binary()) for o in ORDERS[1:]]
        yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SETS.split(", ")])
    _end()


def _reserve(n: Column) -> Column:
    return F.floor(n * RESERVE / 100) + 1


def _needed(n: Column) -> Column:
    return F.ceil(n * PERCENT / 100)


def _rank(token: str) -> Column:
    """The place of a token in the first order: tokens are unsigned, and longs here are not."""
    return F.col(token).bitwiseXOR(F.lit(-(1 << 63)))


def _shared(rows: DataFrame) -> DataFrame:
    """sid, n, toks: each class's prefix tokens that other classes have, for classes with enough of them."""
    w = Window.partitionBy("token")
    # A token has at most an entry for each batch here, so no group is large.
    far = rows.select(F.explode("sent").alias("token"), "sid").repartition("token").select("token", "sid", F.min("sid").over(w).alias("one"), F.max("sid").over(w).alias("two")).filter("one <> two").select("token", "sid")
    near = rows.select(F.explode("shared").alias("token"), "sid")
    got = far.unionByName(near).groupBy("sid").agg(F.collect_set("token").alias("toks"))
    sizes = rows.groupBy("sid").agg(F.min("n").alias("n"))
    return got.join(sizes, "sid").filter(F.size("toks") >= _reserve(_needed(F.col("n")))).select("sid", "n", "toks")


def links(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets link."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _links(a: pa.Array, b: pa.Array) -> pa.Array:
    _begin()
    sets = ((x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)) for x, y in zip(a, b, strict=True))
    return pa.array([links(x, y) for x, y in sets], pa.bool_())


def _own(sets: DataFrame, pairs: DataFrame, side: str, *cols: str) -> DataFrame:
    """The rows of sets that pairs have on a side (a or b, which is what sid is called then); others need not move."""
    ids = pairs.select(F.col(side).alias("sid")).distinct()
    ids = F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
    return sets.select("sid", *cols).join(ids, "sid", "left_semi").select(F.col("sid").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in cols])


def _sided(pairs: DataFrame, sets: DataFrame, *cols: str) -> DataFrame:
    for side in "ab":
        pairs = pairs.join(_own(sets, pairs, side, *cols), side)
    return pairs


def _bounded(pairs: DataFrame, sets: DataFrame, tables: Stashes) -> DataFrame:
    """The pairs (a, b) that pass the bounds of sizes and sketches."""
    told = _told(sketches_allow)("a_n", "b_n", "a_wide", "b_wide")
    return tables.put("bounded", _sided(pairs, sets, "n", "bits", "wide").filter(_close("a", "b")).filter(told).select("a", "b"))


def _near(bounded: DataFrame, sets: DataFrame, tables: Stashes) -> DataFrame:
    """The pairs (a, b) that pass the filters of all other orders, too."""
    told = _told(orders_allow)(*[F.col(f"{side}_{c}") for c in ("n", "second", "third") for side in "ab"])
    return tables.put("near", _sided(bounded, sets, "n", "second", "third").filter(told).select("a", "b"))


def _linked(near: DataFrame, sets: DataFrame, tables: Stashes) -> DataFrame:
    """The pairs (a, b) that link."""
    whole = _sided(near, sets, "toks")
    return tables.put("edges", whole.filter(F.arrow_udf(_links, "boolean")(F.col("a_toks"), F.col("b_toks"))).select("a", "b"))


def _verified(pairs: DataFrame, sets: DataFrame, tables: Stashes) -> DataFrame:
    return _linked(_near(_bounded(pairs, sets, tables), sets, tables), sets, tables)


def _stars(entries: DataFrame, turn: int) -> DataFrame:
    """Candidates (a, b) from entries (token, sid, comp): of each token's components one member each meets one of the
    component with most members."""
    one = entries.groupBy("token", "comp").agg(F.min_by("sid", F.xxhash64("sid", F.lit(turn))).alias("sid"), F.count("*").alias("c"))
    first = one.groupBy("token").agg(F.count("*").alias("k"), F.max_by(F.struct("sid", "comp"), F.struct("c", "sid")).alias("l")).filter("k > 1")
    pairs = one.join(first.select("token", "l"), "token").filter(F.col("comp") != F.col("l.comp"))
    return pairs.select(F.least("sid", "l.sid").alias("a"), F.greatest("sid", "l.sid").alias("b")).distinct()


def _close(x: str, y: str) -> Column:
    """Whether sizes and sketches of two entries allow a link."""
    differ = None
    for i in range(SKETCH_LONGS):
        d = F.bit_count(F.col(f"{x}_bits")[i].bitwiseXOR(F.col(f"{y}_bits")[i]))
        differ = d if differ is None else differ + d
    n, m = F.col(f"{x}_n"), F.col(f"{y}_n")
    # |x - y| + |y - x| <= (100 - t) / (100 + t) * (|x| + |y|), t in hundredths.
    return (100 * n >= PERCENT * m) & (100 * m >= PERCENT * n) & (differ * (100 + PERCENT) <= (100 - PERCENT) * (n + m))


def _meeting(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, x_comp, y_comp of pairs of entries (token, sid, comp) of different components that share a token and pass
    the bounds of sizes and sketches. A pair comes up for each token that it shares, but not for one whose forerunner it
    shares, too."""
    before = F.lag("token").over(Window.partitionBy("sid").orderBy("token"))
    group = entries.withColumn("before", F.coalesce(before, "token")).join(sets.select("sid", "n", "bits"), "sid")
    x, y = (group.select("token", *[F.col(c).alias(f"{p}_{c}") for c in ("sid", "comp", "n", "bits", "before")]) for p in "xy")
    new = (F.col("x_before") != F.col("y_before")) | (F.col("x_before") == x["token"])
    met = x.join(y, (x["token"] == y["token"]) & (F.col("x_comp") < F.col("y_comp")) & new & _close("x", "y"))
    return met.select(F.least("x_sid", "y_sid").alias("a"), F.greatest("x_sid", "y_sid").alias("b"), "x_comp", "y_comp")


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n, sid and check (fingerprints of the set), and the prefix under the first order, of each row."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_profiles, f"doc_id {kind}, {PROFILE}")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, sid) of each row, and (node, comp) of each sid that has links: comp is a sid."""
    spark = docs.sparkSession
    tables = Stashes(spark, "jaccard")
    found = tables.put("profiles", profiles(docs))
    same = found.filter("n > 0").groupBy("sid").agg(F.min("check").alias("c1"), F.max("check").alias("c2"), F.min("doc_id").alias("doc_id"))
    clash = same.filter("c1 <> c2").limit(1).count()
    if clash:
        raise ValueError("two sets have one fingerprint: choose other factors in ORDERS")
    first = tables.put("first", _shared(found.filter("n > 0").select("sid", "n", "shared", "sent")))
    left = tables.put("left", first.select("sid").join(same, "sid").select("sid", "doc_id"))
    rows = stash(found.select("doc_id", "n", "sid"), "jaccard-rows")
    tables.drop("profiles")
    few = left.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    # A null id stands in for its set only where no other row does.
    texts = docs.select("doc_id", "text").join(F.broadcast(left) if few else left, docs["doc_id"].eqNullSafe(left["doc_id"])).select("sid", "text")
    sets = tables.put("sets", texts.mapInArrow(_sets, SETS))
    if sets.count() > left.count():  # an id stands in several rows
        sets = tables.put("sets", sets.dropDuplicates(["sid"]))
    labels = tables.put("labels", sets.select(F.col("sid").alias("node"), F.col("sid").alias("comp")))
    of = lambda rows: rows.join(labels, F.col("sid") == labels["node"]).select("token", "sid", "comp")
    for turn, many in enumerate(HEADS):
        entries = of(sets.select("sid", F.explode(F.slice("heads", sum(HEADS[:turn]) + 1, many)).alias("token")))
        pairs = tables.put("pairs", _stars(entries, turn))
        if not pairs.isEmpty():
            labels = merge(labels, _verified(pairs, sets, tables), tables)
    open_ = first.select("sid", F.explode("toks").alias("token")).join(sets.select("sid", "cut"), "sid").filter(_rank("token") <= _rank("cut"))
    turn = len(HEADS)
    while True:
        entries = of(open_.select("token", "sid"))
        ends = entries.groupBy("token").agg(F.min("comp").alias("one"), F.max("comp").alias("two")).filter("one <> two").select("token")
        open_ = tables.put("open", entries.join(ends, "token"))
        if turn < 0:
            break
        firsts = open_.groupBy("sid").agg(F.min_by("token", F.xxhash64("token", F.lit(turn))).alias("token"), F.min("comp").alias("comp"))
        some = _meeting(firsts, sets).groupBy("x_comp", "y_comp").agg(F.min_by(F.struct("a", "b"), F.xxhash64("a", "b")).alias("p")).select("p.a", "p.b")
        edges = _verified(tables.put("pairs", some), sets, tables)
        joined, components = edges.count(), open_.select("comp").distinct().count()
        labels = merge(labels, edges, tables)
        turn = turn + 1 if joined and joined * WORTH >= components else -1
    rest = tables.put("rest", _meeting(open_, sets).select("a", "b").distinct())
    rest = tables.put("rest", _bounded(rest, sets, tables))
    one, two = (F.col("comp").alias(f"{side}_comp") for side in "ab")
    many = 1
    while True:
        # Of each pair of components one candidate, then four times as many each round, until none is left: where
        # components join at once, sets move for few pairs.
        of_a, of_b = labels.select(F.col("node").alias("a"), one), labels.select(F.col("node").alias("b"), two)
        rest = tables.put("rest", rest.join(of_a, "a").join(of_b, "b").filter("a_comp <> b_comp").select("a", "b", "a_comp", "b_comp"))
        if rest.isEmpty():
            break
        ends = [F.least("a_comp", "b_comp").alias("u"), F.greatest("a_comp", "b_comp").alias("v")]
        turn = F.row_number().over(Window.partitionBy(*ends).orderBy(F.xxhash64("a", "b"), "a", "b"))
        some = tables.put("pairs", rest.withColumn("turn", turn).filter(F.col("turn") <= many).select("a", "b"))
        many *= 4
        labels = merge(labels, _linked(_near(some, sets, tables), sets, tables), tables)
        rest = rest.select("a", "b").join(some, ["a", "b"], "left_anti")
    labels = stash(labels, "jaccard-labels")
    tables.drop()
    return rows, labels


def linked(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_shingles, component_id; a row for each row of docs."""
    rows, labels = classes(docs)
    own = rows.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    comp = own.join(labels, own["sid"] == labels["node"], "left").select("sid", "copies", F.coalesce("comp", "sid").alias("comp"), "first")
    low = comp.groupBy("comp").agg(F.min("first").alias("component_id"), F.sum("copies").alias("size"))
    # Rows that are alone need no join: only classes of more rows, or with links, are looked up.
    known = stash(comp.join(low.filter("size > 1"), "comp").select(F.col("sid").alias("_sid"), "component_id"), "jaccard-components")
    out = rows.join(known, (rows["sid"] == F.col("_sid")) & (rows["n"] > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without those that have a smaller id in their component; a null id stays only where its component has no other."""
    if docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        gone = linked(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
        return docs.join(gone, docs["doc_id"] == F.col("_gone"), "left_anti")
    # Ids do not tell rows apart: components are of row numbers, and their smallest ids are looked up.
    rows = stash(docs.withColumn("_rid", F.monotonically_increasing_id()), "jaccard-numbered")
    comps = linked(rows.select(F.col("_rid").alias("doc_id"), "text")).select(F.col("doc_id").alias("_gone"), "component_id")
    known = stash(rows.select("_rid", "doc_id").join(comps, F.col("_rid") == F.col("_gone")).select("_gone", "component_id", "doc_id"), "jaccard-ids")
    low = known.groupBy("component_id").agg(F.min("doc_id").alias("least"))
    gone = known.join(low, "component_id").filter(~F.col("doc_id").eqNullSafe(F.col("least"))).select("_gone")
    return rows.join(gone, F.col("_rid") == F.col("_gone"), "left_anti").select(*docs.columns)
