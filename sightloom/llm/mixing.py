r"""Mixing sources to target weights by packed blocks.

Each source's words, documents one after another in a fixed pseudorandom order, are packed into blocks of block_words
words; a source's last block may be shorter, and a block may hold the ends of several documents. The mix is a sequence of
slots, shard_slots to an output shard. Each shard draws its source counts (shard, source, n): the draws are multinomial
given that all shards together meet every source's number of slots (target words over block length), that is, slots are
drawn without replacement from an urn, by a pseudorandom permutation of all slots. The counts decide what follows: running
sums give each shard its part of a source's slots, and the j-th slot of a source takes block p(j mod blocks) of pass
j div blocks, where p is the pass's own pseudorandom permutation of the source's block indexes. Blocks are joined by
(source, index).

Permutations are of the kind swap-or-not (Hoang, Morris and Rogaway, 2012): they permute any range without tables or
sorting, so that an index costs a few hashes, wherever it is computed. A source gives each block at most three times,
since targets stop at three times its size, so no document gives more than three times its words.

All steps are DataFrame operations. Word offsets come from two-level sums (buckets of a source, then documents of a
bucket), so that a source with most rows is no single task. What grows with the documents is joined by sorting: sizes that
Spark expects of exploded rows are far too small. Sources themselves are few, a row each, and are ordered in one task.

Edge cases: a null text has no words; null is a source of its own, after all others; sources without words have target
0; documents without words are taken 0 times; repeated rows are documents of their own; an empty table gives empty
results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightloom.llm.common import WORD, stash, whole

WEIGHTS = (5, 2, 1)
LIMIT = 3
BLOCK_WORDS, SHARD_SLOTS, SEED = 64, 4096, 17
BUCKET_ROWS, BUCKET_SHARDS, TASK_SLOTS = 50_000, 1024, 1 << 16
ROUNDS = 20


def permuted(index: Column, n: Column, *keys: Column | int) -> Column:
    """The place of index in a pseudorandom permutation of 0 to n - 1; the permutation depends on keys."""
    seed = F.xxhash64(*[k if isinstance(k, Column) else F.lit(k) for k in keys])

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(seed, r), n) - x, n)
        swap = F.xxhash64(F.greatest(x, other), r, seed).bitwiseAND(1) == 1
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), index, step)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size (words) of each row, and rid, a number of its own."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.regexp_count(whole(text_col), F.lit(WORD)).cast("long").alias("size"))
    return stash(rows.withColumn("rid", F.monotonically_increasing_id()), "mix-sizes")


def targets(sizes: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """source, pos, source_size, weight, target, blocks, slots and first (slot) of each source. A row for each source.

    Targets are shares min(weight * level, 3 * size) of one level: sources in order of the level at which they are
    full; the level is that of the first source which the words left over do not fill.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    names = Window.orderBy(F.col("source").asc_nulls_last())
    w = by.withColumn("pos", F.row_number().over(names)).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.col("pos") - 1, len(WEIGHTS)) + 1))
    w = w.withColumn("cap", LIMIT * F.col("source_size")).withColumn("full", F.col("cap") / F.col("weight"))
    order = Window.orderBy("full", "pos")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    w = w.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
    level = F.coalesce(F.min_by(F.when(F.col("level") <= F.col("full"), F.col("level")), F.when(F.col("level") <= F.col("full"), F.struct("full", "pos"))).over(Window.partitionBy()), F.lit(0.0))
    w = w.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * level))
    w = w.withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    w = w.withColumn("slots", F.when(F.col("source_size") > 0, F.least(LIMIT * F.col("blocks"), F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"))).otherwise(F.lit(0).cast("long")))
    first = F.coalesce(F.sum("slots").over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = w.withColumns({"first": first, "all_slots": F.sum("slots").over(Window.partitionBy())})
    return stash(out.select("source", "pos", "source_size", "weight", "target", "blocks", "slots", "first", "all_slots"), "mix-targets")


def _dealt(rows: DataFrame, plan: DataFrame, *keys: str) -> DataFrame:
    """rows in as many tasks as the mix's slots need; few rows become many where they are exploded."""
    n = plan.agg(F.max("all_slots")).first()[0] or 0
    return rows.repartition(n // TASK_SLOTS + 1, *keys)


def _running(rows: DataFrame, key: str, bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """rows with the sum of value over those before them of the same key, by bucket and then order: sums of buckets first."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(key, bucket).agg(F.sum(value).alias("_total"))
    base = F.coalesce(F.sum("_total").over(before(Window.partitionBy(key).orderBy(bucket))), F.lit(0))
    within = F.coalesce(F.sum(value).over(before(Window.partitionBy(key, bucket).orderBy(*order))), F.lit(0))
    rows = rows.withColumn(out, within).join(sums.select(key, bucket, base.alias("_base")), [key, bucket])
    return rows.withColumn(out, F.col(out) + F.col("_base")).drop("_base")


def drawn(plan: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """shard, pos, n: how many slots each output shard draws from each source."""
    # In two steps, so that a large source's slots are made by many tasks.
    step = 1 << 14
    parts = plan.filter("slots > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / step))).alias("part"))
    rows = _dealt(parts, plan, "pos", "part").select("*", F.explode(F.sequence(F.col("part") * step, F.least(F.col("slots"), (F.col("part") + 1) * step) - 1)).alias("j"))
    at = permuted(F.col("first") + F.col("j"), F.col("all_slots"), seed)
    return stash(shard_counts(rows.select("pos", F.floor(at / shard_slots).alias("shard"))), "mix-draws")


def slots(plan: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """pos, shard, place (in the shard), pass and block of each slot of the mix."""
    counts = drawn(plan, shard_slots, seed).withColumn("bucket", F.floor(F.col("shard") / BUCKET_SHARDS))
    counts = _running(counts, "pos", "bucket", ["shard"], "n", "start")
    own = Window.partitionBy("shard")
    ahead = F.coalesce(F.sum("n").over(own.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumns({"ahead": ahead, "length": F.sum("n").over(own)}).join(plan.select("pos", "blocks"), "pos")
    rows = _dealt(counts, plan, "pos", "shard").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    rows = rows.withColumn("j", F.col("start") + F.col("i"))
    rows = rows.withColumn("pass", F.floor(F.col("j") / F.col("blocks")))
    block = permuted(F.pmod("j", "blocks"), F.col("blocks"), F.lit(seed), F.col("pos"), F.col("pass"))
    place = permuted(F.col("ahead") + F.col("i"), F.col("length"), F.lit(seed), F.col("shard"), F.lit("place"))
    return rows.select("pos", "shard", place.alias("place"), "pass", block.alias("block"))


def shard_counts(mix: DataFrame) -> DataFrame:
    """shard, pos, n: how many slots each output shard draws from each source."""
    return mix.groupBy("shard", "pos").agg(F.count("*").alias("n"))


def placed(sizes: DataFrame, plan: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """rid, pos, block, size, at, lo, hi: the words lo to hi (exclusive) of a document that a block holds; at: its first word's
    number within the source."""
    buckets = max(1, sizes.count() // BUCKET_ROWS)
    # Broadcast is left to Spark's own size limit; sources are few, but nothing bounds them.
    rows = sizes.filter("size > 0").join(plan.select("source", "pos"), sizes["source"].eqNullSafe(plan["source"])).select("id", "rid", "size", "pos", F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket"))
    rows = _running(rows, "pos", "bucket", ["id", "size", "rid"], "size", "start")
    rows = rows.select("rid", "pos", "size", "start", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))).alias("block"))
    lo = F.greatest(F.lit(0), F.col("block") * block_words - F.col("start"))
    return rows.select("rid", "pos", "block", "size", F.col("start").alias("at"), lo.alias("lo"), F.least(F.col("size"), (F.col("block") + 1) * block_words - F.col("start")).alias("hi"))


def mix_shares(docs: DataFrame, *, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED, **cols: str) -> DataFrame:
    """The contract's columns: doc_id, size, source_size, target, taken; a row for each row of docs."""
    sizes = sized(docs, **cols)
    plan = targets(sizes, block_words)
    uses = slots(plan, shard_slots, seed).groupBy("pos", "block").agg(F.count("*").alias("uses"))
    taken = placed(sizes, plan, block_words).join(uses.hint("merge"), ["pos", "block"]).groupBy("rid").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("uses")).alias("taken"))
    of = plan.select(F.col("source").alias("_s"), "source_size", "target")
    out = sizes.join(taken.hint("merge"), "rid", "left").join(F.broadcast(of) if _few(of) else of, F.col("source").eqNullSafe(F.col("_s")))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_blocks(docs: DataFrame, *, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The mix itself: shard, place, source, pass, block and text of each slot. A block's text is its documents' words by
    single spaces, documents in the order in which they were packed."""
    rows = stash(docs.select(F.col("doc_id").alias("id"), "source", whole("text").alias("text")).withColumn("rid", F.monotonically_increasing_id()), "mix-rows")
    sizes = rows.select("id", "source", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"), "rid")
    plan = targets(sizes, block_words)
    cut = placed(sizes, plan, block_words).groupBy("rid", "pos").agg(F.collect_list(F.struct("block", "lo", "hi", "at")).alias("cuts"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words")
    held = rows.join(cut.hint("merge"), "rid").select("pos", words, F.explode("cuts").alias("c"))
    piece = F.array_join(F.slice("words", (F.col("c.lo") + 1).cast("int"), (F.col("c.hi") - F.col("c.lo")).cast("int")), " ")
    blocks = held.groupBy("pos", F.col("c.block").alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("c.at").alias("at"), piece.alias("t")))), lambda x: x["t"]), " ").alias("text"))
    mix = slots(plan, shard_slots, seed).join(blocks.hint("merge"), ["pos", "block"]).join(plan.select("pos", "source"), "pos")
    return mix.select("shard", "place", "source", "pass", "block", "text")


def _few(sources: DataFrame, most: int = 10_000) -> bool:
    """Whether the sources are few enough to broadcast; else Spark joins by key, and splits large partitions."""
    return sources.limit(most + 1).count() <= most


def mixed_documents(docs: DataFrame, *, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The rows of docs as the mix takes them: one for each document and pass, its text the words taken in that pass.

    A pass that takes all words of a document keeps its text as it is; else the words taken are joined by single spaces.
    n_chars, where there is one, becomes the new text's length.
    """
    rid = "_rid"
    once = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty()
    rows = docs.withColumn(rid, F.col("doc_id")) if once else stash(docs.withColumn(rid, F.monotonically_increasing_id()), "mix-rows")
    sizes = stash(rows.select(F.col("doc_id").alias("id"), "source", F.regexp_count(whole("text"), F.lit(WORD)).cast("long").alias("size"), F.col(rid).cast("long").alias("rid")), "mix-sizes")
    plan = targets(sizes, block_words)
    taken = placed(sizes, plan, block_words).join(slots(plan, shard_slots, seed).select("pos", "block", "pass").hint("merge"), ["pos", "block"])
    # A document's pieces are as many as its own words need. Own names: docs may have any column.
    passes = taken.groupBy("rid", "pass").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("_cut"), F.sum(F.col("hi") - F.col("lo")).alias("_got"), F.max("size").alias("_of"))
    passes = passes.select(F.col("rid").alias("_taken"), "_cut", "_got", "_of")
    out = rows.join(passes.hint("merge"), rows[rid] == passes["_taken"])
    words = F.regexp_extract_all(whole("text"), F.lit(WORD), F.lit(0))
    some = F.array_join(F.flatten(F.transform("_cut", lambda c: F.slice(F.col("_words"), (c["lo"] + 1).cast("int"), (c["hi"] - c["lo"]).cast("int")))), " ")
    part = F.col("_got") < F.col("_of")
    out = out.withColumn("_words", F.when(part, words)).withColumn("_text", F.when(part, some).otherwise(F.col("text")))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])
