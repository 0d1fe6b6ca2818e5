"""Exact deduplication through content-defined chunk recipes.

Each text is cut after some of its sentences: those whose own hash says so, whatever stands before or after,
so that equal passages give equal chunks from their second sentence on wherever they stand, and an insertion changes the
chunk that it falls into and the next at most. Longer chunks are cut at MAX_CHUNK. Chunks are deduplicated to identifiers: a 64-bit
hash and a length, and an ordinal that tells apart different chunks which share both. The registry that verifies this
groups by the chunk itself, so that a chunk's characters cross the network once, after map-side combining. A document
is then its ordered list of identifiers, and documents are compared by these short lists alone.

All steps are DataFrame operations. Groups of copies are aggregated map-side; joining the decision back is a plain
equi-join whose large partitions adaptive execution may split.

Edge cases: null counts as the empty text, whose recipe is the empty list; repeated rows (same id, same text) are
counted one by one in group_size and all carry kept = true when their id is the group's largest; a null id is kept only
if its group has no other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightloom.llm.common import sha256_hex, stash, whole

MIN_CHUNK, MAX_CHUNK = 1024, 8192
#: One in so many characters is the end of a sentence, about.
SENTENCE = 64
#: Stands after a chunk before texts are split. A text's own \\x01 and \\x02 are written as two other characters.
_CUT, _OWN = "\x02", {"\x01": "\x01\x03", "\x02": "\x01\x04"}


def _chunks(text: Column, least: int, most: int) -> Column:
    """A text's chunks, of least characters about. Put together they are the text (with _OWN written so) and a full stop.

    A sentence ends at a full stop: splitting at one character needs no pattern.
    """
    for c, written in _OWN.items():
        text = F.replace(text, F.lit(c), F.lit(written))
    ends = lambda s: F.pmod(F.xxhash64(s), F.lit(max(1, least // SENTENCE))) == 0
    marked = F.transform(F.split(text, r"\."), lambda s: F.when(ends(s), F.concat(s, F.lit("." + _CUT))).otherwise(F.concat(s, F.lit("."))))
    cut = F.filter(F.split(F.array_join(marked, ""), _CUT), lambda c: c != "")
    short = lambda c: F.when(F.length(c) > most, F.regexp_extract_all(c, F.lit(rf"(?s).{{1,{most}}}"), F.lit(0))).otherwise(F.array(c))
    return F.when(text == "", F.filter(F.array(F.lit("")), lambda c: c != "")).otherwise(F.flatten(F.transform(cut, short)))


def _hash(chunk: Column, bits: int) -> Column:
    h = F.xxhash64(chunk)
    return h if bits == 64 else h.bitwiseAND((1 << bits) - 1)


def _ordinals(rows: DataFrame) -> DataFrame | None:
    """(h, n, chunk, ord) of chunks whose hash and length are another chunk's too; None where there is no such pair."""
    registry = rows.groupBy("h", "n", "chunk").agg(F.count("*").alias("uses"))
    shared = registry.groupBy("h", "n").agg(F.count("*").alias("k")).filter("k > 1").select("h", "n")
    shared = stash(shared, "chunk-collisions")
    if shared.isEmpty():
        return None
    w = Window.partitionBy("h", "n").orderBy("chunk")
    return rows.select("h", "n", "chunk").distinct().join(shared, ["h", "n"]).withColumn("ord", F.row_number().over(w))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK, hash_bits: int = 64) -> DataFrame:
    """id, text_sha256 and recipe array<struct<h,n,ord>> of each row. Equal texts have equal recipes, and no others do.

    hash_bits is there for tests: few bits force collisions.
    """
    base = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    cut = _chunks(F.col("text"), min_chunk, max_chunk)
    ident = lambda c: F.struct(_hash(c, hash_bits).alias("h"), F.length(c).alias("n"))
    rows = base.select(F.explode(cut).alias("chunk")).select(_hash(F.col("chunk"), hash_bits).alias("h"), F.length("chunk").alias("n"), "chunk")
    ordinals = _ordinals(rows)
    plain = F.transform(cut, lambda c: F.struct(*[ident(c)[x].alias(x) for x in ("h", "n")], F.lit(1).alias("ord")))
    if ordinals is None:
        return base.select("id", sha256_hex(F.col("text")).alias("text_sha256"), plain.alias("recipe"))
    numbered = stash(base.withColumn("row", F.monotonically_increasing_id()), "chunk-rows")
    parts = numbered.select("row", F.posexplode(cut).alias("pos", "chunk")).select("row", "pos", _hash(F.col("chunk"), hash_bits).alias("h"), F.length("chunk").alias("n"), "chunk")
    parts = parts.join(ordinals, ["h", "n", "chunk"], "left").select("row", "pos", "h", "n", F.coalesce("ord", F.lit(1)).alias("ord"))
    lists = parts.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "h", "n", "ord"))).alias("l"))
    empty = F.expr("filter(array(named_struct('h', 0L, 'n', 0, 'ord', 0)), x -> false)")
    short = F.transform("l", lambda x: F.struct(x["h"].alias("h"), x["n"].alias("n"), x["ord"].alias("ord")))
    return numbered.join(lists, "row", "left").select("id", sha256_hex(F.col("text")).alias("text_sha256"), F.coalesce(short, empty).alias("recipe"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256. Of equal texts the largest id stays."""
    known = stash(recipes(docs, id_col, text_col, **options).withColumn("key", F.xxhash64("recipe")), "recipes")
    groups = known.groupBy("key", "recipe").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    # Without the recipe where the key is enough would be shorter, but lists are what decides.
    joined = known.join(groups.withColumnsRenamed({"recipe": "same"}), (known["key"] == groups["key"]) & (F.col("recipe") == F.col("same")), "left")
    size = F.coalesce("group_size", F.lit(1))
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(F.col("id").alias(id_col), keep.alias("keep_id"), size.cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_duplicates drops."""
    # By id and text: an id may stand in rows with different texts, and copies may have null ids.
    dropped = exact_duplicates(docs, id_col, text_col).filter(~F.col("kept")).select(F.col(id_col).alias("_dropped"), F.col("text_sha256").alias("_dropped_sha256"))
    rows = docs.withColumn("_text_sha256", sha256_hex(whole(text_col)))
    return rows.join(dropped, rows[id_col].eqNullSafe(F.col("_dropped")) & (F.col("_text_sha256") == F.col("_dropped_sha256")), "left_anti").select(*docs.columns)
