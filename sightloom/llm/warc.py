r"""WARC archives: writing records, and reading them back by verified boundary chains.

Writing. Equal payloads are found by digest and length; the row with the largest id becomes the response and the others
revisit it. A record is one line of Spark's text writer with the record terminator as the line separator, so that the
committer's guarantees hold when executors are lost, in gzip files of at most max_records records.

Reading. The text reader splits the files at the version line, wherever it occurs: each piece is a candidate record,
also where the version line stands inside a payload. A task turns each candidate into its offset and, from its header's
Content-Length, its successor's offset. Pointer jumping from each file's start then keeps the candidates that are
reachable: in round k every pointer leads 2**k records ahead, so that a file of n records takes log2(n) rounds, each an
equi-join of offsets. Pieces that are not reachable belong to the payload of the record before them.

A file is one gzip member; readers that seek by record need one a record, which Spark's writer does not make.

Edge cases: a null payload is empty; a null id is written as an empty record id and read as null, and is a response unless
a row with an id has its payload; rows with the largest id and one payload are all responses; a repeated id with other
payloads has a record of its own for each; records with a broken
header end their file's chain, and pieces after them are reported by nobody; an empty table writes no record and reads
back as an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightloom.llm.common import Stashes, new_path, stash, whole

VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PIECE = "file string, block long, seq long, local long, piece binary"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base 32 of the SHA-1 of a binary or string column (160 bits are 32 digits, so there is no padding)."""
    digest = F.sha1(payload.cast("binary"))
    parts = []
    for k in range(0, 40, 10):
        bits = F.conv(F.substring(digest, k + 1, 10), 16, 10).cast("long")
        parts += [F.lit(BASE32).substr((F.shiftright(bits, 35 - 5 * i).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for i in range(8)]
    return F.concat(*parts)


def records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int = 0) -> DataFrame:
    """id, url, payload, bytes, digest and refers_to (null: a response) of each row."""
    rows = pages.select(F.col(id_col).alias("id"), whole(url_col).alias("url"), whole(payload_col).alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": base32_sha1(F.col("payload")), "full": F.sha2(F.col("payload").cast("binary"), 256)})
    first = rows.select("id", "bytes", "full").filter(F.col("bytes") >= least_bytes).groupBy("full", "bytes").agg(F.max("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    revisits = stash(rows.select("id", "bytes", "full").join(first, ["full", "bytes"]).filter("id < first or id is null").select(F.col("id").alias("rid"), F.xxhash64("full", "bytes").alias("rkey"), F.col("first").alias("refers_to")).distinct(), "warc-revisits")
    # By id and payload: an id may stand in several rows.
    same = rows["id"].eqNullSafe(revisits["rid"]) & (F.xxhash64("full", "bytes") == F.col("rkey"))
    return rows.join(revisits, same, "left").drop("rid", "rkey", "full")


def _header(fields: dict[str, Column]) -> Column:
    lines = [F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit("\r\n")) for k, v in fields.items()]
    return F.concat(*[F.coalesce(x, F.lit("")) for x in lines], F.lit("\r\n"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", *, least_bytes: int = 0, max_records: int = 20_000, date: str | None = None) -> str:
    """Writes a record for each row of pages below path, and returns path. date: WARC-Date of all records, or now."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = records(pages, id_col, url_col, payload_col, least_bytes)
    again = F.col("refers_to").isNotNull()
    body = F.when(again, "").otherwise(F.col("payload"))
    clean = F.regexp_replace("url", r"[\r\n]", "")
    head = _header(
        {
            "WARC-Type": F.when(again, "revisit").otherwise("response"),
            "WARC-Record-ID": F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">")),
            "WARC-Date": F.lit(date),
            "WARC-Target-URI": clean,
            "WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.col("digest")),
            "WARC-Refers-To": F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">")),
            "WARC-Profile": F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            "Content-Type": F.lit("text/html; charset=utf-8"),
            "Content-Length": F.octet_length(body),
        }
    )
    lines = rows.select(F.concat(F.lit(VERSION), head, body).alias("value"))
    lines.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max_records).text(path)
    return path


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Numbers a split's pieces and gives each the bytes before it within the split. A task reads splits one by one."""
    now, seq, at = None, 0, 0
    gap = len(VERSION)
    for b in batches:
        seqs, locs = [], []
        for key, piece in zip(zip(b["file"], b["block"], strict=True), b["piece"], strict=True):
            if key != now:
                now, seq, at = key, 0, 0
            seqs.append(seq)
            locs.append(at)
            seq, at = seq + 1, at + len(piece) + gap
        yield b.assign(seq=seqs, local=locs)[["file", "block", "seq", "local", "piece"]]


HEAD = re.compile(rb"\A((?:[!-9;-~]+:[^\r\n]*\r\n)+)\r\n", re.S)
HEADERS = {b"warc-type": "kind", b"warc-record-id": "id", b"warc-target-uri": "url", b"warc-payload-digest": "digest", b"warc-refers-to": "refers_to", b"content-length": "length"}
CANDIDATE = "file string, block long, seq long, local long, size long, head long, kind string, id string, url string, digest string, refers_to string, length long"


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in _pieces(batches):
        rows = []
        for file, block, seq, local, piece in b.itertuples(index=False):
            row = dict.fromkeys(HEADERS.values())
            m = HEAD.match(piece)
            for line in m[1].split(b"\r\n") if m else ():
                k, _, v = line.partition(b":")
                if name := HEADERS.get(k.lower()):
                    row[name] = v.strip().decode("utf-8", "replace")
            n = row["length"]
            rows.append((file, block, seq, local, len(piece), len(m[0]) if m else None, row["kind"], row["id"], row["url"], row["digest"], row["refers_to"], int(n) if n and n.isdigit() else None))
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in CANDIDATE.split(", ")])
        yield out.astype({"head": "Int64", "length": "Int64"})


def _split(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", VERSION).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("local"), F.col("value").cast("binary").alias("piece"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """The candidate records below path: file, off, next (null: no valid header), and what the header says.

    A piece's text begins after its version line. The first piece of a file is what stands before the first version
    line (nothing, in a sound file); offsets of splits after the first come from the sizes of those before.
    """
    found = stash(_split(spark, path).mapInPandas(_candidates, CANDIDATE), "warc-candidates")
    # Paths are long, and every round would move them: files get numbers.
    files = stash(found.select("file").distinct().select(F.col("file").alias("path"), F.monotonically_increasing_id().alias("number")), "warc-files")
    found = found.join(files, F.col("file") == F.col("path")).drop("file").withColumnRenamed("number", "file")
    sizes = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(VERSION)).alias("total"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    rows = found.join(base, ["file", "block"])
    # The version line of a piece ends where the piece's text begins.
    off = F.col("base") + F.col("local") - len(VERSION)
    end = off + len(VERSION) + F.col("head") + F.col("length") + len(END)
    return rows.withColumns({"off": off, "next": end})


def reachable(links: DataFrame) -> DataFrame:
    """file, off of the records that the chain from offset 0 of each file reaches. links: file, off, next."""
    tables = Stashes(links.sparkSession, "warc")
    nodes = links.filter("next is not null and off >= 0").select("file", "off", "next")
    # A pointer to an offset at which no candidate stands (the file's end, in a sound file) leads nowhere: null.
    there = nodes.select("file", F.col("off").alias("next"), F.lit(True).alias("there"))
    jumps = tables.put("jumps", nodes.join(there, ["file", "next"], "left").select("file", "off", F.when(F.col("there"), F.col("next")).alias("next")))
    reached = tables.put("reached", jumps.filter("off = 0").select("file", "off"))
    most = jumps.groupBy("file").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    rounds = math.ceil(math.log2(max(1, most)))
    for k in range(rounds):
        ahead = reached.join(jumps.filter("next is not null"), ["file", "off"]).select("file", F.col("next").alias("off"))
        # Pointers of 2 ** k records from what 2 ** k - 1 steps reach lead to records not reached before.
        reached = tables.put("reached", reached.unionByName(ahead))
        if k < rounds - 1:
            far = jumps.select("file", F.col("off").alias("next"), F.col("next").alias("then"))
            jumps = tables.put("jumps", jumps.filter("next is not null").join(far, ["file", "next"]).select("file", "off", F.col("then").alias("next")))
    tables.drop("jumps")
    return reached


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, off, kind, id, url, digest, refers_to and payload (binary) of each record below path."""
    found = stash(candidates(spark, path), "warc-offsets")
    good = reachable(found).withColumn("good", F.lit(True))
    w = Window.partitionBy("file").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    marked = found.join(good, ["file", "off"], "left").withColumn("owner", F.last(F.when(F.col("good"), F.col("off")), ignorenulls=True).over(w))
    owned = stash(marked.filter("owner is not null").drop("base", "next", "size", "good"), "warc-owned")
    heads = owned.filter("off = owner")
    split = heads.join(owned.filter("off > owner").select("file", "owner").distinct(), ["file", "owner"], "left_semi").select("file", "owner").withColumn("more", F.lit(True))
    texts = _split(spark, path).mapInPandas(_pieces, PIECE)
    # A record in one piece needs its own piece alone; only those whose payload holds a version line are put together.
    texts = texts.withColumnRenamed("file", "path")
    key = ["path", "block", "seq"]
    single = heads.join(split, ["file", "owner"], "left_anti").join(texts, key).withColumn("whole", F.col("piece"))
    parts = owned.join(split, ["file", "owner"], "left_semi").select(*key, "file", "owner", "off").join(texts, key)
    joined = parts.groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("off", "piece"))).alias("l"))
    text = F.aggregate("l", F.lit(b""), lambda a, x: F.when(F.length(a) == 0, x["piece"]).otherwise(F.concat(a, F.lit(VERSION.encode()), x["piece"])))
    several = heads.join(joined.select("file", "owner", text.alias("whole")), ["file", "owner"])
    cols = ["file", "off", "kind", "id", "url", "digest", "refers_to", F.expr("substring(whole, cast(head + 1 as int), cast(length as int))").alias("payload")]
    return single.select(*cols).unionByName(several.select(*cols))


def _number(col: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(col), F.lit("")), r"<urn:page:(-?[0-9]+)>", 1)


def pages_of(read: DataFrame) -> DataFrame:
    """The contract's columns, read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    long = lambda c: F.when(_number(c) != "", _number(c).cast("long"))
    own = F.when(F.col("kind") == "revisit", F.regexp_replace("digest", "^sha1:", "")).otherwise(base32_sha1(F.col("payload")))
    rows = stash(read.select(long("id").alias("page_id"), F.col("kind").alias("record_type"), long("refers_to").alias("refers_to"), F.length("payload").cast("long").alias("n"), own.alias("d")), "warc-pages")
    # A revisit's payload is that of the response with its digest, among the responses of the page that it names.
    full = rows.filter("record_type = 'response'").select(F.col("page_id").alias("to"), F.col("n").alias("full_n"), F.col("d").alias("full_d")).dropDuplicates(["to", "full_d"])
    out = rows.filter("record_type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = rows.filter("record_type = 'revisit'").join(full, (F.col("refers_to") == F.col("to")) & (F.col("d") == F.col("full_d"))).select("page_id", F.col("full_n").alias("payload_bytes"), F.col("full_d").alias("payload_digest"), "record_type", "refers_to")
    return out.unionByName(again)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    return pages_of(read_warc(spark, write_warc(pages, new_path(spark, "warc"))))
