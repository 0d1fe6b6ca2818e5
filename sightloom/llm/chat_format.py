r"""Chat formatting with typed content parts.

A turn's content is a list of parts, array<struct<kind, text, ref, units>>: kind is text, image, audio or document. The
visitor goes through the parts in order. Text parts side by side are joined and written with control strings escaped; any
other part leaves a numbered placeholder in the text, an attachment record (ordinal, kind, ref, tokens) and its expanded token count.

Template: <|turn|>ROLE<|body|>TEXT<|end|> for every turn, joined without anything between. Loss falls on the bodies of
assistant turns. Escaping is reversible: each backslash is doubled, and one is put after the first character of whatever
looks like a control string (of this template or of other widespread ones), so that no text can open or close a turn.

All steps are DataFrame operations; a conversation's turns meet in one row, since its formatted text is one value.

Edge cases: null text and null role are empty; turns with equal numbers follow by role, then text; null turn numbers
come first; a null conv_id is one conversation; repeated rows are turns of their own; unknown part kinds count as
documents; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightloom.llm.common import sha256_hex, whole

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Tokens that one unit of a part stands for: image patches of 14 x 14 pixels, seconds of audio, pages of a document.
UNIT_TOKENS = {"image": 1, "audio": 25, "document": 600}
PARTS = "array<struct<kind:string,text:string,ref:string,units:bigint>>"

#: The place after the first character of a control string: <| or </s> or <s> or [INST] or [/INST] or a placeholder.
_CONTROL = r"(?<=<)(?=\||/?s>)|(?<=\[)(?=/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def text_part(text: Column) -> Column:
    """A text as a list of one typed part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).alias("ref"), F.lit(None).alias("units"))).cast(PARTS)


def visit(parts: Column) -> Column:
    """struct<text, attachments> of a list of parts: the escaped text with placeholders, and what they stand for."""
    kind = lambda p: F.when(p["kind"].isin(*UNIT_TOKENS), p["kind"]).otherwise(F.lit("document"))
    is_text = lambda p: p["kind"].eqNullSafe(F.lit("text"))
    rate = lambda p: F.element_at(F.create_map(*[F.lit(x) for kv in UNIT_TOKENS.items() for x in kv]), kind(p))
    known = F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p.isNotNull())
    others = F.filter(known, lambda p: ~is_text(p))
    attachments = F.transform(others, lambda p, i: F.struct((i + 1).alias("ordinal"), kind(p).alias("kind"), p["ref"].alias("ref"), (F.coalesce(p["units"], F.lit(1)) * rate(p)).cast("long").alias("tokens")))

    # Text parts side by side are one text: a control string may lie across their border.
    def step(acc: Column, p: Column) -> Column:
        n = acc["n"] + 1
        place = F.concat(acc["done"], escape(acc["run"]), F.lit("<|"), kind(p), F.lit(":"), n.cast("string"), F.lit("|>"))
        more = F.struct(acc["done"].alias("done"), F.concat(acc["run"], whole(p["text"])).alias("run"), acc["n"].alias("n"))
        return F.when(is_text(p), more).otherwise(F.struct(place.alias("done"), F.lit("").alias("run"), n.alias("n")))

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("run"), F.lit(0).alias("n"))
    text = F.aggregate(known, start, step, lambda acc: F.concat(acc["done"], escape(acc["run"])))
    return F.struct(text.alias("text"), attachments.alias("attachments"))


def format_conversations(turns: DataFrame, parts_col: str | None = None) -> DataFrame:
    """conv_id, formatted, loss_spans, attachments, attachment_tokens of each conversation.

    turns has conv_id, turn, role and text, or in place of text the typed parts in parts_col. loss_spans are offsets in
    code points, end exclusive, of the assistant bodies within formatted. attachments are per turn.
    """
    # Turns are put in order by what they say, before anything is escaped.
    content = F.col(parts_col) if parts_col else text_part(F.col("text"))
    rows = turns.select("conv_id", F.struct("turn", whole("role").alias("role"), content.alias("parts")).alias("x"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    seen = F.transform("xs", lambda x: F.struct(x["role"].alias("role"), visit(x["parts"]).alias("v")))
    convs = convs.select("conv_id", seen.alias("xs")).select("conv_id", F.transform("xs", lambda x: F.struct(x["role"].alias("role"), x["v"]["text"].alias("body"), x["v"]["attachments"].alias("files"))).alias("xs"))
    head = lambda x: F.concat(F.lit(TURN), escape(x["role"]), F.lit(BODY))
    formatted = F.array_join(F.transform("xs", lambda x: F.concat(head(x), x["body"], F.lit(END))), "")
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + F.length(head(x))
        last = first + F.length(x["body"])
        spans = F.when(x["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct(first.alias("start"), last.alias("end"))))).otherwise(acc["spans"])
        return F.struct((last + len(END)).alias("at"), spans.alias("spans"))

    spans = F.aggregate("xs", start, step, lambda acc: acc["spans"])
    tokens = F.aggregate(F.flatten(F.transform("xs", lambda x: x["files"])), F.lit(0).cast("long"), lambda a, f: a + f["tokens"])
    return convs.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"), F.transform("xs", lambda x: x["files"]).alias("attachments"), tokens.alias("attachment_tokens"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns of a formatted conversation, unescaped."""
    turn = rf"(?s)<\|turn\|>(.*?)<\|body\|>(.*?)<\|end\|>"
    roles, bodies = (F.regexp_extract_all(formatted, F.lit(turn), F.lit(g)) for g in (1, 2))
    return F.transform(F.arrays_zip(roles.alias("role"), bodies.alias("text")), lambda x: F.struct(unescape(x["role"]).alias("role"), unescape(x["text"]).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """What lies under the loss mask, unescaped, joined without anything between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def digests(out: DataFrame) -> DataFrame:
    """The contract's digest columns, read back from format_conversations' output."""
    read = out.withColumns({"turns": parse(F.col("formatted")), "loss": loss_text(F.col("formatted"), F.col("loss_spans"))})
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha256_hex(joined).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        sha256_hex(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
