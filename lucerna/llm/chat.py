"""Chat formatting with typed content parts, as DataFrame expressions only.

A turn is a list of parts.  The visitor below has one rule for each type: text is escaped; image,
audio and document parts become ordered placeholders, while their references and expanded token
counts go to the attachments.  Control strings inside texts are escaped reversibly, so the marks
of the template never come from a text, and reading back needs no other input than the output.

Neighbouring text parts of a turn are one text before anything is escaped, so a control string that is
spread over parts is escaped like any other.

Rows and edge cases: a null text is empty, a null role is an empty role, a null conversation id is a
conversation of its own, repeated rows are turns of their own (rows of equal turn number follow in
the order of role and text as they were given, rows without a number come last); other columns are
ignored; an empty table gives nothing.  A whole
conversation is one string, hence one value of one row: that is the format itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, ROLE_END, CLOSE = "### ", ": ", "</turn>"
#: Control string -> its escape; the backslash comes first when escaping and last when reading.
ESCAPES = {"###": "\\h", "</turn>": "\\t", "<|": "\\p"}
#: Tokens for one unit of size: a tile of an image, a second of audio, a page of a document.
EXPANSION = {"image": 256, "audio": 50, "document": 512}
PARTS = "array<struct<type:string,text:string,ref:string,size:bigint>>"
PLACED = "array<struct<type:string,text:string,ref:string,size:bigint,i:int>>"
ATTACHED = "array<struct<placeholder:string,type:string,ref:string,tokens:bigint>>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control, code in ESCAPES.items():
        out = F.replace(out, F.lit(control), F.lit(code))
    return out


def unescape(text: Column) -> Column:
    """Escaped backslashes are split off first, so what is left of a backslash starts a code."""

    def codes(piece: Column) -> Column:
        for control, code in ESCAPES.items():
            piece = F.replace(piece, F.lit(code), F.lit(control))
        return piece

    return F.array_join(F.transform(F.split(text, r"\\\\"), codes), "\\")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit(":"), F.lit("\\c")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    piece = lambda x: F.replace(F.replace(x, F.lit("\\c"), F.lit(":")), F.lit("\\n"), F.lit("\n"))
    return unescape(F.array_join(F.transform(F.split(role, r"\\\\"), piece), "\\\\"))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def joined(parts: Column) -> Column:
    """The parts with their places (``i``); neighbouring text parts are one."""
    null = F.lit(None)
    numbered = F.transform(parts, lambda p, i: F.struct(p["type"].alias("type"), p["text"].alias("text"), p["ref"].alias("ref"), p["size"].alias("size"), i.alias("i")))

    def add(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(F.lit("text").alias("type"), F.concat(F.coalesce(last["text"], F.lit("")), F.coalesce(part["text"], F.lit(""))).alias("text"), null.cast("string").alias("ref"), null.cast("bigint").alias("size"), last["i"].alias("i"))
        one = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))
        return F.when((F.size(done) > 0) & _is_text(part) & _is_text(last), one).otherwise(F.concat(done, F.array(part)))

    return F.aggregate(numbered, F.array().cast(PLACED), add)


def visit(parts: Column, turn: Column) -> tuple[Column, Column]:
    """(flattened text, attachments) of placed parts, in order, each by the rule of its type."""
    holder = lambda x: F.concat(F.lit("<|"), F.replace(escape_role(x["type"]), F.lit("|"), F.lit("\\b")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit("")), F.lit("."), x["i"].cast("string"), F.lit("|>"))
    flat = F.transform(parts, lambda x: F.when(_is_text(x), escape(F.coalesce(x["text"], F.lit("")))).otherwise(holder(x)))

    def tokens(x: Column) -> Column:
        per = F.lit(0)
        for kind, n in EXPANSION.items():
            per = F.when(x["type"] == kind, F.lit(n)).otherwise(per)
        return (per * F.coalesce(x["size"], F.lit(1))).cast("long")

    attached = F.transform(F.filter(parts, lambda x: ~_is_text(x)), lambda x: F.struct(holder(x).alias("placeholder"), x["type"].alias("type"), x["ref"].alias("ref"), tokens(x).alias("tokens")))
    return F.array_join(flat, ""), attached


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row for each conversation: formatted text, loss spans, attachments and their tokens.

    ``turns`` has conv_id, turn, role and either ``parts`` (type PARTS) or ``text``.  A loss span is
    (segment, start, length) in code points of the segment, the part of the output up to a close mark.
    """
    typed = "parts" in turns.columns
    given = joined(F.coalesce(F.col("parts").cast(PARTS), F.array().cast(PARTS))) if typed else F.coalesce(F.col("text"), F.lit(""))
    t = turns.select("conv_id", F.struct(F.col("turn").isNull().alias("unnumbered"), "turn", F.coalesce("role", F.lit("")).alias("role"), given.alias("given")).alias("x"))
    t = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("t"))

    def laid(x: Column) -> Column:
        body, attached = visit(x["given"], x["turn"]) if typed else (escape(x["given"]), F.array().cast(ATTACHED))
        return F.struct((x["role"] == "assistant").alias("loss"), F.concat(F.lit(OPEN), escape_role(x["role"]), F.lit(ROLE_END)).alias("head"), body.alias("body"), attached.alias("attached"))

    t = t.select("conv_id", F.transform("t", laid).alias("t"))
    segments = F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE)))
    spans = F.filter(
        F.transform("t", lambda x, i: F.struct(i.alias("segment"), (F.char_length(x["head"]) + 1).alias("start"), F.char_length(x["body"]).alias("length"), x["loss"].alias("loss"))),
        lambda s: s["loss"],
    )
    attachments = F.flatten(F.transform("t", lambda x: x["attached"]))
    return t.select(
        "conv_id",
        F.array_join(segments, "").alias("formatted"),
        F.transform(spans, lambda s: F.struct(s["segment"].alias("segment"), s["start"].alias("start"), s["length"].alias("length"))).alias("loss"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("attachment_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and loss_text, from ``formatted`` and ``loss`` alone."""
    pieces = F.split(F.col("formatted"), CLOSE)
    f = formatted.withColumn("__s", F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))))
    head = F.lit(len(OPEN) + 1)

    def read(s: Column) -> Column:
        end = F.instr(s, ROLE_END)
        return F.struct(unescape_role(F.substr(s, head, end - head)).alias("role"), unescape(F.substr(s, end + F.lit(len(ROLE_END)))).alias("text"))

    under = F.transform("loss", lambda x: unescape(F.substr(F.element_at(F.col("__s"), x["segment"].cast("int") + 1), x["start"], x["length"])))
    return f.select("conv_id", F.transform("__s", read).alias("turns"), F.array_join(under, "").alias("loss_text"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def chat_digests(turns: DataFrame) -> DataFrame:
    """Digests of every conversation, read back from its formatted output."""
    r = read_back(format_conversations(turns))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return r.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
