"""Chat formatting: turns of typed parts to one training string with a loss mask, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template and the control strings that are escaped inside texts.
START, END = "<|im_start|>", "<|im_end|>\n"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
_AFTER = r"\||/?s>|<SYS>>|</SYS>>|/?INST\]"
CONTROL = rf"([<\[])(\\*)({_AFTER})"
ESCAPED = rf"([<\[])\\(\\*)({_AFTER})"
#: What one token of an attachment stands for: square pixels, milliseconds; tokens of a page.
PIXELS, MILLISECONDS, PAGE_TOKENS = 784, 40, 256
PART = "struct<kind:string,text:string,ref:string,amount:bigint>"


def escape(text: Column) -> Column:
    """Puts a backslash after the first character of every control string; those that have some get one more."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def escape_role(role: Column) -> Column:
    """Roles are one line: backslashes and line feeds are escaped too."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    halves = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(halves, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def text_parts(text: Column) -> Column:
    """A plain text as parts."""
    part = F.struct(
        F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("amount")
    )
    return F.array(part.cast(PART))


def part_text(part: Column) -> Column:
    """Visits one part: a text is escaped, an attachment becomes its placeholder; unknown kinds and NULL give nothing."""
    case = F.when(part["kind"] == "text", escape(F.coalesce(part["text"], F.lit(""))))
    for kind, mark in PLACEHOLDERS.items():
        case = case.when(part["kind"] == kind, F.lit(mark))
    return F.coalesce(case, F.lit(""))


def part_tokens(part: Column) -> Column:
    """Tokens that a placeholder expands to, one at least; NULL amounts count one."""
    amount = F.coalesce(part["amount"], F.lit(0))
    units = (
        F.when(part["kind"] == "image", F.ceil(amount / PIXELS))
        .when(part["kind"] == "audio", F.ceil(amount / MILLISECONDS))
        .otherwise(amount * PAGE_TOKENS)
    )
    return F.greatest(units.cast("long"), F.lit(1).cast("long"))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans, attachments, expanded_tokens``.

    ``parts`` is an array of ``PART``. ``loss_spans`` are ``(start, length)`` in code points of ``formatted`` and
    cover each assistant turn's body, escapes included. ``attachments`` are ``(kind, ref, start, tokens)`` in order,
    ``expanded_tokens`` their sum. Turns are ordered by turn, then role, then text, NULL first, so ties have one
    order; repeated rows stay. A NULL conv_id is a conversation of its own, NULL roles are empty, NULL or
    empty parts give an empty body. A conversation is one string, as in any chat format; its turns are numbered by a
    window and put together once, so its time grows in proportion to its turns (times a sort of them).
    """
    body = F.array_join(F.transform(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), part_text), "")
    kept = F.filter(
        F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), lambda p: p["kind"].isin("text", *PLACEHOLDERS)
    )
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            body.alias("body"),
            kept.alias("parts"),
        ).alias("t"),
    )
    head = F.concat(F.lit(START), escape_role(F.col("t.role")), F.lit("\n"))
    pieces = rows.select("conv_id", "t", head.alias("head"), F.col("t.body").alias("body")).withColumn(
        "length", F.char_length("head").cast("long") + F.char_length("body") + len(END)
    )
    before = Window.partitionBy("conv_id").orderBy(F.col("t").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long")))

    def attach(seen: Column, part: Column) -> Column:
        text = part_text(part)
        file = F.struct(part["kind"].alias("kind"), part["ref"].alias("ref"), seen["at"].alias("start"), part_tokens(part).alias("tokens"))
        return F.struct(
            (seen["at"] + F.char_length(text)).alias("at"),
            F.when(part["kind"] == "text", seen["files"]).otherwise(F.array_append(seen["files"], file)).alias("files"),
        )

    opens = F.col("start") + F.char_length("head")
    no_files = F.array().cast("array<struct<kind:string,ref:string,start:bigint,tokens:bigint>>")
    files = F.aggregate("t.parts", F.struct(opens.alias("at"), no_files.alias("files")), attach)["files"]
    span = F.struct(opens.alias("start"), F.char_length("body").cast("long").alias("length"))
    piece = F.struct(
        F.col("start"),
        F.concat("head", "body", F.lit(END)).alias("text"),
        F.when(F.col("t.role") == "assistant", span).alias("span"),
        F.when(F.exists("t.parts", lambda p: p["kind"] != "text"), files).otherwise(no_files).alias("files"),
    )
    # No piece is empty, so their starts order them.
    chats = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("ps"))
    attachments = F.flatten(F.transform("ps", lambda p: p["files"]))
    return chats.select(
        "conv_id",
        F.array_join(F.transform("ps", lambda p: p["text"]), "").alias("formatted"),
        F.filter(F.transform("ps", lambda p: p["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, f: n + f["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of ``(role, text)``, unescaped; placeholders stay as they are."""
    raw = F.split(formatted, r"<\|im_end\|>\n")
    raw = F.filter(raw, lambda x: x.startswith(START))
    raw = F.transform(raw, lambda x: F.substr(x, F.lit(len(START) + 1)))
    return F.transform(
        raw,
        lambda x: F.struct(
            unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
            unescape(F.substr(x, F.instr(x, "\n") + 1)).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped span by span.

    Spans are cut from the text in UTF-32, four bytes a code point, where a place is found without reading what is
    before it. The array of one row makes Spark encode the text once and not in each span.
    """
    one = F.array(F.struct(F.encode(formatted, "UTF-32").alias("wide"), spans.alias("spans")))

    def cut(x: Column) -> Column:
        wide, start, length = x["wide"], lambda s: (s["start"] * 4 + 1).cast("int"), lambda s: (s["length"] * 4).cast("int")
        return F.transform(x["spans"], lambda s: unescape(F.decode(F.substr(wide, start(s), length(s)), "UTF-32")))

    return F.array_join(F.flatten(F.transform(one, cut)), "")


def chat_digests(chats: DataFrame) -> DataFrame:
    """What ``op7`` returns, read back from the formatted strings."""
    back = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("ts"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    joined = F.array_join(F.transform("ts", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
