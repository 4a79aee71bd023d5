r"""Chat formatting by prefix-target expansion, in DataFrame functions alone.

Every assistant turn becomes an example of its own: all preceding turns are its context and
only that reply is trainable. expanded() has a row for each, with its whole context and its
reply as they are written: [0, target_start) and [target_start, target_end) of the
conversation's stream, in code points. Turns after the last reply, or all where there is none,
follow in a closing row without a target, so the last row of a conversation holds all of it.
Rows are made one at a time from turns kept once: memory follows a conversation's length, the
time to write its contexts out the square of it.

A turn is written `<|turn|>role\ntext<|end|>\n`. Inside roles and texts `\` becomes `\0`, `<`
becomes `\1`, `[` becomes `\2` and, in roles, a newline becomes `\3`: no control string of this
or a common other template survives inside a text, and the change is undone exactly.

Defined cases: null roles and texts are empty, null turns come first, ties of a turn are
ordered by role and text (repeated rows all stay), a null conv_id is one conversation, a
conversation without assistant turns has a stream, a closing row and no examples; an empty table
gives no rows; other columns are ignored. A conversation is one row of streams(), as its digest
needs it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\0")), F.lit("<"), F.lit("\\1")), F.lit("["), F.lit("\\2"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\2"), F.lit("[")), F.lit("\\1"), F.lit("<")), F.lit("\\0"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\3"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\3"), F.lit("\n")))


def placed(conversations: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """Every turn as it is written, with its place: conv_id, turn, role, place (0, 1 ...), head, body, start, start_octet, trained.

    start is the code point of the conversation's stream where the turn begins, start_octet the
    octet of its UTF-8, running sums over the turns before it.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    # dealt before anything is derived, so that all that is made of the turns shares one shuffle
    dealt = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("raw")).repartition("conv_id")
    head, body = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n")), escape(F.col("raw"))
    turns = dealt.withColumns({"trained": F.col("role") == trained_role, "head": head, "body": body})
    inside = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "raw")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = {name: length("head").cast("long") + length("body") + len(CLOSE) for name, length in (("start", F.char_length), ("start_octet", F.octet_length))}
    return turns.withColumns({name: F.sum(size).over(running) - size for name, size in sizes.items()} | {"place": F.row_number().over(inside) - 1}).drop("raw")


def gathered(turns: DataFrame) -> DataFrame:
    """conv_id, pieces (all turns of placed() in order, as written), replies (place, turn, ranges and size of the head of each)."""
    piece = F.struct("place", F.concat("head", "body", F.lit(CLOSE)).alias("text"))
    head = F.char_length("head")
    start, mask = F.col("start") + head, F.col("start_octet") + F.octet_length("head")
    reply = F.struct(
        "place", "turn", start.alias("target_start"), (start + F.char_length("body")).alias("target_end"), mask.alias("mask_start"), (mask + F.octet_length("body")).alias("mask_end"), head.alias("head")
    )
    return turns.groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list(piece)), lambda p: p["text"]).alias("pieces"), F.sort_array(F.collect_list(F.when(F.col("trained"), reply))).alias("replies")
    )


def streams(turns: DataFrame) -> DataFrame:
    """conv_id and stream, all turns of placed() in order."""
    return gathered(turns).select("conv_id", F.array_join("pieces", "").alias("stream"))


def expanded(turns: DataFrame) -> DataFrame:
    """placed() expanded: conv_id, example, target_turn, context_turns, context_chars, target_start, target_end, mask_start, mask_end, context, target, closing, last.

    A row for each reply, with all that stands before it and the reply, as they are written; a
    closing row holds as its context a conversation that ends otherwise, its target is null.
    last marks the row that holds the whole conversation. The mask is the target's range in
    octets, which a reader of UTF-8 needs not count code points for.
    """
    n = F.size("pieces")
    whole = F.array_join("pieces", "")
    end, octets = F.char_length(whole).cast("long"), F.octet_length(whole).cast("long")
    rest = F.struct(
        n.alias("place"), F.lit(None).cast("long").alias("turn"), end.alias("target_start"), end.alias("target_end"), octets.alias("mask_start"), octets.alias("mask_end"), F.lit(0).alias("head")
    )
    ends_trained = F.coalesce(F.try_element_at("replies", F.lit(-1))["place"] == n - 1, F.lit(False))
    # a lambda inside keeps the generator out of compiled stages, which would hold all contexts of a conversation at once
    marks = lambda x: F.struct(*(x[c].alias(c) for c in ("place", "turn", "target_start", "target_end", "mask_start", "mask_end", "head")), (x["place"] == n).alias("closing"), (x["place"] >= n - 1).alias("last"))
    each = gathered(turns).select("conv_id", "pieces", F.explode(F.transform(F.when(ends_trained, F.col("replies")).otherwise(F.concat("replies", F.array(rest))), marks)).alias("x"))
    own, size = F.get("pieces", F.col("x.place")), (F.col("x.target_end") - F.col("x.target_start")).cast("int")
    before = F.array_join(F.slice("pieces", F.lit(1), F.col("x.place")), "")
    return each.select(
        "conv_id", F.col("x.place").alias("example"), F.col("x.turn").alias("target_turn"), F.col("x.place").cast("long").alias("context_turns"), F.col("x.target_start").alias("context_chars"), "x.target_start", "x.target_end", "x.mask_start", "x.mask_end",
        F.concat(before, F.coalesce(F.substr(own, F.lit(1), F.col("x.head")), F.lit(""))).alias("context"), F.substr(own, F.col("x.head") + 1, size).alias("target"), "x.closing", "x.last",
    )


def examples(turns: DataFrame) -> DataFrame:
    """The rows of expanded() that have a reply, without the marks of closing and last ones."""
    return expanded(turns).filter(~F.col("closing")).drop("closing", "last")


def written() -> Column:
    """The text of a row of expanded() or examples(): everything up to and with the reply's end mark."""
    return F.concat("context", F.coalesce(F.concat("target", F.lit(CLOSE)), F.lit("")))


def inline(turns: DataFrame) -> DataFrame:
    """Examples as one text each, with the range of the reply in it."""
    return examples(turns).select("conv_id", "example", "target_turn", written().alias("text"), F.col("target_start").alias("loss_start"), F.col("target_end").alias("loss_end"))


def read_back(stream: Column) -> Column:
    """The turns (role, text) that a reader of a stream finds."""
    chunks = F.filter(F.split(stream, "<\\|turn\\|>", -1), lambda c: c != "")
    return F.transform(
        chunks,
        lambda c: F.struct(
            unescape_role(F.substring_index(c, "\n", 1)).alias("role"),
            unescape(F.substr(c, F.instr(c, F.lit("\n")) + 1, F.char_length(c) - F.instr(c, F.lit("\n")) - len(CLOSE))).alias("text"),
        ),
    )


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = placed(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra))
    rows = expanded(turns).withColumn("text", written())
    told = F.array_join(F.transform(read_back(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.substr(F.col("text").cast("binary"), (F.col("mask_start") + 1).cast("int"), (F.col("mask_end") - F.col("mask_start")).cast("int")).cast("string")
    # what is read of a row is small, the row is not: only this is gathered
    read = rows.select(
        "conv_id", F.when(~F.col("closing"), F.struct("example", unescape(masked).alias("text"))).alias("reply"), F.when(~F.col("closing"), F.col("context_chars")).alias("before"),
        *(F.when(F.col("last"), c).alias(n) for n, c in (("n", F.size(read_back(F.col("text"))).cast("long")), ("turns", F.sha2(told.cast("binary"), 256)), ("chars", F.char_length("text").cast("long")))),
    )
    whole = read.groupBy("conv_id").agg(
        F.max("n").alias("n_turns"), F.max("turns").alias("turns_sha256"), F.max("chars").alias("formatted_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list("reply")), lambda r: r["text"]), "").alias("loss"),
        F.count("reply").alias("n_examples"), F.coalesce(F.sum("before"), F.lit(0)).alias("context_chars"),
    )
    return whole.select(
        "conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "n_examples", "context_chars"
    )


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
h AS (SELECT *, length(role) + length(regexp_replace(role, '[^\\<\[\n]', '', 'g')) + 9 AS head, length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g')) AS body FROM c),
e AS (SELECT *, head + body + 8 AS n, sum(head + body + 8) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) - body - 8 AS before FROM h)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples, coalesce(sum(before) FILTER (role = 'assistant'), 0)::BIGINT AS context_chars
FROM e GROUP BY conv_id
"""
