"""Chat formatting: turns become training text with a loss mask, in Spark
expressions only.

The turns of a conversation are collected as structs and sorted; adjacent
turns of a role are merged into one block by slicing the array where the role
changes; blocks are concatenated between control strings:

    [SYS] text [/SYS]    [INST] text [/INST]     text </s>    [ROLE] name[TURN]text [/ROLE]

for system, user, assistant and any other role; merged texts have [TURN]
between them. Where a text holds a control string, escaped or not, a backslash
more goes behind its first character; reading back takes one off, so every
text survives and no text can open or close a turn. The loss mask is a list of
(start, length) spans of code points, one for each assistant text.

A long conversation is formatted in parts by turn number, PART_TURNS numbers
each, so that no task collects an unbounded conversation; the parts joined in
order are its text, and a block ends where its part does.

Defined results: turns are ordered by turn (null first), then role and text;
repeated rows are turns of their own, and those of one turn number share its
part; a null text is empty; a null role reads as an empty name; a row without
conv_id is a conversation of its own, of that one turn; an empty table gives
no rows; other columns don't matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salespanel.llm.common import bound, broadcast_if_small, keep_columns, table, written

#: Turn numbers of a part, as a power of two.
PART_BITS = 10
BLOCK_TAGS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
OTHER_TAGS = ("[ROLE] ", " [/ROLE]")
NEXT = "[TURN]"
#: Every control string is [ or < and one of these, none of which holds either.
REST = r"/?(?:SYS|INST|ROLE)\]|TURN\]|/?s>"
BLOCK = r"(?s)(?:\[SYS\]|\[INST\]|\[ROLE\]|) (.*?) (\[/SYS\]|\[/INST\]|\[/ROLE\]|</s>)"
#: Reckoned bytes of an id in a broadcast.
ID_BYTES = 64

#: The planted conversation of the query.
PLANTED = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([\[<])(\\*)({REST})", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([\[<])\\(\\*)({REST})", "$1$2$3")


def _tag(role: Column, k: int) -> Column:
    out = F.lit(OTHER_TAGS[k])
    for name, tags in BLOCK_TAGS.items():
        out = F.when(role == name, F.lit(tags[k])).otherwise(out)
    return out


def merged(turns: Column) -> Column:
    """Runs of adjacent turns of a role: an array of (role, texts) from a sorted array of (turn, role, text)."""
    starts = lambda t: F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (
        F.get(t, i)["role"] != F.get(t, i - 1)["role"]))
    blocks = lambda t, s: F.transform(s, lambda at, k: F.struct(
        F.get(t, at)["role"].alias("role"),
        F.transform(F.slice(t, at + 1, F.coalesce(F.get(s, k + 1), F.size(t)) - at), lambda x: x["text"]).alias("texts")))
    return bound(turns, lambda t: bound(starts(t), lambda s: blocks(t, s)))


def _known(role: Column) -> Column:
    return role.isin(*BLOCK_TAGS)


def pieces(blocks: Column) -> Column:
    """The formatted text as an array of (text, learn): tags, texts and whether the loss counts them."""
    def of_block(b: Column) -> Column:
        role = b["role"]
        opening = F.when(_known(role), _tag(role, 0)).otherwise(F.concat(F.lit(OTHER_TAGS[0]), escaped(role), F.lit(NEXT)))
        tag = lambda c: F.struct(c.alias("text"), F.lit(False).alias("learn"))
        body = F.flatten(F.transform(b["texts"], lambda t, i: F.array(
            tag(F.when(i == 0, opening).otherwise(F.lit(NEXT))), F.struct(escaped(t).alias("text"), (role == "assistant").alias("learn")))))
        return F.concat(body, F.array(tag(_tag(role, 1))))
    return F.flatten(F.transform(blocks, of_block))


def loss_spans(parts: Column) -> Column:
    """(start, length) in code points of the pieces that the loss counts; empty ones too."""
    span = lambda at, p: F.array(F.struct(at.alias("start"), F.char_length(p["text"]).alias("length")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return F.aggregate(parts, zero, lambda s, p: F.struct(
        (s["at"] + F.char_length(p["text"])).alias("at"),
        F.when(p["learn"], F.concat(s["spans"], span(s["at"], p))).otherwise(s["spans"]).alias("spans")), lambda s: s["spans"])


def rows_of(convs: DataFrame) -> DataFrame:
    return keep_columns(convs, {"conv_id": "long", "turn": "long", "role": "string", "text": "string"}).select(
        "conv_id", F.shiftright("turn", PART_BITS).alias("part"),
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("turn"))


def formatted(convs: DataFrame) -> DataFrame:
    """(conv_id, part, formatted, loss_spans): each part of each conversation."""
    rows = rows_of(convs)
    own = rows.where(F.col("conv_id").isNotNull()).groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    alone = rows.where(F.col("conv_id").isNull()).select("conv_id", "part", F.array("turn").alias("turns"))
    out = lambda p: F.struct(F.array_join(F.transform(p, lambda x: x["text"]), "").alias("formatted"),
                             loss_spans(p).alias("loss_spans"))
    return own.unionByName(alone).select("conv_id", "part", bound(pieces(merged(F.col("turns"))), out).alias("out")).select(
        "conv_id", "part", "out.*")


def turns_read(text: Column) -> Column:
    """The (role, text) turns of a formatted text, read back from it."""
    def of_block(body: Column, close: Column) -> Column:
        texts = F.split(body, r"\[TURN\]", -1)
        role = F.lit(None).cast("string")
        for name, tags in BLOCK_TAGS.items():
            role = F.when(close == tags[1].strip(), F.lit(name)).otherwise(role)
        turn = lambda r, t: F.struct(r.alias("role"), unescaped(t).alias("text"))
        return F.when(role.isNotNull(), F.transform(texts, lambda t: turn(role, t))).otherwise(bound(
            texts, lambda ts: F.transform(F.slice(ts, 2, F.size(ts) - 1), lambda t: turn(unescaped(F.get(ts, F.lit(0))), t))))
    return F.flatten(F.zip_with(F.regexp_extract_all(text, F.lit(BLOCK), 1), F.regexp_extract_all(text, F.lit(BLOCK), 2), of_block))


def text_under_loss(text: Column, spans: Column) -> Column:
    """What the mask counts of a formatted text, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(text, s["start"] + 1, s["length"]))), "")


def _read_back(parts: DataFrame) -> DataFrame:
    turns = turns_read(F.col("formatted"))
    shown = lambda ts: F.struct(
        F.size(ts).cast("long").alias("n_turns"),
        F.array_join(F.transform(ts, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"))
    return parts.select("conv_id", "part", bound(turns, shown).alias("r"), text_under_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
                        F.char_length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id", "part", "r.*", "loss", "formatted_chars")


def _digests(read: DataFrame) -> DataFrame:
    return read.select("conv_id", "n_turns", F.sha2(F.col("turns"), 256).alias("turns_sha256"),
                       F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars")


def digests(convs: DataFrame) -> DataFrame:
    """One row a conversation, from its formatted parts read back. Those of
    several parts, which a first look at the turn numbers finds, are put
    together by a second shuffle; the others are digested where they are formatted."""
    rows = rows_of(convs).select("conv_id", "part").where(F.col("conv_id").isNotNull())
    least = F.lit(-2 ** 63)  # a null part is one of its own
    several = rows.groupBy("conv_id").agg(F.min(F.coalesce("part", least)).alias("a"), F.max(F.coalesce("part", least)).alias("b")).where(
        "a < b").select("conv_id")
    several = broadcast_if_small(written(convs.sparkSession, several, "chat-parts"), ID_BYTES)
    own = keep_columns(convs, {"conv_id": "long", "turn": "long", "role": "string", "text": "string"})
    one = _digests(_read_back(formatted(own.join(several, "conv_id", "left_anti"))))
    parts = _read_back(formatted(own.join(several, "conv_id", "left_semi")))
    put = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "turns", "loss"))).alias("p"),
                                       F.sum("n_turns").alias("n_turns"), F.sum("formatted_chars").alias("formatted_chars"))
    whole = put.select("conv_id", "n_turns", F.array_join("p.turns", "").alias("turns"), F.array_join("p.loss", "").alias("loss"), "formatted_chars")
    return one.unionByName(_digests(whole))


def query(spark, sf_dir) -> DataFrame:
    convs = keep_columns(table(spark, sf_dir, "conversations"), {"conv_id": "long", "turn": "long", "role": "string", "text": "string"})
    return digests(convs.unionByName(spark.createDataFrame(PLANTED, convs.schema)))


#: Plain SQL over the turns; only formatted_chars knows the template (tags per block, [TURN] between merged texts).
ORACLE = rf"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
rows AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () ELSE 0 END AS alone FROM given),
marked AS (
  SELECT *, lag(role) OVER w AS prior,
    regexp_replace(text, '([\[<])(\\*)({REST})', '\1\\\2\3', 'g') AS body,
    regexp_replace(role, '([\[<])(\\*)({REST})', '\1\\\2\3', 'g') AS name
  FROM rows WINDOW w AS (PARTITION BY conv_id, alone, turn >> {PART_BITS} ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(body) + CASE WHEN prior = role THEN 6 ELSE
    CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 ELSE 21 + length(name) END END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id, alone
"""
