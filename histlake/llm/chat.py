"""Multi-party perspective rotation (operator 4), on DataFrame functions alone.

For every participant of a conversation the whole dialogue is rendered once with that speaker as the assistant, all
other speakers as named users and system turns as they are. Every row is one rendered turn with its loss mask: 1 on
the turns of the participant whose perspective it is. A dialogue is its rows in order of turn (null first), then
content, then name: rows that are equal in these are equal in all, so the order is whole, and no conversation, however
long, is gathered into one task. dialogues() joins the rows of conversations that fit into a row of their own.

Names are what is left of a role without white space and control characters around it, and with one space for each run
of them inside; of any case, "system" is no participant. Neither contents nor names can open or close a turn: of
"<|" in them the signs are set apart in rendered; content stays as it is.

Defined results: a null or blank role is the participant "unknown"; a null text is an empty turn; a null conv_id is a
conversation of its own; turns that share a number, also repeated rows, are all kept; a conversation without
participants (system turns only) has no perspective and gives no rows; texts of any length are rendered whole. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from histlake.llm.common import table

#: A conversation may hold a third of all rows: its turns meet its participants in so many parts.
SALTS = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: What markers begin with, and what stands for it in contents and names.
SIGN, APART = "<|", "< |"
BLANK = r"[\x00-\x20\x7F]+"


def harmless(text: Column) -> Column:
    return F.replace(text, F.lit(SIGN), F.lit(APART))


def speaker_of(role: Column) -> Column:
    name = F.trim(F.regexp_replace(F.coalesce(role, F.lit("")), BLANK, " "))
    return F.when(name == "", "unknown").when(F.lower(name) == "system", "system").otherwise(name)


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, role (assistant, user or system), name (of users), content, rendered, loss_mask, and
    mask_start and mask_end: the characters of rendered that are learned from (null where none are)."""
    content = F.coalesce("text", F.lit(""))
    # A null id is joined as a key of its own.
    turns = turns.select(F.struct("conv_id").alias("conv"), "turn", speaker_of(F.col("role")).alias("speaker"), content.alias("content"))
    turns = turns.withColumn("salt", F.pmod(F.xxhash64("turn", "content"), F.lit(SALTS)).cast("int"))
    cast = turns.filter("speaker <> 'system'").groupBy("conv").agg(F.array_sort(F.collect_set("speaker")).alias("cast"))
    cast = cast.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = turns.join(cast, ["conv", "salt"]).select("*", F.explode("cast").alias("perspective"))
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == "system", "system").when(own, "assistant").otherwise("user")
    name = F.when(role == "user", F.col("speaker"))
    head = F.concat(F.lit(OPEN), role, F.coalesce(F.concat(F.lit(" name="), harmless(name)), F.lit("")), F.lit("\n"))
    body = harmless(F.col("content"))
    mask = F.when(own, F.length(head))
    return out.select(
        "conv.conv_id", "perspective", "turn", role.alias("role"), name.alias("name"), "content",
        F.concat(head, body, F.lit(CLOSE + "\n")).alias("rendered"), own.cast("int").alias("loss_mask"),
        mask.cast("long").alias("mask_start"), (mask + F.length(body) + len(CLOSE)).cast("long").alias("mask_end"),
    )


def dialogues(rotated: DataFrame) -> DataFrame:
    """conv_id, perspective, text and masks (start and end in text of what is learned from) of each whole dialogue. A
    dialogue is one value, so this is for conversations that are known to fit into memory."""
    key = F.struct("turn", "content", "name", "rendered", "mask_start", "mask_end")
    turns = rotated.groupBy(F.struct("conv_id").alias("conv"), "perspective").agg(F.array_sort(F.collect_list(key)).alias("turns"))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("masks"))

    def add(done: Column, t: Column) -> Column:
        mask = F.struct((done["at"] + t["mask_start"]).alias("start"), (done["at"] + t["mask_end"]).alias("end"))
        masks = F.when(t["mask_start"].isNull(), done["masks"]).otherwise(F.concat(done["masks"], F.array(mask)))
        return F.struct((done["at"] + F.length(t["rendered"])).alias("at"), masks.alias("masks"))

    whole = F.array_join(F.transform("turns", lambda t: t["rendered"]), "")
    return turns.select("conv.conv_id", "perspective", whole.alias("text"), F.aggregate("turns", empty, add)["masks"].alias("masks"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH n AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(role, ''), '[\x00-\x20\x7F]+', ' ', 'g')) AS name, coalesce(text, '') AS content FROM conversations),
t AS (SELECT conv_id, turn, CASE WHEN name = '' THEN 'unknown' WHEN lower(name) = 'system' THEN 'system' ELSE name END AS speaker, content FROM n),
c AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (SELECT t.*, perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
      FROM t JOIN c ON t.conv_id IS NOT DISTINCT FROM c.conv_id),
h AS (SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || replace(speaker, '<|', '< |') ELSE '' END || chr(10) AS head, replace(content, '<|', '< |') AS body FROM r)
SELECT conv_id, perspective, turn, role, CASE WHEN role = 'user' THEN speaker END AS name, content,
       head || body || '<|im_end|>' || chr(10) AS rendered, CAST(role = 'assistant' AS INTEGER) AS loss_mask,
       CASE WHEN role = 'assistant' THEN CAST(length(head) AS BIGINT) END AS mask_start,
       CASE WHEN role = 'assistant' THEN CAST(length(head) + length(body) + 10 AS BIGINT) END AS mask_end
FROM h
"""
