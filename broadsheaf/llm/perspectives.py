"""Multi-party perspective rotation, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant: their
turns become assistant turns and are trained on, all other speakers become named users. A rendered dialogue is
returned as its segments, one row per turn, with each segment's place in the whole, so that a dialogue of any
length never has to fit into one task; concatenated in order of ``segment`` they are the dialogue.

``system`` turns are context: they are rendered as such, never trained on, and are no participant.

Segment places are sums over the turns before. They are dealt by (conversation, block of turns): sums are taken
within blocks and over blocks, so one conversation with a third of all turns is still spread over tasks.

Defined cases: null roles count as the speaker ``unknown``, null texts as empty; turns with equal numbers are put in
order of role and text, null turn numbers come first; repeated rows are repeated turns; conversations without a
participant give no rows; null conversation ids form one conversation; an empty table gives an empty result; columns
other than the four are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Turn numbers in a block.
BLOCK = 64
HEADS = {"system": "<|system|>\n", "assistant": "<|assistant|>\n", "user": "<|user name={name}|>\n"}
TAIL = "<|end|>\n"


def _named(name: Column) -> Column:
    before, after = HEADS["user"].split("{name}")
    return F.concat(F.lit(before), name, F.lit(after))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", context: str = "system") -> DataFrame:
    """One row per conversation, participant and turn: the rendered segment, its role, mask and place.

    conv_id, assistant, segment (from 0), turn, speaker, role, rendered, begin, finish (characters of the rendered
    dialogue), mask_begin, mask_finish (the characters trained on; null where none), trained.
    """
    t = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK))
    n_tail, n_sys, n_asst, n_user = len(TAIL), len(HEADS["system"]), len(HEADS["assistant"]), len(HEADS["user"]) - len("{name}")
    body = F.length("text") + n_tail
    as_user = F.when(F.col("speaker") == context, n_sys).otherwise(n_user + F.length("speaker"))
    # sums by block: segments, characters if nobody were the assistant, and by speaker what being the assistant changes
    blocks = t.groupBy("conv_id", "block", "speaker").agg(F.count("*").alias("n"), F.sum(body + as_user).alias("chars"))
    total = blocks.groupBy("conv_id", "block").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    over = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    total = total.select("conv_id", "block", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("n0"), F.coalesce(F.sum("chars").over(over), F.lit(0)).alias("chars0"))
    people = blocks.where(F.col("speaker") != context).select("conv_id", F.col("speaker").alias("assistant")).distinct()
    # for each participant and block: how many of the turns before are the participant's own
    own = blocks.select("conv_id", "block", F.col("speaker").alias("assistant"), F.col("n").alias("mine"))
    base = total.join(people, total["conv_id"].eqNullSafe(people["conv_id"])).select(total["conv_id"], "block", "n0", "chars0", "assistant")
    b, o = base.alias("b"), own.alias("o")
    base = b.join(o, F.expr("b.conv_id <=> o.conv_id and b.block = o.block and b.assistant = o.assistant"), "left").select("b.*", F.coalesce("o.mine", F.lit(0)).alias("mine"))
    per = W.partitionBy("conv_id", "assistant").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    base = base.withColumn("mine0", F.coalesce(F.sum("mine").over(per), F.lit(0)))

    x, y = t.alias("t"), base.alias("y")
    j = x.join(y, F.expr("t.conv_id <=> y.conv_id and t.block = y.block")).select("t.*", "y.assistant", "y.n0", "y.chars0", "y.mine0")
    trained = F.col("speaker") == F.col("assistant")
    role = F.when(trained, "assistant").when(F.col("speaker") == context, "system").otherwise("user")
    head = F.when(trained, F.lit(HEADS["assistant"])).when(F.col("speaker") == context, F.lit(HEADS["system"])).otherwise(_named(F.col("speaker")))
    j = j.withColumn("role", role).withColumn("head", head).withColumn("rendered", F.concat("head", "text", F.lit(TAIL)))
    inside = W.partitionBy("conv_id", "block", "assistant").orderBy("turn", "speaker", "text")
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    segment = F.col("n0") + F.row_number().over(inside) - 1
    # being the assistant changes the head of each own turn by the same number of characters
    change = n_asst - n_user - F.length("assistant")
    begin = F.col("chars0") + F.col("mine0") * change + F.coalesce(F.sum(F.length("rendered")).over(before), F.lit(0))
    done = j.withColumn("segment", segment.cast("long")).withColumn("begin", begin.cast("long"))
    trained = F.col("role") == "assistant"
    start = F.col("begin") + F.length("head")
    return done.select(
        "conv_id", "assistant", "segment", "turn", "speaker", "role", "rendered", "begin", (F.col("begin") + F.length("rendered")).alias("finish"),
        F.when(trained, start).alias("mask_begin"), F.when(trained, start + F.length("text") + n_tail).alias("mask_finish"), trained.alias("trained"),
    )


#: The same for DuckDB, over the view ``conversations``.
SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations
), people AS (
  SELECT DISTINCT conv_id, speaker AS assistant FROM t WHERE speaker <> 'system'
), r AS (
  SELECT t.conv_id, assistant, turn, speaker, text,
    CASE WHEN speaker = assistant THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role,
    CASE WHEN speaker = assistant THEN '<|assistant|>' || chr(10) WHEN speaker = 'system' THEN '<|system|>' || chr(10)
         ELSE '<|user name=' || speaker || '|>' || chr(10) END AS head
  FROM t JOIN people ON t.conv_id IS NOT DISTINCT FROM people.conv_id
), s AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS rendered FROM r
), w AS (
  SELECT *, row_number() OVER o - 1 AS segment,
    coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, assistant ORDER BY turn NULLS FIRST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin
  FROM s WINDOW o AS (PARTITION BY conv_id, assistant ORDER BY turn NULLS FIRST, speaker, text)
)
SELECT conv_id, assistant, segment, turn, speaker, role, rendered, begin, begin + length(rendered) AS finish,
  CASE WHEN role = 'assistant' THEN begin + length(head) END AS mask_begin,
  CASE WHEN role = 'assistant' THEN begin + length(rendered) END AS mask_finish,
  role = 'assistant' AS trained
FROM w
"""
