"""Preference formatting: a shared prompt and two masked completions, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    """A backslash more in each `<|`, `<\\|`, ..., so that no text can hold a mark of its own; undone by taking one away."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def _said() -> Column:
    return F.struct(escape(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"))


def paired_turns(conversations: DataFrame, role: str = TRAINED_ROLE) -> DataFrame:
    """(block, pair_id, chosen boolean, turn, said struct): every conversation is the chosen side of a pair of its own.

    The rejected side is the same conversation up to its last answer (last turn of `role`), and then the last answer of the
    conversation whose id differs in the lowest bit, if there is one. Both conversations are in one block, and rows are dealt out by
    block, the only shuffle. Rows without conversation or turn number take no part; of rows that give a turn twice the
    least (role, text) counts; a conversation without an answer has nothing else on its rejected side.
    """
    conv = F.col("conv_id").cast("long")
    rows = conversations.select(F.shiftright(conv, 1).alias("block"), conv.alias("pair_id"), F.col("turn").cast("long").alias("turn"), _said().alias("said"))
    rows = rows.where("pair_id IS NOT NULL AND turn IS NOT NULL").repartition("block").groupBy("block", "pair_id", "turn").agg(F.min("said").alias("said"))
    odd = F.col("pair_id").bitwiseAND(F.lit(1)) == 1
    answer = F.struct("turn", "said")

    def last(side: Column) -> Column:
        return F.max(F.when(side & (F.col("said.role") == role), answer)).over(Window.partitionBy("block"))

    rows = rows.withColumn("even_last", last(~odd)).withColumn("odd_last", last(odd))
    rows = rows.withColumn("own", F.when(odd, F.col("odd_last")).otherwise(F.col("even_last")))
    rows = rows.withColumn("other", F.when(odd, F.col("even_last")).otherwise(F.col("odd_last")))
    other = F.when(F.col("own").isNull() | (F.col("turn") < F.col("own.turn")), F.col("said")).when(F.col("turn") == F.col("own.turn"), F.col("other.said"))
    sides = F.array(F.struct(F.lit(True).alias("chosen"), "said"), F.struct(F.lit(False).alias("chosen"), other.alias("said")))
    return rows.select("block", "pair_id", "turn", F.explode(sides).alias("side")).select("block", "pair_id", "side.chosen", "turn", "side.said").where("said IS NOT NULL")


def format_preferences(turns: DataFrame) -> DataFrame:
    """One row for each pair: prompt, chosen, rejected, their masks, and how many turns they share.

    `turns` is (pair_id, chosen, turn, role, text). The longest run of first turns that agree in turn number, role
    and text is rendered once, as prompt; the rest of either side is its completion. A mask lists start:end in code
    points of the completion where the trained role speaks, its end mark included. Null roles and texts are empty, marks inside
    them are escaped; rows without pair or turn number take no part; of rows that give a turn twice the least (role, text) counts;
    a side that is missing is empty; sides that agree have empty completions. A pair is one row, so one pair's turns
    meet in one task, as its text must; they are shuffled once.
    """
    known = turns.where("pair_id IS NOT NULL AND turn IS NOT NULL")
    return _formatted(known.select("pair_id", "chosen", "turn", _said().alias("said")).repartition("pair_id"), ["pair_id"])


def _formatted(turns: DataFrame, keys: list[str]) -> DataFrame:
    """`turns` (keys, chosen, turn, said) must be dealt out by one of `keys`, whose last is pair_id and tells the others."""
    both = turns.groupBy(*keys, "turn").agg(F.min(F.when(F.col("chosen"), F.col("said"))).alias("c"), F.min(F.when(~F.col("chosen"), F.col("said"))).alias("r"))
    order = Window.partitionBy(*keys).orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    parted = both.withColumn("apart", F.max((~F.col("c").eqNullSafe(F.col("r"))).cast("int")).over(order) == 1)
    for side in "cr":
        parted = parted.withColumn(f"{side}_text", render(F.col(f"{side}.role"), F.col(f"{side}.text")))
        own = F.when(F.col("apart"), F.coalesce(F.length(f"{side}_text"), F.lit(0))).otherwise(0)
        parted = parted.withColumn(f"{side}_end", F.sum(own).over(order))

    def joined(text: Column, when: Column, sep: str = "") -> Column:
        rows = F.array_sort(F.collect_list(F.when(when & text.isNotNull(), F.struct("turn", text.alias("s")))))
        return F.array_join(F.transform(rows, lambda x: x.s), sep)

    def mask(side: str) -> Column:
        end = F.col(f"{side}_end") - 1
        start = end - F.length(f"{side}.text") - F.length(F.lit("<|end|>"))
        return joined(F.concat(start.cast("string"), F.lit(":"), end.cast("string")), F.col("apart") & (F.col(f"{side}.role") == TRAINED_ROLE), ",")

    found = parted.groupBy(*keys).agg(
        joined(F.col("c_text"), ~F.col("apart")).alias("prompt"),
        joined(F.col("c_text"), F.col("apart")).alias("chosen"),
        joined(F.col("r_text"), F.col("apart")).alias("rejected"),
        mask("c").alias("chosen_mask"),
        mask("r").alias("rejected_mask"),
        F.count(F.when(~F.col("apart"), 1)).alias("n_shared"),
    )
    return found.drop(*keys[:-1])


def op3_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formatted(paired_turns(table(spark, sf_dir, "conversations")), ["block", "pair_id"])


SQL = r"""
WITH told AS (
  SELECT conv_id AS pair_id, turn, min(struct_pack(
    role := regexp_replace(coalesce(role, ''), '<(\\*)\|', '<\1\\|', 'g'), text := regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\1\\|', 'g'))) AS s
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
), answers AS (
  SELECT pair_id, max(turn) AS last, arg_max(s, turn) AS s FROM told WHERE s.role = 'assistant' GROUP BY pair_id
), rejected AS (
  SELECT t.pair_id, t.turn, t.s FROM told t LEFT JOIN answers a USING (pair_id) WHERE a.last IS NULL OR t.turn < a.last
  UNION ALL
  SELECT a.pair_id, a.last, b.s FROM answers a JOIN answers b ON b.pair_id = xor(a.pair_id, 1)
), pairs AS (
  SELECT coalesce(t.pair_id, x.pair_id) AS pair_id, coalesce(t.turn, x.turn) AS turn, t.s AS c, x.s AS r
  FROM told t FULL JOIN rejected x ON t.pair_id = x.pair_id AND t.turn = x.turn
), parted AS (
  SELECT *, bool_or(c IS DISTINCT FROM r) OVER w AS apart,
    '<|' || c.role || '|>' || chr(10) || c.text || '<|end|>' || chr(10) AS ct, '<|' || r.role || '|>' || chr(10) || r.text || '<|end|>' || chr(10) AS rt
  FROM pairs WINDOW w AS (PARTITION BY pair_id ORDER BY turn ROWS UNBOUNDED PRECEDING)
), placed AS (
  SELECT *, CAST(sum(CASE WHEN apart THEN coalesce(length(ct), 0) ELSE 0 END) OVER w AS BIGINT) AS ce,
    CAST(sum(CASE WHEN apart THEN coalesce(length(rt), 0) ELSE 0 END) OVER w AS BIGINT) AS re
  FROM parted WINDOW w AS (PARTITION BY pair_id ORDER BY turn ROWS UNBOUNDED PRECEDING)
)
SELECT pair_id,
  coalesce(string_agg(ct, '' ORDER BY turn) FILTER (NOT apart), '') AS prompt,
  coalesce(string_agg(ct, '' ORDER BY turn) FILTER (apart), '') AS chosen,
  coalesce(string_agg(rt, '' ORDER BY turn) FILTER (apart), '') AS rejected,
  coalesce(string_agg((ce - 8 - length(c.text)) || ':' || (ce - 1), ',' ORDER BY turn) FILTER (apart AND c.role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((re - 8 - length(r.text)) || ':' || (re - 1), ',' ORDER BY turn) FILTER (apart AND r.role = 'assistant'), '') AS rejected_mask,
  count(*) FILTER (NOT apart) AS n_shared
FROM placed GROUP BY pair_id
"""
