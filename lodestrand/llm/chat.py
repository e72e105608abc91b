"""Chat formatting by rotating the perspective of multi-party dialogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Turns in a row of the result; a longer dialogue goes on in the next part.
PART_TURNS = 512
END = "<|end|>"


def rotate_perspectives(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """Render each dialogue once for every participant.

    In a participant's rendering its turns are the assistant's, the others' are those of named users, and the mask
    covers the assistant's texts with their end marks: the spans to learn from. System turns stay system turns and get
    no rendering. Spans are [start, end) in characters of the part's text, written start:end and joined by commas.

    Turns are ordered by turn (null first), then role, then text; a null role is the participant "unknown", a null
    text is empty, and turns with a null conv_id are one dialogue. Repeated rows are turns of their own. A dialogue of
    system turns alone, like an empty table, gives no rows. Dialogues are cut into parts of part_turns turns, so that
    a row stays bounded however long a dialogue is; no turn is left out or repeated, so a system turn is in the part it
    falls in alone, and a part without a turn of the participant has an empty mask. Columns other than conv_id, turn, role and
    text are not read.

    Returns conv_id, perspective, part, n_turns, n_masked, n_chars, text, mask_spans.
    """
    said = turns.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("who"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("said")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "who", "said")
    placed = said.withColumn("_at", F.row_number().over(order) - 1)
    people = said.where("who <> 'system'").select("conv_id", F.col("who").alias("perspective")).distinct()
    mine = F.col("who") == F.col("perspective")
    head = F.when(F.col("who") == "system", "<|system|>\n").when(mine, "<|assistant|>\n").otherwise(F.concat(F.lit("<|user:"), "who", F.lit("|>\n")))
    both = placed.alias("p").join(people.alias("q"), F.col("p.conv_id").eqNullSafe(F.col("q.conv_id")))
    lines = both.select(
        F.col("p.conv_id").alias("conv_id"), "perspective", "_at", "who", "said", F.floor(F.col("_at") / part_turns).cast("int").alias("part"), head.alias("_head")
    ).withColumn("_line", F.concat("_head", "said", F.lit(END + "\n")))
    so_far = Window.partitionBy("conv_id", "perspective", "part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("_line")).over(so_far), F.lit(0)) + F.length("_head")
    span = F.when(mine, F.concat_ws(":", start, start + F.length("said") + len(END)))
    spans = lines.select("conv_id", "perspective", "part", F.struct("_at", "_line", span.alias("_span")).alias("_row"))
    rows = spans.groupBy("conv_id", "perspective", "part").agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    text = F.array_join(F.transform("_rows", lambda r: r["_line"]), "")
    masked = F.filter(F.transform("_rows", lambda r: r["_span"]), lambda s: s.isNotNull())
    return rows.select(
        "conv_id", "perspective", "part", F.size("_rows").alias("n_turns"), F.size(masked).alias("n_masked"), F.length(text).alias("n_chars"),
        text.alias("text"), F.array_join(masked, ",").alias("mask_spans"),
    )


def op6_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP6_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS who, coalesce(text, '') AS said FROM conversations
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, who, said) - 1 AS pos FROM said
), people AS (
  SELECT DISTINCT conv_id, who AS perspective FROM said WHERE who <> 'system'
), lines AS (
  SELECT p.conv_id, perspective, pos, who, said, CAST(pos // 512 AS INTEGER) AS part,
         CASE WHEN who = 'system' THEN '<|system|>' WHEN who = perspective THEN '<|assistant|>' ELSE '<|user:' || who || '|>' END || chr(10) AS head
  FROM placed p JOIN people q ON p.conv_id IS NOT DISTINCT FROM q.conv_id
), marked AS (
  SELECT *, head || said || '<|end|>' || chr(10) AS line,
         coalesce(sum(length(head) + length(said) + 8) OVER (PARTITION BY conv_id, perspective, part ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start
  FROM lines
)
SELECT conv_id, perspective, part, CAST(count(*) AS INTEGER) AS n_turns, CAST(count(*) FILTER (who = perspective) AS INTEGER) AS n_masked,
       CAST(sum(length(line)) AS INTEGER) AS n_chars, string_agg(line, '' ORDER BY pos) AS text,
       coalesce(string_agg(CAST(start AS BIGINT) || ':' || CAST(start + length(said) + 7 AS BIGINT), ',' ORDER BY pos) FILTER (who = perspective), '') AS mask_spans
FROM marked GROUP BY conv_id, perspective, part
"""
