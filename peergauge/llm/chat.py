"""Logged conversations collapsed to maximal ones, then rendered for training.

Services log a conversation anew after every turn, so that a log holds its own beginnings. A turn's
prefix hash stands for all turns up to it; a conversation whose whole hash is the prefix hash of a
longer one is one of these beginnings and goes. Of conversations that are equal one stays. DataFrame
functions only, and SQL can say the same.

The prefix hash is a running sum of the turns' hashes, exact and in two independent 64-bit parts. Sums
roll over blocks of turns, and blocks over conversations, so a conversation of any length is never
sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peergauge.session import write_shared

# Turn numbers that one block spans.
BLOCK_TURNS = 256
# Turns that one part holds.
PART_TURNS = 256
_SUM = "decimal(38,0)"


def _marked(column: str) -> Column:
    """Tells null from empty text."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def distinct_turns(conversations: DataFrame) -> DataFrame:
    """The turns of conversations that have an id; rows alike in all four columns count once."""
    return (
        conversations.where("conv_id is not null")
        .select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
        .distinct()
        .withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(2**60))))
    )


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, n, h1, h2, total: the hash of each prefix of n rows, and the rows of the whole.

    Rows with the same turn number enter a prefix together. Null turns come first.
    """
    content = (F.col("turn"), _marked("role"), _marked("text"))
    hashed = turns.select(
        "conv_id",
        "block",
        "turn",
        F.xxhash64(F.lit(1), *content).cast(_SUM).alias("h1"),
        F.xxhash64(F.lit(2), *content).cast(_SUM).alias("h2"),
    )
    sums = ("n", "h1", "h2")

    def added(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(*(F.sum(c).cast(_SUM).alias(c) for c in sums))

    # One written table of turns, from which blocks and conversations are added up.
    each = write_shared(
        added(hashed.withColumn("n", F.lit(1)), "conv_id", "block", "turn"), "turn-hashes"
    )
    blocks = added(each, "conv_id", "block")
    before = Window.partitionBy("conv_id").orderBy("block")
    offsets = blocks.select(
        "conv_id", "block", *((F.sum(c).over(before) - F.col(c)).alias(f"{c}_before") for c in sums)
    )
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first())
    running = each.select(
        "conv_id", "block", *(F.sum(c).over(inside).alias(c) for c in sums)
    )
    totals = each.groupBy("conv_id").agg(F.sum("n").cast(_SUM).alias("total"))
    return (
        running.join(offsets, ["conv_id", "block"])
        .join(totals, "conv_id")
        .select(
            "conv_id", *((F.col(c) + F.col(f"{c}_before")).cast(_SUM).alias(c) for c in sums), "total"
        )
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies of those that no longer conversation begins with.

    Of equal ones the smallest conv_id stays, and n_copies counts them.
    """
    prefixes = write_shared(prefix_hashes(turns), "prefixes")
    key = ["n", "h1", "h2"]
    whole = (
        prefixes.where("n = total")
        .groupBy(*key)
        .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    )
    begun = prefixes.where("n < total").select(*key).distinct()
    return whole.join(begun, key, "left_anti").select(
        "conv_id", F.col("n").cast("long").alias("n_turns"), "n_copies"
    )


def rendered(role: Column, text: Column) -> Column:
    """One turn in the template; a null role or text is empty."""
    empty = F.lit("")
    return F.concat(
        F.lit("<|im_start|>"),
        F.coalesce(role, empty),
        F.lit("\n"),
        F.coalesce(text, empty),
        F.lit("<|im_end|>\n"),
    )


def numbered_turns(turns: DataFrame) -> DataFrame:
    """The turns with ``part``, the place of their PART_TURNS in the conversation.

    Turns are numbered inside their block and the blocks' sizes added up, so only turns of one block
    are sorted together.
    """
    blocks = turns.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block")
    offsets = blocks.select("conv_id", "block", (F.sum("n").over(before) - F.col("n")).alias("before"))
    inside = Window.partitionBy("conv_id", "block").orderBy(
        *(F.col(c).asc_nulls_first() for c in ("turn", "role", "text"))
    )
    row = F.col("before") + F.col("row") - 1
    return (
        turns.withColumn("row", F.row_number().over(inside))
        .join(offsets, ["conv_id", "block"])
        .withColumn("part", F.floor(row / PART_TURNS))
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, n_copies and text of every maximal conversation.

    Turns are rendered by number, then role and text. A part holds the next PART_TURNS turns,
    whatever their numbers, so an ordinary conversation is one row with part 0, and a very long one
    gives several. Rows without conv_id belong to no conversation and are left out; null turn
    numbers come first; rows repeated exactly count once. An empty table gives no rows, and other
    columns are not read.
    """
    turns = write_shared(distinct_turns(conversations), "turns")
    maximal = write_shared(maximal_conversations(turns), "maximal")
    rows = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    texts = F.transform(rows, lambda t: rendered(t["role"], t["text"]))
    return (
        numbered_turns(turns.join(maximal, "conv_id"))
        .groupBy("conv_id", "part", "n_turns", "n_copies")
        .agg(F.array_join(texts, "").alias("text"))
    )


ORACLE_SQL = f"""
WITH turns AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
), whole AS (
  SELECT conv_id, count(*) AS n_turns, list(
    {{'turn': turn, 'role': coalesce('=' || role, ''), 'text': coalesce('=' || text, '')}}
    ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS items
  FROM turns GROUP BY conv_id
), kept AS (
  SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies FROM whole AS a
  WHERE NOT EXISTS (
    SELECT 1 FROM whole AS b
    WHERE b.items[1] = a.items[1] AND b.n_turns > a.n_turns AND b.items[1:a.n_turns] = a.items)
  GROUP BY items, n_turns
), numbered AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST,
                                text NULLS FIRST) - 1) // {PART_TURNS} AS part
  FROM turns JOIN kept USING (conv_id)
)
SELECT conv_id, part, n_turns, n_copies, string_agg(
  '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10),
  '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text
FROM numbered GROUP BY 1, 2, 3, 4
"""
