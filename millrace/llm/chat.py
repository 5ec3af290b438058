"""Chat formatting: conversations logged again and again as they grow are collapsed to the longest, then rendered.

In DataFrame functions only. Every turn gets a hash of role and text, and every prefix of a
conversation a rolling hash: that of the prefix before and the next turn. A conversation whose hash is that
of a shorter prefix of another one adds nothing and goes; of equal conversations the smallest conv_id
stays. Prefixes are compared by position, so gaps and offsets in turn numbers don't matter. Positions come
from one sort over all rows, dealt by ranges, and the counts of each range; hashes roll through parts of
256 positions, and a prefix is its part's own hash and one of all parts before. So a conversation of any
length is many small groups.

Rendering gives one text for each 256 turn numbers of a conversation.

Null role: "unknown". Null text: empty. Null turn: before the others. Rows without conv_id are one
conversation. Rows that repeat conv_id, turn, role and text count once; different rows of one turn are
ordered by role and text. Control marks inside a text are broken up. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import staged

PART = 256
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def turns(conversations: DataFrame) -> DataFrame:
    """key, conv_id, part, turn, role, text; key is conv_id as text that is never null."""
    return conversations.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key"),
        "conv_id",
        F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / PART).cast("long").alias("part"),
        F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def placed(conversations: DataFrame) -> DataFrame:
    """key, conv_id, part, i and two hashes of role and text: every distinct turn by its place in the conversation, part * PART + i."""
    order = ["key", "turn", "role", "text"]
    distinct = turns(conversations).groupBy(*order).agg(F.min("conv_id").alias("conv_id"))
    ranged = staged(distinct.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "conv_id", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(7), "text", "role").alias("b"), F.monotonically_increasing_id().alias("at")), "turns")
    in_range = ranged.withColumn("range", F.shiftright("at", 33))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    runs = in_range.groupBy("key", "range").agg(F.min("at").alias("first"), F.count("*").alias("n")).select("key", "range", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    place = F.col("at") + F.col("shift")
    return in_range.join(runs, ["key", "range"]).select("key", "conv_id", F.floor(place / PART).cast("long").alias("part"), (place % PART).cast("int").alias("i"), "a", "b")


def rolling(hashes: Column) -> Column:
    """The hash of every prefix, each from the one before and the next element."""
    empty = F.struct(F.lit(0).cast("long").alias("h"), F.slice(hashes, 1, 0).alias("all"))

    def step(acc: Column, x: Column) -> Column:
        h = F.xxhash64(acc["h"], x)
        return F.struct(h.alias("h"), F.concat(acc["all"], F.array(h)).alias("all"))

    return F.aggregate(hashes, empty, step)["all"]


def maximal(conversations: DataFrame) -> DataFrame:
    """key of the conversations that no longer one begins with."""
    parts = placed(conversations).groupBy("key", "part").agg(F.min("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("i", "a", "b"))).alias("ts"))
    parts = parts.select("key", "conv_id", "part", *[rolling(F.col(f"ts.{c}")).alias(c) for c in ("a", "b")])
    parts = staged(parts, "prefixes")

    along = Window.partitionBy("key").orderBy("part")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = lambda x: F.xxhash64("part", F.size(x), F.element_at(x, -1))
    chained = parts.select("key", "conv_id", "part", "a", "b", F.coalesce(F.bit_xor(whole("a")).over(before), F.lit(0).cast("long")).alias("a0"), F.coalesce(F.bit_xor(whole("b")).over(before), F.lit(0).cast("long")).alias("b0"), F.lead("part").over(along).isNull().alias("ends"))
    prefix = chained.select("key", "conv_id", "part", "a0", "b0", "ends", F.size("a").alias("n"), F.posexplode(F.arrays_zip("a", "b")).alias("i", "h"))
    prefix = prefix.select("key", "conv_id", "part", (F.col("i") + 1).alias("i"), F.xxhash64("a0", "h.a").alias("ha"), F.xxhash64("b0", "h.b").alias("hb"), (F.col("ends") & (F.col("i") + 1 == F.col("n"))).alias("full"))
    same = ["part", "i", "ha", "hb"]
    full = prefix.where("full").groupBy(*same).agg(F.min(F.struct(F.col("conv_id").isNull(), "conv_id", "key")).alias("first")).select(*same, "first.key")
    return full.join(prefix.where("NOT full").select(*same).distinct(), same, "left_anti").select("key")


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, text: the maximal conversations, as one text for each part of up to 256 turn numbers."""
    kept = turns(conversations).join(maximal(conversations), "key", "left_semi")
    parts = kept.groupBy("key", "part").agg(F.min("conv_id").alias("conv_id"), F.sort_array(F.collect_set(F.struct("turn", "role", "text"))).alias("ts"))
    line = lambda t: F.concat(F.lit(OPEN), F.replace(t["role"], F.lit("<|im_"), F.lit("<| im_")), F.lit(MIDDLE), F.replace(t["text"], F.lit("<|im_"), F.lit("<| im_")), F.lit(CLOSE))
    return parts.select("conv_id", "part", F.size("ts").cast("long").alias("n_turns"), F.array_join(F.transform("ts", line), "").alias("text"))


#: The same rows in DuckDB's SQL, from whole prefixes instead of their hashes.
SQL = f"""
WITH t AS (
  SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), p AS (
  SELECT conv_id, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, string_agg(role || chr(2) || text, chr(3)) OVER w AS pre
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
), f AS (
  SELECT min(conv_id) AS conv_id, n, pre FROM p WHERE i = n GROUP BY n, pre
), k AS (
  SELECT conv_id FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.i < p.n AND p.i = f.n AND p.pre = f.pre)
)
SELECT t.conv_id, CAST(floor(turn / {PART}) AS BIGINT) AS part, count(*) AS n_turns,
       string_agg('<|im_start|>' || replace(role, '<|im_', '<| im_') || chr(10) || replace(text, '<|im_', '<| im_') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS text
FROM t JOIN k ON t.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY t.conv_id, floor(turn / {PART})"""
