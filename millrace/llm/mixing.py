"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every document of a source is wanted equally often: target / size of the source, at most `cap` times.
The whole part is given out at once. The fractional parts are rounded by pivotal steps: two documents
meet, and words move at random from one to the other, keeping both expectations and the sum of words,
until one of them is wanted a whole number of times. The other goes on. Small chunks of a source do
this side by side, what is left of each chunk meets again in the next level, and so on up a tree, so
that a source of any size takes log(size) small steps and never sits in one task. The last document of a
source that is still fractional goes to the nearer whole number, so the words taken differ from the
target by at most half of one document's.

Null text: size 0. Null source: a source of its own, last. Sources without words take nothing. Repeated
rows (and null ids) are documents of their own. Columns other than doc_id, text, source are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import in_order, staged, uniform, words

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
CHUNK = 64


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size, target for rows (source, size).

    The total is shared by weight. A source stops at cap times its size; the others share the excess by
    weight again. In order of cap / weight this ends at the first source that its share does not fill,
    so running sums over one row for each source replace the rounds.
    """
    by_name = [F.col("source").asc_nulls_last()]
    ranked = in_order(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), by_name, {})
    weighted = ranked.select("source", "source_size", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("place__") % len(weights)).alias("w"), (F.col("source_size") * F.lit(float(cap))).alias("top"))
    filled = staged(in_order(weighted, [F.col("top") / F.col("w"), *by_name], {"top_before": F.col("top"), "w_before": F.col("w")}), "filled")
    total = filled.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    level = (F.lit(float(total["size"] or 0)) - F.col("top_before")) / (F.lit(float(total["w"] or 0)) - F.col("w_before"))
    # the first level that leaves its source below the cap holds for all sources from there on
    below = filled.where(level * F.col("w") <= F.col("top")).agg(F.min(F.struct((F.col("top") / F.col("w")).alias("at"), level.alias("level")))["level"].alias("level")).first()["level"]
    return filled.select("source", "source_size", F.coalesce(F.least("top", F.col("w") * F.lit(below).cast("double")), F.col("top")).alias("target"))


def _fold(units: Column, seed: int) -> Column:
    """Run a chunk's units through one another: struct(done: those decided, rest: the one that is still fractional, or null)."""
    def step(acc: Column, b: Column) -> Column:
        a = acc["rest"]
        wa, wb = a["size"].cast("double"), b["size"].cast("double")
        up = F.least(1 - a["p"], b["p"] * wb / wa)  # a rises, b pays
        down = F.least(a["p"], (1 - b["p"]) * wb / wa)  # a pays, b rises
        rise = uniform(F.lit(seed), a["salt"], b["salt"], a["p"]) * (up + down) < down
        ends = F.when(rise, 1 - a["p"] <= b["p"] * wb / wa).otherwise(a["p"] <= (1 - b["p"]) * wb / wa)  # a becomes whole
        pa = F.when(rise, a["p"] + up).otherwise(a["p"] - down)
        pb = F.when(rise, b["p"] - up * wa / wb).otherwise(b["p"] + down * wa / wb)
        whole = lambda u, p: F.struct(u["doc_id"].alias("doc_id"), u["size"].alias("size"), p.cast("double").alias("p"), u["salt"].alias("salt"))
        one = F.when(rise, F.lit(1.0)).otherwise(F.lit(0.0))
        done = F.when(ends, whole(a, one)).otherwise(whole(b, 1.0 - one))
        rest = F.when(ends, whole(b, F.least(F.greatest(pb, F.lit(0.0)), F.lit(1.0)))).otherwise(whole(a, F.least(F.greatest(pa, F.lit(0.0)), F.lit(1.0))))
        return F.struct(F.concat(acc["done"], F.array(done)).alias("done"), rest.alias("rest"))

    start = F.struct(F.slice(units, 1, 0).alias("done"), F.get(units, F.lit(0)).alias("rest"))
    return F.aggregate(F.slice(units, 2, F.greatest(F.size(units), F.lit(1))), start, step)


def counted(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = 11, chunk: int = CHUNK) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, salt (a hash of id and text) and rows: how many rows of docs alike in id, text and source are taken so often."""
    alike = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("salt"))
    sized = staged(alike.groupBy("doc_id", "source", "size", "salt").agg(F.count("*").alias("rows")), "sizes")
    targets = staged(source_targets(sized.select("source", (F.col("size") * F.col("rows")).alias("size")), weights, cap), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    wanted = targets.select(F.col("source").alias("of__"), "source_size", "target", F.floor(rate).alias("base"), (rate - F.floor(rate)).alias("p"))
    units = sized.join(wanted, F.col("source").eqNullSafe(F.col("of__"))).select("doc_id", "source", "size", "salt", "base", "p", "rows")

    # a document without words moves none: its fraction is rounded by itself
    whole = (F.col("p") <= 0) | (F.col("size") <= 0)
    alone = (F.col("base") + (uniform(F.lit(seed), F.col("salt")) < F.col("p")).cast("long")).alias("copies")
    decided = [units.where(whole).select("doc_id", "source", "size", "salt", alone, "rows")]
    # rows alike share their sum: so many once more, the others not, and one for the fraction that is left
    more = F.floor(F.col("rows") * F.col("p"))
    split = units.where(~whole).select("source", "base", "doc_id", "size", "salt", "rows", more.alias("more"), (F.col("rows") * F.col("p") - more).alias("p"))
    several = split.where("rows > 1").select("doc_id", "source", "size", "salt", F.explode(F.array(F.struct((F.col("base") + 1).alias("copies"), F.col("more").alias("rows")), F.struct(F.col("base").alias("copies"), (F.col("rows") - F.col("more") - 1).alias("rows")))).alias("s"))
    decided.append(several.where("s.rows > 0").select("doc_id", "source", "size", "salt", "s.copies", "s.rows"))
    left = split.select("source", "base", "doc_id", "size", "p", "salt")
    most = (left.groupBy("source").count().agg(F.max("count")).first()[0]) or 0
    for level in range(1, 2 + max(0, math.ceil(math.log(max(most, 1), chunk))) + 1):
        if most == 0:
            break
        parts = max(1, math.ceil(most / chunk)) if most > 2 * chunk else 1
        place = F.pmod(F.xxhash64(F.lit(seed + level), "salt", "doc_id"), F.lit(parts))
        biggest_first = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("k"), "salt", "doc_id", "size", "p"))), lambda x: F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["p"].alias("p"), x["salt"].alias("salt")))
        gathered = left.groupBy("source", "base", place.alias("place")).agg(biggest_first.alias("units"))
        folded = staged(gathered.select("source", "base", _fold(F.col("units"), seed + level).alias("f")), "mixed")
        decided.append(folded.select("source", "base", F.explode("f.done").alias("u")).select("u.doc_id", "source", "u.size", "u.salt", (F.col("base") + F.col("u.p").cast("long")).alias("copies"), F.lit(1).cast("long").alias("rows")))
        rest = folded.select("source", "base", "f.rest.*")
        if parts == 1:
            decided.append(rest.select("doc_id", "source", "size", "salt", (F.col("base") + (F.col("p") >= 0.5).cast("long")).alias("copies"), F.lit(1).cast("long").alias("rows")))
            break
        left, most = rest.select("source", "base", "doc_id", "size", "p", "salt"), min(most, parts)
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    named = targets.withColumnRenamed("source", "of__")
    return out.join(named, F.col("source").eqNullSafe(F.col("of__"))).select("doc_id", "source", "size", "source_size", "target", "copies", "salt", "rows")


def repeated(df: DataFrame, times: str) -> DataFrame:
    """Every row of df so often, without that column; no array is longer than the root of the number."""
    step = F.ceil(F.sqrt(times)).cast("long")
    runs = df.where(F.col(times) > 0).withColumn("step__", step).withColumn("run__", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(times) / step).cast("long") - 1)))
    some = F.least(F.col("step__"), F.col(times) - F.col("run__") * F.col("step__"))
    return runs.withColumn("k__", F.explode(F.sequence(F.lit(1).cast("long"), some))).drop(times, "step__", "run__", "k__")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = 11, chunk: int = CHUNK) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and salt (a hash of id and text), a row for each row of docs."""
    found = counted(docs, weights, cap, seed, chunk)
    return found.where("rows = 1").drop("rows").unionByName(repeated(found.where("rows > 1"), "rows"))


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = 11) -> DataFrame:
    """The rows of docs as often as the mix takes them, with the columns of docs."""
    # rows alike in id, text and source share their copies: so many each, and one more for the first of them
    shared = counted(docs, weights, cap, seed).groupBy(F.col("salt").alias("salt__"), F.col("source").alias("of__")).agg(F.sum(F.col("copies") * F.col("rows")).alias("sum__"), F.sum("rows").alias("rows__"))
    shared = staged(shared.where("sum__ > 0"), "copies")
    # the text is dealt by that key at every size, so that what a run needs grows in proportion
    joined = docs.join(shared.hint("shuffle_hash"), (F.xxhash64("doc_id", "text") == F.col("salt__")) & F.col("source").eqNullSafe(F.col("of__")))
    names = docs.columns
    one = repeated(joined.where("rows__ = 1").select(*names, "sum__"), "sum__")
    if shared.where("rows__ > 1").isEmpty():
        return one
    # rows alike in every column are counted first, so only different ones of a text meet
    many = joined.where("rows__ > 1").groupBy(*names, "salt__", "of__", "sum__", "rows__").agg(F.count("*").alias("alike__"))
    before = F.coalesce(F.sum("alike__").over(Window.partitionBy("salt__", "of__").orderBy(F.xxhash64(*names)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    extra = F.least(F.greatest(F.col("sum__") % F.col("rows__") - before, F.lit(0)), F.col("alike__"))
    many = many.withColumn("share__", F.col("alike__") * F.floor(F.col("sum__") / F.col("rows__")) + extra)
    return one.unionByName(repeated(many.select(*names, "share__"), "share__"))
