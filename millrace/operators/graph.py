"""The property graph as vertex and edge tables: traversal by frontier joins, genealogy by equi-joins.

A walk keeps the nodes it has seen; each hop joins only the new ones with the edges and drops what was
seen, so the work of a hop is its frontier's edges and no path is enumerated. Every hop is written to the
shared folder, so lineage stays short and a lost executor costs one hop.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where the session names none and runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/hop-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upsert_by_key(existing: DataFrame, incoming: DataFrame, keys: list[str], update_cols: list[str], order: str | None = None) -> DataFrame:
    """Rows of existing with update_cols taken from the newest incoming row of the key; new keys are added."""
    rest = [c for c in incoming.columns if c not in keys]
    newest = incoming.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*([F.col(order)] if order else []), F.xxhash64(*rest))).alias("n__"))
    old = existing.select(*keys, F.struct(*[c for c in existing.columns if c not in keys]).alias("o__"))
    j = old.join(newest, keys, "full")
    there = F.col("o__").isNotNull()

    def value(c: str):
        new = F.col(f"n__.{c}") if c in rest else F.lit(None)
        if c in update_cols and c in rest:
            return F.when(F.col("n__").isNotNull(), new).otherwise(F.col(f"o__.{c}"))
        return F.when(there, F.col(f"o__.{c}")).otherwise(new)

    return j.select(*[F.col(c) if c in keys else value(c).alias(c) for c in existing.columns])


def build_graph(tables: dict[str, tuple[DataFrame, str]], edges: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Vertices (label, id) from tables with their id columns, and edges, each once."""
    vertices = reduce(DataFrame.unionByName, [df.select(F.lit(label).alias("label"), F.col(key).cast("string").alias("id")) for label, (df, key) in tables.items()])
    return vertices.distinct(), reduce(DataFrame.unionByName, edges).distinct()


def both_ways(edges: DataFrame, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """a, b, type, forward: edges as steps that a walk may take."""
    e = edges.where(F.col("type").isin(types)) if types else edges
    out = e.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"), "type", F.lit(True).alias("forward"))
    back = e.select(F.col("dst_id").alias("a"), F.col("src_id").alias("b"), "type", F.lit(False).alias("forward"))
    return out if direction == "forward" else back if direction == "backward" else out.unionByName(back)


def neighbors(edges: DataFrame, node: str, kind: str | None = None) -> DataFrame:
    """Adjacent nodes in either direction with the edge's type and direction."""
    return both_ways(edges, "both", [kind] if kind else None).where(F.col("a") == node).select(F.col("b").alias("node"), "type", "forward").distinct()


def traverse(edges: DataFrame, start: DataFrame, depth: int = 3, direction: str = "forward", types: list[str] | None = None) -> DataFrame:
    """node, depth for all nodes within 1 to depth hops of the nodes in start (column node), at their smallest depth.

    Each hop keeps only the edges of its frontier: a semi-join, which Spark pushes below unions and distincts of the edges
    and answers by a broadcast where the frontier is small. So the edges are scanned, never written or sorted as a whole.
    """
    steps = both_ways(edges, direction, types).select("a", "b")
    seen = cut(start.select("node", F.lit(0).alias("depth")).distinct())
    frontier = seen.select("node")
    for hop in range(1, depth + 1):
        reached = steps.join(frontier, F.col("a") == F.col("node"), "left_semi").select(F.col("b").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        new = cut(reached.withColumn("depth", F.lit(hop)))
        if new.isEmpty():
            break
        seen, frontier = seen.unionByName(new), new.select("node")
    return seen.where("depth > 0")


def traverse_edges(edges: DataFrame, start: DataFrame, depth: int = 3, direction: str = "forward", types: list[str] | None = None) -> DataFrame:
    """Edges between the nodes of traverse() that leave a node above the last hop, each once."""
    edges = cut(edges.select("src_id", "type", "dst_id"))
    nodes = traverse(edges, start, depth, direction, types).unionByName(start.select("node", F.lit(0).alias("depth")))
    steps = both_ways(edges, direction, types)
    inside = steps.join(nodes.where(F.col("depth") < depth).select(F.col("node").alias("a")), "a").join(nodes.select(F.col("node").alias("b")), "b")
    return inside.select(F.when(F.col("forward"), F.col("a")).otherwise(F.col("b")).alias("src_id"), "type", F.when(F.col("forward"), F.col("b")).otherwise(F.col("a")).alias("dst_id")).distinct()


def shortest_path(edges: DataFrame, a: str, b: str, depth: int = 5) -> DataFrame:
    """One path of fewest undirected hops as step, node; of equal ones the smallest by node ids. Empty if there is none.

    Each hop keeps the smallest predecessor of a new node only, so the tables grow with nodes, not with paths.
    """
    spark = edges.sparkSession
    steps = both_ways(edges).select("a", "b")
    seen = cut(spark.range(1).select(F.lit(a).alias("node"), F.lit(0).alias("step"), F.array(F.lit(a)).alias("path")))
    frontier = seen
    for hop in range(1, depth + 1):
        if a == b:
            break
        of = steps.join(frontier.select(F.col("node").alias("here__")), F.col("a") == F.col("here__"), "left_semi").distinct()
        near = frontier.join(of, F.col("node") == F.col("a")).join(seen.select(F.col("node").alias("old__")), F.col("b") == F.col("old__"), "left_anti")
        new = cut(near.groupBy(F.col("b").alias("node")).agg(F.min("path").alias("path")).select("node", F.lit(hop).alias("step"), F.concat("path", F.array("node")).alias("path")))
        seen, frontier = seen.unionByName(new), new
        if new.where(F.col("node") == b).head(1) or new.isEmpty():
            break
    return seen.where(F.col("node") == b).select(F.posexplode("path").alias("step", "node"))


def trace_lot_forward(edges: DataFrame, lot: str, depth: int = 3) -> DataFrame:
    return traverse(edges, edges.sparkSession.range(1).select(F.lit(lot).alias("node")), depth, "forward")


def closure(pairs: DataFrame) -> DataFrame:
    """a, b, length: all pairs joined by one edge or more, with the fewest edges, however many.

    A pair of more than `far` edges starts with one of exactly `far`, so each round extends only those by all
    pairs found so far and doubles `far`: rounds grow with the logarithm of the longest length.
    """
    seen, far = cut(pairs.select("a", "b").distinct().withColumn("length", F.lit(1))), 1
    while True:
        ends = seen.where(F.col("length") == far).select("a", F.col("b").alias("mid"))
        on = seen.select(F.col("a").alias("mid"), "b", (F.col("length") + far).alias("length"))
        new = cut(ends.join(on, "mid").groupBy("a", "b").agg(F.min("length").alias("length")).join(seen.select("a", "b"), ["a", "b"], "left_anti"))
        if new.isEmpty():
            return seen
        seen, far = cut(seen.unionByName(new)), 2 * far


def process_route(edges: DataFrame) -> DataFrame:
    """All (from, to) step pairs that NEXT_STEP connects."""
    return closure(edges.where("type = 'NEXT_STEP'").select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"))).select(F.col("a").alias("from_step"), F.col("b").alias("to_step"))


def battery_genealogy(cells: DataFrame, pack: str | None = None, roll: str | None = None) -> DataFrame:
    """Pack, module, cell, roll of a pack, or of all packs that a roll went into."""
    out = cells.select("pack_id", "module_id", "cell_id", "roll_id")
    return out.where(F.col("pack_id") == pack) if pack is not None else out.where(F.col("roll_id") == roll)


def affected_packs(cells: DataFrame) -> DataFrame:
    """Per roll: the packs and cells that it went into."""
    return cells.groupBy("roll_id").agg(F.count_distinct("pack_id").alias("packs"), F.count("*").alias("cells"))


def trace_root_causes(rules: DataFrame, param: str, depth: int = 3) -> DataFrame:
    """Upstream causes with their depth; is_root for causes without a cause of their own."""
    e = rules.select(F.col("source").alias("src_id"), F.col("target").alias("dst_id"), F.lit("CAUSES").alias("type"))
    up = traverse(e, rules.sparkSession.range(1).select(F.lit(param).alias("node")), depth, "backward")
    caused = rules.select(F.col("target").alias("node"), F.lit(True).alias("caused__")).distinct()
    return up.join(caused, "node", "left").select(F.col("node").alias("cause"), "depth", F.col("caused__").isNull().alias("is_root"))


def _chains(edges: DataFrame, chain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of nodes with one edge in and one out: v, u, w (the nodes before and after its chain), and node, part of those on cycles of such nodes alone.

    Pointers double: each round a node's pointer, if it stands on a chain, moves on to where that one points. Once the number
    of pointers on chains stays the same, those left go round a cycle; their smallest node is found by going on.
    """
    at = edges.join(chain.select(F.col("node").alias("a")), "a").select(F.col("a").alias("v"), F.col("b").alias("w"))
    back = edges.join(chain.select(F.col("node").alias("b")), "b").select(F.col("b").alias("v"), F.col("a").alias("u"))
    now, left = cut(at.join(back, "v").select("v", "u", "w", F.least("v", "w").alias("least"), F.lit(False).alias("changed"))), None
    while True:
        ahead = now.select(F.col("v").alias("w"), F.col("w").alias("w2"), F.col("least").alias("least2"))
        behind = now.select(F.col("v").alias("u"), F.col("u").alias("u2"))
        both = now.join(ahead, "w", "left").join(behind, "u", "left")
        least = F.least("least", F.coalesce("least2", "least"))
        now = cut(both.select("v", F.coalesce("u2", "u").alias("u"), F.coalesce("w2", "w").alias("w"), least.alias("least"), (F.col("w2").isNotNull() & (least < F.col("least"))).alias("changed")))
        on_chain = now.join(chain.select(F.col("node").alias("w")), "w", "left_semi")
        n, moved = on_chain.agg(F.count("*"), F.count_if("changed")).first()
        if not n or (n == left and not moved):
            ends = now.join(chain.select(F.col("node").alias("w")), "w", "left_anti").select("v", "u", "w")
            return ends, on_chain.select(F.col("v").alias("node"), F.col("least").alias("part"))
        left = n


def _core_parts(edges: DataFrame) -> DataFrame:
    """node, part of the strongly connected parts of two nodes or more, by colours: each node takes the largest node that reaches it; those of a colour that reach its namesake are its part."""
    spark, found = edges.sparkSession, []
    while not edges.isEmpty():
        colour = cut(edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct().withColumn("part", F.col("node")))
        while True:
            coming = edges.join(colour.select(F.col("node").alias("a"), "part"), "a").groupBy(F.col("b").alias("node")).agg(F.max("part").alias("more"))
            new = cut(colour.join(coming, "node", "left").select("node", F.greatest("part", F.coalesce("more", "part")).alias("part"), (F.col("more") > F.col("part")).alias("moved")))
            colour = new.select("node", "part")
            if new.where("moved").isEmpty():
                break
        same = cut(edges.join(colour.select(F.col("node").alias("a"), "part"), "a").join(colour.select(F.col("node").alias("b"), F.col("part").alias("q")), "b").where("part = q").select("a", "b", "part"))
        reach = frontier = cut(colour.where("node = part"))
        while True:
            new = cut(same.join(frontier.select(F.col("node").alias("b"), "part"), ["b", "part"], "left_semi").select(F.col("a").alias("node"), "part").distinct().join(reach, ["node", "part"], "left_anti"))
            if new.isEmpty():
                break
            reach, frontier = reach.unionByName(new), new
        reach = cut(reach)
        several = reach.groupBy("part").agg(F.count("*").alias("n")).where("n > 1")
        found.append(reach.join(several, "part", "left_semi").select("node", "part"))
        gone = lambda c, r=reach: r.select(F.col("node").alias(c))
        edges = cut(same.join(gone("a"), "a", "left_anti").join(gone("b"), "b", "left_anti").select("a", "b"))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "node string, part string")


def on_cycles(pairs: DataFrame) -> DataFrame:
    """node: those that edges (a, b) lead back to, with work in proportion to the edges and rounds in proportion to the logarithm of a chain's length.

    Edges from a node without an edge in, or to one without an edge out, go first, as long as that takes a fifth of them each time.
    Chains of nodes with one edge in and one out shrink to an edge; nodes without an edge in or out go; what is left is cut
    into strongly connected parts. A node of a shrunk chain is on a cycle if both of the chain's ends are in one part.
    """
    edges = cut(pairs.where("a IS NOT NULL AND b IS NOT NULL").select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).distinct())
    parts, levels = [cut(edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("part")))], []
    edges = cut(edges.where("a <> b"))
    n = edges.count()
    while n:
        edges = cut(edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").join(edges.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b"))
        n, before = edges.count(), n
        if n > 0.8 * before:
            break
    while True:
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
        degrees = cut(ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("in").alias("in")))
        chains, dead = degrees.agg(F.count_if((F.col("out") == 1) & (F.col("in") == 1)), F.count_if((F.col("out") == 0) | (F.col("in") == 0))).first()
        if not chains and not dead:
            break
        if chains:
            chain = degrees.where("out = 1 AND `in` = 1").select("node")
            segments, rings = _chains(edges, chain)
            segments = cut(segments)
            closed = segments.where("u = w")
            parts += [rings, closed.select(F.col("v").alias("node"), F.col("u").alias("part")), closed.select(F.col("u").alias("node"), F.col("u").alias("part")).distinct()]
            levels.append(segments.where("u <> w"))
            inner = lambda c, n=chain: n.select(F.col("node").alias(c))
            core = edges.join(inner("a"), "a", "left_anti").join(inner("b"), "b", "left_anti").select("a", "b")
            edges = cut(core.unionByName(segments.where("u <> w").select(F.col("u").alias("a"), F.col("w").alias("b"))).distinct())
        if dead:
            lost = degrees.where("out = 0 OR `in` = 0")
            of = lambda c, n=lost: n.select(F.col("node").alias(c))
            edges = cut(edges.join(of("a"), "a", "left_anti").join(of("b"), "b", "left_anti").select("a", "b"))
    known = cut(reduce(DataFrame.unionByName, [*parts, _core_parts(edges)]).distinct())
    for segments in reversed(levels):
        before, after = (known.select(F.col("node").alias(c), "part") for c in ("u", "w"))
        inside = segments.join(before, "u").join(after, ["w", "part"]).select(F.col("v").alias("node"), "part")
        known = cut(known.unionByName(inside).distinct())
    return known.select("node").distinct()


def check_link_constraints(vertices: DataFrame, edges: DataFrame, valid_from: str | None = None, valid_to: str | None = None) -> DataFrame:
    """kind, key, n of what breaks a constraint: repeated edges, unknown ends, inverted validity, nodes on cycles of NEXT_STEP."""
    key = F.concat_ws("|", "src_id", "type", "dst_id")
    parts = [edges.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate").alias("kind"), "key", "n")]
    # both ends of an edge are counted before they are looked up, so the edges are read once for them and each node is looked up once
    ends = F.array(*[F.struct(F.lit(f"unknown_{end}").alias("kind"), F.col(f"{end}_label").alias("l__"), F.col(f"{end}_id").alias("i__")) for end in ("src", "dst")])
    nodes = edges.select(F.inline(ends)).groupBy("kind", "l__", "i__").agg(F.count("*").alias("n"))
    lost = nodes.join(vertices.select(F.col("label").alias("l__"), F.col("id").alias("i__")), ["l__", "i__"], "left_anti")
    parts.append(lost.groupBy("kind", F.concat_ws("|", "l__", "i__").alias("key")).agg(F.sum("n").alias("n")).select("kind", "key", "n"))
    if valid_from and valid_to:
        parts.append(edges.where(F.col(valid_from) > F.col(valid_to)).groupBy(key.alias("key")).agg(F.count("*").alias("n")).select(F.lit("inverted_validity").alias("kind"), "key", "n"))
    route = on_cycles(edges.where("type = 'NEXT_STEP'").select(F.col("src_id").alias("a"), F.col("dst_id").alias("b")))
    parts.append(route.select(F.lit("cycle").alias("kind"), F.col("node").alias("key"), F.lit(1).cast("long").alias("n")))
    return reduce(DataFrame.unionByName, parts)
