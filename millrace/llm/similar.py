"""Near-duplicates of word shingles: candidates by covering SimHash, verified by exact Jaccard similarity.

A fingerprint of 5-word shingles can't find a similarity of 0.8: its expected distance there is 9.7 of 64
bits, and a word that changes takes five shingles with it. So candidates come from fingerprints of the
distinct words, where a changed word counts once; covering masks find every pair of fingerprints within
`radius`. Only inside the connected components of these pairs are the texts themselves compared, by the
whole sets of their shingles: a group is what links of similarity `least` or more connect.

Work is done once for each text (lower case, single spaces), so groups of exact copies cost one row. A
component's texts meet in slices of about `block` texts or `block_bytes`; some of a large component's texts
(`pivots` of them, by hash) go to each of its slices and connect these. Texts that are still apart from a
component's largest group are then compared with everything outside their own group, in pairs of blocks.
Of similar texts only a spanning forest leaves a task, and texts of one group aren't compared again.

Words are those of op9. Null text: no words; texts without words form one group. Null doc_id: the row
takes part, and is kept only where no row of its group has an id. Repeated rows are copies of one
another. Other columns are kept and ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import small_batches, staged, uniform
from millrace.llm.simhash import SEED, components, majority, rows_of_texts
from millrace.llm.simhash import links as fingerprint_links

SHINGLE = 5
LEAST = 0.8
RADIUS = 6
BLOCK, BLOCK_BYTES, PIVOTS = 2048, 1 << 25, 16


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of the distinct shingles of a text in UTF-8, ascending; a text with fewer words is one shingle."""
    from xxhash import xxh64_intdigest

    ws = text.lower().split()  # of bytes: A-Z alone, and exactly the six white-space bytes
    if not ws:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(ws), len(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, n) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, n)
    return np.unique(np.fromiter((xxh64_intdigest(joined[x:y], SEED) for x, y in zip(begins[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n - k + 1))


def word_print(text: bytes) -> tuple[int, int]:
    """A hash of the text's words in order, and the fingerprint of its distinct words."""
    from xxhash import xxh64_intdigest

    ws = text.lower().split()
    distinct = set(ws)
    return xxh64_intdigest(b" ".join(ws), SEED), majority(np.fromiter((xxh64_intdigest(w, SEED) for w in distinct), np.uint64, len(distinct)))


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, salt (a hash of id and text), size (bytes), unit (a hash of the words in order) and fp, a row for each row of docs."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [word_print(x.as_py() or b"") for x in batch.column(3).cast(pa.binary())]
            unit, fp = (np.array(x, np.uint64).view(np.int64) for x in (zip(*both, strict=True) if both else ([], [])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(unit), pa.array(fp)], ["doc_id", "salt", "size", "unit", "fp"])

    of = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("salt"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), F.col("text").cast("string").alias("text"))
    return of.mapInArrow(run, f"doc_id {of.schema['doc_id'].dataType.simpleString()}, salt long, size long, unit long, fp long")


def candidates(rows: DataFrame, radius: int) -> DataFrame:
    """One row for each unit: unit, first (the smallest doc_id of its rows, with the salt and number of those), and root, n, bytes of its component where that has several units."""
    by_row = rows.groupBy("unit", "fp", "size", "doc_id", "salt").agg(F.count("*").alias("rows"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "salt", "rows", "size"))
    units = staged(by_row.groupBy("unit", "fp").agg(first.alias("first")), "units")
    near = components(fingerprint_links(units.select("fp").distinct(), radius))
    rooted = units.join(near.withColumnRenamed("node", "fp"), "fp", "left").select("unit", "first", F.coalesce("root", "fp").alias("root"))
    sizes = staged(rooted.groupBy("root").agg(F.count("*").alias("n"), F.sum("first.size").alias("bytes")).where("n > 1"), "components")
    return staged(rooted.join(sizes, "root", "left").select("unit", "first", F.when(F.col("n").isNotNull(), F.col("root")).alias("root"), "n", "bytes"), "candidates")


def similar(sets: list[np.ndarray], least: float = LEAST, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest, as places in the list, of the pairs of sets with a Jaccard similarity of `least` or more; those with one number in group are connected already."""
    if not sets:
        return []
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size, sets = size[order], [sets[i] for i in order]
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate(([0], np.cumsum(size)))
    group = np.arange(len(sets)) if group is None else np.unique(group, return_inverse=True)[1][order]
    mark, out = np.zeros(int(codes.max(initial=-1)) + 1, np.int64), []
    for i in range(len(sets)):
        j = int(np.searchsorted(size * least, size[i] + 1e-9, "right"))  # the longest that can be similar
        others = i + 1 + np.flatnonzero(group[i + 1 : j] != group[i])
        if not size[i] or not len(others):
            continue
        theirs = codes[starts[i + 1] : starts[j]] if len(others) == j - i - 1 else np.concatenate([codes[starts[x] : starts[x + 1]] for x in others.tolist()])
        mine = codes[starts[i] : starts[i + 1]]
        mark[mine] = 1
        both = np.add.reduceat(mark[theirs], np.cumsum(size[others]) - size[others])
        mark[mine] = 0
        for x in others[both / (size[i] + size[others] - both) >= least].tolist():
            if group[x] != group[i]:
                out.append((int(order[i]), int(order[x])))
                group[group == group[x]] = group[i]
    return out


def verified(texts: DataFrame, least: float, shingle: int, block: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """unit and group (the smallest unit that links lead to) of the units with a link. texts: unit, root, n, bytes and text, each unit once."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        unit = pdf["unit"].to_numpy()
        found = similar([shingles((t or "").encode(), shingle) for t in pdf["text"]], least, pdf["group"].to_numpy() if "group" in pdf else None)
        return pd.DataFrame([(unit[i], unit[j]) for i, j in found], columns=["a", "b"], dtype="int64")

    upto = lambda n: F.sequence(F.lit(0), n - 1)
    dealt = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "unit"), n).cast("int")
    slices: Column = F.ceil(F.greatest(F.col("n") / block, F.col("bytes") / block_bytes)).cast("int")
    sliced = texts.withColumn("slices", slices)
    everywhere = (F.col("slices") > 1) & (uniform(F.lit(59), F.col("unit")) < PIVOTS / F.col("n"))
    once = sliced.withColumn("slice", F.explode(F.when(everywhere, upto(F.col("slices"))).otherwise(F.array(dealt(F.col("slices"), 53)))))
    found = staged(once.select("root", "slice", "unit", "text").groupBy("root", "slice").applyInPandas(compare, "a long, b long"), "similar")

    large = sliced.where("slices > 1")
    if large.isEmpty():
        return components(found).withColumnRenamed("node", "unit").withColumnRenamed("root", "group")
    groups = components(found).select(F.col("node").alias("unit"), F.col("root").alias("group"))
    named = staged(large.select("unit", "root").join(groups, "unit", "left").select("unit", "root", F.coalesce("group", "unit").alias("group")), "groups")
    sizes = named.groupBy("root", "group").agg(F.count("*").alias("k"))
    main = staged(sizes.groupBy("root").agg(F.max(F.struct("k", "group")).alias("m"), F.sum("k").alias("all")).where(F.col("all") > F.col("m.k")).select(F.col("root").alias("of__"), F.col("m.group").alias("main"), F.col("m.k").alias("inside"), (F.col("all") - F.col("m.k")).alias("outside")), "main")
    apart = large.drop("root").join(named, "unit").join(main, F.col("root") == F.col("of__"))
    share = F.col("slices") / F.col("n")
    ins, outs = F.ceil(F.col("inside") * share).cast("int"), F.ceil(F.col("outside") * share).cast("int")
    own = dealt(outs, 61)
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    with_main = F.transform(upto(outs), lambda j: cell("main", dealt(ins, 61), j))
    with_rest = F.concat(F.transform(upto(ins), lambda i: cell("main", i, own)), F.transform(upto(outs), lambda j: cell("rest", F.least(own, j), F.greatest(own, j))))
    pairs = apart.withColumn("cell", F.explode(F.when(F.col("group") == F.col("main"), with_main).otherwise(with_rest)))
    more = pairs.select("root", "cell", "unit", "group", "text").groupBy("root", "cell").applyInPandas(compare, "a long, b long")
    return components(found.unionByName(more)).select(F.col("node").alias("unit"), F.col("root").alias("group"))


def _texts(units: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of docs that are first of their unit, with unit__, root__, n__ and bytes__."""
    chosen = staged(units.select(F.col("first.salt").alias("salt__"), F.col("first.rows").alias("rows__"), *[F.col(c).alias(f"{c}__") for c in ("unit", "root", "n", "bytes")]), "chosen")
    return rows_of_texts(docs, chosen).drop("key__")


def grouped(docs: DataFrame, least: float = LEAST, shingle: int = SHINGLE, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """doc_id, salt, unit, root (of the group, a unit) and component_id (the group's smallest doc_id), a row for each row of docs."""
    rows = staged(prints(docs), "prints")
    units = candidates(rows, radius)
    texts = _texts(units.where("root IS NOT NULL"), docs.select("doc_id", "text")).select(F.col("unit__").alias("unit"), F.col("root__").alias("root"), F.col("n__").alias("n"), F.col("bytes__").alias("bytes"), F.col("text").cast("string").alias("text"))
    groups = verified(staged(texts, "texts"), least, shingle, block)
    rooted = staged(units.select("unit", "first.doc_id").join(groups, "unit", "left").select("unit", "doc_id", F.coalesce("group", "unit").alias("root")), "rooted")
    smallest = staged(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest")
    return rows.select("doc_id", "salt", "unit").join(rooted.join(smallest, "root").select("unit", "root", "component_id"), "unit")


def keep_one(docs: DataFrame, least: float = LEAST, shingle: int = SHINGLE, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """The row of docs with the smallest doc_id of each group (of several texts with that id, one), with the columns of docs."""
    units = candidates(staged(prints(docs), "prints"), radius)
    # of a unit only its first row can stay, so the texts are dealt once
    firsts = staged(_texts(units, docs), "firsts")
    texts = firsts.where("root__ IS NOT NULL").select(F.col("unit__").alias("unit"), F.col("root__").alias("root"), F.col("n__").alias("n"), F.col("bytes__").alias("bytes"), F.col("text").cast("string").alias("text"))
    groups = verified(texts, least, shingle, block)
    near = units.where("root IS NOT NULL").select("unit", "first").join(groups, "unit", "left")
    best = F.min(F.struct("first.none", "first.doc_id", "first.salt", "unit")).alias("best")
    stay = staged(near.groupBy(F.coalesce("group", "unit").alias("group")).agg(best).select(F.col("best.unit").alias("stay__")), "stay")
    alone, several = firsts.where("root__ IS NULL"), firsts.where("root__ IS NOT NULL")
    return alone.unionByName(several.join(stay.hint("shuffle_hash"), F.col("unit__") == F.col("stay__"), "left_semi")).select(*docs.columns)
