"""MinHash near-duplicates: candidates share a band of MinHash samples, odd sketches estimate their similarity, full sets confirm it.

A text's set are its distinct word shingles. Of every set, `BANDS * ROWS` MinHash samples are taken; the
samples of a band make a key, and two sets with a common key are candidates. At a Jaccard similarity of
0.85 a pair shares no key with a probability of 2e-6. The odd sketch folds all samples into 512 bits, each
flipping one; samples that two sets share cancel out in the XOR of their sketches, so its population count
tells how many differ. Candidates more than five standard deviations beyond the count expected at the
threshold are dropped; the others are confirmed on their full sets, so no dissimilar pair links.

Sets are compared once, however many rows have them: groups of copies of any size are one node. Not all pairs
of a bucket are formed. First every member of a bucket meets the bucket's smallest node, in a few bands, then
in the others where that didn't connect them. Buckets that still hold several groups are compared in cells of
up to two slices of `slice_rows` members, those outside the largest group with it and with one another: sketches
first, then the full sets of those that are close to another one. Only links leave a cell, and a pair is compared
in the first bucket that it shares.

Hashes of shingles have 64 bits and stand for the shingles. Null text or no words: an empty set, linked with
nothing. Fewer words than a shingle has: one shingle of all words. Null doc_id: the row takes part, and a
component's id is null only if none of its rows has one. Repeated rows: each gets the same result. Empty
table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import small_batches, staged
from millrace.llm.simhash import SEED, components

SHINGLE, LEAST = 3, 85
BANDS, ROWS, BITS = 28, 6, 512
#: Bands whose buckets are connected through their smallest node before the others are.
FIRST = 4
SLICE_ROWS = 2048
WORDS = BITS // 64

_numbers = np.random.default_rng(11)
_FACTORS, _OFFSETS, _SALTS = (_numbers.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) for _ in range(3))
_FACTORS |= np.uint32(1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def farthest(least: int = LEAST, sds: float = 5.0) -> int:
    """The largest population count that a pair of that similarity (in percent) may have."""
    samples, other = BANDS * ROWS, 1 - least / 100
    differ = 2 * samples * other
    mean = BITS / 2 * (1 - (1 - 2 / BITS) ** differ)
    by_samples = 2 * (1 - 2 / BITS) ** differ * (samples * other * (1 - other)) ** 0.5
    by_folding = 2 * (differ * differ / (2 * BITS)) ** 0.5
    return int(mean + sds * (by_samples**2 + by_folding**2) ** 0.5)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[2]
    x = (x ^ (x >> np.uint64(27))) * _ODD[3]
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of the distinct shingles of a text in UTF-8, ascending."""
    from xxhash import xxh64_intdigest

    ws = text.lower().split()  # of bytes: A-Z alone, and exactly the six white-space bytes
    if not ws:
        return np.zeros(0, np.uint64)
    words = np.fromiter((xxh64_intdigest(w, SEED) for w in ws), np.uint64, len(ws))
    k = min(shingle, len(ws))
    n = len(ws) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = _mixed(h * _ODD[0] + words[i : i + n])
    return np.unique(h)


def digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of non-empty sets: a hash of the whole set, the key of each band, and the words of the odd sketch."""
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    together = np.concatenate(sets)
    unit = _mixed(np.add.reduceat(_mixed(together * _ODD[1]), starts))
    x = (together >> np.uint64(32)).astype(np.uint32)
    least = np.stack([np.minimum.reduceat(x * a + b, starts) for a, b in zip(_FACTORS, _OFFSETS, strict=True)], axis=1)
    keys = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band + 1, np.uint64)
        for i in range(band * ROWS, (band + 1) * ROWS):
            key = _mixed(key * _ODD[0] + least[:, i])
        keys[:, band] = key
    at = _mixed((least.astype(np.uint64) << np.uint64(32)) | _SALTS.astype(np.uint64)) >> np.uint64(64 - BITS.bit_length() + 1)
    flips = np.zeros((len(sets), BITS), np.uint8)
    np.add.at(flips, (np.arange(len(sets))[:, None], at.astype(np.int64)), 1)
    sketch = np.packbits(flips & 1, axis=1, bitorder="little").view("<u8")
    return unit.view(np.int64), keys.view(np.int64), sketch.view(np.int64)


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, salt (a hash of id and text), n (size of the set), and for sets that aren't empty unit (a hash of the set), keys of the bands, sketch; a row for each row of docs."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py() or b"", shingle) for x in batch.column(2).cast(pa.binary())]
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            at = np.full(len(sets), -1)
            at[full] = np.arange(len(full))
            unit, keys, sketch = digests([sets[i] for i in full]) if len(full) else (np.zeros(0, np.int64), np.zeros((0, BANDS), np.int64), np.zeros((0, WORDS), np.int64))
            taken = pa.array(at, mask=at < 0)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.int64())).take(taken) for x in (keys, sketch)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n), pa.array(unit).take(taken), *lists], ["doc_id", "salt", "n", "unit", "keys", "sketch"])

    of = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("salt"), F.col("text").cast("string").alias("text"))
    return of.mapInArrow(run, f"doc_id {of.schema['doc_id'].dataType.simpleString()}, salt long, n long, unit long, keys array<long>, sketch array<long>")


def full_sets(docs: DataFrame, rows: DataFrame, chosen: DataFrame, shingle: int) -> DataFrame:
    """unit and set of the units of chosen (unit, salt); rows: those of sketches()."""
    repeated = rows.groupBy("salt").agg(F.count("*").alias("times")).where("times > 1")
    chosen = staged(chosen.join(repeated, "salt", "left").select(F.col("salt").alias("salt__"), "unit", F.col("times").isNotNull().alias("several")), "chosen")
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key__"), F.col("text").cast("string").alias("text"))
    # texts are dealt by that key at every size, so that what a run needs grows in proportion
    of = lambda cond: keyed.join(chosen.where(cond).hint("merge"), F.col("key__") == F.col("salt__")).select("unit", "text")
    texts = of("NOT several")
    if not chosen.where("several").isEmpty():
        texts = texts.unionByName(of("several").dropDuplicates(["unit"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py() or b"", shingle).view(np.int64) for x in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["unit", "set"])

    return staged(texts.mapInArrow(run, "unit long, set array<long>"), "sets")


def apart(a: Column, b: Column) -> Column:
    """How many bits two sketches differ in."""
    out = F.bit_count(F.get(a, F.lit(0)).bitwiseXOR(F.get(b, F.lit(0))))
    for i in range(1, WORDS):
        out = out + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return out


def confirmed(pairs: DataFrame, info: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Those of the pairs (a, b), each once, whose sketches are close and whose full sets are similar."""
    side = lambda x: info.select(F.col("unit").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    close = pairs.join(side("a"), "a").join(side("b"), "b")
    close = close.where((least * F.greatest("n_a", "n_b") <= 100 * F.least("n_a", "n_b")) & (apart(F.col("s_a"), F.col("s_b")) <= farthest(least))).select("a", "b")
    whole = lambda x: sets.select(F.col("unit").alias(x), F.col("set").alias(f"set_{x}"))
    both = close.join(whole("a"), "a").join(whole("b"), "b")
    both = both.select("a", "b", F.size("set_a").alias("n_a"), F.size("set_b").alias("n_b"), F.size(F.array_intersect("set_a", "set_b")).alias("common"))
    return staged(both.where(100 * F.col("common").cast("long") >= least * (F.col("n_a") + F.col("n_b") - F.col("common")).cast("long")).select("a", "b"), "confirmed")


def _close(x: np.ndarray, y: np.ndarray, band: int, least: int, most: int) -> np.ndarray:
    """Places (i, j) of rows of x and y of different groups whose sketches are close, whose sizes allow the similarity, and that share no key of a band before. Rows: main, group, unit, n, sketch..., keys..."""
    far = np.zeros((len(x), len(y)), np.int16)
    for i in range(4, 4 + WORDS):
        far += np.bitwise_count(x[:, i].view(np.uint64)[:, None] ^ y[:, i].view(np.uint64)[None, :])
    sizes = x[:, 3][:, None], y[:, 3][None, :]
    at = np.argwhere((far <= most) & (least * np.maximum(*sizes) <= 100 * np.minimum(*sizes)) & (x[:, 1][:, None] != y[:, 1][None, :]))
    if band and len(at):
        first = slice(4 + WORDS, 4 + WORDS + band)
        at = at[~(x[at[:, 0], first] == y[at[:, 1], first]).any(axis=1)]
    return at


def cell_pairs(rows: np.ndarray, rest: bool, band: int, least: int, most: int) -> Iterator[np.ndarray]:
    """Places of such pairs in a cell: of rows outside the main group with it, or with one another (each once), some at a time."""
    outside = np.flatnonzero(rows[:, 0] == 0)
    others = outside if rest else np.flatnonzero(rows[:, 0] == 1)
    if len(others) <= rest:
        return
    own = np.ascontiguousarray(rows[others])
    for a in range(0, len(outside), 256):
        some = outside[a : a + 256]
        at = _close(np.ascontiguousarray(rows[some]), own, band, least, most)
        pairs = np.stack([some[at[:, 0]], others[at[:, 1]]], axis=1)
        yield pairs[pairs[:, 0] < pairs[:, 1]] if rest else pairs


def cell_links(rows: np.ndarray, sets: list[np.ndarray], rest: bool, band: int, least: int, most: int) -> list[tuple[int, int]]:
    """Places of the pairs of a cell that their full sets confirm; pairs that links of this cell have connected aren't compared any more."""
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    of = lambda i: codes[starts[i] : starts[i + 1]]
    group, mark, out = rows[:, 1].copy(), np.zeros(int(codes.max(initial=0)) + 1, np.int64), []
    for pairs in cell_pairs(rows, rest, band, least, most):
        for i in np.unique(pairs[:, 0]).tolist():
            partners = pairs[pairs[:, 0] == i, 1]
            partners = partners[group[partners] != group[i]]
            if not len(partners):
                continue
            mark[of(i)] = 1
            sizes = starts[partners + 1] - starts[partners]
            both = np.add.reduceat(mark[np.concatenate([of(j) for j in partners.tolist()])], np.cumsum(sizes) - sizes)
            mark[of(i)] = 0
            for j in partners[100 * both >= least * (len(of(i)) + sizes - both)].tolist():
                if group[j] != group[i]:
                    out.append((i, j))
                    group[group == group[j]] = group[i]
    return out


def across(shared: DataFrame, groups: DataFrame, info: DataFrame, sets: DataFrame, least: int, slice_rows: int) -> DataFrame:
    """Links (a, b) between different groups of one bucket that connect whatever its pairs of similar sets connect. groups: unit and group of the units that have links.

    Sketches meet first; full sets come only of units with a close sketch in their cell, and each pair is compared in the first bucket that it shares.
    """
    members = shared.select("band", "key", "unit").join(groups, "unit", "left").select("band", "key", "unit", F.coalesce("group", "unit").alias("group"))
    members = staged(members, "members")
    sizes = members.groupBy("key", "group").agg(F.count("*").alias("k"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("k", "group")).alias("m"), F.sum("k").alias("all")).where(F.col("all") > F.col("m.k"))
    slices = lambda n: F.ceil(n / slice_rows).cast("int")
    mixed = mixed.select("key", F.col("m.group").alias("main"), slices(F.col("m.k")).alias("ins"), slices(F.col("all") - F.col("m.k")).alias("outs"))
    rows = members.join(mixed, "key")
    is_main = F.col("group") == F.col("main")
    own = lambda n: F.pmod(F.xxhash64(F.lit(61), "unit"), n).cast("long")
    upto = lambda n: F.transform(F.sequence(F.lit(0), n - 1), lambda x: x.cast("long"))
    cell = lambda rest, i, j: F.struct(F.lit(rest).cast("long").alias("rest"), i.alias("i"), j.alias("j"))
    ins, outs = F.col("ins"), F.col("outs")
    with_main = F.transform(upto(outs), lambda j: cell(0, own(ins), j))
    with_rest = F.concat(F.transform(upto(ins), lambda i: cell(0, i, own(outs))), F.transform(upto(outs), lambda j: cell(1, F.least(own(outs), j), F.greatest(own(outs), j))))
    rows = rows.withColumn("cell", F.explode(F.when(is_main, with_main).otherwise(with_rest)))
    at, fixed = ["key", "rest", "i", "j", "band"], ["main", "group", "unit", "n"]
    rows = staged(rows.select("key", "cell.*", F.col("band").cast("long").alias("band"), is_main.cast("long").alias("main"), "group", "unit"), "cells")
    flat = ["n", *[F.get("sketch", F.lit(i)).alias(f"s{i}") for i in range(WORDS)], *[F.get("keys", F.lit(i)).alias(f"k{i}") for i in range(BANDS)]]
    most, width = farthest(least), len(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: np.ndarray | None = None  # the cell that the next batch may continue

        def close(matrix: np.ndarray, last: bool) -> tuple[pa.RecordBatch, np.ndarray]:
            cuts = np.flatnonzero((matrix[1:, :4] != matrix[:-1, :4]).any(axis=1)) + 1
            parts, found = np.split(matrix, cuts), []
            for part in parts if last else parts[:-1]:
                here = np.zeros(len(part), bool)
                for pairs in cell_pairs(part[:, width:], bool(part[0, 1]), int(part[0, 4]), least, most):
                    here[pairs.ravel()] = True
                found.append(part[here][:, [0, 1, 2, 3, 4, 5, 6, 7]])
            out = np.concatenate(found) if found else np.zeros((0, 8), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(out[:, i]) for i in range(8)], [*at, *fixed[:3]]), parts[-1]

        for batch in batches:
            matrix = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            if len(matrix):
                found, carry = close(matrix if carry is None else np.concatenate([carry, matrix]), False)
                yield found
        if carry is not None:
            yield close(carry, True)[0]

    def confirm(pdf: pd.DataFrame) -> pd.DataFrame:
        matrix = np.concatenate([pdf[[*fixed[:3], "n"]].to_numpy(np.int64), np.stack(pdf["sketch"]), np.stack(pdf["keys"])], axis=1)
        found = cell_links(matrix, list(pdf["set"]), bool(pdf["rest"].iloc[0]), int(pdf["band"].iloc[0]), least, most)
        unit = pdf["unit"].to_numpy()
        return pd.DataFrame([(unit[i], unit[j]) for i, j in found], columns=["a", "b"], dtype="int64")

    dealt = rows.join(info, "unit").select(*at, "main", "group", "unit", *flat).repartition(*at).sortWithinPartitions(*at)
    close = staged(dealt.mapInArrow(run, ", ".join(f"{c} long" for c in [*at, *fixed[:3]])), "close")
    whole = close.join(info, "unit").join(sets, "unit").select(*at, *fixed, "sketch", "keys", "set")
    return staged(whole.groupBy(*at).applyInPandas(confirm, "a long, b long"), "across")


def linked(docs: DataFrame, least: int = LEAST, shingle: int = SHINGLE, slice_rows: int = SLICE_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of sketches(), a table of units (unit, first_id), and unit and group of the units with links."""
    rows = staged(sketches(docs, shingle), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "salt")).alias("first")
    units = rows.where("n > 0").groupBy("unit").agg(first, *[F.any_value(c).alias(c) for c in ("n", "keys", "sketch")])
    units = staged(units.select("unit", F.col("first.doc_id").alias("first_id"), F.col("first.salt").alias("salt"), "n", "keys", "sketch"), "units")

    keyed = units.select("unit", F.posexplode("keys").alias("band", "key"))
    tops = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("unit").alias("top")).where("n > 1").select("key", "top")
    shared = staged(keyed.join(tops, "key").select("band", "key", "unit", "top"), "shared")
    with_partner = units.join(shared.select("unit").distinct(), "unit", "left_semi")
    info = staged(with_partner.select("unit", "salt", "n", "sketch", "keys"), "info")
    sets = full_sets(docs, rows, info.select("salt", "unit"), shingle)
    info = info.drop("salt")

    def pairs_with_top(some: DataFrame) -> DataFrame:
        return some.where("unit <> top").select(F.col("top").alias("a"), F.col("unit").alias("b")).distinct()

    def groups_of(found: DataFrame) -> DataFrame:
        return staged(components(found).withColumnsRenamed({"node": "unit", "root": "group"}), "groups")

    found = confirmed(pairs_with_top(shared.where(F.col("band") < FIRST)), info, sets, least)
    groups = groups_of(found)
    group = lambda c: groups.select(F.col("unit").alias(c), F.col("group").alias(f"of_{c}"))
    split = pairs_with_top(shared.where(F.col("band") >= FIRST)).join(group("a"), "a", "left").join(group("b"), "b", "left")
    split = staged(split.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b"), "split")
    found = found.unionByName(confirmed(split, info, sets, least))
    found = found.unionByName(across(shared, groups_of(found), info, sets, least, slice_rows))
    return rows, units.select("unit", "first_id"), groups_of(found)


def near_duplicates(docs: DataFrame, least: int = LEAST, shingle: int = SHINGLE, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links lead to) and kept, a row for each row of docs."""
    rows, units, groups = linked(docs, least, shingle, slice_rows)
    rooted = staged(units.join(groups, "unit", "left").select("unit", "first_id", F.coalesce("group", "unit").alias("root")), "rooted")
    smallest = staged(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "smallest")
    out = rows.select("doc_id", "n", "unit").join(rooted.join(smallest, "root").select("unit", "component_id"), "unit", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


#: The same rows in DuckDB's SQL, from all pairs of sets with a common shingle.
SQL = f"""
WITH RECURSIVE t AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT r, array_to_string(ws[i:i + {SHINGLE - 1}], ' ') AS x FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - {SHINGLE - 1}, 1) + 1)) AS i FROM t WHERE len(ws) > 0)
), n AS MATERIALIZED (
  SELECT r, count(*) AS n FROM s GROUP BY r
), p AS MATERIALIZED (
  SELECT a, b FROM (SELECT l.r AS a, g.r AS b, count(*) AS c FROM s l JOIN s g ON l.x = g.x AND l.r < g.r GROUP BY l.r, g.r) JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * c >= {LEAST} * (na.n + nb.n - c)
), e AS MATERIALIZED (
  SELECT a, b FROM p UNION SELECT b, a FROM p
), reach AS (
  SELECT r AS a, r AS b FROM t UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b
), c AS (
  SELECT a AS r, min(t.doc_id) AS component_id FROM reach JOIN t ON t.r = reach.b GROUP BY a
)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, t.doc_id IS NOT DISTINCT FROM c.component_id AS kept FROM t JOIN c USING (r) LEFT JOIN n USING (r)"""
