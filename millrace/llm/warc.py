"""WARC archives and a Merkle audit of their replicas.

A replica is a table of (archive, offset, record); leaves() reduces it to hashes. The leaves are SHA-256 of the records; a tree's
lowest nodes cover ranges of 2^16 bytes of an archive by the records' offsets, and 16 neighbouring nodes
make one above, so that a lost record moves nothing else. Two replicas are compared from the roots
down: only below nodes that differ are the next ones looked at, until the records that differ remain.
Trees are built level by level with groups of bounded size; no archive is held as a whole.

Null url or html: empty. Repeated rows make records of their own. Null ids come first. Records of one
replica at the same place of an archive are compared as a set, in the order of their hashes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import staged

RANGE_BITS, FANOUT_BITS = 16, 4


def records(pages: DataFrame) -> DataFrame:
    """page_id and record: each page as one WARC resource record."""
    body = F.coalesce("html", F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return pages.select("page_id", F.concat(head, body, F.lit("\r\n\r\n")).cast("binary").alias("record"))


def placed(rows: DataFrame, per_archive: int = 2000) -> DataFrame:
    """rows (page_id, bytes, digest, more) with archive and offset: dealt out to archives of about per_archive records, in the order of page_id."""
    archives = max(1, -(-rows.count() // per_archive))
    dealt = rows.withColumn("archive", F.pmod(F.xxhash64("page_id", "digest"), F.lit(archives)))
    before = Window.partitionBy("archive").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("offset", F.coalesce(F.sum("bytes").over(before), F.lit(0).cast("long")))


HEAD = re.compile(rb"WARC/1\.[01]\r\n(?:[^\r\n]+\r\n)*?Content-Length: *(\d+)\r\n(?:[^\r\n]+\r\n)*\r\n", re.I)


def split_plain(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of each record. Where none starts, or one does not end as its length says, the bytes up to the next record's start are one."""
    at = 0
    while at < len(data):
        m = HEAD.match(data, at)
        end = m.end() + int(m[1]) + 4 if m else 0
        if not m or data[end - 4 : end] != b"\r\n\r\n":
            after = HEAD.search(data, m.end() if m else at + 1)
            end = after.start() if after else len(data)
        yield at, data[at:end]
        at = end


def split_gzip(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset in the file and text of each member, one record each. A member that can't be read is given as it lies, up to the next one's start."""
    at = 0
    while at < len(data):
        z, parts, i = zlib.decompressobj(31), [], at
        try:
            while i < len(data) and not z.eof:
                parts.append(z.decompress(data[i : i + 65536]))
                i += 65536
        except zlib.error:
            pass
        if z.eof:
            end = min(i, len(data)) - len(z.unused_data)
        else:
            after = data.find(b"\x1f\x8b\x08", at + 1)
            end, parts = after if after >= 0 else len(data), [data[at : after if after >= 0 else len(data)]]
        yield at, b"".join(parts)
        at = end


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """archive, offset, record from WARC files, plain or with a gzip member for each record.

    Every byte of a file belongs to one record: what is damaged becomes a record of its own and reading goes on behind
    it, so that an audit finds one fault, not all that follow. A file is one task's work and at most 2 GB; files that
    were compressed as one member have the whole of it as their only record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = (split_gzip if data[:3] == b"\x1f\x8b\x08" else split_plain)(data)
                while rows := list(islice(found, 1000)):
                    offsets, parts = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(offsets), pa.array(parts, pa.binary())], ["archive", "offset", "record"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, offset long, record binary")


def leaves(replica: DataFrame) -> DataFrame:
    """archive, offset, bytes, digest of each record of a replica (archive, offset, record)."""
    return replica.select("archive", "offset", F.octet_length("record").cast("long").alias("bytes"), F.sha2("record", 256).alias("digest"))


def levels_of(top: int) -> int:
    """Levels of nodes above the records, for archives whose last record starts at top."""
    n, span = 1, top >> RANGE_BITS
    while span:
        span, n = span >> FANOUT_BITS, n + 1
    return n


def nodes_above(below: DataFrame, shift: int, order: tuple[str, ...]) -> DataFrame:
    """archive, node, digest: one node for each run of 2^shift places, hashing what is below it in order."""
    node = F.shiftright(F.col("place"), shift)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order))), lambda x: F.concat_ws(":", *[x[c].cast("string") for c in order])), "\n")
    return below.groupBy("archive", node.alias("node")).agg(F.sha2(joined, 256).alias("digest")).select("archive", F.col("node").alias("place"), "digest")


def tree(leaf: DataFrame, levels: int) -> list[DataFrame]:
    """Nodes level by level, the lowest first; the last has one root for each archive."""
    out = [staged(nodes_above(leaf.withColumn("place", F.col("offset")), RANGE_BITS, ("place", "digest")), "merkle")]
    for _ in range(levels - 1):
        out.append(staged(nodes_above(out[-1], FANOUT_BITS, ("place", "digest")), "merkle"))
    return out


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """archive, place of the nodes that only one side has or whose digests differ."""
    pairs = a.withColumnRenamed("digest", "da").join(b.withColumnRenamed("digest", "db"), ["archive", "place"], "full")
    return pairs.where(~F.col("da").eqNullSafe(F.col("db"))).select("archive", "place")


def audit(good: DataFrame, other: DataFrame) -> DataFrame:
    """archive, offset, bytes, status (corrupt, missing, extra), good_digest, other_digest of every record in which two replicas' leaves differ."""
    columns = ("archive", "offset", "bytes", "digest")
    a, b = staged(good.select(*columns), "leaves"), staged(other.select(*columns), "leaves")
    top = a.unionByName(b).agg(F.max("offset")).first()[0] or 0
    levels = levels_of(top)
    up_a, up_b = tree(a, levels), tree(b, levels)
    bad = differing(up_a[-1], up_b[-1])
    for level in range(levels - 2, -1, -1):
        parent = bad.withColumnRenamed("place", "parent__")
        under = lambda t: t.withColumn("parent__", F.shiftright("place", FANOUT_BITS)).join(parent, ["archive", "parent__"], "left_semi").drop("parent__")  # noqa: B023, E731
        bad = staged(differing(under(up_a[level]), under(up_b[level])), "differing")
    ranges = bad.withColumnRenamed("place", "range__")
    inside = lambda t: t.withColumn("range__", F.shiftright("offset", RANGE_BITS)).join(ranges, ["archive", "range__"], "left_semi")
    twin = F.row_number().over(Window.partitionBy("archive", "offset").orderBy("digest"))
    x, y = (inside(t).select("archive", "offset", twin.alias("twin__"), F.col("bytes").alias(f"{n}_bytes"), F.col("digest").alias(f"{n}_digest")) for t, n in ((a, "good"), (b, "other")))
    both = x.join(y, ["archive", "offset", "twin__"], "full").where(~F.col("good_digest").eqNullSafe(F.col("other_digest")))
    status: Column = F.when(F.col("other_digest").isNull(), "missing").when(F.col("good_digest").isNull(), "extra").otherwise("corrupt")
    return both.select("archive", "offset", F.coalesce("good_bytes", "other_bytes").alias("bytes"), status.alias("status"), "good_digest", "other_digest")
