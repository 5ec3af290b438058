"""Token ids in a binary file format: canonical Huffman codes of limited length, decoded block by block.

Global counts of the ids (at most one row for each entry of the vocabulary) give code lengths by
package-merge; codes are canonical, so the code book is only (id, length). A file is a Parquet table of
self-contained binary blocks, which Spark's writer commits as a whole on any store. A block holds
whole documents in ascending order and the bit offset of every 128th id, so that all its stretches are
decoded side by side with one look-up table.

Block, little-endian: "MRT1", documents n, stretches m; n doc ids (int64), n null flags (1 byte), n id
counts (uint32), m bit offsets (uint64), the bits (first bit first). Files are ordered by doc_id, nulls
first, ties by content; rows with the same id stay rows of their own. Null text is empty text: it has
the end id alone. Other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import small_batches, staged
from millrace.llm.tokens import WORD_BPE, encoder

MAX_BITS = 16
STRETCH = 128
BLOCK_BYTES = 1 << 20
VOCABULARY = 1 << 16
MAGIC = b"MRT1"


def code_lengths(weights: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code under the limit, for positive weights (package-merge)."""
    n = len(weights)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols don't fit codes of {max_bits} bits")
    order = np.argsort(weights, kind="stable")
    leaves = np.asarray(weights, np.float64)[order]
    packages, levels = np.empty(0), []
    for _ in range(max_bits):
        both = np.concatenate([leaves, packages])
        at = np.argsort(both, kind="stable")
        levels.append(at < n)
        both = both[at]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    out, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(levels):
        k = int(leaf[:take].sum())
        out[order[:k]] += 1
        take = 2 * (take - k)
    return out


def canonical(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code and length by id, for all of the vocabulary; codes ascend by (length, id)."""
    code, bits = np.zeros(VOCABULARY, np.uint64), np.zeros(VOCABULARY, np.int64)
    order = np.lexsort((ids, lengths))
    ids, lengths = ids[order], lengths[order]
    steps = np.concatenate(([0], np.cumsum(1 << (MAX_BITS - lengths))[:-1])) if len(ids) else lengths
    code[ids], bits[ids] = (steps >> (MAX_BITS - lengths)).astype(np.uint64), lengths
    return code, bits


def pack(ids: np.ndarray, counts: np.ndarray, code: np.ndarray, bits: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The codes of documents one after another, each from a whole byte on: bytes, first byte of each document (and the end), bit offset of each id."""
    width = bits[ids]
    ends = np.cumsum(width)
    last = np.cumsum(counts)
    size = np.diff(np.concatenate(([0], ends[last - 1]))) if len(counts) else np.zeros(0, np.int64)
    first = np.concatenate(([0], np.cumsum((size + 7) // 8)))
    shift = first[:-1] * 8 - (np.cumsum(size) - size)
    at = ends - width + np.repeat(shift, counts)
    value = code[ids] << (64 - (at & 31) - width).astype(np.uint64)
    words = int(first[-1] * 8 // 32 + 2)
    total = np.bincount(at >> 5, (value >> np.uint64(32)).astype(np.float64), words) + np.bincount((at >> 5) + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), words + 0 if len(ids) else words)[:words]
    return total.astype(">u4").tobytes()[: int(first[-1])], first, at


def look_up(code: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and length for every 16 bits that may come next."""
    ids = np.flatnonzero(bits)
    order = ids[np.lexsort((ids, bits[ids]))]
    span = 1 << (MAX_BITS - bits[order])
    symbol, length = np.zeros(1 << MAX_BITS, np.uint32), np.zeros(1 << MAX_BITS, np.int64)
    symbol[: span.sum()], length[: span.sum()] = np.repeat(order, span), np.repeat(bits[order], span)
    return symbol, length


def stretches(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First id (counted through all documents) and number of ids of each stretch; none crosses a document."""
    n = (counts + STRETCH - 1) // STRETCH
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = np.repeat(np.cumsum(counts) - counts, n) + k * STRETCH
    return first, np.minimum(STRETCH, np.repeat(counts, n) - k * STRETCH)


def unpack(payload: bytes, offsets: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of a block: every stretch takes one step at a time, all of them together."""
    symbol, length = table
    raw = np.frombuffer(payload + b"\0\0\0", np.uint8).astype(np.uint32)
    three = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    first, n = stretches(counts)
    order = np.argsort(-n, kind="stable")
    at, to, n = offsets[order].astype(np.int64), first[order], n[order]
    out = np.zeros(int(counts.sum()), np.uint32)
    for step in range(int(n[0]) if len(n) else 0):
        live = int(np.searchsorted(-n, -step, "left"))
        at, to = at[:live], to[:live]
        window = three[at >> 3] >> (8 - (at & 7)).astype(np.uint32) & 0xFFFF
        out[to + step] = symbol[window]
        at = at + length[window]
    return out


def tokenized(docs: DataFrame, name: str, end: int) -> DataFrame:
    """doc_id and ids (unsigned 16-bit, with the end id), a row for each row of docs."""
    small_batches(docs.sparkSession)
    tail = struct.pack("<H", end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(name)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([ids + tail for ids in of.encode_all(batch.column(1))], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def id_counts(tokens: DataFrame) -> DataFrame:
    """id, n over all documents; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2"), minlength=VOCABULARY)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(total[ids])], ["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, path: str, name: str = WORD_BPE, end: int = 1) -> None:
    """Encode docs into path/blocks and path/codes."""
    spark = docs.sparkSession
    tokens = staged(tokenized(docs, name, end), "tokens")
    book = id_counts(tokens).orderBy("id").toPandas()  # at most a row for each entry of the vocabulary
    ids, lengths = book["id"].to_numpy(np.int64), code_lengths(book["n"].to_numpy())
    spark.createDataFrame(list(zip(ids.tolist(), lengths.tolist(), strict=True)), "id int, bits int").coalesce(1).write.parquet(f"{path}/codes")
    code, bits = canonical(ids, lengths)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            counts = np.fromiter((len(x) // 2 for x in raw), np.int64, len(raw))
            payload, first, at = pack(np.frombuffer(b"".join(raw), "<u2").astype(np.int64), counts, code, bits)
            starts, _ = stretches(counts)
            n = (counts + STRETCH - 1) // STRETCH
            own = (at[starts] - np.repeat(first[:-1] * 8, n)).astype("<u8")
            cut = np.concatenate(([0], np.cumsum(n)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array([own[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), pa.array([payload[a:b] for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["doc_id", "n", "offsets", "code"]
            )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def flush() -> pa.RecordBatch:
            doc_ids, counts, offsets, codes = zip(*held, strict=True)
            base = np.cumsum([0, *map(len, codes)])[:-1] * 8
            marks = b"".join((np.frombuffer(o, "<u8") + np.uint64(b)).astype("<u8").tobytes() for o, b in zip(offsets, base.tolist(), strict=True))
            body = b"".join([MAGIC, struct.pack("<II", len(held), len(marks) // 8), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids), np.array(counts, "<u4").tobytes(), marks, *codes])
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, block, start, sum(counts), body)], schema=pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("body", pa.binary())]))

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.append(row)
                size += len(row[3])
                if size >= BLOCK_BYTES:
                    yield flush()
                    block, start, held, size = block + 1, start + sum(r[1] for r in held), [], 0
        if held:
            yield flush()

    # finding the ranges reads the ids once more, so they are dealt before they are coded
    ordered = tokens.withColumn("tie", F.xxhash64("ids")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids")
    rows = ordered.mapInArrow(coded, "doc_id long, n long, offsets binary, code binary")
    rows.mapInArrow(blocks, "part int, block int, start long, n_ids long, body binary").write.option("compression", "none").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (unsigned 32-bit, little-endian) of every document in the files."""
    stored = spark.read.schema("part int, block int, start long, n_ids long, body binary").parquet(f"{path}/blocks")
    book = spark.read.schema("id int, bits int").parquet(f"{path}/codes").toPandas()
    code, bits = canonical(book["id"].to_numpy(np.int64), book["bits"].to_numpy(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = look_up(code, bits)
        for batch in batches:
            for part, start, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if body[:4] != MAGIC:
                    raise ValueError("not a block of token ids")
                n, m = struct.unpack_from("<II", body, 4)
                at = 12
                doc_ids = np.frombuffer(body, "<i8", n, at)
                nulls = np.frombuffer(body, np.bool_, n, at + 8 * n)
                counts = np.frombuffer(body, "<u4", n, at + 9 * n).astype(np.int64)
                offsets = np.frombuffer(body, "<u8", m, at + 13 * n)
                raw = unpack(body[at + 13 * n + 8 * m :], offsets, counts, table).astype("<u4").tobytes()
                last = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(doc_ids, mask=nulls), pa.array(start + last - counts), pa.array(counts), pa.array([raw[4 * a : 4 * b] for a, b in zip((last - counts).tolist(), last.tolist(), strict=True)], pa.binary())], ["part", "doc_id", "own", "n_tokens", "ids"]
                )

    sizes = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    decoded = stored.select("part", "start", "body").mapInArrow(run, "part int, doc_id long, own long, n_tokens long, ids binary")
    # one row for each file of the table
    return decoded.join(F.broadcast(starts), "part").select("doc_id", (F.col("before") + F.col("own")).alias("start"), "n_tokens", "ids")
