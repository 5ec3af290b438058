"""Packing documents into training windows by order-preserving dynamic programming.

The ids of a task's documents form one stream, in the order of the rows. It is cut into windows of at
most `limit` ids where the sum of padding and of penalties for cut documents is least: cuts fall after
documents (no penalty) or after sentences inside them; where a stretch without such a place is longer
than a window, also every `limit / 8` ids. A window is padded to `limit`, except at a power of two. The
best cost up to a boundary needs the least (cost + position) among the boundaries of the last `limit`
ids, which a monotone queue keeps at one step a boundary, and one look at each power of two.

A stream is handled in spans of about `span` ids, so a task holds little at a time; the last window of a
span is not written but begins the next span, so only a task's last window is padded for want of text. Null text
is empty: one id, the end. Repeated rows are packed as often as they occur. Other columns are ignored.
"""

from __future__ import annotations

import struct
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import small_batches
from millrace.llm.tokens import BYTE_BPE, encoder

LIMIT = 1024
#: What cutting a document costs, in ids of padding.
SENTENCE_CUT, FORCED_CUT = 4, 16
SPAN = 1 << 17


def padding(length: int, limit: int = LIMIT) -> int:
    return 0 if length & (length - 1) == 0 else limit - length


def boundaries(doc_ends: np.ndarray, sentence_ends: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream may be cut (0 first) and the penalty at each; both inputs ascend, positions count ids before the cut."""
    ends = np.union1d(np.union1d(doc_ends, sentence_ends), [0])
    gaps = np.diff(ends)
    step = max(1, limit // 8)
    forced = [np.arange(a + step, a + g, step) for a, g in zip(ends[:-1][gaps > limit], gaps[gaps > limit], strict=True)]
    at = np.union1d(ends, np.concatenate([*forced, ends[:0]]))
    cost = np.where(np.isin(at, doc_ends) | (at == 0), 0, np.where(np.isin(at, sentence_ends), SENTENCE_CUT, FORCED_CUT))
    return at, cost


def best_cuts(at: np.ndarray, cost: np.ndarray, limit: int = LIMIT) -> list[int]:
    """The cuts (with 0 and the end) of least padding and penalties."""
    places, costs = at.tolist(), cost.tolist()
    index = {p: i for i, p in enumerate(places)}
    powers = [1 << k for k in range(limit.bit_length()) if 1 << k <= limit]
    best, back = [0] * len(places), [0] * len(places)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # (cost + position, position, index), ascending in both
    for j in range(1, len(places)):
        p = places[j]
        while queue[0][1] < p - limit:
            queue.popleft()
        key, _, i = queue[0]
        least = key + limit - p
        for w in powers:
            k = index.get(p - w)
            if k is not None and best[k] < least:
                least, i = best[k], k
        best[j], back[j] = least + costs[j], i
        key = best[j] + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, j))
    cuts, j = [places[-1]], len(places) - 1
    while j:
        j = back[j]
        cuts.append(places[j])
    return cuts[::-1]


def pieces(counts: np.ndarray, cuts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First id, end and window of every piece of documents with so many ids, for cuts of their stream."""
    ends = np.cumsum(counts)
    edges = np.union1d(np.array(cuts), np.concatenate(([0], ends)))
    return edges[:-1], edges[1:], np.searchsorted(np.array(cuts), edges[:-1], "right") - 1


def pack(docs: DataFrame, name: str = BYTE_BPE, end: int = 0, limit: int = LIMIT, span: int = SPAN) -> DataFrame:
    """doc_id, start, length, ids (unsigned 32-bit, little-endian), doc_tokens, sequence_id, offset: a row for each piece of a document in a window."""
    small_batches(docs.sparkSession)
    tail = struct.pack("<H", end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(name)
        stops = np.zeros(1 << 16, bool)
        for text, i in of.tokenizer.get_vocab().items():
            stops[i] = text[-1:] in (".", "!", "?", "Ċ")
        stops[end] = False
        # a document's ids, how many of them are written, and how many it has
        held: list[tuple[int | None, bytes, int, int]] = []
        window, size = TaskContext.get().partitionId() << 36, 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal window, held, size
            ids = np.frombuffer(b"".join(x[1] for x in held), "<u2")
            counts = np.fromiter((len(x[1]) // 2 for x in held), np.int64, len(held))
            doc_ends = np.cumsum(counts)
            at, cost = boundaries(doc_ends, np.flatnonzero(stops[ids]) + 1, limit)
            cuts = best_cuts(at, cost, limit)
            if not last:
                cuts = cuts[:-1]
            a, b, w = pieces(counts, cuts)
            a, b, w = (x[a < cuts[-1]] for x in (a, b, w))
            b = np.minimum(b, cuts[-1])
            d = np.searchsorted(doc_ends, a, "right")
            raw = ids.astype("<u4").tobytes()
            gone, total = (np.array([x[k] for x in held], np.int64) for k in (2, 3))
            out = [
                pa.array([held[i][0] for i in d.tolist()], pa.int64()),
                pa.array(a - (doc_ends - counts)[d] + gone[d]),
                pa.array(b - a),
                pa.array([raw[4 * x : 4 * y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary()),
                pa.array(total[d]),
                pa.array(window + w),
                pa.array(a - np.array(cuts)[w]),
            ]
            window += len(cuts) - 1
            k = int(np.searchsorted(doc_ends, cuts[-1], "right"))
            split = cuts[-1] - int(doc_ends[k] - counts[k]) if k < len(held) else 0
            held = [(x[0], x[1][2 * split :], x[2] + split, x[3]) if i == 0 else x for i, x in enumerate(held[k:])]
            size = len(ids) - cuts[-1]
            return pa.RecordBatch.from_arrays(out, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), of.encode_all(batch.column(1)), strict=True):
                ids += tail
                held.append((doc, ids, 0, len(ids) // 2))
                size += len(ids) // 2
                if size >= span:
                    yield flush(False)
        if held:
            yield flush(True)

    of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return of.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def pack_digests(docs: DataFrame) -> DataFrame:
    """pack() with the ids' crc32 in place of the ids."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
