"""Quality classifier: a byte-level convolutional network in numpy.

Filters look at 6 bytes in a row, at every byte of the whole text. Their strongest answer is taken in
each chunk of 256 bytes, and chunks overlap by half. Mean, maximum and minimum of the chunks' answers
go through one logistic unit. Since a filter's weights depend on byte and place alone, the network is
a sum of table look-ups; two places share a table when it scores, which saves half of them.

Fitted on a bounded sample: of each class the `per_class` labelled ids with the smallest hashes, as far as
they have texts of at most `max_bytes`; rows with crc32(doc_id as text) mod 3 = 1 are never used.
Inputs of a score are the bytes of the text and nothing else.

Null and empty texts get the score of no bytes. Labels null or without a text are left out, doc_ids
with several labels count as often. If a class has no labels, every score is the share of good labels
(1 without labels). Repeated rows and null ids are scored like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import small_batches

TAPS, FILTERS, BLOCK = 6, 16, 128
LOW = np.float32(-1e9)


class Net(NamedTuple):
    taps: np.ndarray  # (place, byte, filter)
    bias: np.ndarray  # (filter,)
    out: np.ndarray  # (3 * filters,)
    shift: np.ndarray  # (1,)


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in whole blocks (zeros between them, which no window may start with), and blocks of each text."""
    sizes = np.array([(len(t) + TAPS - 1) // BLOCK + 1 for t in texts], np.int64)
    flat = np.zeros(int(sizes.sum()) * BLOCK + TAPS, np.uint8)
    for t, at in zip(texts, ((np.cumsum(sizes) - sizes) * BLOCK).tolist(), strict=True):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
    return flat, sizes


def over_chunks(blocks: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks (a block and the next one of its text): their maxima, first chunk of each text, whether the second block won."""
    last = np.zeros(len(blocks), bool)
    last[np.cumsum(sizes) - 1] = True
    after = np.concatenate([blocks[1:], blocks[:1]])
    after[last] = LOW
    return np.maximum(blocks, after), np.cumsum(sizes) - sizes, after > blocks


def features(blocks: np.ndarray, sizes: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """(text, 3 * filters): mean, maximum and minimum over the chunks of each text."""
    chunks, first, _ = over_chunks(blocks, sizes)
    answers = np.maximum(chunks + bias, 0)
    return np.concatenate([np.add.reduceat(answers, first) / sizes[:, None], np.maximum.reduceat(answers, first), np.minimum.reduceat(answers, first)], axis=1)


class Scorer:
    def __init__(self, net: Net):
        self.net = net
        taps = net.taps.astype(np.float32).copy()
        taps[0, 0] = LOW
        self.pairs = [(taps[p][:, None, :] + taps[p + 1][None, :, :]).reshape(1 << 16, FILTERS) for p in range(0, TAPS, 2)]

    def score(self, texts: list[bytes]) -> np.ndarray:
        flat, sizes = laid_out(texts)
        two = flat[:-1].astype(np.int32) << 8 | flat[1:]
        blocks = np.empty((len(flat) // BLOCK, FILTERS), np.float32)
        for a in range(0, len(blocks), 512):
            x, y = a * BLOCK, min(a + 512, len(blocks)) * BLOCK
            sums = self.pairs[0][two[x:y]]
            for p in range(1, TAPS // 2):
                sums += self.pairs[p][two[x + 2 * p : y + 2 * p]]
            blocks[a : a + 512] = sums.reshape(-1, BLOCK, FILTERS).max(axis=1)
        z = features(blocks, sizes, self.net.bias.astype(np.float32)).astype(np.float64) @ self.net.out + self.net.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 12, batch: int = 48, seed: int = 5, rate: float = 0.01, decay: float = 1e-4) -> Net:
    """Adam on the logistic loss; both classes weigh the same. Gradients pass only through the places that won the maxima."""
    rng = np.random.default_rng(seed)
    share = float(np.mean(labels)) if len(labels) else 1.0
    net = Net(rng.normal(0, 0.1, (TAPS, 256, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 3 * FILTERS), np.zeros(1))
    if share in (0.0, 1.0):
        flat = np.log(max(share, 1e-9) / max(1 - share, 1e-9)) if share else -20.0
        return net._replace(out=np.zeros(3 * FILTERS), shift=np.array([min(flat, 20.0)]))
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    params = list(net)
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    steps = epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            taps, bias, out, shift = params
            flat, sizes = laid_out([texts[i] for i in pick])
            n = len(flat) - TAPS
            table = taps.astype(np.float32)
            table[0, 0] = LOW
            sums = table[0][flat[:n]]
            for p in range(1, TAPS):
                sums += table[p][flat[p : n + p]]
            sums = sums.reshape(-1, BLOCK, FILTERS)
            place = sums.argmax(axis=1)
            blocks = np.take_along_axis(sums, place[:, None, :], axis=1)[:, 0]
            place += (np.arange(len(blocks)) * BLOCK)[:, None]
            chunks, first, second = over_chunks(blocks, sizes)
            answers = np.maximum(chunks + bias, 0)
            mean, top, low = np.add.reduceat(answers, first) / sizes[:, None], np.maximum.reduceat(answers, first), np.minimum.reduceat(answers, first)
            z = np.concatenate([mean, top, low], axis=1) @ out + shift
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) * weight[pick] / len(pick)
            of = np.repeat(np.arange(len(pick)), sizes)
            gm, gt, gl = (g[:, None] * out[None, k * FILTERS : (k + 1) * FILTERS] for k in range(3))
            # a maximum or minimum that several chunks share goes to all of them, in equal parts
            is_top, is_low = answers == top[of], answers == low[of]
            back = (gm / sizes[:, None])[of] + is_top * (gt / np.add.reduceat(is_top.astype(float), first))[of] + is_low * (gl / np.add.reduceat(is_low.astype(float), first))[of]
            back = np.where((chunks + bias > 0), back, 0.0)
            won = np.where(second, np.concatenate([place[1:], place[:1]]), place)
            grad_taps = np.zeros_like(taps)
            filters = np.broadcast_to(np.arange(FILTERS), won.shape)
            for p in range(TAPS):
                grad_taps[p] = np.bincount((flat[won + p].astype(np.int64) * FILTERS + filters).ravel(), back.ravel(), 256 * FILTERS).reshape(256, FILTERS)
            grads = [grad_taps + decay * taps, back.sum(axis=0), np.concatenate([(g[:, None] * x).sum(axis=0) for x in (mean, top, low)]) + decay * out, np.array([g.sum()])]
            t += 1
            now = rate * (1 - 0.9 * t / steps)
            for i, d in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d * d
                params[i] = params[i] - now * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Net(*params)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 800, max_bytes: int = 1 << 16) -> Net:
    """Fit on at most per_class labelled texts of each class: of several texts with one id, that of the smallest hash."""
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # ids are chosen from the labels alone; texts are then looked up in one scan, by at most 2 * per_class ids
    chosen = [r for q in (0, 1) for r in usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    wanted = docs.sparkSession.createDataFrame(chosen, usable.schema).withColumnRenamed("doc_id", "wanted__")
    found = docs.select("doc_id", "text").where(F.octet_length("text") <= max_bytes).join(F.broadcast(wanted), F.col("doc_id") == F.col("wanted__"))
    one = found.groupBy("quality", "doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("s")).select("quality", "doc_id", "s.text")
    sample = sorted((r["quality"], r["doc_id"], r["text"]) for r in one.collect())  # at most 2 * per_class rows
    return fit([t.encode() for _, _, t in sample], np.array([q for q, _, _ in sample], np.float64))


def scored(docs: DataFrame, net: Net, *carry: str) -> DataFrame:
    """The columns in carry and score, a row for each row of docs."""
    small_batches(docs.sparkSession)
    of = docs.select(*carry, F.col("text").cast("string").alias("text__"))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net_ = Scorer(net)
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column(batch.num_columns - 1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(net_.score(texts) if texts else np.zeros(0))], [*carry, "score"])

    return of.mapInArrow(run, f"{kinds}, score double")


def classify(docs: DataFrame, labels: DataFrame, per_class: int = 800) -> DataFrame:
    """doc_id, held_out, score and predicted, a row for each row of docs."""
    out = scored(docs, train(docs, labels, per_class), "doc_id")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, net: Net, least: float = 0.5) -> DataFrame:
    """The rows of docs with a score of at least `least`, with the columns of docs."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net_ = Scorer(net)
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column(at).cast(pa.binary())]
            yield batch.filter(pa.array(net_.score(texts) >= least)) if texts else batch

    return docs.mapInArrow(run, docs.schema)
