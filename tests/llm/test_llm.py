"""Each operator against SQL, brute force, an exact round trip or held-out labels, and on awkward tables."""

from __future__ import annotations

import gzip
import math
import re
import uuid
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import ann, chat, classifier, html, mixing, packing, rules, simhash, similar, token_files, warc
from millrace.llm.common import load
from millrace.llm.queries import QUERIES, SQL
from millrace.llm.tokens import BYTE_BPE, WORD_BPE, Encoder
from tests.compare import rows_of, rows_of_sql

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    long = "Words of a very long text, one after another. " * 4000
    rows = [(1, "a b c d e f g h", "s1"), (1, "a b c d e f g h", "s1"), (2, None, None), (None, "no id here", "s2"), (3, "", "s1"), (4, " \t\n ", "s2"), (5, long, "s1"), (6, long, None), (7, long + " end", "s2"), (None, None, None), (8, "ünï ’中文 x　y\u0000z", "s3"), (9, "A b c d e f g h", "s1")]
    names = ("n_words", "kept", "size", "copies", "fp", "component_id", "score", "ids", "start", "part", "n", "copy__x")
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(c) for c in names})


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, name):
    assert rows_of(QUERIES[name](spark, data)) == rows_of_sql(SQL[name], data)


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_rules_by_hand(odd, none):
    got = sorted((tuple(r) for r in rules.judge(odd).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=repr)
    want = []
    for doc, text in texts_of(odd):
        text = text or ""
        ws = WORD.findall(text)
        wins = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
        count = {w: 0 for w in wins}
        for w in wins:
            count[w] += 1
        covered = {i + j for i, w in enumerate(wins) if count[w] > 1 for j in range(8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want.append((doc, len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(ws) < 20 or 100 * len(covered) > 30 * len(ws)))
    assert got == sorted(want, key=repr)
    assert rules.judge(none).count() == 0
    assert rules.keep_good(odd).columns == odd.columns


def test_rules_keep_clean_documents(spark, data):
    docs, labels = load(spark, data, "documents"), load(spark, data, "labels")
    j = rules.judge(docs).join(labels, "doc_id").where("NOT base_failed")
    assert j.where("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0] > 0.99
    assert j.where("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0] < 0.2


@pytest.mark.parametrize("name", [WORD_BPE, BYTE_BPE])
def test_pieces_give_the_ids_of_whole_texts(name):
    import random

    rng = random.Random(4)
    of = Encoder(name, keep=500)
    alphabet = list("abHe\n\n%<|> .,'\t 　éß#%1’中́\u001c\x85ΣÀÿ×ª")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["", " ", "a  b", "<|endoftext|>", "x<|endoftext|> y", "it's, don't."]
    for t, e in zip(texts, of.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(of.encode(t), "<u2").tolist() == e.ids, repr(t)


def test_huffman():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 3000):
        w = rng.zipf(1.3, n).astype(np.int64)
        lengths = token_files.code_lengths(w)
        assert lengths.max() <= token_files.MAX_BITS
        assert n == 1 or (2.0**-lengths).sum() == 1
        ids = np.sort(rng.choice(60000, n, replace=False))
        code, bits = token_files.canonical(ids, lengths)
        counts = rng.integers(1, 400, 40)
        text = ids[rng.integers(0, n, counts.sum())]
        payload, first, at = token_files.pack(text, counts, code, bits)
        starts, _ = token_files.stretches(counts)
        assert (token_files.unpack(payload, at[starts].astype(np.uint64), counts, token_files.look_up(code, bits)) == text).all()
    assert token_files.code_lengths(np.array([1, 1, 2, 3, 5, 8, 13, 21]), 4).max() == 4


def test_token_files_round_trip(spark, odd, none):
    of = Encoder(WORD_BPE).tokenizer
    path = f"/tmp/spark-{uuid.uuid4().hex}"
    token_files.write_token_files(odd, path)
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    want = sorted(((-1 if d is None else d), tuple([*of.encode(t or "", add_special_tokens=False).ids, 1])) for d, t in texts_of(odd))
    assert sorted(((-1 if r["doc_id"] is None else r["doc_id"]), tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == sorted(ids)
    empty = f"/tmp/spark-{uuid.uuid4().hex}"
    token_files.write_token_files(none, empty)
    assert token_files.read_token_files(spark, empty).count() == 0


def water(sizes, weights, cap):
    target, open_, left = dict.fromkeys(sizes, 0.0), set(sizes), float(sum(sizes.values()))
    while open_:
        w = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / w > cap * sizes[s]}
        if not full:
            return target | {s: left * weights[s] / w for s in open_}
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mixing(spark, data, odd, none):
    docs = load(spark, data, "documents")
    for df in (docs, odd, docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "big").otherwise(F.concat(F.lit("tiny"), (F.col("doc_id") % 7).cast("string")))), docs.where("doc_id < 12")):
        rows = mixing.mix(df).collect()
        assert len(rows) == df.count()
        assert all(r["copies"] <= 3 for r in rows)
        by: dict = {}
        for r in rows:
            by.setdefault(r["source"], []).append(r)
        order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
        sizes = {s: sum(r["size"] for r in by[s]) for s in order}
        want = water(sizes, {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}, 3.0)
        for s, rs in by.items():
            assert rs[0]["source_size"] == sizes[s]
            assert rs[0]["target"] == pytest.approx(want[s], rel=1e-9, abs=1e-6)
            assert abs(sum(r["copies"] * r["size"] for r in rs) - want[s]) <= max(r["size"] for r in rs) / 2 + 1e-6
        again = mixing.mix(df.repartition(3)).collect()
        key = lambda r: repr((r["doc_id"], r["source"], r["size"], r["copies"]))
        assert sorted(map(key, rows)) == sorted(map(key, again))
        out = mixing.mixed_rows(df)
        assert out.columns == df.columns and out.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(none).count() == 0 and mixing.mixed_rows(none).count() == 0


def test_mixing_keeps_expectations(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.sequence(F.lit(1), (F.col("id") % 40 + 1).cast("int"))).alias("text"), F.when(F.col("id") < 100, "a").otherwise("b").alias("source"))
    total: dict = {}
    for seed in range(8):
        for r in mixing.mix(docs, (1.0,), seed=seed).where("source = 'b'").collect():
            total[r["doc_id"] % 40 < 20] = total.get(r["doc_id"] % 40 < 20, 0) + r["copies"]
    share = mixing.mix(docs, (1.0,)).where("source = 'b'").selectExpr("target / source_size AS f").first()["f"]
    assert total[True] / (150 * 8) == pytest.approx(share, abs=0.1) and total[False] / (150 * 8) == pytest.approx(share, abs=0.05)


def test_classifier_on_held_out_labels(spark, odd, none):
    d = "/root/testdata/sf0.01"
    docs, labels = load(spark, d, "documents"), load(spark, d, "labels")
    rows = classifier.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    net = classifier.train(docs, labels)
    scores = classifier.scored(odd, net, "doc_id").collect()
    assert len(scores) == odd.count() and all(0 <= r["score"] <= 1 for r in scores)
    assert classifier.keep_good(none, net).count() == 0 and classifier.keep_good(odd, net).columns == odd.columns
    assert classifier.classify(odd, labels.where("false")).where("predicted = 0").count() == 0


def test_classifier_batches_do_not_matter():
    rng = np.random.default_rng(2)
    net = classifier.Net(rng.normal(size=(6, 256, 16)), rng.normal(size=16), rng.normal(size=48), np.zeros(1))
    texts = [bytes(rng.integers(1, 255, n, dtype=np.uint8)) for n in (0, 1, 5, 127, 128, 129, 5000)]
    s = classifier.Scorer(net)
    assert np.allclose(s.score(texts), [s.score([t])[0] for t in texts], atol=1e-6)


def plain_score(net, text: bytes) -> float:
    """The network's score by loops: at each byte a sum of weights over 6 places (behind the end: byte 0), the largest of each block of 128, and of it and the next one; blocks reach to the last place that a window may touch."""
    count = (len(text) + 5) // 128 + 1
    padded = text + bytes(6)
    blocks = [[max((sum(net.taps[p, padded[i + p], f] for p in range(6)) for i in range(k * 128, min(k * 128 + 128, len(text)))), default=-1e9) for f in range(16)] for k in range(count)]
    chunks = [[max(0.0, max(blocks[k][f], blocks[k + 1][f] if k + 1 < count else -1e9) + net.bias[f]) for f in range(16)] for k in range(count)]
    x = [g([c[f] for c in chunks]) for g in (lambda v: sum(v) / len(v), max, min) for f in range(16)]
    return 1 / (1 + math.exp(-sum(w * v for w, v in zip(net.out, x, strict=True)) - net.shift[0]))


def test_classifier_is_the_loop():
    rng = np.random.default_rng(8)
    net = classifier.Net(rng.normal(size=(6, 256, 16)), rng.normal(size=16), rng.normal(0, 0.05, size=48), np.array([0.1]))
    texts = [bytes(rng.integers(1, 255, n, dtype=np.uint8)) for n in (0, 1, 5, 122, 123, 127, 128, 129, 300, 700)]
    want = [plain_score(net, t) for t in texts]
    assert classifier.Scorer(net).score(texts) == pytest.approx(want, abs=1e-5) and 0.01 < min(want) < max(want) < 0.99


def test_audit_finds_each_fault(spark):
    recs = [("w", i * 1000 + (i > 70) * 70_000, bytes([i % 250]) * 50) for i in range(200)]
    other = [r for i, r in enumerate(recs) if i != 5]
    other[100] = (*other[100][:2], b"changed")
    other.append(("v", 0, b"more"))
    schema = "archive string, offset long, record binary"
    found = warc.audit(warc.leaves(spark.createDataFrame(recs, schema)), warc.leaves(spark.createDataFrame(other, schema))).collect()
    assert {(r["archive"], r["offset"], r["status"]) for r in found} == {("w", 5000, "missing"), ("w", recs[101][1], "corrupt"), ("v", 0, "extra")}
    same = warc.leaves(spark.createDataFrame(recs, schema))
    assert warc.audit(same, same).count() == 0
    assert warc.audit(same.where("false"), same.where("false")).count() == 0


def test_warc_files(spark, data, tmp_path):
    recs = [bytes(r["record"]) for r in warc.records(load(spark, data, "pages")).collect()]
    (tmp_path / "a.warc").write_bytes(b"".join(recs))
    back = warc.read_warc(spark, str(tmp_path)).orderBy("offset").collect()
    assert [bytes(r["record"]) for r in back] == recs
    packed = [gzip.compress(r) for r in recs]
    (tmp_path / "zipped").mkdir()
    (tmp_path / "zipped" / "a.warc.gz").write_bytes(b"".join(packed))
    back = warc.read_warc(spark, str(tmp_path / "zipped")).orderBy("offset").collect()
    assert [bytes(r["record"]) for r in back] == recs and [r["offset"] for r in back] == np.cumsum([0, *map(len, packed)])[:-1].tolist()


@pytest.mark.parametrize("spoil", ["header", "length", "cut", "between"])
def test_one_fault_of_an_archive_is_one_fault(spoil):
    recs = [b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, b"x" * n) for n in (5, 0, 300, 7, 12)]
    bad = list(recs)
    if spoil == "header":
        bad[2] = b"ZARC" + recs[2][4:]
    elif spoil == "length":
        bad[2] = recs[2].replace(b": 300", b": 200")
    elif spoil == "cut":
        bad[2] = recs[2][:100]
    else:
        bad.insert(2, b"\0\0\0")
    got = list(warc.split_plain(b"".join(bad)))
    assert [r for _, r in got] == bad and [at for at, _ in got] == np.cumsum([0, *map(len, bad)])[:-1].tolist()
    zipped = [gzip.compress(r) for r in recs]
    zipped[2] = zipped[2][: len(zipped[2]) // 2] + (b"" if spoil == "cut" else b"\xff" * (len(zipped[2]) - len(zipped[2]) // 2))
    got = list(warc.split_gzip(b"".join(zipped)))
    assert [r for _, r in got] == [*recs[:2], zipped[2], *recs[3:]]
    assert list(warc.split_plain(b"")) == [] and list(warc.split_gzip(b"")) == []


def test_search_is_complete(spark, data):
    e = load(spark, data, "embeddings")
    broken = spark.createDataFrame([(100_000, None, 0), (100_020, [0.0] * 64, 0), (100_040, [float("nan")] * 64, 0), (100_001, [None] * 64, 0), (100_060, [], 0)], e.schema)
    twins = e.where("vec_id < 3").withColumn("vec_id", F.col("vec_id") + 200_001)
    df = e.unionByName(broken).unionByName(twins)
    got: dict = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    rows = sorted((r["vec_id"], r["embedding"]) for r in e.unionByName(twins).collect())
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = v @ v[i]
        best = [int(j) for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:20]
        assert [x[0] for x in got[ids[i]]] == list(range(1, len(got[ids[i]]) + 1))
        assert all(x[2] == pytest.approx(s[np.searchsorted(ids, x[1])], abs=1e-12) for x in got[ids[i]])
        hits += len({int(ids[j]) for j in best} & {x[1] for x in got[ids[i]]}) / min(20, len(best))
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    assert hits / len(got) >= 0.9
    assert ann.search(e.where("false"), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("kind", ["clustered", "normal", "few directions", "one large", "lengths", "given"])
def test_search_over_several_lists_and_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(ann, "VECTORS", 300)
    monkeypatch.setattr(ann, "QUERIES", 60)
    monkeypatch.setattr(ann, "PER_LIST", 128)
    monkeypatch.setattr(ann, "SAMPLE", 1000)
    rng = np.random.default_rng(12)
    n = 4000
    x = rng.normal(size=(n, 32))
    if kind == "clustered":
        x = rng.normal(size=(40, 32))[rng.integers(0, 40, n)] + 0.2 * x
    if kind == "few directions":
        x = rng.normal(size=(n, 4)) @ rng.normal(size=(4, 32))
    if kind == "one large":
        x[:, 0] += 8
    if kind == "lengths":
        x *= rng.lognormal(0, 1, n)[:, None]
        x[:1500] = x[7]  # and many equal vectors
    if kind == "given":
        df = load(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", "embedding")
    else:
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = df.collect()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got: dict = {}
    for r in ann.search(df.repartition(4), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    found = []
    for i in np.flatnonzero(ids % 20 == 0):
        score = v @ v[i]
        best = [int(ids[j]) for j in np.lexsort((ids, -score)) if j != i][:20]
        mine = got[int(ids[i])]
        assert len(mine) == 20 and all(s == pytest.approx(v[np.flatnonzero(ids == j)[0]] @ v[i], rel=1e-12, abs=1e-12) for j, s in mine.items())
        found.append(len(set(best) & set(mine)) / 20)
    assert len(got) == len(found) and np.mean(found) >= 0.97


def test_bounds_hold():
    rng = np.random.default_rng(3)
    v, q = rng.normal(size=(500, 64)), rng.normal(size=(20, 64))
    turn = ann.rotations(64)
    guess, error = ann.estimate(*ann.encode(v, turn), q, turn)
    assert (np.abs(guess - q @ v.T) <= ann.ERRORS * error).mean() > 0.99


def test_packing_cuts_are_the_best():
    rng = np.random.default_rng(5)
    for _ in range(30):
        ends = np.unique(rng.integers(1, 120, 14))
        at, cost = packing.boundaries(ends[rng.random(len(ends)) < 0.5].tolist() + [int(ends[-1])], ends, 32)
        cuts = packing.best_cuts(at, cost, 32)
        places = dict(zip(at.tolist(), cost.tolist(), strict=True))
        best = {0: 0.0}
        for p in sorted(places)[1:]:
            best[p] = min(best[q] + packing.padding(p - q, 32) for q in best if 0 < p - q <= 32) + places[p]
        assert sum(packing.padding(b - a, 32) + places[b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)) == best[max(places)]
        assert all(0 < b - a <= 32 for a, b in zip(cuts[:-1], cuts[1:], strict=True))


def test_packing(spark, data, odd, none):
    of = Encoder(BYTE_BPE).tokenizer
    for df in (load(spark, data, "documents"), odd):
        rows = packing.pack(df).collect()
        windows: dict = {}
        for r in rows:
            assert len(r["ids"]) == 4 * r["length"] and r["length"] > 0
            windows.setdefault(r["sequence_id"], []).append(r)
        for w in windows.values():
            w.sort(key=lambda r: r["offset"])
            assert [r["offset"] for r in w] == np.cumsum([0, *[r["length"] for r in w]])[:-1].tolist()
            assert sum(r["length"] for r in w) <= 1024
        parts: dict = {}
        for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
            parts.setdefault(r["doc_id"], []).append(np.frombuffer(r["ids"], "<u4"))
        want: dict = {}
        for doc, text in texts_of(df):
            want.setdefault(doc, []).append([*of.encode(text or "", add_special_tokens=False).ids, 0])
        for doc, ids in want.items():
            assert sorted(np.concatenate(parts[doc]).tolist()) == sorted(sum(ids, []))
            if len(ids) == 1:
                assert np.concatenate(parts[doc]).tolist() == ids[0]
    assert packing.pack(none).count() == 0


def brute_components(texts: list[str | None]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    fps = []
    for t in texts:
        ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hs = [xxh64_intdigest(" ".join(ws[i : i + 4]).encode(), 42) for i in range(max(1, len(ws) - 3))] if ws else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    return np.array(fps, np.uint64)


def test_covering_masks_cover():
    import itertools

    masks = simhash.covering_masks(list(range(12)), 3)
    assert all(any(m & sum(1 << b for b in bits) == 0 for m in masks) for bits in itertools.combinations(range(12), 3))


@pytest.mark.parametrize("big", [2048, 2])
def test_links_lose_nothing(spark, big):
    rng = np.random.default_rng(8)
    centres = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = {0}
    for c in centres:
        for _ in range(60):
            x = int(c)
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    a = np.array(sorted(fps), np.uint64)
    near = np.bitwise_count(a[:, None] ^ a) <= 4
    lab = np.arange(len(a))
    while True:
        new = np.array([lab[near[i]].min() for i in range(len(a))])
        if (new == lab).all():
            break
        lab = new
    df = spark.createDataFrame([(int(x),) for x in a.view(np.int64)], "fp long")
    comp = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, big=big)).collect()}
    roots = [comp.get(int(x), int(x)) for x in a.view(np.int64)]
    assert len(set(roots)) == len(set(lab.tolist())) == len(set(zip(roots, lab.tolist(), strict=True)))


def test_near_duplicates(spark, data, odd, none):
    for df in (load(spark, data, "documents"), odd):
        rows = simhash.near_duplicates(df).collect()
        pairs = sorted(texts_of(df), key=repr)
        fps = brute_components([t for _, t in pairs])
        assert sorted((repr(d), int(f)) for (d, _), f in zip(pairs, fps, strict=True)) == sorted((repr(r["doc_id"]), r["fp"] & (2**64 - 1)) for r in rows)
        near = np.bitwise_count(fps[:, None] ^ fps) <= 4
        lab = np.arange(len(fps))
        for _ in range(len(fps)):
            new = np.array([lab[near[i]].min() for i in range(len(fps))])
            if (new == lab).all():
                break
            lab = new
        first = {k: min((d for (d, _), x in zip(pairs, lab, strict=True) if x == k and d is not None), default=None) for k in set(lab.tolist())}
        assert sorted((repr(d), repr(first[k])) for (d, _), k in zip(pairs, lab.tolist(), strict=True)) == sorted((repr(r["doc_id"]), repr(r["component_id"])) for r in rows)
        kept = simhash.keep_one(df)
        assert kept.columns == df.columns and kept.count() == len(first)
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("block", [2048, 3])
def test_similar_texts_are_joined(spark, data, odd, block):
    words = [f"w{i}" for i in range(400)]
    edited = [(10_000 + i, " ".join(w if k not in range(i, 400, 57) else f"x{k}" for k, w in enumerate(words[: 300 + 5 * i])), "s1") for i in range(20)]
    docs = load(spark, data, "documents").select("doc_id", "text", "source")
    for df in (docs.unionByName(spark.createDataFrame(edited, docs.schema)), odd):
        rows = similar.grouped(df, block=block).collect()
        pairs = sorted(texts_of(df), key=repr)
        sets = []
        for _, t in pairs:
            ws = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(t or "")]
            sets.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
        lab = list(range(len(sets)))
        for i, a in enumerate(sets):
            for j in range(i):
                b = sets[j]
                if lab[i] != lab[j] and (a == b or len(a & b) / len(a | b) >= 0.8):
                    lab = [lab[j] if x == lab[i] else x for x in lab]
        first = {k: min((d for (d, _), x in zip(pairs, lab, strict=True) if x == k and d is not None), default=None) for k in set(lab)}
        assert sorted((repr(d), repr(first[k])) for (d, _), k in zip(pairs, lab, strict=True)) == sorted((repr(r["doc_id"]), repr(r["component_id"])) for r in rows)
        assert corpus_pipeline.near_duplicates(spark, df, data).count() == len(first)


def test_main_text(spark, data):
    import html as entities

    pages = load(spark, data, "pages")
    schema = pages.schema
    df = pages.unionByName(spark.createDataFrame([(900_000, None, None), (900_001, "u", ""), (900_002, "u", "<p>a<"), (None, "u", "<div " * 50)], schema))
    got = {r["page_id"]: r for r in html.main_text(df).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", " ", article))).strip()
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)
    assert got[900_000]["text"] == got[900_001]["text"] == ""
    assert html.main_text(df.where("false")).count() == 0


@pytest.fixture(scope="module")
def trees(spark):
    pages = [r["html"] for r in load(spark, "/root/testdata/sf0.01", "pages").orderBy("page_id").limit(100).collect()]
    return html.fit(pages)


MENU, FOOT, PARA = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>", "<footer>&copy; 2020 Example</footer>", "<p>Sixty five characters of plain text stand in this one paragraph.</p>"
TEXT = "Sixty five characters of plain text stand in this one paragraph."
LAYOUTS = {
    f"{MENU}<article>{PARA}</article>{FOOT}": TEXT,
    "<article><h1>Hi</h1><p>Two words.</p></article>": "Hi Two words.",
    f"{MENU}<article><p>Hi.</p></article>{FOOT}": "Hi.",
    f"<html><body>{MENU}<h1>Title here</h1>{PARA * 4}{FOOT}</body></html>": " ".join(["Title here", *[TEXT] * 4]),
    f"<html><body><form action='/x' method=post>{MENU}<article><h1>Title</h1>{PARA * 3}</article>{FOOT}</form></body></html>": " ".join(["Title", *[TEXT] * 3]),
    f"<body><form>{MENU}<div id='content'><h1>T</h1>{PARA * 3}</div>{FOOT}<input name=q></form></body>": " ".join(["T", *[TEXT] * 3]),
    f"{MENU}<article><h1>T</h1><p>Some words stand here <span class='ad'>Buy now</span> and then go on to the end of it.</p>{PARA}</article>{FOOT}": f"T Some words stand here and then go on to the end of it. {TEXT}",
    f"<body>{MENU}<article><h1>T</h1>{PARA}<section class='comments'><div class='comment'><b>Ann</b><p>I liked this a lot, thank you.</p></div></section></article>{FOOT}</body>": f"T {TEXT}",
    "<article><p>so <math><mi>x</mi></math> is</p></article>": "so x is",
    "Plain text without any tag.": "Plain text without any tag.",
}


@pytest.mark.parametrize("page", LAYOUTS)
def test_main_text_of_other_layouts(trees, page):
    assert html.extract_all([page], *trees) == [LAYOUTS[page]]


@pytest.mark.parametrize("piece", ["<div ", "<div>", "<p>a</p>", "<ul><li>x", '<p ">"', "<b><i>", "</p></span>", "<tr><td>x", "<!--", '<a "', "<textarea>", "<p>x</div>", "<span class=x>a"])
def test_long_malformed_pages_take_their_time_in_proportion(trees, piece):
    import time

    began = time.time()
    html.extract_all([piece * (1_000_000 // len(piece))], *trees)
    assert time.time() - began < 40


def test_decoding_never_contradicts():
    rng = np.random.default_rng(6)
    page = "<body><div><nav><ul><li>a</ul></nav><div><p>b<div>c</div></div><aside><p>d</aside></div></body>"
    nodes, _ = html.parse(page)
    for _ in range(200):
        state = html.decode(nodes, rng.normal(0, 3, len(nodes)))
        for n, s in zip(nodes[1:], state[1:], strict=True):
            above = state[n.parent]
            assert not (above == html.OUT and s != html.OUT) and not (above == html.MAIN and s == html.BOTH)


def test_parsing():
    nodes, flow = html.parse("<p>a <b>b<p>c &amp; d<br>e<script>var x='<p>no</p>'</script><!-- no --><ul><li>f<li>g</ul>h")
    assert html.gathered(flow, {i for i, n in enumerate(nodes) if n.tag not in html.SILENT}) == "a b c & d e f g h"


def test_chat_collapse(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "bot", "yo"), (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (4, 0, "user", "hi"), (4, 1, "bot", "no <|im_end|>"), (4, 1, "bot", "no <|im_end|>"), (5, 0, None, None), (None, 0, "user", "x"), (6, None, "user", "z")]
    rows += [(7, i, "user", f"t{i}") for i in range(600)] + [(8, i, "user", f"t{i}") for i in range(400)] + [(9, i, "user", f"t{i}") for i in range(256)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"part": F.lit(1), "key": F.lit("k")})
    got = {(r["conv_id"], r["part"]): r for r in chat.render(df).collect()}
    assert set(got) == {(2, 0), (4, 0), (5, 0), (None, 0), (6, -1), (7, 0), (7, 1), (7, 2)}
    assert got[2, 0]["text"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>bot\nyo<|im_end|>\n"
    assert got[4, 0]["n_turns"] == 2 and "no <| im_end|>" in got[4, 0]["text"]
    assert chat.render(df.where("false")).count() == 0


@pytest.mark.parametrize("table", ["gap", "shifted", "long", "same turn", "nulls"])
def test_chat_places_are_those_of_the_sql(spark, tmp_path, table):
    said = lambda conv, turns: [(conv, t, "user", x) for t, x in turns]
    rows = {
        "gap": said(1, [(0, "a"), (1, "b"), (2, "c")]) + said(2, [(0, "a"), (300, "b"), (301, "c"), (302, "d")]),
        "shifted": said(1, [(300 + i, f"t{i}") for i in range(300)]) + said(2, [(i, f"t{i}") for i in range(400)]) + said(3, [(5 * i, f"t{i}") for i in range(256)]),
        "long": said(1, [(i, f"t{i}") for i in range(1500)]) + said(2, [(i + 7, f"t{i}") for i in range(1024)]) + said(3, [(i, f"t{i + (i == 700)}") for i in range(900)]),
        "same turn": said(1, [(0, "b")]) + said(2, [(0, "a"), (0, "b"), (0, "c")]) + said(3, [(0, "a"), (0, "b")]) + said(4, [(0, "a"), (1, "b"), (1, "a")]),
        "nulls": [(None, None, None, None), (None, 3, "user", "x"), (1, None, "user", "x"), (1, 2, None, "y"), (2, 0, "user", "x"), (3, 0, "user", "x"), (3, 1, "unknown", "y"), (3, 2, "user", None), (2, 0, "user", "x")],
    }[table]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows_of(QUERIES["op1_chat_format"](spark, str(tmp_path))) == rows_of_sql(SQL["op1_chat_format"], str(tmp_path))


def test_pipeline(spark, data):
    docs = load(spark, data, "documents")
    columns, held = docs.columns, docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, held, data)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        held = out
    assert held.count() > 0
    kept = {r["doc_id"] for r in held.select("doc_id").distinct().collect()}
    judged = {r["doc_id"]: r["kept"] for r in rules.judge(docs).collect()}
    assert kept and all(judged[i] for i in kept)
    good = docs.join(load(spark, data, "labels").where("quality = 1"), "doc_id").where("n_chars > 400")
    passed = corpus_pipeline.quality_classifier(spark, corpus_pipeline.quality_rules(spark, good, data), data).count()
    assert passed >= 0.97 * good.count()
