"""Structured Streaming jobs. Each shares its meaning with a batch operator and gives the same rows for rows that are on time.

Windows use event time with a watermark; keyed histories live in state that event time evicts, and the
rows of a micro-batch are sorted by (time, id) before they enter it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.functions.columns import micros
from millrace.operators.anomaly import forest_score, grow_forest, nearest, path_length
from millrace.operators.graph import shared_folder
from millrace.operators.joins import enrich_measurements
from millrace.operators.windows import window_stats
from millrace.sources.upserts import BUCKETS, MOST, upsert


def with_event_time(df: DataFrame, delay: str = "5 seconds", time: str = "time") -> DataFrame:
    """Rows may come up to `delay` out of order; later ones are dropped by aggregations."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def tumbling_stats_stream(df: DataFrame, width: str) -> DataFrame:
    """window_stats() of one width over a stream."""
    return window_stats(df, width)


def sliding_stats_stream(df: DataFrame, width: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    g = df.groupBy(F.window("time", width, slide).alias("w"), "equipment_id", "param_id").agg(F.count("value").alias("n"), F.avg("value").alias("avg_value"), F.max("value").alias("max_value"))
    return g.select(F.col("w.start").alias("window_start"), "equipment_id", "param_id", "n", "avg_value", "max_value")


def incremental_stats(df: DataFrame, keys: list[str], width: str = "1 hour") -> DataFrame:
    """Running count, sum, min, max, mean and alarms of each window, for update mode."""
    g = df.groupBy(F.window("time", width).alias("w"), *keys).agg(F.count("value").alias("n"), F.sum("value").alias("total"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("avg_value"), F.count_if(F.col("status") == "ALARM").alias("alarm_count"))
    return g.select(F.col("w.start").alias("window_start"), *[c for c in g.columns if c != "w"])


def enrich_stream(df: DataFrame, equipment: DataFrame, recipe: DataFrame, lot: DataFrame) -> DataFrame:
    """Stream-static joins; the dimensions are read again for each micro-batch."""
    return enrich_measurements(df, equipment, recipe, lot)


def rules_at_end(v: np.ndarray, ucl: float, lcl: float, center: float, sigma: float) -> list[str]:
    """The rules that fire on the newest of the values."""
    s = sigma if sigma and sigma > 0 else (ucl - center) / 3
    out = []
    last = lambda n: v[-n:] if len(v) >= n else v[:0]

    def put(name: str, holds: bool) -> bool:
        if holds:
            out.append(name)
        return holds

    put("RULE1_BEYOND_3SIGMA", v[-1] > ucl or v[-1] < lcl)
    a = last(9)
    put("RULE2_RUN_ABOVE", len(a) and (a > center).all()) or put("RULE2_RUN_BELOW", len(a) and (a < center).all())
    d = np.diff(last(6))
    put("RULE3_TREND_UP", len(d) and (d > 0).all()) or put("RULE3_TREND_DOWN", len(d) and (d < 0).all())
    up = np.diff(last(14)) > 0
    put("RULE4_ALTERNATING", len(up) and (up[1:] != up[:-1]).all())
    for name, n, least, k in (("RULE5_2OF3", 3, 2, 2), ("RULE6_4OF5", 5, 4, 1)):
        a = last(n)
        put(f"{name}_ABOVE_{k}SIGMA", (a > center + k * s).sum() >= least) or put(f"{name}_BELOW_{k}SIGMA", (a < center - k * s).sum() >= least)
    a = last(15)
    put("RULE7_STRATIFICATION", len(a) and ((a >= center - s) & (a <= center + s)).all())
    a = last(8)
    put("RULE8_MIXTURE", len(a) and ((a > center + s) | (a < center - s)).all())
    return out


#: The store that lists, maps and timers of a key need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(df: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    """What the processor makes of each key's rows, with state that outlives the batch. Streams that start in this session from now on keep state in RocksDB; those with a checkpoint keep the store that it names."""
    conf, name = df.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    if not conf.get(name, "").endswith("RocksDBStateStoreProvider"):
        conf.set(name, ROCKS)
    return df.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "EventTime")


class Evicted(StatefulProcessor):
    """State that goes once event time is `ttl_ms` past the key's newest row."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.newest = handle, handle.getValueState("newest", "us long")

    def seen(self, us: int) -> None:
        """Note the newest row of the batch; the key's timer is moved there."""
        last = self.newest.get()[0] if self.newest.exists() else None
        if last is None or us > last:
            if last is not None:
                self.handle.deleteTimer(last // 1000 + self.ttl_ms)
            self.newest.update((us,))
            self.handle.registerTimer(us // 1000 + self.ttl_ms)

    def clear(self) -> None:
        self.newest.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.newest.get()[0] if self.newest.exists() else None
        if last is None or expiredTimerInfo.getExpiryTimeInMs() >= last // 1000 + self.ttl_ms:
            self.clear()
        return iter([])

    def close(self) -> None:
        pass


def plain_text(pdf: pd.DataFrame) -> pd.DataFrame:
    """Text columns as objects, which keyed state can send (chunked text it can't)."""
    return pdf.astype({c: object for c in pdf.columns if pd.api.types.is_string_dtype(pdf[c].dtype)})


def rules_of_rows(v: np.ndarray, first: int, ucl: np.ndarray, lcl: np.ndarray, center: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """The rules that fire on each value from place `first` on, by the limits of its own row, as text; rules_at_end() for all rows at once."""
    n = len(v) - first
    with np.errstate(invalid="ignore"):
        s = np.where(sigma > 0, sigma, (ucl - center) / 3)[:, None]
    mid, out = center[:, None], np.full(n, "", object)

    def last(k: int) -> tuple[np.ndarray, np.ndarray]:
        """The last k values up to each row (padded), and whether there are as many."""
        return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(k - 1, np.nan), v]), k)[first:], np.arange(first, len(v)) >= k - 1

    def put(name: str, holds: np.ndarray) -> np.ndarray:
        out[holds] += name + ","
        return holds

    put("RULE1_BEYOND_3SIGMA", (v[first:] > ucl) | (v[first:] < lcl))
    a, full = last(9)
    above = put("RULE2_RUN_ABOVE", full & (a > mid).all(1))
    put("RULE2_RUN_BELOW", full & (a < mid).all(1) & ~above)
    a, full = last(6)
    up = put("RULE3_TREND_UP", full & (np.diff(a, axis=1) > 0).all(1))
    put("RULE3_TREND_DOWN", full & (np.diff(a, axis=1) < 0).all(1) & ~up)
    a, full = last(14)
    up = np.diff(a, axis=1) > 0
    put("RULE4_ALTERNATING", full & (up[:, 1:] != up[:, :-1]).all(1))
    for name, k, least, far in (("RULE5_2OF3", 3, 2, 2), ("RULE6_4OF5", 5, 4, 1)):
        a, full = last(k)
        above = put(f"{name}_ABOVE_{far}SIGMA", full & ((a > mid + far * s).sum(1) >= least))
        put(f"{name}_BELOW_{far}SIGMA", full & ((a < mid - far * s).sum(1) >= least) & ~above)
    a, full = last(15)
    put("RULE7_STRATIFICATION", full & ((a >= mid - s) & (a <= mid + s)).all(1))
    a, full = last(8)
    put("RULE8_MIXTURE", full & ((a > mid + s) | (a < mid - s)).all(1))
    return np.array([x[:-1] for x in out], object)


class Charts(Evicted):
    """The newest values of a key, as a list of at most `history` that a batch replaces."""

    def __init__(self, history: int, ttl_ms: int) -> None:
        super().__init__(ttl_ms)
        self.history = history

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.past = handle.getListState("past", "value double")

    def clear(self) -> None:
        super().clear()
        self.past.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["us", "measurement_id"])
        past = np.array([x[0] for x in self.past.get()] if self.past.exists() else [], float)
        v = np.concatenate([past, pdf["value"].to_numpy(float)])
        limits = {c: pdf[c].to_numpy(float) for c in ("ucl", "lcl", "center", "sigma", "usl", "lsl")}
        rules = rules_of_rows(v, len(past), *(limits[c] for c in ("ucl", "lcl", "center", "sigma")))
        kept = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(self.history - 1, np.nan), v]), self.history)[len(past) :]
        n = np.minimum(np.arange(len(past), len(v)) + 1, self.history)
        mean = np.nansum(kept, axis=1) / n
        with np.errstate(invalid="ignore", divide="ignore"):
            std = np.where(n > 1, np.sqrt(np.nansum((kept - mean[:, None]) ** 2, axis=1) / (n - 1)), np.nan)
            cpk = np.where(std > 0, np.minimum(limits["usl"] - mean, mean - limits["lsl"]) / (3 * std), np.nan)
        self.past.put([(float(x),) for x in v[-self.history :]])
        self.seen(int(pdf["us"].max()))
        yield plain_text(pd.DataFrame({"measurement_id": pdf["measurement_id"].to_numpy(), "rules": rules, "x_bar": mean, "std_dev": std, "cpk": cpk}))


def spc_stream(df: DataFrame, history: int = 25, ttl_ms: int = 86_400_000) -> DataFrame:
    """Per row: rules of the newest point, mean, sample std and cpk of the last `history` values of its equipment and parameter. Rows without a value take no part."""
    cols = df.where(F.col("value").isNotNull()).select("equipment_id", "param_id", "measurement_id", "time", micros(F.col("time")).alias("us"), "value", "usl", "lsl", "ucl", "lcl", "center", "sigma")
    return keyed_state(cols, ["equipment_id", "param_id"], Charts(history, ttl_ms), "measurement_id long, rules string, x_bar double, std_dev double, cpk double")


ALERTS = "alert_id string, equipment_id string, detected_at timestamp, severity string, confidence double, points long"


class Trailing(Evicted):
    """A key's rows of the last `seconds` and 60 s more, in buckets of time: a batch writes the buckets that its rows belong to and removes those that no window reaches any more."""

    def __init__(self, pattern: str, names: list[str], kinds: list[str], seconds: int, find) -> None:
        super().__init__((seconds + 60) * 1000)
        self.pattern, self.names, self.kinds, self.seconds, self.find = pattern, names, kinds, seconds, find
        self.width = max(60, seconds // 16) * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.buckets = handle.getMapState("buckets", "bucket long", ", ".join(f"{c} array<{t}>" for c, t in zip(self.names, self.kinds, strict=True)))

    def clear(self) -> None:
        super().clear()
        self.buckets.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))[self.names].assign(new=True)
        newest = int(new["us"].max())
        if self.newest.exists():
            newest = max(newest, int(self.newest.get()[0]))
        oldest = newest - (self.seconds + 60) * 1_000_000
        held = {int(k[0]): v for k, v in self.buckets.iterator()} if self.buckets.exists() else {}
        old = [pd.DataFrame(dict(zip(self.names, v, strict=True))).assign(new=False) for v in held.values()]
        both = pd.concat([*old, new]) if old else new
        both = both.sort_values(["us", "id"], ignore_index=True)
        us, own = both["us"].to_numpy(np.int64), np.flatnonzero(both["new"])
        lo, hi = np.searchsorted(us, us[own] - self.seconds * 1_000_000, "left"), np.searchsorted(us, us[own], "right")
        fires, severity, confidence = self.find(both, lo, hi)
        for bucket in held:
            if (bucket + 1) * self.width <= oldest:
                self.buckets.removeKey((bucket,))
        touched = both["us"] // self.width
        for bucket in np.unique(touched[own]).tolist():
            mine = both[touched == bucket]
            if (bucket + 1) * self.width > oldest:
                self.buckets.updateValue((bucket,), tuple(mine[c].tolist() for c in self.names))
        self.seen(newest)
        hit = own[fires]
        if len(hit):
            yield plain_text(pd.DataFrame({"alert_id": [f"CEP-{self.pattern}-{i}" for i in both["id"][hit]], "equipment_id": key[0], "detected_at": pd.to_datetime(us[hit], unit="us"), "severity": severity[fires], "confidence": confidence[fires], "points": (hi - lo)[fires]}))


def _trailing_alerts(df: DataFrame, keys: list[str], pattern: str, kept: dict[str, str], seconds: int, find) -> DataFrame:
    """Alerts of rows whose trailing window fires. df: keys, time, us, id and the columns of `kept`, which the state holds for the window and 60 s.

    find(rows, lo, hi) gets a key's known rows in order and, for each new one, where its window begins and ends among
    them; it returns which fire, their severity and confidence.
    """
    kinds = {"us": "bigint", "id": dict(df.dtypes)["id"], **kept}
    return keyed_state(df.select(*keys, "time", *kinds), keys, Trailing(pattern, list(kinds), list(kinds.values()), seconds, find), ALERTS)


def cep_stream(df: DataFrame, n: int = 3, seconds: int = 180) -> DataFrame:
    """cep_threshold() over a stream: rows in ALARM or WARNING with at least n such rows of their key in the window that ends at them."""

    def find(rows: pd.DataFrame, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return hi - lo >= n, np.full(len(lo), "MAJOR", object), np.minimum(1.0, (hi - lo) / n)

    rows = df.where(F.col("status").isin("ALARM", "WARNING")).select("equipment_id", "param_id", "time", micros(F.col("time")).alias("us"), F.col("measurement_id").alias("id"))
    return _trailing_alerts(rows, ["equipment_id", "param_id"], "THRESHOLD_BREACH", {}, seconds, find)


def cep_alarms_stream(alarms: DataFrame, n: int = 5, seconds: int = 300) -> DataFrame:
    """cep_consecutive_alarms() over a stream: at least n alarms of one equipment in the window, CRITICAL with three codes or more."""

    def find(rows: pd.DataFrame, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes = np.zeros(len(lo), int)
        for c in rows["code"].dropna().unique():
            at = np.flatnonzero(rows["code"] == c)
            codes += np.searchsorted(at, hi) > np.searchsorted(at, lo)
        return hi - lo >= n, np.where(codes >= 3, "CRITICAL", "MAJOR").astype(object), np.minimum(1.0, (hi - lo) / n)

    rows = alarms.select("equipment_id", "time", micros(F.col("time")).alias("us"), F.col("alarm_id").alias("id"), F.col("alarm_code").alias("code"))
    return _trailing_alerts(rows, ["equipment_id"], "CONSECUTIVE_ALARMS", {"code": "string"}, seconds, find)


def cep_drift_stream(df: DataFrame, seconds: int = 600, sigma: float = 2.0, least: int = 10) -> DataFrame:
    """cep_drift() over a stream, by sums up to each place among the key's known rows."""

    def find(rows: pd.DataFrame, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = rows["value"].to_numpy(float)
        v = v - v.mean()
        s, q = np.concatenate([[0.0], np.cumsum(v)]), np.concatenate([[0.0], np.cumsum(v * v)])
        n = hi - lo
        mid, many = lo + n // 2, n > least
        with np.errstate(divide="ignore", invalid="ignore"):
            std = np.sqrt(np.maximum(q[hi] - q[lo] - (s[hi] - s[lo]) ** 2 / n, 0) / (n - 1))
            far = np.abs((s[hi] - s[mid]) / (hi - mid) - (s[mid] - s[lo]) / (mid - lo)) / std
        fires = many & (std > 0) & (far >= sigma)
        return fires, np.where(far < 3, "WARNING", "MAJOR").astype(object), np.minimum(1.0, far / 4)

    rows = df.where(F.col("value").isNotNull()).select("equipment_id", "param_id", "time", micros(F.col("time")).alias("us"), F.col("measurement_id").alias("id"), "value")
    return _trailing_alerts(rows, ["equipment_id", "param_id"], "DRIFT_DETECTED", {"value": "double"}, seconds, find)


#: The least ensemble score of each severity, and the share of scores that a local outlier factor must exceed to vote.
SEVERITIES = {"EMERGENCY": 0.95, "CRITICAL": 0.8, "WARNING": 0.6}
USUAL = 0.95


def scaled_score(score: float, past: np.ndarray) -> float:
    """The score between the 5th and 95th percentile of the past ones (itself included), in 0 to 1; with fewer than 10 it is only clipped."""
    if len(past) < 10:
        return float(np.clip(score, 0, 1))
    lo, hi = np.percentile(past, [5, 95])
    return 0.5 if hi - lo < 1e-10 else float(np.clip((score - lo) / (hi - lo), 0, 1))


def outlier_factor(x: np.ndarray, past: np.ndarray, k: int) -> float:
    """The local outlier factor of x among past points, of which k count as neighbours."""
    k, one = min(k, len(past) - 1), np.ones(len(past), np.int64)
    _, i, d, _ = nearest(past, past, one, k, True)
    i, d = i.reshape(-1, k), np.sqrt(d).reshape(-1, k)
    dense = 1 / np.maximum(np.maximum(d.max(1)[i], d).mean(1), 1e-10)
    _, j, e, _ = nearest(x[None], past, one, k)
    return float(dense[j].mean() * max(np.maximum(d.max(1)[j], np.sqrt(e)).mean(), 1e-10))


class Memory(NamedTuple):
    """What a key remembers of its closed windows: these (mean, std, range), the scores of the four detectors, CUSUM sums, and the forest with the window start it was grown at and the score that it usually stays below."""

    past: np.ndarray = np.zeros((0, 3))
    scores: np.ndarray = np.zeros((0, 4))
    up: float = 0.0
    down: float = 0.0
    forest: bytes = b""
    grown: int = 0
    usual: float = 1.0


def grown_forest(past: np.ndarray, at: int, trees: int, sample: int) -> tuple[bytes, float]:
    """An isolation forest of past windows, as float32 bytes, and the score that a share of USUAL of them stays below. Draws depend on the time only, so a batch that comes again grows the same."""
    forest = grow_forest(past, trees, sample, at % (1 << 32)).astype(np.float32)
    return forest.tobytes(), float(np.quantile(forest_score(forest, past, leaves(forest, sample)), USUAL))


def leaves(forest: np.ndarray, sample: int) -> int:
    """The number of rows that a forest's scores are scaled by: its sample, or what its depth holds where it was grown from fewer."""
    return min(sample, (forest.shape[1] + 1) // 2)


def isolation_score(forest: np.ndarray, row: np.ndarray, size: int) -> float:
    """forest_score() of one row, all trees at once."""
    tree, at = np.arange(len(forest)), np.zeros(len(forest), np.int64)
    while True:
        f = forest[tree, at, 0].astype(np.int64)
        if not (f >= 0).any():
            return float(2 ** (-forest[tree, at, 2].astype(float).mean() / max(float(path_length(size)), 1e-9)))
        at = np.where(f >= 0, 2 * at + 1 + (row[np.maximum(f, 0)] >= forest[tree, at, 1]), at)


def score_windows(x: np.ndarray, us: list[int], memory: Memory, history: int, least: int, near: int, k: int, drift: float, trees: int, sample: int, refit: int) -> tuple[list[tuple[float, int]], Memory]:
    """Ensemble score and votes of the windows x (mean, std, range) that begin at us, in order, each against those before it; and what to remember."""
    out = []
    past, scores, up, down, packed, grown, usual = memory
    for row, at in zip(x, us, strict=True):
        if len(past) < least:
            out.append((0.0, 0))
        else:
            if not packed or at - grown >= refit:
                packed, usual = grown_forest(past, at, trees, sample)
                grown = at
            std = past.std(0)
            scale = np.where(std > 0, std, 1.0)
            z = np.where(std > 0, (row - past.mean(0)) / scale, 0.0)
            up, down = max(0.0, up + z[0] - drift), max(0.0, down - z[0] - drift)
            forest = np.frombuffer(packed, np.float32).reshape(trees, -1, 3)
            raw = np.array([np.abs(z).max(), max(up, down), outlier_factor(row / scale, past[-near:] / scale, k), isolation_score(forest, row, leaves(forest, sample))])
            scores = np.concatenate([scores, raw[None]])[-history:]
            votes = int(raw[0] > 3) + int(raw[1] > 5) + int(len(scores) >= least and raw[2] > np.quantile(scores[:-1, 2], USUAL)) + int(raw[3] > usual)
            out.append((float(np.mean([scaled_score(s, scores[:, i]) for i, s in enumerate(raw)])), votes))
        past = np.concatenate([past, row[None]])[-history:]
    return out, Memory(past, scores, float(up), float(down), packed, int(grown), float(usual))


def merged_windows(parts: pd.DataFrame) -> pd.DataFrame:
    """One row for each window start `us` from partial ones: n, mean m, squared deviations q, least lo and most hi."""
    g = parts.assign(nm=parts["n"] * parts["m"]).groupby("us")
    out = g.agg(n=("n", "sum"), nm=("nm", "sum"), q=("q", "sum"), lo=("lo", "min"), hi=("hi", "max"))
    out["m"] = out["nm"] / out["n"]
    apart = parts["n"] * (parts["m"] - parts["us"].map(out["m"])) ** 2
    out["q"] += apart.groupby(parts["us"]).sum()
    return out.reset_index()[["us", "n", "m", "q", "lo", "hi"]]


def ensemble_stream(df: DataFrame, seconds: int = 60, history: int = 1000, least: int = 20, near: int = 100, k: int = 20, drift: float = 0.5, trees: int = 50, sample: int = 64, refit_seconds: int = 86_400, ttl_ms: int = 86_400_000) -> DataFrame:
    """window_start, equipment_id, param_id, score (0 to 1), votes, is_anomaly (two votes or more) and severity of each window that the watermark has passed.

    A key's state holds the open windows as counts and moments, the last `history` closed ones (mean, deviation,
    range) with their scores, its CUSUM sums, and an isolation forest of `trees` trees of up to `sample` windows each.
    Detectors: the largest z-value, CUSUM of the mean, the local outlier factor among the last `near` windows, and the
    forest, which is grown from the key's history and again once it is `refit_seconds` of event time old; scores are
    scaled by the key's own history and averaged. The first `least` windows of a key only teach. Rows without a value
    take no part.
    """
    width, parts = seconds * 1_000_000, ["us", "n", "m", "q", "lo", "hi"]
    flat = lambda a, n: np.array(a, float).reshape(-1, n)

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else ([], 0, [], [], *Memory()[2:])
        windows, last = pd.DataFrame(flat(old[0], 6), columns=parts), old[1]
        if not state.hasTimedOut:
            rows = pd.concat(list(batches))
            one = pd.DataFrame({"us": rows["us"] // width * width, "n": 1, "m": rows["value"], "q": 0.0, "lo": rows["value"], "hi": rows["value"]})
            windows, last = merged_windows(pd.concat([windows, one]).astype(float)), max(last, int(rows["us"].max()))
        closed = windows["us"] + width <= state.getCurrentWatermarkMs() * 1000
        done, waiting = windows[closed], windows[~closed]
        if state.hasTimedOut and not len(windows):
            state.remove()
            return
        x, begins = np.column_stack([done["m"], np.sqrt(done["q"] / done["n"]), done["hi"] - done["lo"]]), done["us"].astype("int64")
        memory = Memory(flat(old[2], 3), flat(old[3], 4), old[4], old[5], bytes(old[6]), old[7], old[8])
        out, new = score_windows(x, begins.tolist(), memory, history, least, near, k, drift, trees, sample, refit_seconds * 1_000_000)
        state.update((waiting.to_numpy().ravel().tolist(), last, new.past.ravel().tolist(), new.scores.ravel().tolist(), *new[2:]))
        until = int(waiting["us"].min() + width) // 1000 if len(waiting) else last // 1000 + ttl_ms
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        score, votes = np.array([x[0] for x in out]), np.array([x[1] for x in out], int)
        severity = np.select([score >= x for x in SEVERITIES.values()], list(SEVERITIES), "NORMAL").astype(object)
        yield pd.DataFrame({"window_start": pd.to_datetime(begins.to_numpy(), unit="us"), "equipment_id": key[0], "param_id": key[1], "score": score, "votes": votes, "is_anomaly": votes >= 2, "severity": severity})

    cols = df.where(F.col("value").isNotNull()).select("equipment_id", "param_id", "time", micros(F.col("time")).alias("us"), "value")
    schema = "window_start timestamp, equipment_id string, param_id string, score double, votes long, is_anomaly boolean, severity string"
    kept = "open array<double>, last long, past array<double>, scores array<double>, up double, down double, forest binary, grown long, usual double"
    return cols.groupBy("equipment_id", "param_id").applyInPandasWithState(work, schema, kept, "append", GroupStateTimeout.EventTimeTimeout)


def upsert_stream(df: DataFrame, path: str, keys: list[str], update_cols: list[str], order: str, checkpoint: str, buckets: int = BUCKETS, most: int = MOST):
    """Each micro-batch goes into the buckets of the table at path that it touches (see sources.upserts); one that is run again gives the same table."""

    def put(batch: DataFrame, batch_id: int) -> None:
        upsert(batch, batch_id, path, keys, update_cols, order, buckets, most)

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def run_now(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and read what it wrote: column batch_id and the rows of each micro-batch."""
    spark: SparkSession = df.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch_id={batch_id}")

    q = df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(f"{df.schema.toDDL()}, batch_id int").parquet(f"{path}/out")


def newest(df: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of each key from the output of run_now(mode="update")."""
    rest = [c for c in df.columns if c not in [*keys, "batch_id"]]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")
