"""Queries: prediction and evaluation, documents and vectors, sources, sinks and streams."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import documents, features, joins, predict
from millrace.operators.graph import cut, shared_folder
from millrace.plans import views as v
from millrace.plans.analytics import KEYS, W
from millrace.plans.monitoring import FOUND, _ALARMS, _DRIFT, _STATS, _THRESHOLD, _found, _we_sql
from millrace.plans.views import EQ, M, query, rounded
from millrace.sources import files, topics, upserts
from millrace.streaming import jobs


def _failures(spark, d):
    m = v.sensors(spark, d).withColumn("failure", (F.col("status") == "ALARM").cast("int"))
    x = features.failure_features(joins.label_failure_horizon(m, 24), ["value"], KEYS, 20)
    return cut(x.dropna(subset=["value_std", "value_slope", "value_pct"]).select("measurement_id", "label", *FAILURE_COLS))  # a fit reads it many times


FAILURE_COLS = ["value", "value_mean", "value_std", "value_max", "value_slope", "value_ratio"]


@query()
def score_failure(spark, d):
    x = _failures(spark, d)
    return predict.score_failure(predict.train_failure_model(x, FAILURE_COLS), x).select("measurement_id", "probability", "risk_level", "prediction")


@query()
def train_failure_model(spark, d):
    model = predict.train_failure_model(_failures(spark, d), FAILURE_COLS, kind="gbt")
    return spark.createDataFrame(predict.top_features(model), "feature string, importance double")


def _quality(spark, d):
    line = v.load(spark, d, "lineitem")
    return line.select(F.concat_ws("-", *v.LINE).alias("wafer_id"), "l_quantity", "l_discount", "l_tax", (F.col("l_partkey") % 20).cast("double").alias("tool"), (F.col("l_extendedprice") / 1000).alias("yield"))


QUALITY_COLS = ["l_quantity", "l_discount", "l_tax", "tool"]


@query()
def train_quality_model(spark, d):
    x = _quality(spark, d)
    model = predict.train_quality_model(x, QUALITY_COLS, "yield", "ridge", poly=True, folds=3)
    return rounded(predict.quality_metrics(model.transform(x), "yield"), 3)


@query()
def score_quality(spark, d):
    x = _quality(spark, d)
    model = predict.train_quality_model(x, QUALITY_COLS, "yield", "rf")
    rmse = predict.quality_metrics(model.transform(x), "yield").first()["rmse"]
    return predict.score_quality(model, x, rmse).select("wafer_id", "prediction", "lower", "upper")


@query()
def feature_impact(spark, d):
    x = _quality(spark, d)
    return predict.feature_impact(x, predict.train_quality_model(x, QUALITY_COLS, "yield", "ridge"), "l_quantity", QUALITY_COLS)


@query()
def optimal_conditions(spark, d):
    x = _quality(spark, d)
    return predict.optimal_conditions(x, predict.train_quality_model(x, QUALITY_COLS, "yield", "ridge", poly=True), QUALITY_COLS, 40.0)


def _health(spark, d):
    return v.sensors(spark, d).select("equipment_id", (F.dayofmonth("time") * 24 + F.hour("time")).cast("double").alias("hours"), (20 + F.exp((F.dayofmonth("time") * 24 + F.hour("time")) / 300) + F.col("value") / 500).alias("health"))


@query()
def fit_degradation(spark, d):
    return rounded(predict.fit_degradation(_health(spark, d)), 4)


@query()
def predict_rul(spark, d):
    return predict.predict_rul(predict.fit_degradation(_health(spark, d)), 60.0).select("equipment_id", "rul_hours")


_EVAL = f"{M}, e AS (SELECT measurement_id, equipment_id, param_id, time, CAST(value > 90 AS INTEGER) AS y_true, CAST(value > 80 AND measurement_id % 5 > 0 AS INTEGER) AS y_pred, floor(value / 10) + measurement_id % 3 AS y_score FROM m)"


def _eval(spark, d):
    i = F.col("measurement_id")
    return v.sensors(spark, d).select("measurement_id", *KEYS, "time", (F.col("value") > 90).cast("int").alias("y_true"), ((F.col("value") > 80) & (i % 5 > 0)).cast("int").alias("y_pred"), (F.floor(F.col("value") / 10) + i % 3).cast("double").alias("y_score"))


_METRICS = f"""WITH {_EVAL}, c AS (SELECT param_id, count_if(y_true = 1 AND y_pred = 1) AS tp, count_if(y_true = 0 AND y_pred = 1) AS fp, count_if(y_true = 1 AND y_pred = 0) AS fn, count_if(y_true = 0 AND y_pred = 0) AS tn, sum(y_true) AS np, count(*) - sum(y_true) AS nn FROM e GROUP BY 1),
r AS (SELECT param_id, y_true, y_score, rank() OVER (PARTITION BY param_id ORDER BY y_score) + (count(*) OVER (PARTITION BY param_id, y_score) - 1) / 2 AS rk, sum(y_true) OVER (PARTITION BY param_id ORDER BY y_score DESC RANGE UNBOUNDED PRECEDING) / count(*) OVER (PARTITION BY param_id ORDER BY y_score DESC RANGE UNBOUNDED PRECEDING) AS prec FROM e),
a AS (SELECT param_id, sum(CASE WHEN y_true = 1 THEN rk END) AS rs, avg(prec) FILTER (y_true = 1) AS ap FROM r GROUP BY 1)
SELECT param_id, tp, fp, fn, tn, round((rs - np * (np + 1) / 2) / (np * nn), 6) AS roc_auc, round(ap, 6) AS pr_auc, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c JOIN a USING (param_id)"""


@query(_METRICS)
def evaluate_detector(spark, d):
    return rounded(predict.evaluate_detector(_eval(spark, d), ["param_id"]))


@query(f"""WITH {_EVAL}, x AS (SELECT *, row_number() OVER {W}) AS i, y_true = 1 AND coalesce(lag(y_true) OVER {W}), 0) = 0 AS s FROM e), y AS (SELECT *, min(CASE WHEN y_pred = 1 THEN i END) OVER {W} ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS f FROM x)
SELECT equipment_id, param_id, round(avg(CASE WHEN f IS NULL THEN 0 WHEN f <= i THEN 1 ELSE 1 - (f - i) / 10 END), 6) AS early_detection, count(*) AS faults FROM y WHERE s GROUP BY 1, 2""")
def early_detection_score(spark, d):
    return rounded(predict.early_detection_score(_eval(spark, d), KEYS))


@query(f"""WITH q AS ({_METRICS}) SELECT param_id, round(0.5 * f1 + 0.5 * roc_auc, 5) AS weighted_score, CAST(rank() OVER (ORDER BY 0.5 * f1 + 0.5 * roc_auc DESC) AS INTEGER) AS place FROM q""")
def rank_algorithms(spark, d):
    m = predict.evaluate_detector(_eval(spark, d), ["param_id"])
    return rounded(predict.rank_algorithms(m, {"f1": 0.5, "roc_auc": 0.5}).select("param_id", "weighted_score", "place"), 5)


_SHAPE = f"""{M}, x AS (SELECT *, lag(value) OVER {W}) AS l FROM m), c AS (SELECT equipment_id, param_id, count(*) AS n, avg(CAST(status = 'ALARM' AS INTEGER)) AS anomalies, abs(corr(value, l)) AS auto, stddev_samp(value) / abs(avg(value)) AS cv FROM x GROUP BY 1, 2)"""


@query(f"""WITH {_SHAPE}, a(algorithm, kind, need, ease, clear, o) AS (VALUES ('Z-Score Detector', 's', 100, 1.0, 1.0, 1), ('CUSUM Detector', 's', 100, 1.0, 1.0, 2), ('SPC Control Chart Detector', 's', 200, 1.0, 1.0, 3),
  ('Isolation Forest', 'm', 500, 0.6, 0.6, 4), ('Local Outlier Factor', 'm', 300, 0.6, 0.6, 5), ('One-Class SVM', 'm', 300, 0.6, 0.3, 6), ('AutoEncoder', 'd', 5000, 0.3, 0.3, 7), ('LSTM AutoEncoder', 'd', 10000, 0.3, 0.3, 8)),
y AS (SELECT *, least(1e0, n / need) * 0.2e0 + (1 - ease / 2) * 0.2e0 + clear * 0.2e0
  + CASE WHEN auto > 0.5 THEN CASE WHEN o = 8 THEN 0.3e0 WHEN o = 2 THEN 0.2e0 WHEN kind = 's' THEN 0.1e0 ELSE 0 END ELSE 0 END
  + CASE WHEN cv > 0.3 THEN CASE WHEN kind = 'd' OR o IN (4, 5) THEN 0.1e0 ELSE 0 END WHEN kind = 's' THEN 0.1e0 ELSE 0 END + CASE WHEN anomalies < 0.01 AND o = 4 THEN 0.15e0 ELSE 0 END AS s FROM c, a)
SELECT equipment_id, param_id, algorithm, round(least(1, s), 6) AS suitability, n >= need AS enough_rows, row_number() OVER (PARTITION BY equipment_id, param_id ORDER BY round(s, 9) DESC, o) AS place FROM y""")
def recommend_algorithms(spark, d):
    m = v.sensors(spark, d).withColumn("is_anomaly", F.col("status") == "ALARM")
    out = predict.recommend_algorithms(features.data_characteristics(m, ["value"], KEYS), KEYS)
    return rounded(out.withColumn("enough_rows", ~F.exists("warnings", lambda w: w.startswith("NOT rows"))).drop("reasons", "warnings"))


# --- documents and vectors --------------------------------------------------------------------------


@query()
def chunk_text(spark, d):
    return documents.chunk_text(v.load(spark, d, "documents"), "doc_id", "text")


@query("""WITH x AS (SELECT doc_id, string_split_regex('## ' || replace(coalesce(text, ''), chr(10), chr(10) || '## '), '(?m)^## ') AS p FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, unnest(p[2:]) AS b, unnest(range(0, len(p) - 1)) AS section FROM x)
SELECT doc_id, count(*) AS sections, sum(length(b) + 3) AS characters FROM y GROUP BY doc_id""".replace("sum(length(b) + 3)", "CAST(sum(length(b) + 3) AS BIGINT)"))
def split_sections(spark, d):
    docs = v.load(spark, d, "documents").select("doc_id", F.concat(F.lit("## "), F.replace("text", F.lit("\n"), F.lit("\n## "))).alias("body_md"))
    out = documents.split_sections(docs, "doc_id", "body_md")
    return out.groupBy("doc_id").agg(F.count("*").alias("sections"), F.sum(F.length("body")).cast("long").alias("characters"))


_KNOWN = f"""WITH {FOUND}, texts AS (
  SELECT 'discovered_relationship|' || source || '|' || relation_type || '|' || target || '|quantity' AS id, 'Discovered relation: ' || source || ' -> ' || target || chr(10) || 'Type: ' || relation_type || chr(10) || 'Confidence: ' || CAST(CAST(round(confidence * 100) AS BIGINT) AS VARCHAR) || '%' || chr(10) || 'Found by: quantity' AS content FROM r
  UNION ALL SELECT 'causal_relationship|' || source || '|' || relation_type || '|' || target, 'Cause: ' || source || ' -> ' || target || chr(10) || 'Type: ' || relation_type || chr(10) || 'When ' || source || ' rises, ' || target || ' rises' || chr(10) || 'Confidence: ' || CAST(CAST(round(confidence * 100) AS BIGINT) AS VARCHAR) || '%' FROM r WHERE relation_type = 'CAUSES'
  UNION ALL SELECT 'alarm_cause|' || code || '|' || cause, 'Alarm ' || code || ': check ' || cause || chr(10) || 'Condition: ' || p_type || chr(10) || 'Priority: ' || CAST(p_partkey % 9 AS VARCHAR) FROM a
  UNION ALL SELECT 'leading_indicator|' || cause || '|' || p_type || '|' || p_brand, 'Leading indicator: ' || cause || ' -> ' || p_brand || chr(10) || 'Pattern: ' || p_type || chr(10) || 'About ' || CAST(p_size AS VARCHAR) || '.0 minutes before ' || p_brand FROM a
  UNION ALL SELECT 'impossible_relationship|' || s_name || '|' || n_name, 'No causal relation is possible between ' || s_name || ' and ' || n_name || chr(10) || 'Reason: ' || 'apart' FROM supplier JOIN nation ON s_nationkey <> n_nationkey AND n_regionkey = 0
  UNION ALL SELECT 'discovery_summary', 'Discovered relations: ' || CAST(count(*) AS VARCHAR) || chr(10) || 'Of high confidence: ' || CAST(count_if(confidence > 0.7) AS VARCHAR) || chr(10) || '- quantity: ' || CAST(count(*) AS VARCHAR) || ', at most ' || CAST(CAST(round(max(confidence) * 100) AS BIGINT) AS VARCHAR) || '%' FROM r)"""


def _knowledge(spark, d):
    """Parts, suppliers and nations as the experts' tables."""
    part, s, n = (v.load(spark, d, t) for t in ("part", "supplier", "nation"))
    cause = F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    causal = _found(spark, d).where("relation_type = 'CAUSES'").withColumns({"direction": F.lit("positive"), "lag_range": F.lit(None).cast("array<double>"), "physics": F.lit(None).cast("string")})
    alarms = part.select(F.concat(F.lit("A"), F.col("p_size").cast("string")).alias("alarm_code"), cause.alias("cause_parameter"), F.col("p_type").alias("condition"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("action"), (F.col("p_partkey") % 9).alias("priority"))
    ahead = part.select(F.col("p_brand").alias("target_event"), cause.alias("indicator"), F.col("p_type").alias("pattern"), (F.col("p_size") * 60.0).alias("lead_time"))
    apart = s.join(n.where("n_regionkey = 0"), s.s_nationkey != n.n_nationkey).select(F.col("s_name").alias("param1"), F.col("n_name").alias("param2"), F.lit("apart").alias("reason"))
    return {"causal_relationships": causal, "alarm_causes": alarms, "leading_indicators": ahead, "impossible_relationships": apart}


@query(f"{_KNOWN.replace(', texts AS', ", a AS (SELECT *, 'A' || CAST(p_size AS VARCHAR) AS code, 'P' || CAST(p_partkey AS VARCHAR) AS cause FROM part), texts AS")} SELECT id, content FROM texts")
def relationship_documents(spark, d):
    found = _found(spark, d)
    parts = [documents.relationship_documents(found), documents.knowledge_documents(_knowledge(spark, d)), documents.discovery_summary(found)]
    return reduce(DataFrame.unionByName, parts).select("id", "content")


def _vectors(spark, d):
    return v.load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("doc_type"))


_TOP = """x AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, CAST(label AS VARCHAR) AS doc_type FROM embeddings), s AS (SELECT q.id AS query_id, x.id, x.doc_type, list_dot_product(q.e, x.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(x.e, x.e)) AS sim FROM x q, x WHERE q.id % 50 = 0)"""


@query(f"WITH {_TOP}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, id) AS place FROM s) SELECT query_id, id, round(sim, 6) AS similarity, round(1 - sim, 6) AS distance, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5".replace("round(sim, 12)", "trunc(sim * 1e12)"))
def vector_search(spark, d):
    docs = _vectors(spark, d)
    return rounded(documents.vector_search(docs, docs.where("id % 50 = 0").withColumnRenamed("id", "query_id"), 5))


@query(f"""WITH {_TOP}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY trunc(sim * 1e12) DESC, id) AS place FROM s), k AS (SELECT * FROM r WHERE place <= 3 AND sim >= 0.3) SELECT query_id, CAST(count(*) AS INTEGER) AS documents, substr(string_agg('vector ' || id, chr(10) || '---' || chr(10) ORDER BY place), 1, 2000) AS context FROM k GROUP BY query_id""")
def retrieve_context(spark, d):
    docs = _vectors(spark, d)
    found = documents.vector_search(docs, docs.where("id % 50 = 0").withColumnRenamed("id", "query_id"), 3).withColumn("content", F.concat(F.lit("vector "), F.col("id").cast("string")))
    return documents.retrieve_context(found)


@query(f"""WITH {_TOP}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_type ORDER BY trunc(sim * 1e12) DESC, id) AS place FROM s WHERE doc_type IN ('1', '2')) SELECT query_id, id, round(sim, 6) AS similarity, doc_type FROM r WHERE place <= 3""")
def retrieve_for_alarm(spark, d):
    docs = _vectors(spark, d)
    return rounded(documents.retrieve_for_alarm(docs, docs.where("id % 50 = 0").withColumnRenamed("id", "query_id"), ("1", "2")))


@query(f"""WITH {_TOP}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY trunc(sim * 1e12) DESC, id) AS place FROM s), k AS (SELECT * FROM r WHERE place <= 5) SELECT DISTINCT query_id, p AS parameter FROM (SELECT query_id, 'P' || id % 7 AS p FROM k UNION ALL SELECT query_id, 'P' || id % 5 FROM k) WHERE p <> 'P3'""")
def related_parameters(spark, d):
    docs = _vectors(spark, d)
    meta = F.create_map(F.lit("source"), F.concat(F.lit("P"), (F.col("id") % 7).cast("string")), F.lit("target"), F.concat(F.lit("P"), (F.col("id") % 5).cast("string")))
    found = documents.vector_search(docs, docs.where("id % 50 = 0").withColumnRenamed("id", "query_id"), 5)
    return documents.related_parameters(found, docs.withColumn("metadata", meta), "P3")


@query("SELECT lang AS doc_type, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS characters FROM documents GROUP BY lang")
def document_stats(spark, d):
    return documents.document_stats(v.load(spark, d, "documents").select(F.col("lang").alias("doc_type"), F.col("text").alias("content")))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE source END AS content FROM documents WHERE doc_id % 3 = 0 OR doc_id % 4 = 0")
def upsert_documents(spark, d):
    docs = v.load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("content"))
    return documents.upsert_documents(docs.where("id % 3 = 0"), docs.where("id % 4 = 0").withColumn("content", F.lit("new")))


@query("SELECT doc_id AS id, lang FROM documents WHERE doc_id % 5 <> 0 AND lang <> 'fr'")
def delete_documents(spark, d):
    docs = v.load(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    return documents.delete_documents(docs, docs.where("id % 5 = 0"), F.col("lang") == "fr")


# --- sources and sinks ------------------------------------------------------------------------------


def _folder(spark, label):
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@query(f"WITH {M} SELECT measurement_id, param_id, round(value, 6) AS value FROM m")
def read_topic(spark, d):
    """Measurements out to a topic of JSON messages and in again."""
    path = _folder(spark, "topic")
    topics.to_messages(v.sensors(spark, d).select("measurement_id", "param_id", "value")).write.text(path)
    rows = topics.read_topic(spark, {"files": path}, "measurement_id long, param_id string, value double")
    return rounded(jobs.run_now(rows).drop("batch_id"))


@query(f"WITH {M} SELECT measurement_id, status FROM m")
def write_topic(spark, d):
    source, out = _folder(spark, "topic"), _folder(spark, "topic")
    topics.to_messages(v.sensors(spark, d).select("measurement_id", "status")).write.text(source)
    rows = topics.read_topic(spark, {"files": source}, "measurement_id long, status string")
    topics.write_topic(rows, {"files": out}, _folder(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return topics.split_dead_letters(spark.read.text(out), "measurement_id long, status string")[0]


@query("SELECT event_id % 10 = 0 AS bad, count(*) AS n FROM events GROUP BY 1")
def split_dead_letters(spark, d):
    e = v.load(spark, d, "events")
    text = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("event_id", "value")))
    good, bad = topics.split_dead_letters(e.select(text.alias("value")), "event_id long, value double")
    return good.select(F.lit(False).alias("bad")).unionByName(bad.select(F.lit(True).alias("bad"))).groupBy("bad").agg(F.count("*").alias("n"))


@query(f"WITH {v.P} SELECT time AS timestamp, round(click, 6) AS click, round(view, 6) AS view FROM p")
def read_pv_csv(spark, d):
    path = _folder(spark, "pv")
    v.wide_hours(spark, d).select(F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), *v.PARAMS, F.lit(0).alias("is_anomaly")).write.option("header", True).csv(path)
    return rounded(files.read_pv_csv(spark, path, v.PARAMS).select("timestamp", "click", "view"))


@query(f"WITH {v.A} SELECT CAST(alarm_id AS INTEGER) AS start_idx, date_trunc('second', time) AS start_timestamp FROM a WHERE severity = 'CRITICAL'")
def read_fault_csv(spark, d):
    path = _folder(spark, "faults")
    t = F.date_format("time", "yyyy-MM-dd HH:mm:ss")
    v.alarms(spark, d).where("severity = 'CRITICAL'").select(F.col("alarm_id").alias("start_idx"), F.col("alarm_id").alias("end_idx"), F.lit("spike").alias("fault_type"), F.lit(1).alias("affected_sensor"), F.lit(60).alias("duration"), t.alias("start_timestamp"), t.alias("end_timestamp"), F.lit("x").alias("sensor_name")).write.option("header", True).csv(path)
    return rounded(files.read_fault_csv(spark, path).select("start_idx", "start_timestamp"))


@query("SELECT 'P' || CAST(n_nationkey AS VARCHAR) AS source, 'P' || CAST(n_regionkey AS VARCHAR) AS target, round(n_nationkey / 25, 6) AS confidence FROM nation")
def read_expert_knowledge(spark, d):
    path = _folder(spark, "rules")
    n = v.load(spark, d, "nation")
    p = lambda c: F.concat(F.lit("P"), F.col(c).cast("string"))
    rule = F.struct(p("n_nationkey").alias("source"), p("n_regionkey").alias("target"), (F.col("n_nationkey") / 25).alias("confidence"))
    n.agg(F.collect_list(rule).alias("causal_relationships")).coalesce(1).write.json(path)
    return rounded(files.read_expert_knowledge(spark, path)["causal_relationships"].select("source", "target", "confidence"))


@query(f"WITH {M} SELECT CAST(time AS DATE) AS date, count(*) AS n FROM m GROUP BY 1")
def write_measurements(spark, d):
    path = _folder(spark, "measurements")
    files.write_measurements(v.sensors(spark, d), path, 2)
    return spark.read.parquet(path).groupBy("date").agg(F.count("*").alias("n"))


@query(f"WITH {M} SELECT measurement_id FROM m WHERE time >= TIMESTAMP '2024-01-20'")
def apply_retention(spark, d):
    return files.apply_retention(v.sensors(spark, d), 10, "2024-01-30").select("measurement_id")


@query(f"WITH {M} SELECT measurement_id, CASE WHEN measurement_id % 9 = 0 THEN 'FIXED' ELSE status END AS status FROM m")
def upsert_days(spark, d):
    path = _folder(spark, "measurements")
    m = v.sensors(spark, d).select("measurement_id", "time", "equipment_id", "param_id", "status")
    files.write_measurements(m, path)
    files.upsert_days(spark, path, m.where("measurement_id % 9 = 0").withColumn("status", F.lit("FIXED")), ["measurement_id"], ["status"])
    return spark.read.parquet(path).select("measurement_id", "status")


@query("""SELECT CASE WHEN event_type = 'click' THEN 'fdc_measurements' WHEN event_type = 'view' THEN 'spc_measurements' WHEN event_type = 'error' THEN 'alarms' ELSE 'other' END AS target, count(*) AS n FROM events GROUP BY 1""")
def route_records(spark, d):
    t = F.col("event_type")
    mixed = v.load(spark, d, "events").select("event_id", F.when(t == "click", "fdc.VALUE").when(t == "view", "spc.VALUE").when(t == "error", "fdc.ALARM").otherwise("x").alias("topic"), F.when(t == "click", "FDC").when(t == "view", "SPC").alias("source_system"))
    parts = [df.groupBy().agg(F.count("*").alias("n")).select(F.lit(n).alias("target"), "n").where("n > 0") for n, df in files.route_records(mixed).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT 'P' || CAST(l_partkey % 30 AS VARCHAR) AS source, 'P' || CAST(s_nationkey AS VARCHAR) AS target, round(avg(l_quantity) / 50, 6) AS confidence FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2")
def export_relationships(spark, d):
    path = _folder(spark, "relations")
    files.export_relationships(_found(spark, d), path, "csv")
    return rounded(spark.read.option("header", True).schema("source string, target string, confidence double, relation_type string, method string").csv(path).select("source", "target", "confidence"))


# --- streams ----------------------------------------------------------------------------------------


def _events(spark, d):
    """Events as a stream of files. A pattern stands for one file or a folder of them."""
    return spark.readStream.schema(v.load(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")


def _stream(spark, d):
    """The measurements as a stream."""
    e = _events(spark, d)
    base = e.select(F.col("event_id").alias("measurement_id"), (F.col("user_id") % 10).cast("string").alias("equipment_id"), F.col("event_type").alias("param_id"), F.col("ts").alias("time"), "value", *[F.lit(x).alias(c) for c, x in (("usl", 150.0), ("lsl", 0.0), ("ucl", 200.0), ("lcl", -100.0), ("center", 50.0), ("sigma", 50.0))])
    return jobs.with_event_time(base.withColumn("status", v.fdc_status(F.col("value"), F.col("usl"), F.col("lsl"))))


@query(f"WITH {M} {_STATS.format(w='1 hour', n='1 hour')}")
def tumbling_stats_stream(spark, d):
    out = jobs.run_now(jobs.tumbling_stats_stream(_stream(spark, d), "1 hour"), "update")
    return rounded(jobs.newest(out, ["window_start", "window_size", "equipment_id", "param_id"]))


@query(f"""WITH {M}, x AS (SELECT *, unnest(range(0, 6)) AS k FROM m) SELECT time_bucket(INTERVAL '10 seconds', time) - to_seconds(10 * k) AS window_start, equipment_id, param_id, count(value) AS n, round(avg(value), 6) AS avg_value, round(max(value), 6) AS max_value FROM x GROUP BY 1, 2, 3""")
def sliding_stats_stream(spark, d):
    out = jobs.run_now(jobs.sliding_stats_stream(_stream(spark, d)), "update")
    return rounded(jobs.newest(out, ["window_start", "equipment_id", "param_id"]))


@query(f"""WITH {M} SELECT time_bucket(INTERVAL '1 hour', time) AS window_start, equipment_id, count(value) AS n, round(sum(value), 6) AS total, round(min(value), 6) AS min_value, round(max(value), 6) AS max_value, round(avg(value), 6) AS avg_value, count_if(status = 'ALARM') AS alarm_count FROM m GROUP BY 1, 2""")
def incremental_stats(spark, d):
    out = jobs.run_now(jobs.incremental_stats(_stream(spark, d), ["equipment_id"]), "update")
    return rounded(jobs.newest(out, ["window_start", "equipment_id"]))


@query(f"WITH {M}, {EQ} SELECT measurement_id, eq.name AS equipment_name, eq.type AS equipment_type FROM m LEFT JOIN eq USING (equipment_id)")
def enrich_stream(spark, d):
    s = _stream(spark, d).withColumns({"recipe_id": F.col("equipment_id"), "lot_id": F.col("equipment_id")})
    return jobs.run_now(jobs.enrich_stream(s, v.equipment(spark, d), v.recipes(spark, d), v.lots(spark, d)).select("measurement_id", "equipment_name", "equipment_type")).drop("batch_id")


@query(f"""WITH w AS ({_we_sql(False)}), {M}, x AS (SELECT measurement_id, avg(value) OVER h AS a, stddev_samp(value) OVER h AS s FROM m WINDOW h AS {W} ROWS 24 PRECEDING))
SELECT measurement_id, rules, round(a, 6) AS x_bar, round(s, 6) AS std_dev, round(CASE WHEN s > 0 THEN least(150 - a, a) / (3 * s) END, 6) AS cpk FROM x JOIN w USING (measurement_id)""")
def spc_stream(spark, d):
    return rounded(jobs.run_now(jobs.spc_stream(_stream(spark, d))).drop("batch_id").replace(float("nan"), None))


@query(f"WITH {M}, {v.A} SELECT alert_id, equipment_id, severity, confidence, points FROM ({_THRESHOLD} UNION ALL {_ALARMS} UNION ALL {_DRIFT})")
def cep_stream(spark, d):
    m, a = _stream(spark, d), jobs.with_event_time(v.as_alarms(_events(spark, d)))
    found = [jobs.run_now(x) for x in (jobs.cep_stream(m, 3, 21_600), jobs.cep_alarms_stream(a, 5, 21_600), jobs.cep_drift_stream(m, 172_800, 1.0))]
    return rounded(reduce(DataFrame.unionByName, found).drop("batch_id", "detected_at"))


@query()
def ensemble_stream(spark, d):
    return jobs.run_now(jobs.ensemble_stream(_stream(spark, d))).drop("batch_id")


@query("SELECT user_id, arg_max(value, ts) AS value FROM events GROUP BY user_id")
def upsert_stream(spark, d):
    path = _folder(spark, "upsert")
    s = spark.readStream.schema(v.load(spark, d, "events").schema).parquet(f"{d}/event[s].parquet").select("user_id", F.col("ts").alias("time"), "value")
    jobs.upsert_stream(s, path, ["user_id"], ["time", "value"], "time", _folder(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return upserts.read_upserts(spark, path, s.schema, ["user_id"], ["time", "value"]).select("user_id", "value")
