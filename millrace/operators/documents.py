"""Documents and vectors: chunks, sections, search, retrieval."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.graph import upsert_by_key

BREAKS = ("\n\n", "\n", ".", "!", "?", " ")


def chunks(text: str, size: int = 500, overlap: int = 50) -> list[str]:
    """Pieces of at most `size` characters that end after the first kind of break found in their second half, each starting `overlap` characters before the last one's end."""
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            for b in BREAKS:
                k = text.rfind(b, at + size // 2, end)
                if k >= 0:
                    end = k + len(b)
                    break
        if piece := text[at:end].strip():
            out.append(piece)
        if end >= len(text):
            break
        at = max(end - overlap, at + 1)
    return out


def chunk_text(docs: DataFrame, id_col: str, text_col: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """id, chunk, text for each piece; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts = chunks(text.as_py() or "", size, overlap)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(parts), batch.column(0).type), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], [id_col, "chunk", "text"])

    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, chunk int, text string")


def split_sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Sections that begin at "## " lines, with index and title (null before the first header)."""
    parts = docs.select(id_col, F.posexplode(F.split(text_col, r"(?m)(?=^## )")).alias("section", "body")).where(F.trim("body") != "")
    title = F.regexp_extract("body", r"\A## *([^\n]*)", 1)
    return parts.select(id_col, "section", F.nullif(title, F.lit("")).alias("title"), "body")


def _percent(c: str) -> Column:
    return F.concat(F.round(F.col(c) * 100).cast("long").cast("string"), F.lit("%"))


def _documents(df: DataFrame, doc_type: str, ids: list[str], text: Column, named: list[str]) -> DataFrame:
    meta = F.map_concat(F.create_map(F.lit("doc_type"), F.lit(doc_type)), F.create_map(*[x for c in named for x in (F.lit(c), F.col(c).cast("string"))]))
    return df.select(F.concat_ws("|", F.lit(doc_type), *ids).alias("id"), text.alias("content"), meta.alias("metadata"))


def _lines(*parts) -> Column:
    """A text of lines; each part is a list of columns and literal texts, and a line with a null in it goes."""
    return F.concat_ws("\n", *[F.concat(*[F.col(x[1:]).cast("string") if isinstance(x, str) and x.startswith("$") else F.lit(x) if isinstance(x, str) else x for x in p]) for p in parts])


def relationship_documents(rel: DataFrame) -> DataFrame:
    """Discovered relations (source, relation_type, target, confidence, method) as texts with metadata."""
    text = _lines(["Discovered relation: ", "$source", " -> ", "$target"], ["Type: ", "$relation_type"], ["Confidence: ", _percent("confidence")], ["Found by: ", "$method"])
    return _documents(rel, "discovered_relationship", ["source", "relation_type", "target", "method"], text, ["source", "target", "relation_type", "method"])


def knowledge_documents(tables: dict[str, DataFrame]) -> DataFrame:
    """The experts' tables (sources.files.read_expert_knowledge) as texts with metadata; a line whose value is null is left out."""
    move = F.when(F.col("direction") == "positive", "rises").otherwise("falls")
    minutes = F.format_string("%.1f", F.col("lead_time") / 60)
    known = {
        "causal_relationships": ("causal_relationship", ["source", "relation_type", "target"], lambda: _lines(["Cause: ", "$source", " -> ", "$target"], ["Type: ", "$relation_type"], ["When ", "$source", " rises, ", "$target", " ", move], ["Delay in seconds: ", F.array_join(F.transform("lag_range", lambda x: x.cast("string")), " to ")], ["Confidence: ", _percent("confidence")], ["Physics: ", "$physics"]), ["source", "target", "relation_type", "confidence"]),
        "alarm_causes": ("alarm_cause", ["alarm_code", "cause_parameter"], lambda: _lines(["Alarm ", "$alarm_code", ": check ", "$cause_parameter"], ["Condition: ", "$condition"], ["Probability: ", _percent("probability")], ["Priority: ", "$priority"], ["Action: ", "$action"]), ["alarm_code", "cause_parameter", "priority", "probability"]),
        "leading_indicators": ("leading_indicator", ["indicator", "pattern", "target_event"], lambda: _lines(["Leading indicator: ", "$indicator", " -> ", "$target_event"], ["Pattern: ", "$pattern"], ["About ", minutes, " minutes before ", "$target_event"]), ["target_event", "indicator", "lead_time"]),
        "impossible_relationships": ("impossible_relationship", ["param1", "param2"], lambda: _lines(["No causal relation is possible between ", "$param1", " and ", "$param2"], ["Reason: ", "$reason"]), ["param1", "param2"]),
    }
    return reduce(DataFrame.unionByName, [_documents(tables[t], kind, ids, text(), named) for t, (kind, ids, text, named) in known.items() if t in tables])


def discovery_summary(rel: DataFrame, high: float = 0.7) -> DataFrame:
    """One text on a run of discovery: relations, those of high confidence, and for each method how many and how sure."""
    each = rel.groupBy("method").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") > high).alias("sure"), F.max("confidence").alias("most"))
    line = F.concat_ws("", F.lit("- "), "method", F.lit(": "), F.col("n").cast("string"), F.lit(", at most "), _percent("most"))
    all_ = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("sure"), F.lit(0)).alias("sure"), F.array_sort(F.collect_list(line)).alias("lines"))
    text = F.concat_ws("\n", F.concat(F.lit("Discovered relations: "), F.col("total").cast("string")), F.concat(F.lit("Of high confidence: "), F.col("sure").cast("string")), F.array_join("lines", "\n"))
    return _documents(all_, "discovery_summary", [], text, ["total", "sure"])


def vector_search(docs: DataFrame, queries: DataFrame, k: int = 5, where: Column | None = None, block: int = 1024) -> DataFrame:
    """query_id, id, similarity, distance, place: the k most cosine-similar documents of each query. docs: id, embedding; queries: query_id, embedding.

    Queries are dealt into blocks and documents into runs; each pair of them is one matrix product that
    keeps k rows a query, and those meet by query. Vectors of zeros or of another length take no part.
    """
    good = lambda df, i: df.select(F.col(i).alias("i"), F.col("embedding").cast("array<double>").alias("v")).where(F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))
    docs = docs.where(where) if where is not None else docs
    a, q = good(docs, "id"), good(queries, "query_id")
    na, nq = a.count(), q.count()
    va, vq = -(-max(na, 1) // (16 * block)), -(-max(nq, 1) // block)
    left = a.withColumn("vb", F.pmod(F.xxhash64("i"), F.lit(va)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(vq - 1))))
    right = q.withColumn("qb", F.pmod(F.xxhash64("i"), F.lit(vq)).cast("int")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(va - 1))))
    ka, kq = a.schema["i"].dataType.simpleString(), q.schema["i"].dataType.simpleString()

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"query_id": [], "id": [], "similarity": []})
        x = x.sort_values("i")
        m, w = np.stack(x["v"].to_numpy()), np.stack(y["v"].to_numpy())
        m, w = m / np.linalg.norm(m, axis=1)[:, None], w / np.linalg.norm(w, axis=1)[:, None]
        s = w @ m.T
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(y)), top.shape[1])
        return pd.DataFrame({"query_id": y["i"].to_numpy()[rows], "id": x["i"].to_numpy()[top.ravel()], "similarity": s[rows, top.ravel()]})

    keys = ["dim", "vb", "qb"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, f"query_id {kq}, id {ka}, similarity double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("similarity", 12).desc(), "id"))
    return near.withColumn("place", place).where(F.col("place") <= k).withColumn("distance", 1 - F.col("similarity"))


def retrieve_context(found: DataFrame, least: float = 0.3, limit: int = 2000) -> DataFrame:
    """Per query: the contents of results with enough similarity, best first, joined and cut to a length."""
    rows = found.where(F.col("similarity") >= least).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "content"))).alias("r__"))
    return rows.select("query_id", F.size("r__").alias("documents"), F.substring(F.array_join(F.transform("r__", lambda r: r["content"]), "\n---\n"), 1, limit).alias("context"))


def retrieve_for_alarm(docs: DataFrame, queries: DataFrame, types: tuple[str, str], k: int = 3) -> DataFrame:
    """The top k of two document types, each document once (the better place stays)."""
    both = [vector_search(docs, queries, k, F.col("doc_type") == t).withColumn("doc_type", F.lit(t)) for t in types]
    union = both[0].unionByName(both[1])
    best = union.groupBy("query_id", "id").agg(F.max_by(F.struct("similarity", "doc_type"), "similarity").alias("r"))
    return best.select("query_id", "id", "r.similarity", "r.doc_type")


def related_parameters(found: DataFrame, docs: DataFrame, param: str) -> DataFrame:
    """Other parameters named in the found documents' metadata."""
    named = found.join(docs.select("id", "metadata"), "id").select("query_id", F.explode(F.array(F.try_element_at("metadata", F.lit("source")), F.try_element_at("metadata", F.lit("target")))).alias("parameter"))
    return named.where(F.col("parameter").isNotNull() & (F.col("parameter") != param)).distinct()


def document_stats(docs: DataFrame) -> DataFrame:
    return docs.groupBy("doc_type").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("characters"))


def upsert_documents(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert_by_key(existing, incoming, ["id"], [c for c in existing.columns if c != "id"])


def delete_documents(docs: DataFrame, ids: DataFrame | None = None, where: Column | None = None) -> DataFrame:
    """docs without the given ids or without rows for which the condition holds."""
    out = docs.join(ids.select("id").distinct(), "id", "left_anti") if ids is not None else docs
    return out.where(~F.coalesce(where, F.lit(False))) if where is not None else out
