"""Writers. Spark's commit protocol writes aside and renames, so a reader sees whole tables only."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_audit(cascade: DataFrame, excluded: DataFrame, path: str) -> None:
    """manifest (JSON lines), excluded (CSV, by id) and the counts."""
    cascade.where("reason is null").drop("reason").write.mode("overwrite").json(f"{path}/manifest")
    excluded.orderBy("sample_id").write.mode("overwrite").option("header", True).csv(f"{path}/excluded")
    cascade.agg(F.count("*").alias("metadata_rows"), F.count_if(F.col("reason").isNull()).alias("included")).write.mode("overwrite").json(f"{path}/report")


def write_views(view_nodes: DataFrame, view_edges: DataFrame, path: str) -> None:
    """Payload tables by view; a second run replaces the views that it holds and no others. A view's samples
    are dealt to 64 tasks."""
    for name, d in (("nodes", view_nodes), ("edges", view_edges)):
        d.repartition("view", F.pmod(F.xxhash64("sample_id"), F.lit(64))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("view").parquet(f"{path}/{name}")


def upserted_index(old: DataFrame, new: DataFrame) -> DataFrame:
    """Index in which the samples of new replace all their old rows."""
    return old.join(new.select("sample_id").distinct(), "sample_id", "left_anti").unionByName(new)


def write_json_lines(d: DataFrame, path: str) -> None:
    """JSON lines with keys in order of their names."""
    d.select(*sorted(d.columns)).write.mode("overwrite").json(path)


def write_run(metrics: dict[str, float], history: DataFrame, predictions: DataFrame, attention: DataFrame, path: str) -> None:
    """What a run leaves: metrics (one JSON object), history and predictions (CSV), attention (JSON lines)."""
    spark = predictions.sparkSession
    spark.createDataFrame([tuple(metrics.values())], list(metrics)).coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    history.orderBy("epoch").write.mode("overwrite").option("header", True).csv(f"{path}/history")
    predictions.select("sample_id", "label", "probability", "prediction").write.mode("overwrite").option("header", True).csv(f"{path}/predictions")
    attention.select("sample_id", "line", "score").write.mode("overwrite").json(f"{path}/attention")


def heat_map_html(rows: list[dict], title: str) -> str:
    """A page of one sample's lines (line, text, score), shaded by score: a thin template over a top-k table."""
    esc = lambda s: str(s).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    top = max([1e-8, *(r["score"] for r in rows)])
    body = "".join(f'<tr style="background:rgba(255,80,0,{r["score"] / top:.3f})"><td>{r["line"]}</td><td><pre>{esc(r["text"])}</pre></td></tr>' for r in rows)
    return f"<!doctype html><title>{esc(title)}</title><table>{body}</table><script type=application/json>{esc(json.dumps({'lines': len(rows)}))}</script>"
