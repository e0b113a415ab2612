"""Writers. Tables stay distributed; only reports, which have a row per run or week, are rendered on the driver."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_run(run: DataFrame, path: str, compress: bool = False) -> None:
    """Run lines with scores of 6 decimals, in the order of query and rank."""
    line = F.format_string("%s Q0 %s %d %.6f %s", "query_id", "doc_id", F.col("rank").cast("int"), "score", "run_name")
    run.orderBy("run_name", "query_id", "rank").select(line.alias("value")).write.mode("overwrite").text(path, compression="gzip" if compress else "none")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_index(tables: dict[str, DataFrame], root: str) -> None:
    """postings partitioned ranges sort by term, so that a search reads the row groups of its terms only."""
    for name, df in tables.items():
        df = df.repartitionByRange("term").sortWithinPartitions("term") if "term" in df.columns else df
        df.write.mode("overwrite").parquet(f"{root}/{name}.parquet")


def read_index(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{root}/{n}.parquet") for n in names}


def status_row(spark: SparkSession, name: str, metrics: list[str], reason: str = "qrels_unavailable") -> DataFrame:
    """What is written in place of metrics where nothing can be evaluated."""
    cols = ", ".join(f"{m} double" for m in metrics)
    return spark.createDataFrame([(name, "skipped", reason, *[None] * len(metrics))], f"run_name string, status string, reason string, {cols}")


def write_report(df: DataFrame, path: str, title: str, limit: int = 10_000) -> None:
    """JSON, Markdown or HTML by suffix. A report larger than `limit` rows is an error, not cut off."""
    rows = [r.asDict() for r in df.limit(limit + 1).collect()]
    if len(rows) > limit:
        raise ValueError(f"a report has at most {limit} rows")
    cols, text = df.columns, lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    kind = Path(path).suffix
    if kind == ".json":
        body = json.dumps(rows, indent=2, default=str)
    elif kind == ".md":
        body = "\n".join([f"# {title}", "", "| " + " | ".join(cols) + " |", "|" + "---|" * len(cols), *("| " + " | ".join(text(r[c]) for c in cols) + " |" for r in rows)]) + "\n"
    elif kind == ".html":
        import html

        cell = lambda tag, v: f"<{tag}>{html.escape(text(v))}</{tag}>"
        body = f"<h1>{html.escape(title)}</h1><table><tr>{''.join(cell('th', c) for c in cols)}</tr>" + "".join(f"<tr>{''.join(cell('td', r[c]) for c in cols)}</tr>" for r in rows) + "</table>"
    else:
        raise ValueError(f"unknown report format: {path}")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(body)
