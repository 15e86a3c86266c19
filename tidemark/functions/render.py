"""Text renderings of small results: at most `limit` rows are brought to the driver, and more is an error."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

LIMIT = 10_000


def _rows(df: DataFrame, limit: int = LIMIT) -> list[dict]:
    rows = [r.asDict(recursive=True) for r in df.limit(limit + 1).collect()]
    if len(rows) > limit:
        raise ValueError(f"over {limit} rows; write them instead")
    return rows


def _id(name: object) -> str:
    return "n_" + "".join(c if c.isalnum() else "_" for c in str(name))


def mermaid(edges: DataFrame) -> str:
    lines = sorted(f'    {_id(r["src"])}["{r["src"]}"] --> {_id(r["dst"])}["{r["dst"]}"]' for r in _rows(edges))
    return "\n".join(["flowchart LR", *lines])


def dot(edges: DataFrame) -> str:
    return "\n".join(["digraph lineage {", *sorted(f'  {json.dumps(str(r["src"]))} -> {json.dumps(str(r["dst"]))};' for r in _rows(edges)), "}"])


def d2(edges: DataFrame) -> str:
    return "\n".join(sorted(f'{json.dumps(str(r["src"]))} -> {json.dumps(str(r["dst"]))}' for r in _rows(edges)))


def cytoscape(edges: DataFrame) -> str:
    rows = _rows(edges)
    nodes = sorted({str(r[c]) for r in rows for c in ("src", "dst")})
    return json.dumps({"elements": {"nodes": [{"data": {"id": n}} for n in nodes], "edges": [{"data": {"source": str(r["src"]), "target": str(r["dst"])}} for r in sorted(rows, key=str)]}}, sort_keys=True)


def markdown(df: DataFrame) -> str:
    rows = _rows(df)
    head = df.columns
    body = sorted("| " + " | ".join("" if r[c] is None else str(r[c]).replace("|", "\\|") for c in head) + " |" for r in rows)
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *body])


def prometheus(df: DataFrame, metric: str, value: str) -> str:
    """One sample a row, other columns as labels."""
    lines = []
    for r in _rows(df):
        labels = ",".join(f'{k}={json.dumps(str(v))}' for k, v in sorted(r.items()) if k != value)
        lines.append(f"{metric}{{{labels}}} {r[value]}")
    return "\n".join([f"# TYPE {metric} gauge", *sorted(lines)])


def open_lineage(edges: DataFrame, job: str) -> list[str]:
    """One run event for each output."""
    by: dict[str, list[str]] = {}
    for r in _rows(edges):
        by.setdefault(str(r["dst"]), []).append(str(r["src"]))
    split = lambda x: dict(zip(("namespace", "name"), ([*x.rsplit("/", 1)] if "/" in x else ["default", x]), strict=True))
    return [json.dumps({"eventType": "COMPLETE", "job": {"namespace": "tidemark", "name": f"{job}.{dst}"}, "inputs": [split(s) for s in sorted(src)], "outputs": [split(dst)]}, sort_keys=True) for dst, src in sorted(by.items())]


def airflow_dag(waves: list[list[str]], name: str) -> str:
    """A DAG file in which each wave waits for the one before."""
    lines = ["from airflow import DAG", "from airflow.operators.empty import EmptyOperator", "", f"with DAG({name!r}, schedule=None) as dag:"]
    for i, wave in enumerate(waves):
        lines.append(f"    wave_{i} = [{', '.join(f'EmptyOperator(task_id={_id(x)!r})' for x in sorted(wave))}]")
    lines += [f"    for task in wave_{i}:\n        task.set_upstream(wave_{i - 1})" for i in range(1, len(waves))]
    return "\n".join(lines)
