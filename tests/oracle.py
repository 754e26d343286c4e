"""Runs queries and their SQL side by side, and refuses plans with products or row-at-a-time Python. As a command: ``python -m tests.oracle FOLDER [names]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from activity_engine.plans import ORACLES, QUERIES


def _canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def cell(value):
        if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
            return "null"
        if isinstance(value, bool) or type(value).__name__ == "bool_":
            return str(bool(value))
        if hasattr(value, "isoformat"):
            stamp = pd.Timestamp(value)
            return stamp.isoformat()
        if isinstance(value, float) and abs(value) < 1e15 and value == int(value):
            return str(int(value))
        return str(value)

    return sorted(tuple(cell(v) for v in row) for row in frame.astype(object).itertuples(index=False))


def difference(spark: SparkSession, folder: str, name: str) -> str | None:
    """None when both sides agree, else what differs."""
    made = QUERIES[name](spark, folder)
    plan = made._jdf.queryExecution().executedPlan().toString()
    unwanted = [word for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython") if word in plan]
    if unwanted:
        return f"plan holds {unwanted}"
    ours = made.toPandas()
    if name not in ORACLES:
        return None if len(ours) else "no rows"
    base = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        base.execute(f"create view {path.stem} as select * from '{path}'")
    theirs = base.execute(ORACLES[name]).fetchdf()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} / {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    kinds = [
        f"{c}: {ours[c].dtype}/{theirs[c].dtype}" for c in ours.columns
        if len(ours) and ours[c].dtype != theirs[c].dtype and not ours[c].isna().any() and "datetime" not in str(theirs[c].dtype)
    ]
    left, right = _canonical(ours), _canonical(theirs)
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ, e.g. {str(bad[0][0])[:300]} / {str(bad[0][1])[:300]}"
    if kinds:
        return f"types {kinds}"
    return None if len(ours) else "no rows"


def main() -> None:
    from activity_engine.session import build_session

    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = build_session("oracle", "local[8]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem = difference(spark, folder, name)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        mark = "ok" if name in ORACLES else "rows"
        print(f"{problem and 'BAD' or mark:5} {time.time() - start:6.1f}s {name} {problem or ''}", flush=True)
    print(f"{len(names)} queries, {failed} bad", flush=True)


if __name__ == "__main__":
    main()
