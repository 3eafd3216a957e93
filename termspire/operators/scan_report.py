"""What a query read: the scans of its executed plan, with their files, bytes, partitions and rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from termspire.plans.staging import local_relation

# Names under which Spark's file scans count; a scan has no partitions if its table has none.
_COUNTS = {"files": "numFiles", "bytes": "filesSize", "partitions": "numPartitions", "rows": "numOutputRows"}


def scan_report(df: DataFrame) -> DataFrame:
    """Runs the frame, without keeping its rows, and returns a row per file scan of its final plan.

    (scan, table, files, bytes, partitions, rows): scans are numbered from 0 in the order of the plan,
    `table` is the last part of the folder that is read, and `rows` are those that leave the scan: rows
    of row groups and pages that statistics and Bloom filters ruled out aren't among them. Files and
    bytes are those of the folders and files that were chosen, before a byte of them was read. A scan
    that several parts of the plan share is listed once, and one whose rows weren't asked for, since
    adaptive execution found a join empty, is left out. The report has as many rows as the plan has
    scans, so it's made on the driver.
    """
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    rows = [_measured(n) for n in _scans(execution.executedPlan())]
    names = {"table": pa.string(), **{name: pa.int64() for name in _COUNTS}}
    columns = {"scan": pa.array(range(len(rows)), pa.int64())}
    columns |= {name: pa.array([r[name] for r in rows], kind) for name, kind in names.items()}
    return local_relation(df.sparkSession, pa.table(columns))


def _scans(node) -> list:
    kind = node.getClass().getSimpleName()
    if kind == "FileSourceScanExec":
        return [node, *(s for sub in _items(node.subqueries()) for s in _scans(sub))]
    if kind.startswith("Reused"):
        return []
    if kind == "AdaptiveSparkPlanExec":
        return _scans(node.executedPlan())
    inner = [node.plan()] if kind.endswith("QueryStageExec") else _items(node.children())
    return [s for child in [*inner, *_items(node.subqueries())] for s in _scans(child)]


def _items(sequence) -> list:
    return [sequence.apply(n) for n in range(sequence.size())]


def _measured(scan) -> dict:
    metrics = scan.metrics()
    found = {name: metrics.get(key) for name, key in _COUNTS.items()}
    values = {name: int(x.get().value()) if x.isDefined() else None for name, x in found.items()}
    roots = _items(scan.relation().location().rootPaths())
    return {"table": roots[0].getName() if roots else None, **values}
