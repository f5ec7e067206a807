from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from weftline.session import get_spark

    s = get_spark("tests", "local[8]", spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def cell(x):
    if x is None or x != x:
        return "NULL"
    if isinstance(x, float):
        return f"{x:.9g}"
    return str(x)


def same(df, rel) -> tuple[list, list]:
    """Sorted rows of both sides with columns in the order of their names."""
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    got = sorted(tuple(cell(r[c]) for c in names) for r in df.collect())
    want = sorted(tuple(map(cell, r)) for r in rel.select(*[f'"{c}"' for c in names]).fetchall())
    return got, want


def shuffled(df):
    """Runs df; (rows, bytes) that its shuffles write."""
    df.collect()
    rows = size = 0
    left = [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            left.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            left.append(node.plan())
        else:
            left += [node.children().apply(i) for i in range(node.children().size())]
            if name == "Exchange":
                rows += node.metrics().get("shuffleRecordsWritten").get().value()
                size += node.metrics().get("shuffleBytesWritten").get().value()
    return rows, size
