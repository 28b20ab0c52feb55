import numpy as np
from pyspark.sql import functions as F

from figmill.operators.scans import numbered, numbered_in_groups, ordered_parts, running


def test_running_and_numbers(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), ["hot", "a", "b", None][min(3, int(rng.integers(0, 9)) // 2) if rng.random() < 0.6 else 0], float(rng.integers(0, 50)), int(rng.integers(0, 9))) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, g string, s double, v int").repartition(7)
    order = [F.col("s").desc(), F.col("id")]
    want = sorted(rows, key=lambda r: (-r[2], r[0]))
    got = running(ordered_parts(df, order), order, sums={"sum": F.col("v")}, tops={"top": F.col("v")}).orderBy(*order).collect()
    assert [r["sum"] for r in got] == np.cumsum([r[3] for r in want]).tolist()
    assert [r["top"] for r in got] == np.maximum.accumulate([r[3] for r in want][::-1])[::-1].tolist()
    assert [(r.id, r.n) for r in numbered(df, order, "n").orderBy("n").collect()] == [(r[0], i + 1) for i, r in enumerate(want)]
    got = {(r.g, r.id): r.n for r in numbered_in_groups(df, ["g"], order, "n").collect()}
    seen = {}
    for r in want:
        seen[r[1]] = seen.get(r[1], 0) + 1
        assert got[r[1], r[0]] == seen[r[1]]
    assert numbered(df.where("false"), order, "n").count() == 0 and numbered_in_groups(df.where("false"), ["g"], order, "n").count() == 0
