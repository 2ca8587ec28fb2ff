"""The choice for given blocks: against its SQL on grids of odd shapes, and the memory of its tasks."""

import random

import duckdb
import pytest

from pyspark.sql import functions as F

from orogen.functions import pixel as px
from orogen.operators import selection as sel
from orogen.plans.oracles import ORACLES
from orogen.plans.queries import QUERIES

CHOICES = ("second_pass_choice", "coarse_precision_sweep", "best_predictor_per_block", "predictor_usage")


def _write(spark, path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{path}/embeddings.parquet")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Rows that are missing, end early or are empty; flat, steep, zero and smooth blocks; runs of zeros."""
    draw, path = random.Random(5), str(tmp_path_factory.mktemp("odd"))
    rows = []
    for y in range(150):
        if y % 11 == 3 or 64 <= y < 75:
            continue
        width = draw.choice([0, 5, 33, 70]) if y % 7 == 0 else 70
        kind = y // 16 % 5
        z = [(0.25, 0.0, y * x / 1000, draw.gauss(0, 1), draw.choice([0.0, 0.0, 0.0, 0.001]))[kind] for x in range(width)]
        rows.append((y, [-v if x > 40 else v for x, v in enumerate(z)]))
    draw.shuffle(rows)
    _write(spark, path, rows)
    return path


def _rows(df, cols):
    return sorted((tuple(r[c] for c in cols) for r in df), key=repr)


@pytest.mark.parametrize("name", CHOICES)
def test_odd_grid_equals_sql(spark, odd, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{odd}/embeddings.parquet/*.parquet'")
    got = con.execute(ORACLES[name])
    cols = [d[0] for d in got.description]
    want = _rows([dict(zip(cols, r)) for r in got.fetchall()], cols)
    assert _rows([r.asDict() for r in QUERIES[name](spark, odd).collect()], cols) == want


def test_superblocks_longer_than_a_batch(spark, odd):
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    want = _rows([r.asDict() for r in QUERIES["second_pass_choice"](spark, odd).collect()], ["sb", "node", "pid", "second", "bits"])
    before = spark.conf.get(most)
    spark.conf.set(most, "300")
    try:
        assert _rows([r.asDict() for r in QUERIES["second_pass_choice"](spark, odd).collect()], ["sb", "node", "pid", "second", "bits"]) == want
    finally:
        spark.conf.set(most, before)


@pytest.mark.parametrize("name", CHOICES)
def test_tasks_hold_little_more_than_their_cells(spark, tmp_path, name):
    """A task's peak of execution memory stays under 80 bytes a cell that it gets, beside two pages of 2 MB (windows over 5 or 35 residuals a cell took many times that)."""
    n = 3000
    _write(spark, str(tmp_path), [(y, [((y * 31 + x * x) % 97) / 1000 for x in range(64)]) for y in range(n)])
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = lambda: {s.stageId(): s.attemptId() for s in jvm.asJava(store.stageList(None, False, False, none, None))}
    old = set(stages())
    try:
        QUERIES[name](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    peak = 0
    for stage, attempt in stages().items():
        if stage not in old:
            peak = max([peak, *(t.taskMetrics().get().peakExecutionMemory() for t in jvm.asJava(store.taskList(stage, attempt, 10000)) if t.taskMetrics().isDefined())])
    assert 0 < peak < 64 * n * 80 + 4 * 2**20


def test_a_cell_missing_between_neighbours_is_an_error(spark):
    df = spark.createDataFrame([(0, 1, 5), (1, 0, 5), (1, 1, 5)], "y long, x long, q long")
    with pytest.raises(Exception, match="none beside both"):
        sel.choose(sel.fixed_blocks(df, 32, 8)).collect()


def test_ties_round_as_in_sql(spark):
    values = [576.92595, 612.08805, 0.00005, -1.00015, 3.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.v for r in df.select(px.rounded(F.col("v"), 4).alias("v")).collect()] == [duckdb.execute("select round(?::double, 4)", [v]).fetchone()[0] for v in values]
