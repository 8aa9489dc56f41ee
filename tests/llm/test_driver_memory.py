"""What the pipeline's plans cost the driver."""

import os
import subprocess
import sys

import pandas as pd

from polysense.llm import mixing

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

PARSE = """
import time
from pyspark.sql import SparkSession
from polysense.llm import pii

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.driver.memory", "750m").getOrCreate()
heap = spark._jvm.java.lang.management.ManagementFactory.getMemoryMXBean()
parser = spark._jsparkSession.sessionState().sqlParser()


def live():
    for _ in range(2):
        spark._jvm.System.gc()
        time.sleep(0.3)
    return heap.getHeapMemoryUsage().getUsed() / 1e6


leaf = ("luhn", 0.5, ("length", 9.5, 0.1, 0.2), ("octets", 0.5, 0.3, -0.4))
model = pii.PiiModel([("kind", 1.5, leaf, leaf)] * pii.TREES, [0.4] * pii.TREES, 0.6)
parser.parseExpression("1 + a")
before = live()
parser.parseExpression(pii.spans("text", model))
print("kept", live() - before)
"""


def test_expressions_of_personal_data_leave_little_in_the_parser():
    """The SQL parser keeps what it looked ahead to for good: 40 MB of long CASE and CAST forms, which the driver then never gets back."""
    done = subprocess.run([sys.executable, "-c", PARSE], env=os.environ | {"PYTHONPATH": REPO}, capture_output=True, text=True, timeout=300)
    kept = [float(line.split()[1]) for line in done.stdout.splitlines() if line.startswith("kept ")]
    assert kept and kept[0] < 20, (kept, done.stderr[-500:])


def test_few_cells_are_raked_without_shuffles(spark, sf_dir, monkeypatch):
    plans = []

    def noted(df, name, write=mixing.materialize):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(mixing, "materialize", noted)
    rows = mixing.measured(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    few = mixing.raked_cells(rows).toPandas()
    assert len(plans) > 2 and "Exchange hashpartitioning" in plans[0] and not any("Exchange hashpartitioning" in p for p in plans[1:])
    plans.clear()
    many = mixing.raked_cells(rows, local_cells=len(few) - 1).toPandas()  # too many cells for one task
    assert any("Exchange hashpartitioning" in p for p in plans[1:])
    order = list(mixing.DIMENSIONS)
    pd.testing.assert_frame_equal(few.sort_values(order, ignore_index=True), many.sort_values(order, ignore_index=True), rtol=1e-9)
