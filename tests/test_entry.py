"""The entry without the corpus part, and numbering by ranges."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[1]
LIST = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(n.startswith('op') or n == 'pipeline' for n in e.queries()))"


@pytest.mark.parametrize("left_out", [("llm",), ("llm", "corpus_pipeline.py")])
def test_entry_imports_without_the_corpus_part(tmp_path, left_out):
    from cuelake.plans.queries import QUERIES
    copy = tmp_path / "copy"
    shutil.copytree(ROOT / "cuelake", copy / "cuelake", ignore=shutil.ignore_patterns("__pycache__", *left_out))
    for name in {"__spark_entry__.py", "corpus_pipeline.py"} - set(left_out):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, copy / name)
    done = subprocess.run([sys.executable, "-c", LIST], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == [str(len(QUERIES)), str(len(QUERIES)), "0"], done.stderr


def test_entry_raises_other_missing_modules(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT / "cuelake", copy / "cuelake", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(ROOT / "__spark_entry__.py", copy)
    (copy / "corpus_pipeline.py").write_text("import a_module_nobody_has\n")
    done = subprocess.run([sys.executable, "-c", LIST], cwd=copy, capture_output=True, text=True, timeout=120)
    assert "a_module_nobody_has" in done.stderr and done.returncode


def test_numbering_by_ranges(spark):
    from cuelake.operators.ordered import numbered
    hot = spark.range(9000).select(F.lit(0).alias("track"), (F.col("id") % 1000).alias("ts"), "id")
    sparse = spark.range(1000).select((F.col("id") / 1 + 1).cast("int").alias("track"), (F.col("id") * 10 ** 9).alias("ts"), "id")
    none = spark.range(7).select(F.lit(None).cast("int").alias("track"), F.lit(5).cast("long").alias("ts"), "id")
    rows = hot.union(sparse).union(none)
    found = numbered(rows, ["track"], ["ts", "id"], "n")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 6
    got = {(r.track, r.id): r.n for r in found.collect()}
    by = {}
    for r in sorted(rows.collect(), key=lambda r: (r.ts, r.id)):
        by.setdefault(r.track, []).append(r.id)
    assert got == {(t, i): at + 1 for t, ids in by.items() for at, i in enumerate(ids)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = numbered(hot, ["track"], ["ts", "id"], "n").withColumn("p", F.spark_partition_id())
        assert max(r["count"] for r in parts.groupBy("p").count().collect()) < 9000 / 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert numbered(rows.limit(0), ["track"], ["ts", "id"], "n").collect() == []
