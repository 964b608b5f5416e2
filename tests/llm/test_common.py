import subprocess
import sys

from pyspark.sql import functions as F

from relgrid.llm.common import HOT_ROWS, dealt_join, hot_keys

MEASURE = """
import re
import pyarrow as pa
from relgrid.llm.common import lean

def resident():
    return int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024

pins = []

def run(batches):
    for batch in batches:
        blocks = [b"x" * 100_000 for _ in range(2000)]  # 200 MB, each block below glibc's threshold for mappings of their own
        pins.append(bytes(50_000))  # above them, so that the heap can't shrink from its end
        yield batch
        del blocks

batch = pa.RecordBatch.from_pydict({"a": [1]})
start = resident()
for task in (run, lean(run)):
    assert [b.num_rows for b in task(iter([batch]))] == [1]
    print(resident() - start)
"""


def test_lean_tasks_leave_no_freed_memory():
    kept, left = map(int, subprocess.run([sys.executable, "-c", MEASURE], capture_output=True, text=True, check=True).stdout.split())
    assert kept > 150 and left < 50


def test_joins_without_hot_keys_are_plain(spark):
    right = spark.range(3).withColumnRenamed("id", "k").withColumn("r", F.col("k") * 10)
    for rows, dealt in ((HOT_ROWS, False), (HOT_ROWS + 1, True)):
        left = spark.range(rows).select(F.lit(1).cast("long").alias("k"), "id").union(spark.sql("select 7L, 1000L union all select null, 2000L"))
        hot = hot_keys(left.groupBy("k").agg(F.count("*").alias("n")), ["k"])
        assert (hot is not None) == dealt
        for how in ("inner", "left"):
            joined = dealt_join(left, right, ["k"], ["id"], hot, how)
            assert ("Broadcast" in joined._jdf.queryExecution().logical().toString() or "ResolvedHint" in joined._jdf.queryExecution().logical().toString()) == dealt
            assert joined.columns == ["k", "id", "r"] and sorted(map(str, joined.collect())) == sorted(map(str, left.join(right, ["k"], how).collect()))
    assert hot_keys(left.where("false").groupBy("k").agg(F.count("*").alias("n")), ["k"]) is None
