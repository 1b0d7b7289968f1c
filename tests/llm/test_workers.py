import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrylib.llm import common


def holder(name, key):
    def run(batches):
        for _ in batches:
            before = sorted(common._kept)
            common.kept(name)[key] = 1
            yield pd.DataFrame({"before": [",".join(before)]})

    return common.releasing(run, name)


def test_workers_keep_what_their_operator_needs_only(spark):
    one = spark.range(1, numPartitions=1)
    run = lambda name: one.mapInPandas(holder(name, "x"), "before string").first().before
    run("a")
    assert run("a") in ("", "a")  # a worker may be new
    assert run("b") in ("", "b")
    assert run("a") in ("", "a")


def test_small_batches_hold_few_bytes(spark):
    def run(batches):
        for b in batches:
            yield pd.DataFrame({"rows": [len(b)], "bytes": [int(b["text"].str.len().sum())]})

    long = spark.range(0, 1500, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    with common.small_batches(spark):
        got = long.mapInPandas(run, "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 1500 and max(r.bytes for r in got) < 2 * common.BATCH_BYTES
    assert spark.conf.get(name, None) == before
    with pytest.raises(ValueError), common.small_batches(spark):
        raise ValueError
    assert spark.conf.get(name, None) == before
