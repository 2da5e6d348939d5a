"""Where intermediate tables go, and how scans are spread."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from textloom import session


def fake(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: folder if folder else d), sparkContext=SimpleNamespace(master=master, applicationId="fake"))


def test_the_sessions_folder_comes_first():
    assert session.shared_dir(fake("spark://x:1", "hdfs:///shared/")) == "hdfs:///shared"
    assert session.shared_dir(fake("local[2]", "file:///shared")) == "file:///shared"


@pytest.mark.parametrize("master", ["spark://x:1", "yarn", "local-cluster[2,1,1024]"])
def test_no_folder_of_our_own_on_a_cluster(master):
    with pytest.raises(RuntimeError):
        session.shared_dir(fake(master))


def test_written_tables(spark):
    df = spark.range(5).select("id", F.lit(None).cast("string").alias("x"))
    again = session.written(df, "test")
    assert again.dtypes == df.dtypes and sorted(again.collect()) == sorted(df.collect())
    assert "Range" not in again._jdf.queryExecution().toString()


def test_spread(spark):
    one = spark.range(10).coalesce(1)
    assert session.partitions(session.spread(one, 3)) == 3 and session.partitions(session.spread(one.repartition(5), 3)) == 5
    assert session.empty_like(spark, "a int").count() == 0


def test_cancel(spark):
    import threading
    import time

    done = []

    def work():
        with session.tagged(spark, "slow"):
            try:
                spark.range(4, numPartitions=4).select(F.expr("reflect('java.lang.Thread', 'activeCount')"), F.udf(lambda x: time.sleep(60))("id")).collect()
            except Exception:  # noqa: BLE001 - that's what is awaited
                done.append("cancelled")

    thread = threading.Thread(target=work)
    thread.start()
    for _ in range(100):
        session.cancel(spark, "slow")
        thread.join(0.3)
        if not thread.is_alive():
            break
    assert done == ["cancelled"]
    assert spark.range(3).count() == 3


def test_llm_is_optional(monkeypatch):
    import importlib.util

    import __spark_entry__ as entry

    found = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith("textloom.llm") else found(name, *a))
    names = set(entry.queries())
    assert "p4_found" in names and "p6_found" in names and "p8_ids" not in names and set(entry.oracle_sql()) <= names
