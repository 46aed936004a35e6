"""The shared folder, the settings that are left alone, and what is cleared up."""

from types import SimpleNamespace

import pytest

from ndgrid import runtime


def _session(setting=None, checkpoint=None, local=True):
    """A session as far as the shared folder looks at it."""
    conf = {"spark.checkpoint.dir": setting}
    context = SimpleNamespace(getCheckpointDir=lambda: checkpoint, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(isLocal=lambda: local)))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k) or d, set=conf.__setitem__), sparkContext=context)


def test_the_shared_folder_is_the_one_that_is_named():
    assert runtime.shared_folder(_session("hdfs://x/a", "hdfs://x/b", local=False)) == "hdfs://x/a"
    assert runtime.shared_folder(_session(None, "hdfs://x/b", local=False)) == "hdfs://x/b"


def test_a_cluster_without_one_raises():
    with pytest.raises(RuntimeError):
        runtime.shared_folder(_session(local=False))


def test_one_process_gets_a_folder_and_keeps_it():
    session = _session()
    assert runtime.shared_folder(session).startswith("file://") and runtime.shared_folder(session) == runtime.shared_folder(session)


def test_tables_are_written_read_back_and_cleared(spark):
    from pathlib import Path

    frame = runtime.cut(spark.range(5), "numbers")
    path = frame.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert frame.count() == 5 and Path(path).exists() and frame._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    other = runtime.shared_path(spark, "other")
    spark.range(1).write.parquet(other)
    runtime.remove(spark, other)
    assert not Path(other.removeprefix("file://")).exists()


def test_jobs_are_described_inside_alone(spark):
    context = spark.sparkContext
    with runtime.described(spark, "reading"):
        assert context.getLocalProperty("spark.job.description") == "reading"
        with runtime.described(spark, "more"):
            pass
        assert context.getLocalProperty("spark.job.description") == "reading"
    assert context.getLocalProperty("spark.job.description") is None
