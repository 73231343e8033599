import os

import pytest

from lumen3d.functions import tables


def test_tables_live_in_the_shared_folder_until_released(spark):
    tables.release_tables(spark)
    table = tables.shared_table(spark.range(5).selectExpr("id", "cast(null as string) as s"), "t")
    path = table.inputFiles()[0].removeprefix("file://").removeprefix("file:").rsplit("/", 1)[0]
    assert path.startswith(tables.shared_root(spark).removeprefix("file://")) and table.count() == 5 and os.path.isdir(path)
    assert tables.release_tables(spark) == 1 and not os.path.isdir(path)


def test_empty_tables_keep_their_schema(spark):
    table = tables.shared_table(spark.range(3).where("id > 9"), "empty")
    assert table.count() == 0 and table.columns == ["id"]


def test_the_session_names_the_folder():
    class Context:
        master = "spark://host:7077"

    class Conf:
        @staticmethod
        def get(key, default):
            return {"spark.checkpoint.dir": Session.root}.get(key) or default

    class Session:
        root, conf, sparkContext = "hdfs://x/y/", Conf, Context

    assert tables.shared_root(Session) == "hdfs://x/y"
    Session.root = None
    with pytest.raises(RuntimeError):
        tables.shared_root(Session)


def test_batch_size_comes_back(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with pytest.raises(ZeroDivisionError), tables.small_batches(spark):
        assert spark.conf.get(name) == "1000"
        _ = 1 / 0
    assert spark.conf.get(name) == before
