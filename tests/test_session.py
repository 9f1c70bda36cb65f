"""Where checkpoints go, and which masters are local."""

import os

import pytest

from shoal import session


@pytest.mark.parametrize(("master", "local"), [("local", True), ("local[4]", True), ("local[*]", True), ("local-cluster[2,1,512]", False), ("yarn", False), ("spark://h:7077", False)])
def test_local_masters(master, local):
    assert session.is_local(master) is local


def test_settled_rows_are_written_once(spark):
    df = session.settled(spark.range(10).selectExpr("id", "uuid() AS u"))
    assert df.collect() == df.collect()
    where = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    assert os.listdir(where)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "yarn"

    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        session._checkpoints(Session())
