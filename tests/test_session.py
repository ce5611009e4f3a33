"""Where shared files go."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from markspan import session


def fake(master, **settings):
    conf = SimpleNamespace(get=lambda k, d=None: settings.get(k, d))
    context = SimpleNamespace(master=master, getConf=lambda: conf, getCheckpointDir=lambda: None, setCheckpointDir=lambda p: None)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_the_clusters_folder_is_used():
    shared = fake("yarn", **{"spark.checkpoint.dir": "hdfs:///shared"})
    assert session.work_dir(shared) == "hdfs:///shared"
    assert session.new_path(shared, "x").startswith("hdfs:///shared/x-")


@pytest.mark.parametrize("master", ["spark://host:7077", "local[8]", "local-cluster[2,1,1024]"])
def test_a_missing_folder_is_an_error(master):
    with pytest.raises(RuntimeError):
        session.work_dir(fake(master))


def test_entry_points_may_choose_one_in_a_single_process():
    chosen = []
    for master in ("local", "local[8]", "local[*]", "local-cluster[2,1,1024]", "yarn"):
        one = fake(master)
        one.sparkContext.setCheckpointDir = lambda p, m=master: chosen.append((m, p))
        session.set_local_folder(one, lambda: "x")
    assert chosen == [("local", "x"), ("local[8]", "x"), ("local[*]", "x")]
    session.set_local_folder(fake("local", **{"spark.checkpoint.dir": "y"}), lambda: chosen.append("no"))
    assert "no" not in chosen


def test_written_rows_are_read_back(spark):
    df = spark.range(5).selectExpr("id", "struct(id AS a, 'x' AS b) AS s", "map('k', id) AS m")
    back = session.written(df, "rows")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
