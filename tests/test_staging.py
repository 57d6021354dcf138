from types import SimpleNamespace

import pytest

from shelfwise.functions import staging


def test_refuses_a_cluster_without_a_shared_folder():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None),
                              sparkContext=SimpleNamespace(master="yarn", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_folder(session)


def test_takes_the_folder_of_the_context():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None),
                              sparkContext=SimpleNamespace(master="yarn", getCheckpointDir=lambda: "hdfs://x/check/"))
    assert staging.shared_folder(session) == "hdfs://x/check"


def test_staged_copy_is_complete_and_can_be_removed(spark):
    copy = staging.stage(spark.range(5), "five")
    assert copy.count() == 5
    path = copy.inputFiles()[0].rsplit("/", 1)[0]
    staging.remove(spark, f"{path}/_SUCCESS")
    with pytest.raises(RuntimeError, match="not written to the end"):
        staging.staged(spark, path, copy)
    staging.remove(spark, path)
    assert not staging.exists(spark, path)
