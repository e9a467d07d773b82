import os
from types import SimpleNamespace

import pytest

from detframe.llm import common


def test_shared_folder_is_named_on_a_cluster(spark):
    fake = lambda master, named: SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": named} if named else {}))
    assert common.shared_dir(fake("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    assert common.shared_dir(fake("local[4]", None)).startswith("file:///tmp/")
    for master in ("yarn", "spark://h:1", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            common.shared_dir(fake(master, None))


def test_workspace_removes_what_it_wrote(spark):
    with common.workspace(spark):
        d = common.materialize(spark.range(5), "gone")
        path = d.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path) and d.count() == 5
    assert not os.path.exists(path)


def test_components_with_a_hot_node(spark):
    edges = spark.range(2000).selectExpr("5000 as a", "id as b").unionByName(spark.range(3000, 3300).selectExpr("id as a", "id + 1 as b")).unionByName(spark.createDataFrame([(7, 7), (None, 1)], "a long, b long"))
    got = {r.node: r.root for r in common.connected_components(edges).collect()}
    assert got == {i: 0 for i in [*range(2000), 5000]} | {i: 3000 for i in range(3000, 3301)}
