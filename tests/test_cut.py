from types import SimpleNamespace

import pytest

from keyflow.plans.cut import shared_folder


def session(master, setting=None):
    context = SimpleNamespace(master=master, found=None)
    context.getCheckpointDir = lambda: context.found
    context.setCheckpointDir = lambda name: setattr(context, "found", name)
    return SimpleNamespace(sparkContext=context, conf={"spark.checkpoint.dir": setting} if setting else {})


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1024]"])
def test_a_cluster_has_no_local_folders(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session(master))
    assert shared_folder(session(master, "hdfs://host/shared/")).startswith("hdfs://host/shared/")


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]"])
def test_one_process_makes_its_own(master):
    assert shared_folder(session(master)).startswith("file://")
