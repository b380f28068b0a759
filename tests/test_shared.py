import os

import pytest

from gridloom.operators import shared


def test_folders_are_released(spark):
    table = shared.written(spark.range(5))
    assert table.count() == 5
    base = spark.conf.get("spark.checkpoint.dir")
    held = [d for d in os.listdir(base) if d.startswith("gridloom-")]
    assert held
    kept = dict(shared._folders)  # what other tests still read stays
    shared._folders[spark.sparkContext.applicationId] = kept[spark.sparkContext.applicationId][-1:]
    assert shared.release(spark) == 1 and len([d for d in os.listdir(base) if d.startswith("gridloom-")]) == len(held) - 1
    shared._folders[spark.sparkContext.applicationId] = kept[spark.sparkContext.applicationId][:-1]


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return {"spark.master": "local-cluster[2,1,512]"}.get(key, default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.folder(Session())
