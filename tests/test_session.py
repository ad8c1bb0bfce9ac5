from __future__ import annotations

from types import SimpleNamespace

import pytest

from chatloom import session


def fake(master, setting=None, current=None):
    made = {}

    def set_dir(path):
        made["dir"] = path

    context = SimpleNamespace(
        master=master, getCheckpointDir=lambda: made.get("dir", current), setCheckpointDir=set_dir
    )
    conf = SimpleNamespace(get=lambda key, default=None: setting if setting else default)
    return SimpleNamespace(sparkContext=context, conf=conf), made


def test_the_clusters_folder_is_used():
    spark, made = fake("yarn", setting="hdfs:///shared")
    assert session.shared_folder(spark) == "hdfs:///shared" and made["dir"] == "hdfs:///shared"
    first, second = (session.fresh_folder(spark, "run") for _ in range(2))
    assert first.startswith("hdfs:///shared/run-") and first != second


def test_a_cluster_without_the_setting_raises():
    with pytest.raises(RuntimeError):
        session.shared_folder(fake("spark://host")[0])


def test_a_local_session_may_use_a_temporary_folder():
    spark, made = fake("local[2]")
    assert session.shared_folder(spark) == made["dir"]
    assert session.shared_folder(spark) == made["dir"]
    assert session.shared_folder(fake("yarn", current="hdfs:///set")[0]) == "hdfs:///set"
