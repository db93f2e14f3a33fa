"""The shared folder for intermediate tables."""

import pytest

from placetime.session import scratch_path, shared_dir


class Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        assert key == "spark.checkpoint.dir"
        return self.value or default


class Context:
    applicationId = "app-1"

    def __init__(self, master):
        self.master = master


class Session:
    def __init__(self, folder, master):
        self.conf, self.sparkContext = Conf(folder), Context(master)


def test_the_configured_folder_is_used(spark):
    assert shared_dir(Session("s3a://bucket/shared", "yarn")) == "s3a://bucket/shared"
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_a_cluster_must_name_one():
    with pytest.raises(ValueError):
        shared_dir(Session(None, "spark://host:7077"))


def test_a_laptop_gets_one_folder_per_application():
    session = Session(None, "local[2]")
    assert shared_dir(session) == shared_dir(session)
