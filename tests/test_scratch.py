import os

import pytest

from termloom import scratch


def test_written_tables_are_read_back_and_discarded(spark):
    made = scratch.materialise(spark.range(5), "five")
    assert made.count() == 5 and os.path.isdir(made.scratch_path)
    scratch.discard(made)
    assert not os.path.exists(os.path.dirname(made.scratch_path))


def test_scratch_folder_must_be_shared_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match="share"):
        scratch.scratch_dir(Session())
    Context.master = "local[4]"
    Session.conf = type("Conf", (dict,), {"set": dict.__setitem__})()
    assert os.path.isdir(scratch.scratch_dir(Session()))
