import pytest

from trajkit.sources import scratch


class _Session:
    """A session without spark.checkpoint.dir, on some master."""

    def __init__(self, master):
        self.master, self.conf, self.sparkContext = master, self, self

    def get(self, name, default=None):
        return default

    def getConf(self):
        return self


def test_executors_of_their_own_need_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            scratch.shared_folder(_Session(master))
    for master in ("local", "local[4]", "local[*]"):
        assert scratch.shared_folder(_Session(master)).startswith("file:///")
