import pytest

from millrace import session


class Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


class Fake:
    def __init__(self, **conf):
        self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})
        self.sparkContext = type("C", (), {"applicationId": "test-app"})


def test_shared_folder():
    named = Fake(spark_master="spark://h:7077", spark_checkpoint_dir="hdfs://n/x/")
    assert session.shared_dir(named) == "hdfs://n/x"
    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]", "k8s://h"):
        with pytest.raises(session.NoSharedFolder):
            session.shared_dir(Fake(spark_master=master))
    assert session.shared_dir(Fake(spark_master="local[4]")) == session.shared_dir(Fake(spark_master="local"))
