import pytest


@pytest.fixture(scope="session", autouse=True)
def intermediate_folder(spark, tmp_path_factory):
    """Where operators write their tables; only a session that names none gets one."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
