import pytest


@pytest.fixture(autouse=True, scope="session")
def checkpoint_folder(spark, tmp_path_factory):
    """Tests name their own shared folder; a cluster names it in spark.checkpoint.dir."""
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
