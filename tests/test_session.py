import pytest

from seqwatch.session import ensure_checkpoint_dir, remove_scratch, scratch_path, shared_folder


def test_the_folder_of_the_session_is_used(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(shared_folder(spark) + "/x-")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    ensure_checkpoint_dir(spark)
    assert shared_folder(spark) in spark.sparkContext.getCheckpointDir()


def test_scratch_is_removed_on_demand(spark, tmp_path):
    remove_scratch(spark)
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    assert remove_scratch(spark) == 1 and remove_scratch(spark) == 0
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


class FakeCluster:
    """A session on a cluster that names no shared folder."""

    class conf:
        get = staticmethod(lambda key, default: default)

    class sparkContext:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(FakeCluster)
