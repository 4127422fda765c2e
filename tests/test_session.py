import pytest

from peergauge import session
from peergauge.session import shared_dir, shuffle_partitions, write_shared

MB, TB = 1024**2, 1024**4


@pytest.mark.parametrize(
    ("size", "cores", "expected"),
    [(1, 8, 8), (200 * MB, 1, 1), (201 * MB, 1, 2), (TB, 100, 5243), (100 * TB, 8000, 524_288)],
)
def test_shuffle_partitions_fit_memory(size, cores, expected):
    assert shuffle_partitions(size, cores) == expected


def test_larger_partitions_are_the_callers_choice():
    assert shuffle_partitions(100 * TB, 8000, 2048 * MB) == 51_200


def test_shared_dir_is_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (named or spark.sparkContext.getCheckpointDir())


class FakeSession:
    """A cluster session that names no shared folder."""

    class conf:
        get = staticmethod(lambda key, default: default)

    class sparkContext:
        master = "yarn"
        getCheckpointDir = staticmethod(lambda: None)


def test_a_cluster_without_a_shared_dir_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(FakeSession)


def test_written_tables_have_their_true_size(spark):
    small = write_shared(spark.range(1000), "test")
    size = int(str(small._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert 0 < size < 20_000
    assert small.count() == 1000
    assert "Range" not in small._jdf.queryExecution().optimizedPlan().toString()


def test_removing_a_path_that_is_gone_does_no_harm(spark):
    session.remove_path(spark, session.new_shared_path(spark, "never-written"))
