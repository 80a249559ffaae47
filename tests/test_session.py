"""Session settings and the shared folder."""

from reviewloom.session import SETTINGS, configure, shared_folder

STARTING = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
SPLITS = "spark.sql.files.maxPartitionBytes"


def test_settings_follow_the_input(spark):
    splits = spark.conf.get(SPLITS)
    try:
        configure(spark, 10**9)
        assert spark.conf.get(STARTING) == "200"
        configure(spark, 100 * 10**12)
        assert 90_000 < int(spark.conf.get(STARTING)) < 100_000
        assert all(spark.conf.get(name) == value for name, value in SETTINGS.items())
    finally:
        spark.conf.unset(STARTING)
        spark.conf.set(SPLITS, splits)


def test_shared_folder_stays_the_same(spark):
    assert shared_folder(spark) == shared_folder(spark)
