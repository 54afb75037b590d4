import pytest

from ledgerloom import store


def test_stash_reads_back_and_sweep_removes(spark):
    df = spark.createDataFrame([(1, "a"), (None, None)], "x int, y string")
    held = store.stash(df, "t")
    assert held.schema == df.schema and sorted(map(str, held.collect())) == sorted(map(str, df.collect()))
    assert store.shared_dir(spark).removeprefix("file://") in held.inputFiles()[0]
    store.sweep(spark)
    with pytest.raises(Exception, match="(?i)exist"):
        held.collect()


def test_discard_and_scope_remove_only_their_own(spark):
    df = spark.range(3)
    outer, gone = store.stash(df, "t"), store.stash(df, "t")
    store.discard(gone)
    with store.scope(spark):
        inner = store.stash(df, "t")
        assert inner.count() == 3
    for table in (gone, inner):
        with pytest.raises(Exception, match="(?i)exist"):
            table.collect()
    assert outer.count() == 3


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_dir(Session())
