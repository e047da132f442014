"""Working tables go with the block that made them, and with no other."""

import threading

import pytest

from surfacegraph.llm import workspace


def there(path):
    system, at = workspace._filesystem(path)
    return system.get_file_info(at).type.name != "NotFound"


def files(df):
    return df.inputFiles()[0]


def test_blocks_keep_to_themselves(spark):
    df = spark.range(5)
    with workspace.transient(spark):
        outer = files(workspace.written(df, "outer"))
        with workspace.transient(spark):
            inner = files(workspace.written(df, "inner"))
            kept = files(workspace.keep(df, "kept"))
        assert there(outer) and there(kept) and not there(inner)
        last = workspace.keep(df, "last")
    assert not there(outer) and not there(kept) and last.count() == 5


def test_a_block_that_raises(spark):
    with pytest.raises(KeyError), workspace.transient(spark):
        path = files(workspace.written(spark.range(3), "t"))
        raise KeyError
    assert not there(path)
    assert workspace.written(spark.range(3), "t").count() == 3


def test_blocks_of_threads(spark):
    """The first block to end leaves the other's tables."""
    made, ended, found = threading.Event(), threading.Event(), []

    def other():
        with workspace.transient(spark):
            table = workspace.written(spark.range(7), "other")
            made.set()
            ended.wait(60)
            found.append(table.count())

    thread = threading.Thread(target=other)
    with workspace.transient(spark):
        workspace.written(spark.range(2), "mine")
        thread.start()
        made.wait(60)
    ended.set()
    thread.join()
    assert found == [7]
