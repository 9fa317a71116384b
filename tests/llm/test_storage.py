"""What stays in the shared folder."""

import threading
from pathlib import Path

import corpus_pipeline
from framelake.llm import common

from ..conftest import DATA


def test_scratch_of_one_thread_leaves_another_thread_s_tables_alone(spark):
    inside, done = threading.Event(), threading.Event()
    kept = []

    def other():
        inside.wait(60)
        kept.append(common.stored(spark.range(4), "other"))
        done.set()

    t = threading.Thread(target=other)
    t.start()
    with common.scratch(spark):
        mine = common.stored(spark.range(2), "mine")
        inside.set()
        assert done.wait(120)
        with common.scratch(spark):
            inner = common.stored(spark.range(2), "inner")
        assert not Path(inner.stored_at).exists() and Path(mine.stored_at).exists()
    t.join()
    assert not Path(mine.stored_at).exists() and kept[0].count() == 4
    common.forget(spark, kept[0].stored_at)


def test_scratch_deletes_after_an_error_too(spark):
    try:
        with common.scratch(spark):
            mine = common.stored(spark.range(2), "mine")
            raise KeyError
    except KeyError:
        assert not Path(mine.stored_at).exists()


def test_pipeline_leaves_its_result_only(spark):
    folder = Path(common.shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    assert corpus_pipeline.run(spark, DATA).count() > 0
    assert [p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before] == ["pipeline-packing"]
