from __future__ import annotations

from tabflow import scratch


def test_release_deletes_what_the_application_wrote(spark):
    path = scratch.materialize(spark.range(3), "probe").inputFiles()[0]
    scratch.release(spark)
    import os

    assert not os.path.exists(path.removeprefix("file://"))
