"""A page of the replicating stream is one micro-batch."""

import glob

from lektra.operators.settling import shared_folder
from lektra.plans import registry
from tests.conftest import SF
from tests.test_tasks import by_sql


def test_a_page_of_many_files_is_one_batch(spark):
    there = set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/replication-*"))
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 500)
    try:
        got = registry.queries()["c13_replicated_stream"](spark, SF)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert sorted(map(tuple, got.collect())) == by_sql("c13_replicated_stream")
    (folder,) = set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/replication-*")) - there
    assert len(glob.glob(f"{folder}/pages/part-*")) > 4 == len(glob.glob(f"{folder}/state/manifest/batch=*"))
