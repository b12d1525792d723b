"""What a stored table leaves on the executors' disks."""

import time

from pyspark.sql import functions as F

from sourceloom.llm.common import FREE_SHUFFLES, discard, stored


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = {files.apply(i).getName() for i in range(files.size())}
    return {name for name in names if name.startswith("shuffle_")}


def test_shuffle_files_go_when_a_table_is_stored(spark):
    before, setting = shuffle_files(spark), spark.conf.get(FREE_SHUFFLES, "false")
    rows = spark.range(10_000).groupBy((F.col("id") % 100).alias("n")).agg(F.max("id").alias("id"))
    kept = stored(rows, "shuffled")
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert kept.count() == 100 and spark.conf.get(FREE_SHUFFLES, "false") == setting
    assert rows.count() == 100  # the frame itself can be run again
    discard(kept)
