"""Run as a script from another folder: executors must not need the package on their path."""

import sys

sys.path.insert(0, sys.argv[1])

from pyspark.sql import SparkSession  # noqa: E402

from sourceloom.functions.encoder import ModelEncoder  # noqa: E402
from sourceloom.operators import similarity  # noqa: E402
from sourceloom.operators.embed import embed  # noqa: E402

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
model = ModelEncoder("lengths", 2, lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])
base = embed(spark.createDataFrame([(1, "a"), (2, "bbb")], "key long, text string"), "text", model)
asked = base.selectExpr("key AS query_id", "embedding")
for limit in (1 << 20, 4):
    rows = similarity.top_k_batch(base, asked, 1, query_bytes=limit).collect()
    assert sorted((r.query_id, r.key) for r in rows) == [(1, 1), (2, 2)], rows
print("passed")
