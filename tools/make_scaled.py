"""Write replicated copies of ``orders`` for scale runs (never under testdata).

Usage: python tools/make_scaled.py SRC_SF_DIR OUT_DIR FACTOR [shift|copy|hot]

``shift`` gives every copy new order keys (k + i * (max_k + 1)), so the
catalogue grows FACTOR times with the same mix of dirt; ``copy`` repeats the
rows unchanged, so every title id appears FACTOR times (heavy duplication);
``hot`` is ``shift`` with a third of all rows moved onto order key 1, so one
title id holds a third of the catalogue.
"""

import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main():
    src, out, factor = sys.argv[1], sys.argv[2], int(sys.argv[3])
    mode = sys.argv[4] if len(sys.argv) > 4 else "shift"
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    orders = spark.read.parquet(os.path.join(src, "orders.parquet"))
    step = orders.agg(F.max("o_orderkey")).collect()[0][0] + 1
    grown = orders.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(factor - 1).cast("long"))))
    if mode in ("shift", "hot"):
        grown = grown.withColumn("o_orderkey", F.col("o_orderkey") + F.col("copy") * step)
    if mode == "hot":
        hot = F.xxhash64("o_orderkey") % 3 == 0
        grown = grown.withColumn("o_orderkey", F.when(hot, F.lit(1)).otherwise(F.col("o_orderkey")))
    grown.drop("copy").repartition(8 * max(1, factor // 10)).write.mode("overwrite").parquet(
        os.path.join(out, "orders.parquet"))
    os.symlink(os.path.join(src, "pages.parquet"), os.path.join(out, "pages.parquet"))
    spark.stop()


if __name__ == "__main__":
    main()
