import random

from pyspark.sql import functions as F

from tessella.operators.ordered import global_rank, tree_digest


def test_global_rank(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(5)) for i in range(500)]
    got = global_rank(spark.createDataFrame(rows, "id int, v int").repartition(7), [F.desc("v"), F.asc("id")]).collect()
    assert {r.id: r["rank"] for r in got} == {i: n + 1 for n, (i, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])))}


def test_tree_digest_depends_on_content_and_not_on_partitions(spark):
    rows = spark.createDataFrame([("a", i, str(i)) for i in range(50)] + [("b", 1, "x")], "g string, k int, p string")
    one = {r.g: r.digest for r in tree_digest(rows, "g", "k", F.col("p"), fan=4).collect()}
    assert one == {r.g: r.digest for r in tree_digest(rows.repartition(9), "g", "k", F.col("p"), fan=4).collect()}
    other = {r.g: r.digest for r in tree_digest(rows.withColumn("p", F.when(F.col("k") == 7, "z").otherwise(F.col("p"))), "g", "k", F.col("p"), fan=4).collect()}
    assert other["a"] != one["a"] and other["b"] == one["b"]
