from pyspark.sql import functions as F

from loomgraph.llm import common


def test_lookup_of_hot_rare_and_missing_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 3)
    rows = spark.createDataFrame([(k, "hot" if k % 2 else f"k{k % 7}") for k in range(60)] + [(100, None), (101, "absent")], "id long, name string").repartition(4)
    sizes = rows.filter("name IS NOT NULL AND name != 'absent'").groupBy(F.col("name").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    got = common.looked_up(rows, sizes, F.col("name"), "n", ["n", "least"], F.concat(F.lit("row "), F.col("id").cast("string"))).collect()
    want = {r["key"]: (r["n"], r["least"]) for r in sizes.collect()}
    assert len(got) == 62
    assert all((r["n"], r["least"]) == want.get(r["name"], (None, None)) for r in got)
