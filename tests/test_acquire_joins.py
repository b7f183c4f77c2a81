from pyspark.sql import functions as F
from quillspark.operators import acquire


def test_no_table_goes_through_the_driver(spark):
    """Tables that grow with the references are small when compressed; none may be broadcast for that."""
    n = spark.range(50)
    key = F.concat(F.lit("k "), "id")
    refs = n.select(key.alias("key"), F.lit(None).cast("string").alias("doi"))
    files = n.where("id < 5").select(acquire.pdf_name(F.lit(None).cast("string"), key).alias("name"), F.lit(True).alias("valid"))
    lookups = n.where("id < 40").select(key.alias("key"), F.when(F.col("id") % 2 == 0, "oa").otherwise("closed").alias("status"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("u"), "id")).alias("pdf_url"))
    downloads = n.where("id % 4 = 0").select(F.concat(F.lit("u"), "id").alias("url"), F.lit(True).alias("ok"))
    got = acquire.classify(refs, files, lookups, downloads)
    counts = {r.status: r["count"] for r in got.groupBy("status").count().collect()}
    assert counts == {"already_present": 5, "paywalled": 18, "fetched": 8, "error": 19}
    got.collect()
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
