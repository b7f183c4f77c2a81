"""Job 2: every manuscript's checks as its reviewers left them, for the queue that they work through.

    python -m jobs.review_queue --checks PATH --overrides PATH --output PATH --mark PATH [--config FILE]

Checks and overrides are append-only tables with a rising ``seq``. The mark holds the highest of each that the output contains. A run looks at
what lies above it, names the buckets of manuscripts that this touches, computes these from all their rows, and replaces them by dynamic
partition overwrite; then it writes the mark. A run that is repeated, or that failed before the mark was written, replaces the same buckets
with the same rows. Settings map the tables' columns, as SQL expressions, to those that the job works with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main, settings, there
from quillspark.operators import audit

NAME = "review_queue"
COLUMNS = ["manuscript", "check_id", "status", "rank", "is_problem", "reviewed", "human_override", "note", "section", "claim", "ref_key", "open_problems"]


def reviewed(checks: DataFrame, overrides: DataFrame) -> DataFrame:
    """COLUMNS and bucket of each check, after its overrides; open_problems is the number of its manuscript's problems that nobody has reviewed."""
    folded = audit.fold_overrides(overrides).select(F.col("check_id").alias("o_id"), "human_override", F.col("reviewed").alias("o_reviewed"), F.col("note").alias("o_note"))
    rows = checks.join(folded, F.col("check_id") == F.col("o_id"), "left").drop("o_id")
    status = audit.display_status(F.col("human_override"), F.col("status"), F.lit("unchecked"))
    rows = rows.withColumns({"status": status, "reviewed": F.coalesce("o_reviewed", "reviewed", F.lit(False)), "note": F.coalesce("o_note", "note", F.lit(""))})
    rows = rows.withColumns({"rank": audit.rank(F.col("status")).cast("long"), "is_problem": F.coalesce(F.col("status").isin(*audit.PROBLEMS), F.lit(False))})
    open_ = rows.groupBy(F.col("manuscript").alias("m")).agg(F.count_if(F.col("is_problem") & ~F.col("reviewed")).alias("open_problems"))
    return rows.join(open_, F.col("manuscript").eqNullSafe(F.col("m"))).select(*COLUMNS, "bucket")


def run(spark: SparkSession, checks: str, overrides: str, output: str, mark: str, config: dict | None = None) -> dict:
    """Brings the queue up to date; returns what it read and wrote."""
    config = config or settings(NAME)
    table = lambda path, columns: spark.read.parquet(path).selectExpr(*[f"{expression} AS {name}" for name, expression in columns.items()])
    bucket = F.pmod(F.xxhash64(F.col("manuscript").cast("string")), F.lit(config["buckets"])).cast("int")
    all_checks, all_overrides = table(checks, config["checks"]).withColumn("bucket", bucket), table(overrides, config["overrides"])
    held = there(spark, mark)
    since = held.first().asDict() if held is not None else {"checks": None, "overrides": None}
    above = lambda df, least: df if least is None else df.where(F.col("seq") > least)
    new_checks, new_overrides = above(all_checks, since["checks"]), above(all_overrides, since["overrides"])
    # the mark is read before the rows, so rows that arrive meanwhile are above it
    highest = {"checks": new_checks.agg(F.max("seq"), F.count(F.lit(1))).first(), "overrides": new_overrides.agg(F.max("seq"), F.count(F.lit(1))).first()}
    done = {"new_checks": highest["checks"][1], "new_overrides": highest["overrides"][1], "buckets": 0, "rows": 0}
    if done["new_checks"] or done["new_overrides"]:
        of_overrides = all_checks.join(new_overrides.select("check_id").distinct(), "check_id", "left_semi").select("bucket")
        touched = sorted(r.bucket for r in new_checks.select("bucket").unionByName(of_overrides).distinct().collect())  # as many as there are buckets at most
        own = all_checks.where(F.col("bucket").isin(touched))
        theirs = all_overrides.join(own.select("check_id").distinct(), "check_id", "left_semi")
        wrote = Observation()
        out = reviewed(own.drop("seq"), theirs).observe(wrote, F.count(F.lit(1)).alias("n"))
        if touched:
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(output)
            done |= {"buckets": len(touched), "rows": wrote.get["n"]}
        reached = {k: v[0] if v[0] is not None else since[k] for k, v in highest.items()}
        spark.createDataFrame([(reached["checks"], reached["overrides"])], "checks long, overrides long").coalesce(1).write.mode("overwrite").parquet(mark)
    log.info("read %s and %s above %s: %d checks, %d overrides; wrote %d rows of %d buckets to %s", checks, overrides, since, done["new_checks"], done["new_overrides"], done["rows"], done["buckets"], output)
    return done


def queue(spark: SparkSession, output: str) -> DataFrame:
    """The whole queue as it stands, without the column that only lays it out."""
    return spark.read.parquet(output).select(*COLUMNS)


if __name__ == "__main__":
    main(NAME, run, {"checks": "Parquet table of checks", "overrides": "Parquet table of reviewers' overrides", "output": "folder of the queue", "mark": "folder of the high-water mark"})
