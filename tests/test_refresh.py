from pyspark.sql import functions as F

from tracemill.operators.rollup import rollup_technology
from tracemill.streaming import new_files, read_rollup, refresh_rollup


def rows(df):
    return sorted(tuple(row) for row in df.select(*sorted(df.columns)).collect())


def test_refresh_takes_in_new_files_only(spark, tmp_path):
    root, table, progress = (str(tmp_path / name) for name in ("runs [x]", "table", "progress"))
    facts = spark.range(200).select(
        (F.col("id") % 5).cast("string").alias("Datetime"),
        (F.col("id") % 3).cast("string").alias("PEMMDB_TECHNOLOGY"),
        F.when(F.col("id") % 7 != 0, F.col("id").cast("double")).alias("Value"),
    )

    def refresh():
        stream = new_files(spark, root, facts.schema)
        refresh_rollup(stream, table, progress, ["Datetime"])
        return read_rollup(spark, table, ["Datetime"])

    def expected(*parts):
        whole = None
        for run, part in parts:
            tagged = part.withColumn("__run_key", F.lit(run))
            whole = tagged if whole is None else whole.unionByName(tagged)
        return rows(rollup_technology(whole, time_columns=["Datetime"]))

    first, second = facts.where("Value < 100"), facts.where("Value >= 100 or Value is null")
    first.write.parquet(f"{root}/a b/deep")
    first.write.parquet(f"{root}/.hidden")
    assert rows(refresh()) == expected(("a b", first))
    # Nothing new: nothing changes. Then more files in the same run, and a new run.
    assert rows(refresh()) == expected(("a b", first))
    second.write.parquet(f"{root}/a b/late")
    first.write.parquet(f"{root}/c")
    assert rows(refresh()) == expected(("a b", facts), ("c", first))
