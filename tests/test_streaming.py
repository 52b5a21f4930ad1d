from pyspark.sql import functions as F

from seqwatch.operators.sequences import filter_ambiguous, match_serotypes


def test_stateless_operators_take_a_stream(spark, tmp_path):
    """Documents that keep landing can be labelled and filtered as they come."""
    source = tmp_path / "in"
    spark.createDataFrame(
        [(">1 DENV2, complete genome", "ACGT"), (">2 DENV2, complete genome", "ACGN"), (">3 Zika", "ACGT")],
        "body string, sequence string",
    ).write.parquet(str(source))
    landed = spark.readStream.schema("body string, sequence string").parquet(str(source))
    kept = match_serotypes(filter_ambiguous(landed)).select("serotype", F.substr("body", F.lit(2), F.lit(1)).alias("n"))
    query = (
        kept.writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    assert query.awaitTermination(120)
    assert [tuple(row) for row in spark.read.parquet(str(tmp_path / "out")).collect()] == [("DENV2", "1")]
