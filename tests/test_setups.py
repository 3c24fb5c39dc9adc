"""What a sentence refers back to is told from tokens that are found once."""

from pyspark.sql import functions as F

from spanloom.operators import transcript
from spanloom.plans.queries import LISTS


def test_tokens_are_found_once(spark):
    df = spark.createDataFrame([("This second idea works",), ("they said so",), ("Plain text",), (None,)], "x string").select(transcript.dangling(F.col("x"), LISTS).alias("r"))
    assert df._jdf.queryExecution().analyzed().toString().lower().count("regexp_extract_all") == 1
    assert [r["r"] and r["r"]["kind"] for r in df.collect()][2:] == [None, None]
