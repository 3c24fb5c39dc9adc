"""Training rows for the classifiers: labelled documents outside the held-out fifth, a bounded sample of them.

Edge cases: null labels and null identifiers train nothing; an identifier that is labelled twice has the greater label; an identifier
that repeats among documents trains with one of its texts, the one whose digest is smallest, so however many rows there are the
bound holds; identifiers may be text; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5
#: Labelled rows a model is fitted on at most, chosen by a hash of the identifier; a fixed bound, whatever the input's size.
SAMPLE = 10_000


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, target: str, sample: int = SAMPLE) -> DataFrame:
    """Rows (doc_id, text, y): at most `sample`, one an identifier; null labels and the held-out fold are left out."""
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # at most `sample` rows
    named = docs.select("doc_id", "text").join(chosen, "doc_id")
    # a row an identifier, picked before the shuffle, so at most `sample` texts move however often one repeats
    return named.groupBy("doc_id", "y").agg(F.min_by("text", F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text")).select("doc_id", "text", "y")
