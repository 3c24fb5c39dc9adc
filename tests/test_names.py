"""Names and markers of sponsor passages as the SQL finds them: ASCII words, lower case sign by sign, shares in decimals."""

from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from spanloom.operators import exclusions
from spanloom.plans import queries as plans

TEXTS = [
    "all of it under the MIT license. then ümit spoke. and mité too. the end. " * 3,
    "write to x@mail1.example now. the mail of ②mail1 and mail1② came. so it went on. " * 3,
    "a LİCENSE under GNU terms. other words. gnů or İgnu follow. deals are made. ",
    "sold under the bookſ license here. ſome bookſ are good. booksſ are not. " * 2,
]


@pytest.mark.parametrize("name", ["q_ad_spans", "q_excluded"])
def test_odd_letters_equal_sql(spark, tmp_path, name):
    pq.write_table(pa.table({"doc_id": pa.array(range(40), pa.int64()), "text": [TEXTS[i % 4] for i in range(40)]}), f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    rows = plans.Q[name](spark, str(tmp_path))
    columns = ", ".join(rows.columns)
    want = Counter(con.execute(f"SELECT {columns} FROM ({plans.SQL[name]})").fetchall())
    assert Counter(tuple(r) for r in rows.collect()) == want and want


def test_a_spread_of_just_the_share_is_kept(spark):
    total, spread = 655_400, 229_390  # 655,400 * 0.35 is 229,389.99999999997 as a double
    texts = [("sponsored by acme", 0, 100), ("acme", spread - 100, spread), ("the end", total - 100, total)]
    rows = spark.createDataFrame([(1, i, t, s, e) for i, (t, s, e) in enumerate(texts)], "media_id long, sent_id long, text string, start_ms long, end_ms long")
    got = exclusions.find_brands(rows, ["sponsored"], templates=[r"by (\w+)"], domain=r"(\w+)\.com").collect()
    assert [tuple(r) for r in got] == [(1, "acme")]
