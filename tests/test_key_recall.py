import random

import duckdb

import __spark_entry__ as E
from kinweave.operators import evaluate


def test_pairs_of_a_frequent_key_are_counted_not_made(spark):
    rows = spark.range(300_000).selectExpr("int(id % 3 + 1) as src", "string(id) as entity_id", "string(id div 3) as copy", "'w1' as blocker", "'k' as key")
    assert [tuple(r) for r in evaluate.key_recall(rows).collect()] == [("w1", 100_000 * 200_000, 200_000)]


def test_repeated_ids_count_as_in_sql(spark, tmp_path):
    draw = random.Random(2)
    words = ["north", "east", "x1", "shop"]
    rows = [(draw.randint(0, 60), draw.choice([None, "", "North East ", " ".join(draw.choice(words) for _ in range(draw.randint(1, 3)))]), draw.choice(["en", "de"])) for _ in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, E.queries()["blocker_alone_recall"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(E.oracle_sql()["blocker_alone_recall"]).fetchall())
