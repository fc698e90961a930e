"""Streams over the given tables read them as one file and as a folder of part files alike."""

import pytest
from compare import connect, rows_of
from pyspark.sql import functions as F

from vigilbus.queries import load_all

QUERIES = load_all()


@pytest.fixture(scope="module")
def parted(spark, tmp_path_factory):
    """Small tables of the test schemas, each a folder of three part files."""
    folder = str(tmp_path_factory.mktemp("parted"))
    i = F.col("id")
    kinds = F.array(*[F.lit(k) for k in ("click", "purchase", "view", "error", "signup")])
    events = spark.range(120).select(
        i.alias("event_id"), F.timestamp_micros(i * 7_000_000 + 1_700_000_000_000_000).cast(
            "timestamp_ntz").alias("ts"), (i % 7).alias("user_id"),
        F.get(kinds, (i % 5).cast("int")).alias("event_type"), (i * 0.5).alias("value"),
        F.concat(F.lit('{"k": '), i % 100, F.lit("}")).alias("props"))
    vectors = spark.range(90).select(
        i.alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda x: (
            F.sin(x + i)).cast("float")).alias("embedding"), (i % 4).cast("int").alias("label"))
    for name, table in (("events", events), ("embeddings", vectors)):
        table.repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", [
    "j08_stream_round_average", "j09_stream_send_decisions", "a12_stream_vehicle_log"])
def test_folder_of_part_files(spark, parted, name):
    q = QUERIES[name]
    con = connect("/nowhere")
    for table in ("events", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{parted}/{table}.parquet/*.parquet')")
    df = q.run(spark, parted)
    cur = con.execute(q.sql)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got[1] and got == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_vehicle_log_folders_are_bounded(spark, tmp_path):
    i = F.col("id")
    spark.range(600).select(
        i.alias("event_id"), F.timestamp_micros(i + 1_700_000_000_000_000).cast("timestamp_ntz").alias("ts"),
        (i % 300).alias("user_id"), F.lit("click").alias("event_type"), (i * 0.5).alias("value"),
        F.lit('{"k": 3}').alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    log = QUERIES["a12_stream_vehicle_log"].run(spark, str(tmp_path))
    folders = {f.rsplit("/", 2)[1] for f in log.inputFiles()}
    assert log.count() == 600 and log.select("vehicle_id").distinct().count() == 300
    assert len(folders) <= 64
