"""Streams over several micro-batches, ended and begun again on the same folder, and what expires without a further event."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakwork.sources import tables
from cloakwork.streaming import files, limits


def write(spark, folder, n, rows, schema="user_id long, event_id long, t long, ttl_ms long"):
    """One more file of a table that streams; its name orders it."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/events.parquet/part={n}")


def stream(spark, folder):
    schema = "user_id long, event_id long, t long, ttl_ms long"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("basePath", f"{folder}/events.parquet").parquet(f"{folder}/events.parquet/part=*")
    return rows.select("user_id", "event_id", "t", "ttl_ms", F.timestamp_millis("t").alias("ts")).withWatermark("ts", "0 seconds")


def test_sessions_expire_by_timer_and_go_on_after_a_restart(spark, tmp_path):
    write(spark, tmp_path, 1, [(1, 1, 1000, None), (1, 2, 1500, None), (2, 3, 1200, None)])
    ended = limits.ended_sessions(stream(spark, tmp_path).drop("ttl_ms"), 1000)
    got = files.drain(ended, f"{tmp_path}/out")
    assert got.count() == 0  # nothing is over at 1,500
    write(spark, tmp_path, 2, [(3, 4, 2100, None)])
    assert sorted(map(tuple, files.drain(ended, f"{tmp_path}/out").collect())) == [(1, 1, 1000, 2000, 2)]  # by the watermark alone
    write(spark, tmp_path, 3, [(1, 5, 2500, None), (2, 6, 2600, None)])
    assert sorted(map(tuple, files.drain(ended, f"{tmp_path}/out").collect())) == [(1, 1, 1000, 2000, 2), (2, 1, 1200, 2200, 1)]
    write(spark, tmp_path, 4, [(9, 7, 9000, None)])
    want = [(1, 1, 1000, 2000, 2), (1, 2, 2500, 3500, 1), (2, 1, 1200, 2200, 1), (2, 2, 2600, 3600, 1), (3, 1, 2100, 3100, 1)]
    assert sorted(map(tuple, files.drain(ended, f"{tmp_path}/out").collect())) == want


def test_leases_are_used_once_replaced_and_expire(spark, tmp_path):
    write(spark, tmp_path, 1, [(1, 1, 100, 50), (1, 2, 120, None), (1, 3, 130, None), (2, 4, 100, 500), (2, 5, 110, 500), (3, 6, 105, None)])
    outcomes = limits.lease_outcomes(stream(spark, tmp_path))
    first = sorted(map(tuple, files.drain(outcomes, f"{tmp_path}/out").collect()))
    assert first == [(1, 2, 120, "used"), (1, 3, 130, "used before"), (2, 4, 110, "replaced"), (3, 6, 105, "no lease")]
    write(spark, tmp_path, 2, [(1, 7, 160, None), (9, 8, 1000, None)])
    more = set(map(tuple, files.drain(outcomes, f"{tmp_path}/out").collect())) - set(first)
    assert more == {(1, 1, 150, "expired"), (1, 7, 160, "no lease"), (9, 8, 1000, "no lease"), (2, 5, 610, "expired")}


def test_a_ring_over_batches_holds_the_last_rows(spark, tmp_path):
    rows = [(u, e, (e * 37) % 500, None) for u in (1, 2) for e in range(u * 1000, u * 1000 + 130)]
    for n in range(4):
        write(spark, tmp_path, n, rows[n::4])
    got = files.drain(limits.last_rows(stream(spark, tmp_path).drop("ts", "ttl_ms"), 100), f"{tmp_path}/out")
    assert got.select("seen").distinct().count() > 2  # several micro-batches
    last = got.join(got.groupBy("user_id").agg(F.max("seen").alias("seen")), ["user_id", "seen"], "left_semi")
    for u in (1, 2):
        want = sorted((t, e) for v, e, t, _ in rows if v == u)[-100:]
        assert sorted((r.t, r.event_id) for r in last.filter(F.col("user_id") == u).collect()) == want


def test_settings_and_folders_are_as_before(spark, tmp_path):
    write(spark, tmp_path, 1, [(1, 1, 1000, None)])
    key = "spark.sql.streaming.stateStore.providerClass"
    before, folders = spark.conf.get(key, None), []
    shared = tables.shared_folder
    files.shared_folder = lambda s: folders.append(shared(s)) or folders[-1]
    try:
        rows = files.drained(limits.last_rows(stream(spark, tmp_path).drop("ts", "ttl_ms"), 3))
    finally:
        files.shared_folder = shared
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folders[0])
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    assert [tuple(r) for r in rows.collect()] == [(1, 1, 1000, 1)] and spark.conf.get(key, None) == before

