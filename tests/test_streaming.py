"""Several micro-batches, late fixes and restarts of the agent."""

import datetime

from pyspark.sql import functions as F

from headway.operators import delay, quantiles
from headway.streaming import agent

DAY = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
SCHEMA = "vehicle_id long, fix_id long, ts timestamp, u long, route_id string, seg_seq int, x double"


def rows(ids):
    out = []
    for i in ids:
        t = DAY + datetime.timedelta(seconds=30 * i)
        out.append((i % 3, i, t, int(t.timestamp() * 1e6), "r", i % 4, float(i * 37 % 23)))
    return out


def start(spark, place, base):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{place}/out/batch={n}")
    agent.agent_stream(stream, base).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{place}/cp").trigger(availableNow=True).start().awaitTermination()


def test_micro_batches_late_fixes_and_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", agent.PROVIDER)
    place = str(tmp_path)
    base = spark.createDataFrame([("r", s, [float(i) / 5 + s for i in range(101)]) for s in range(4)], "route_id string, seg_seq int, q array<double>")
    for ids in (range(0, 20), range(20, 40)):
        spark.createDataFrame(rows(ids), SCHEMA).coalesce(1).write.mode("append").parquet(f"{place}/in")
    start(spark, place, base)
    late = rows([1, 4])
    spark.createDataFrame(rows(range(40, 60)) + late, SCHEMA).coalesce(1).write.mode("append").parquet(f"{place}/in")
    start(spark, place, base)
    last = delay.latest(spark.read.parquet(f"{place}/out").drop("batch"))
    batch = spark.createDataFrame(rows(range(60)), SCHEMA).withColumn("speed_kmh", F.col("x"))
    want = delay.latest(delay.delays(delay.ema(quantiles.raw_pct(batch, base))).select("vehicle_id", "u", "fix_id", "ema_pct", "anomaly_ms", "micro_ms"))
    cols = ["vehicle_id", "u", F.round("ema_pct", 6).alias("ema_pct"), "anomaly_ms", "micro_ms"]
    assert sorted(map(tuple, last.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert sum(r["late"] for r in last.collect()) == 2


def test_nulls_leave_the_state_and_the_query_alone(spark, tmp_path):
    """Null and NaN speeds and a null time, in the stream and in its batch twin."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", agent.PROVIDER)
    place = str(tmp_path)
    base = spark.createDataFrame([("r", s, [float(i) / 5 + s for i in range(101)]) for s in range(4)], "route_id string, seg_seq int, q array<double>")
    good = rows(range(12))
    holes = [(v, 100 + i, t, u, r, s, None if i % 2 else float("nan")) for i, (v, _, t, u, r, s, _) in enumerate(rows(range(3, 15)))]
    lone = [(9, 200, DAY, 1, "r", 0, None), (0, 300, None, None, "r", 0, 1.0)]
    spark.createDataFrame(good + holes + lone, SCHEMA).coalesce(1).write.parquet(f"{place}/in")
    start(spark, place, base)
    out = {r["vehicle_id"]: r for r in spark.read.parquet(f"{place}/out").collect()}
    batch = delay.delays(delay.ema(quantiles.raw_pct(spark.createDataFrame(good + holes, SCHEMA), base)))
    assert batch.filter("(x is null or isnan(x)) and (raw_pct is not null or channel is not null or anomaly_step <> 0 or micro_step <> 0)").count() == 0
    want = {r["vehicle_id"]: r for r in delay.latest(batch.filter("raw_pct is not null").select("vehicle_id", "u", "fix_id", "ema_pct", "anomaly_ms", "micro_ms")).collect()}
    last = {r["vehicle_id"]: r for r in delay.latest(batch.select("vehicle_id", "u", "fix_id", "ema_pct", "anomaly_ms", "micro_ms")).collect()}
    for v in (0, 1, 2):
        got = (out[v]["u"], round(out[v]["ema_pct"], 6), out[v]["anomaly_ms"], out[v]["micro_ms"])
        assert got == (want[v]["u"], want[v]["ema_pct"], want[v]["anomaly_ms"], want[v]["micro_ms"]) and got[1:] == (last[v]["ema_pct"], last[v]["anomaly_ms"], last[v]["micro_ms"])
    assert sum(r["skipped"] for r in out.values()) >= len(holes) + 1 and out[9]["u"] is None
