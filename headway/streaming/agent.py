"""The stateful bus agent on Structured Streaming, and the arrival-estimate sink.

Each vehicle's state is its last time and segment, how much of that lies behind,
whether it stands, its smoothed percentile and the two delay accumulators.  A
sample that is not later than the state, and one without a time or percentile,
are counted and not applied.

Samples may come from `traversal`: those of kind `now` tell where a vehicle is
and how long it has been in its segment.  They move it, and what that time
exceeds the zone by is its pending delay, which the segment's own sample settles
when it ends.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from headway.functions.scalars import HI, LO
from headway.operators import delay, quantiles, recovery, stops
from headway.sources import fixes as src
from headway.streaming.buckets import bucket, listed, number

STATE = "u bigint, fix_id bigint, route_id string, seg_seq int, stopped int, ema_pct double, anomaly_ms bigint, micro_ms bigint, progress double, late bigint, skipped bigint, now_u bigint, now_pct double, pending_ms bigint"
OUT = f"vehicle_id bigint, {STATE}"
FIELDS = [f.split()[0] for f in STATE.split(", ")]
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def half_up(x: float, places: int) -> float:
    """Round as SQL does, ties away from zero."""
    return float(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))


class BusAgent(StatefulProcessor):
    """Folds the new samples of a bucket's vehicles (`buckets`), in order of time, into their states, and emits the state of each that has some after each micro-batch."""

    def __init__(self, lo: int = LO, hi: int = HI, alpha: float = delay.ALPHA, enter: float = stops.ENTER, exit_: float = stops.EXIT):
        self.lo, self.hi, self.alpha, self.enter, self.exit_ = lo, hi, alpha, enter, exit_

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("agent", OUT)

    def step(self, s: dict, r) -> dict:
        """The state after one fix with its segment's quantiles q, raw_pct and progress; pandas reads nulls as NaN or None."""
        known = lambda v: v is not None and not math.isnan(v)
        if r.kind == "now" and known(r.u):
            return self.move(s, r, known)
        if not all(map(known, (r.u, r.x, r.raw_pct))):
            return s | {"skipped": s["skipped"] + 1}
        if s["u"] is not None and (r.u, r.fix_id) <= (s["u"], s["fix_id"]):
            return s | {"late": s["late"] + 1}
        x, q = r.x, r.q
        pct = r.raw_pct if s["ema_pct"] is None else half_up(r.raw_pct * self.alpha + s["ema_pct"] * (1 - self.alpha), 12)
        anomaly, micro = s["anomaly_ms"], s["micro_ms"]
        if r.raw_pct > self.hi:
            anomaly += int(half_up((x - q[self.hi]) * 1000, 0))
        elif r.raw_pct < self.lo:
            anomaly += int(half_up((x - q[self.lo]) * 1000, 0))
        else:
            p = half_up(pct, 6)
            i = min(int(p), 99)
            micro += int(half_up((q[i] + (p - i) * (q[i + 1] - q[i]) - q[50]) * 1000, 0))
        v = r.speed_kmh
        stopped = int(r.stopped) if known(r.stopped) else s["stopped"] if not known(v) else 1 if v <= self.enter else 0 if v >= self.exit_ else s["stopped"]
        progress = float(r.progress) if known(r.progress) else None
        return s | {"u": int(r.u), "fix_id": int(r.fix_id), "route_id": r.route_id, "seg_seq": int(r.seg_seq), "stopped": stopped, "ema_pct": pct, "anomaly_ms": anomaly, "micro_ms": micro, "progress": progress, "now_u": None, "now_pct": None, "pending_ms": 0}

    def move(self, s: dict, r, known) -> dict:
        """The state after a sample of the segment that the vehicle is in: r.x is the time since it entered, if that was seen."""
        over = int(half_up((r.x - r.q[self.hi]) * 1000, 0)) if known(r.x) and known(r.raw_pct) and r.raw_pct > self.hi else 0
        return s | {
            "now_u": int(r.u),
            "route_id": r.route_id,
            "seg_seq": int(r.seg_seq),
            "progress": float(r.progress) if known(r.progress) else None,
            "stopped": int(r.stopped) if known(r.stopped) else s["stopped"],
            "now_pct": float(r.raw_pct) if known(r.raw_pct) else None,
            "pending_ms": over,
        }

    def handleInitialState(self, key, initial: pd.DataFrame, timerValues) -> None:
        """Begin from states of the batch twin (columns of STATE; absent ones are as in a new state)."""
        whole = [f.split()[0] for f in STATE.split(", ") if f.split()[1] in ("bigint", "int")]
        rows = []
        for given in initial.to_dict("records"):
            row = {k: int(v) if k in whole else v for k, v in given.items() if k in FIELDS and not (v is None or v != v)}
            rows.append((number(given["vehicle_id"]), *((self.new() | row)[f] for f in FIELDS)))
        self.state.appendList(rows)

    def new(self) -> dict:
        return dict.fromkeys(FIELDS) | {"stopped": 0, "anomaly_ms": 0, "micro_ms": 0, "late": 0, "skipped": 0, "pending_ms": 0}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        states, new = listed(self.state, FIELDS), {}
        for r in pd.concat(list(rows)).sort_values(["u", "kind", "fix_id"], kind="stable").itertuples():
            n = number(r.vehicle_id)
            states[n] = new[n] = self.step(states.get(n) or self.new(), r)
        self.state.put([(n, *(s[f] for f in FIELDS)) for n, s in states.items()])
        yield pd.DataFrame([{"vehicle_id": n, **s} for n, s in new.items()], columns=["vehicle_id", *FIELDS])

    def close(self) -> None:
        pass


SAMPLE = {"progress": "double", "speed_kmh": "double", "stopped": "int", "kind": "string"}


def agent_stream(live: DataFrame, baseline: DataFrame, agent: BusAgent | None = None, initial: DataFrame | None = None) -> DataFrame:
    """A stream of samples (u, vehicle_id, fix_id, route_id, seg_seq, x, and where they are known those of SAMPLE) to the vehicles' states.

    initial: states (vehicle_id and columns of STATE) to begin from, a row for a
    vehicle, as the batch twin gives them; the first micro-batch reads them.
    """
    agent = agent or BusAgent()
    rows = quantiles.raw_pct(live, baseline)
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in SAMPLE.items() if c not in rows.columns}).withColumn("kind", F.coalesce("kind", F.lit("whole")))
    # Of samples of one time, a segment that ended comes before the one entered.
    rows = rows.withColumn("kind", F.when(F.col("kind") == "now", "now").otherwise("a whole"))
    rows = rows.select("vehicle_id", "fix_id", "u", "route_id", "seg_seq", "x", "q", "raw_pct", *SAMPLE, bucket())
    grouped = initial.withColumn("bucket", bucket()).groupBy("bucket") if initial is not None else None
    return rows.groupBy("bucket").transformWithStateInPandas(agent, outputStructType=OUT, outputMode="Update", timeMode="None", initialState=grouped)


def live_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.event_fixes(spark, sf_dir, streaming=True).filter("not history").withColumn("x", F.col("speed_kmh")).drop("history", "time_bucket", "cents")


def write_eta(states: DataFrame, sink: str, baseline: DataFrame, stats: DataFrame, checkpoint: str):
    """Start a query that publishes arrival estimates for every micro-batch's states as Parquet under sink/batch=<id>.

    A repeated batch overwrites its own folder, so a restart publishes each once.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        state = batch.filter("u is not null or now_u is not null").withColumn("total_ms", F.col("anomaly_ms") + F.col("micro_ms") + F.col("pending_ms"))
        plan = recovery.remaining(state, baseline, stats)
        out = recovery.eta(recovery.propagate(recovery.allocate(plan)))
        out.select("vehicle_id", "route_id", "seg_seq", "recovery", "delay_after", "eta_s").write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return states.writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def landing(place: str):
    """A foreachBatch function that writes a micro-batch's rows under place/batch=<id>; a repeated batch overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/batch={batch_id}")

    return write


def run(rows: DataFrame, write, checkpoint: str, wait: bool = True):
    """Start a query that gives every micro-batch to `write` and ends with the input there is."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    query = rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if wait:
        query.awaitTermination()
    return query


def run_to_end(spark: SparkSession, sf_dir: str, baseline: DataFrame, samples: DataFrame | None = None, initial: DataFrame | None = None) -> DataFrame:
    """Run the agent over all live fixes there are (or a stream of samples), from initial states if there are; each vehicle's last state."""
    place = f"{src.scratch(spark)}/agent-{uuid.uuid4().hex}"
    states = agent_stream(samples if samples is not None else live_samples(spark, sf_dir), src.table(baseline, "baseline"), initial=initial)
    run(states, landing(f"{place}/states"), f"{place}/checkpoint")
    found = spark.read.schema(f"{OUT}, batch bigint").parquet(f"{place}/states")
    last = delay.latest(found.filter("u is not null"))
    return last.select("vehicle_id", F.col("u").alias("last_u"), "route_id", "seg_seq", "progress", "stopped", F.round("ema_pct", 6).alias("ema_pct"), "anomaly_ms", "micro_ms")


def publish_eta(spark: SparkSession, sf_dir: str, baseline: DataFrame, stats: DataFrame) -> DataFrame:
    """Run the agent and the sink over all live fixes; what was published."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    place = f"{src.scratch(spark)}/eta-{uuid.uuid4().hex}"
    base, stop = src.table(baseline, "baseline"), src.table(stats, "stats")
    query = write_eta(agent_stream(live_samples(spark, sf_dir), base), f"{place}/eta", base, stop, f"{place}/checkpoint")
    query.awaitTermination()
    return spark.read.parquet(f"{place}/eta").drop("batch")
