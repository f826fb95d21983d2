"""From a stream of landed position reports to segment traversals, in the order of event time.

A vehicle's reports wait in its state until the watermark has passed them, so
reports that come out of order within it are folded in order; later ones are
dropped and counted by Spark (`dropped`).  The fold knows the trip, how far it
has come, and when the current segment was entered.  It gives a row `whole` for
each segment that was left, and one `now` for the current segment: the time
spent in it so far, so that a long wait shows before the segment ends.

A vehicle without reports for `idle_s` of event time gives what it still holds
and its state goes.  Vehicles share keys (`buckets`), a key's reports and states
being two lists.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from headway.operators import stops, travel
from headway.streaming.buckets import bucket, listed, number

WATERMARK = "10 minutes"
IDLE_S = 4 * 3600
FIX = "u bigint, fix_id bigint, route_id string, dist_m double, speed_kmh double"
FIX_FIELDS = [f.split()[0] for f in FIX.split(", ")]
#: A vehicle's reports that a micro-batch brought, one row for all: a row of the state costs much more than a value.
WAITING = ", ".join(["vehicle_id bigint", *(f"{f.split()[0]} array<{f.split()[1]}>" for f in FIX.split(", "))])
#: The report not judged yet, as its successor isn't known; what the judgement needs of the one before it; the trip so far.
STATE = "p_u bigint, p_fix_id bigint, p_route_id string, p_dist_m double, p_speed_kmh double, b_u bigint, b_route_id string, b_dist_m double, b_wild boolean, b_before double, trip bigint, u bigint, fix_id bigint, route_id string, reach double, began double, seg_seq int, enter_u bigint, progress double, stopped int, due_ms bigint"
FIELDS = [f.split()[0] for f in STATE.split(", ")]
OUT = "vehicle_id bigint, route_id string, trip bigint, seg_seq int, kind string, u bigint, fix_id bigint, x double, progress double, stopped int"


def judged(before: dict | None, fix: dict, after: dict | None, fall_m: float, top_ms: float) -> tuple[bool, bool, bool, float | None]:
    """(a trip begins, out of place, wild, distance before) of a fix, as travel.with_trips has it, from its neighbours on the vehicle's line of reports."""
    new = before is not None and before["route_id"] != fix["route_id"]
    s0 = None if before is None or new else before["dist_m"]
    far = lambda a, b: max(b - a, 1_000_000) / 1e6 * top_ms
    wild = s0 is not None and fix["dist_m"] - s0 > far(before["u"], fix["u"])
    follows = after is not None and after["route_id"] == fix["route_id"]
    held = (before["before"] if before["wild"] else s0) if before is not None else None
    fallen = not new and held is not None and fix["dist_m"] < held - fall_m
    rises = follows and after["dist_m"] - fix["dist_m"] > far(fix["u"], after["u"])
    back = fallen and rises and after["dist_m"] >= held - fall_m
    ahead = wild and follows and fix["dist_m"] - after["dist_m"] > far(fix["u"], after["u"])
    return new or (fallen and not back), back or ahead, wild, s0


def packed(fixes: list[tuple]) -> list[tuple]:
    """Rows (vehicle_id, FIX) as rows of WAITING."""
    of = {}
    for n, *fix in fixes:
        of.setdefault(n, []).append(fix)
    return [(n, *map(list, zip(*some))) for n, some in of.items()]


class Traversals(StatefulProcessor):
    """Folds the reports of a bucket's vehicles into traversals."""

    def __init__(self, fall_m: float = travel.FALL_M, top_ms: float = travel.TOP_MS, enter: float = stops.ENTER, exit_: float = stops.EXIT, idle_s: int = IDLE_S):
        self.fall_m, self.top_ms, self.enter, self.exit_, self.idle_s = fall_m, top_ms, enter, exit_, idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("trip", f"vehicle_id bigint, {STATE}")
        self.waiting = handle.getListState("waiting", WAITING)
        self.routes = handle.getMapState("routes", "route_id string", "seqs array<int>, ends array<double>")

    def new(self) -> dict:
        return dict.fromkeys(FIELDS) | {"trip": 0, "stopped": 0}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows))
        for route, of in found.groupby("route_id"):
            self.routes.updateValue((route,), (of["seqs"].iloc[0].tolist(), of["ends"].iloc[0].tolist()))
        fixes = [tuple(None if v is None or v != v else v for v in r) for r in found[["vehicle_id", *FIX_FIELDS]].itertuples(index=False)]
        fixes = [(number(n), int(u), int(i), route, float(d), v if v is None else float(v)) for n, u, i, route, d, v in fixes]
        yield from self.fold(timerValues.getCurrentWatermarkInMs(), fixes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.fold(timerValues.getCurrentWatermarkInMs(), None)

    def fold(self, mark_ms: int, new: list[tuple] | None) -> Iterator[pd.DataFrame]:
        """Fold what the watermark has passed of the bucket's reports and the new ones (None: a timer has expired, and vehicles that are due give what they hold and go)."""
        if new and min(f[1] for f in new) > mark_ms * 1000:
            # Nothing new is ready; what is ready of the others has its timer.
            self.waiting.appendList(packed(new))
            self.handle.registerTimer(min(f[1] for f in new) // 1000 + 1)
            return
        states, waiting = listed(self.state, FIELDS), {}
        held = [(n, *fix) for n, *columns in self.waiting.get() for fix in zip(*columns)] if self.waiting.exists() else []
        for n, *fix in [*held, *(new or [])]:
            waiting.setdefault(n, []).append(dict(zip(FIX_FIELDS, fix)))
        self.shapes, rest, out = {}, [], []
        for n in sorted(states.keys() | waiting.keys()):
            s, fixes = states.get(n) or self.new(), sorted(waiting.get(n, []), key=lambda f: (f["u"], f["fix_id"]))
            ready = [f for f in fixes if f["u"] <= mark_ms * 1000]
            if fixes:
                s["due_ms"] = fixes[-1]["u"] // 1000 + self.idle_s * 1000
            found = self.folded(s, ready)
            idle = new is None and len(ready) == len(fixes) and s["due_ms"] is not None and s["due_ms"] <= mark_ms
            if idle:
                found += self.folded(s, None)
                states.pop(n, None)
            else:
                states[n] = s
                rest += [(n, *(f[k] for k in FIX_FIELDS)) for f in fixes[len(ready) :]]
            out += [{"vehicle_id": n, **row} for row in found]
        if states:
            self.state.put([(n, *(s[f] for f in FIELDS)) for n, s in states.items()])
            self.handle.registerTimer(min(s["due_ms"] for s in states.values()))
        else:
            self.state.clear()
            self.routes.clear()
        if rest:
            self.waiting.put(packed(rest))
            self.handle.registerTimer(min(f[1] for f in rest) // 1000 + 1)
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=[f.split()[0] for f in OUT.split(", ")])

    def folded(self, s: dict, fixes: list[dict] | None) -> list[dict]:
        """The rows that a vehicle's next fixes give; None: no successor comes for the one not judged yet."""
        out = []
        for fix in fixes or []:
            if s["p_u"] is not None:
                out += self.judge(s, fix)
            for k in FIX_FIELDS:
                s[f"p_{k}"] = fix[k]
        if fixes is None and s["p_u"] is not None:
            out += self.judge(s, None)
        elif not fixes:
            return out
        return out + self.now(s)

    def judge(self, s: dict, after: dict | None) -> list[dict]:
        """Fold the report that waited for its successor; the traversals that it ends."""
        fix = {k: s[f"p_{k}"] for k in FIX_FIELDS}
        before = None if s["b_u"] is None else {"u": s["b_u"], "route_id": s["b_route_id"], "dist_m": s["b_dist_m"], "wild": s["b_wild"], "before": s["b_before"]}
        begins, out_of_place, wild, s0 = judged(before, fix, after, self.fall_m, self.top_ms)
        s |= {"b_u": fix["u"], "b_route_id": fix["route_id"], "b_dist_m": fix["dist_m"], "b_wild": wild, "b_before": s0}
        if begins:
            s |= {"trip": s["trip"] + 1, "reach": None, "seg_seq": None, "enter_u": None}
        return [] if out_of_place else self.move(s, fix)

    def move(self, s: dict, fix: dict) -> list[dict]:
        if fix["route_id"] not in self.shapes:
            seqs, ends = map(list, self.routes.getValue((fix["route_id"],)))
            self.shapes[fix["route_id"]] = seqs, ends, [0.0, *ends[:-1]]
        seqs, ends, starts = self.shapes[fix["route_id"]]
        out, d0, d1, v = [], s["reach"], fix["dist_m"], fix["speed_kmh"]
        s["stopped"] = s["stopped"] if v is None else 1 if v <= self.enter else 0 if v >= self.exit_ else s["stopped"]
        if d0 is None:
            k = bisect_right(ends, d1)
            s |= {"began": d1, "enter_u": fix["u"] if k < len(ends) and starts[k] == d1 else None}
        elif d1 <= d0 == s["began"]:
            d1, k = d0, bisect_right(ends, d0)
            s["enter_u"] = fix["u"] if s["enter_u"] is not None else None
        else:
            d1 = max(d0, d1)
            at = lambda d: s["u"] + math.floor((d - d0) / (d1 - d0) * (fix["u"] - s["u"]) + 0.5)
            if d0 < starts[0] <= d1:
                s["enter_u"] = at(starts[0])
            for k in range(bisect_right(ends, d0), bisect_right(ends, d1)):
                t = at(ends[k])
                if s["enter_u"] is not None:
                    out.append({"route_id": fix["route_id"], "trip": s["trip"], "seg_seq": seqs[k], "kind": "whole", "u": t, "fix_id": fix["fix_id"], "x": (t - s["enter_u"]) / 1e6, "progress": None, "stopped": s["stopped"]})
                s["enter_u"] = t
            k = bisect_right(ends, d1)
        inside = k < len(ends) and d1 >= starts[0]
        s |= {"u": fix["u"], "fix_id": fix["fix_id"], "route_id": fix["route_id"], "reach": d1, "seg_seq": seqs[k] if inside else None, "progress": (d1 - starts[k]) / (ends[k] - starts[k]) if inside else None}
        return out

    def now(self, s: dict) -> list[dict]:
        """The current segment's row; x is null where its entry wasn't seen."""
        if s["seg_seq"] is None:
            return []
        x = None if s["enter_u"] is None else (s["u"] - s["enter_u"]) / 1e6
        return [{"route_id": s["route_id"], "trip": s["trip"], "seg_seq": s["seg_seq"], "kind": "now", "u": s["u"], "fix_id": s["fix_id"], "x": x, "progress": s["progress"], "stopped": s["stopped"]}]

    def close(self) -> None:
        pass


def traversals(fixes: DataFrame, segments: DataFrame, agent: Traversals | None = None) -> DataFrame:
    """A stream of landed fixes (sources.read_fixes) to traversals (OUT).  Fixes without a time, distance or vehicle, and those of routes without segments, go."""
    usable = fixes.filter("u is not null and dist_m is not null and not isnan(dist_m) and vehicle_id is not null").withWatermark("ts", WATERMARK)
    shape = travel.bounds(segments).select("route_id", F.transform("bounds", lambda b: b["seg_seq"]).alias("seqs"), F.transform("bounds", lambda b: b["end_m"]).alias("ends"))
    rows = usable.join(shape, "route_id").select("ts", "vehicle_id", *FIX_FIELDS, "seqs", "ends", bucket())
    return rows.groupBy("bucket").transformWithStateInPandas(agent or Traversals(), outputStructType=OUT, outputMode="Update", timeMode="EventTime")


def dropped(query: StreamingQuery) -> int:
    """How many reports came after the watermark and were left out, over the query's progress that Spark still keeps."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
