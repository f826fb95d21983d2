"""Trajectory outliers: a GRU autoencoder's reconstruction error, and rejection above a threshold."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headway.operators.quantiles import exact_quantiles
from headway.sources.fixes import ORDER, table

#: Windows that the autoencoder learns from at most, the least by a hash of the row.
TRAIN_WINDOWS = 4000
#: Fixes on either side of the one that a window of fixes is about.
HALF = 5
#: Scaled values are held within this before they are read by a robust model.
BOUND = 6.0
#: The least scale of a channel, in metres per second.
LEAST_SCALE = 0.5
#: A fix whose score, in squared scales, is at most this is never rejected.
LEAST_SCORE = 100.0


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Cell:
    """A GRU over inputs of `width` values, with its backward pass."""

    def __init__(self, hidden: int, rng: np.random.Generator, width: int = 1):
        s = hidden**-0.5
        self.p = {k: rng.uniform(-s, s, (width if k[0] == "w" else hidden, hidden)) for k in ("wz", "wr", "wn", "uz", "ur", "un")}
        self.p |= {k: np.zeros(hidden) for k in ("bz", "br", "bn")}

    def forward(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        p = self.p
        z = sigmoid(x @ p["wz"] + h @ p["uz"] + p["bz"])
        r = sigmoid(x @ p["wr"] + h @ p["ur"] + p["br"])
        a = h @ p["un"]
        n = np.tanh(x @ p["wn"] + r * a + p["bn"])
        return (1 - z) * n + z * h, (x, h, z, r, a, n)

    def backward(self, d: np.ndarray, kept: tuple, grad: dict) -> np.ndarray:
        """Adds to grad; returns the gradient of the state before."""
        x, h, z, r, a, n = kept
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (h - n) * z * (1 - z)
        dr = dn * a * r * (1 - r)
        da = dn * r
        for k, g in (("z", dz), ("r", dr), ("n", dn)):
            grad["w" + k] += x.T @ g
            grad["b" + k] += g.sum(axis=0)
        grad["uz"] += h.T @ dz
        grad["ur"] += h.T @ dr
        grad["un"] += h.T @ da
        p = self.p
        return d * z + dz @ p["uz"].T + dr @ p["ur"].T + da @ p["un"].T


@dataclass
class Autoencoder:
    """Encoder and decoder cells, output weights, and the scale of the training values by channel; `losses` by epoch.

    Windows are rows x length x channels, or rows x length for one channel.
    """

    encoder: Cell
    decoder: Cell
    out: np.ndarray
    shift: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    losses: list[float]

    def scaled(self, windows: np.ndarray) -> np.ndarray:
        x = windows if windows.ndim == 3 else windows[:, :, None]
        return (x - self.mean) / self.scale

    def run(self, x: np.ndarray) -> tuple[np.ndarray, list, list, list]:
        """Reconstruction of scaled windows, and what the backward pass needs."""
        h, enc, dec, states = np.zeros((len(x), len(self.out))), [], [], []
        for t in range(x.shape[1]):
            h, kept = self.encoder.forward(x[:, t], h)
            enc.append(kept)
        y, before = np.zeros_like(x), np.zeros((len(x), x.shape[2]))
        for t in range(x.shape[1]):
            h, kept = self.decoder.forward(before, h)
            dec.append(kept)
            states.append(h)
            y[:, t] = h @ self.out + self.shift
        return y, enc, dec, states

    def mse(self, windows: np.ndarray) -> np.ndarray:
        x = self.scaled(windows)
        return ((self.run(x)[0] - x) ** 2).mean(axis=(1, 2))

    def errors(self, windows: np.ndarray, at: int) -> np.ndarray:
        """Squared error at one place of each window, summed over the channels; what is read is held within BOUND, what it is compared with isn't."""
        x = self.scaled(windows)
        return ((self.run(np.clip(x, -BOUND, BOUND))[0][:, at] - x[:, at]) ** 2).sum(axis=1)


def spread(x: np.ndarray, robust: bool) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scale of each channel: mean and deviation, or median and quartiles' distance, which outliers don't move."""
    flat = x.reshape(-1, x.shape[2])
    if not flat.size:
        return np.zeros(x.shape[2]), np.ones(x.shape[2])
    if not robust:
        return flat.mean(axis=0), np.where(flat.std(axis=0) > 0, flat.std(axis=0), 1.0)
    low, mid, high = np.quantile(flat, [0.25, 0.5, 0.75], axis=0)
    return mid, np.maximum((high - low) / 1.349, LEAST_SCALE)


def train(x: np.ndarray, hidden: int = 16, epochs: int = 20, seed: int = 1, batch: int = 64, rate: float = 5e-3, robust: bool = False) -> Autoencoder:
    """Minimise the reconstruction error of the windows with Adam; the seed fixes the result.  robust: scale by quartiles and hold values within BOUND."""
    rng = np.random.default_rng(seed)
    x = x if x.ndim == 3 else x[:, :, None]
    width = x.shape[2]
    model = Autoencoder(Cell(hidden, rng, width), Cell(hidden, rng, width), rng.normal(0, hidden**-0.5, (hidden, width)), np.zeros(width), *spread(x, robust), [])
    z = model.scaled(x)
    z = np.clip(z, -BOUND, BOUND) if robust else z
    parts = [(model.encoder.p, k) for k in model.encoder.p] + [(model.decoder.p, k) for k in model.decoder.p]
    first, second, step = {}, {}, 0
    for _ in range(epochs):
        total = 0.0
        for i in range(0, len(z), batch) if len(z) else []:
            order = rng.permutation(len(z)) if i == 0 else order
            rows = z[order[i : i + batch]]
            y, enc, dec, states = model.run(rows)
            total += float(((y - rows) ** 2).sum())
            dy = 2 * (y - rows) / rows.size
            ge, gd = ({k: np.zeros_like(v) for k, v in c.p.items()} for c in (model.encoder, model.decoder))
            gout, d = np.zeros_like(model.out), np.zeros((len(rows), hidden))
            for t in reversed(range(z.shape[1])):
                gout += states[t].T @ dy[:, t]
                d = model.decoder.backward(d + dy[:, t] @ model.out.T, dec[t], gd)
            for t in reversed(range(z.shape[1])):
                d = model.encoder.backward(d, enc[t], ge)
            step += 1
            grads = [ge[k] for k in model.encoder.p] + [gd[k] for k in model.decoder.p]
            for name, holder, key, g in [*((n, h, k, g) for n, ((h, k), g) in enumerate(zip(parts, grads))), ("out", model.__dict__, "out", gout), ("shift", model.__dict__, "shift", dy.sum(axis=(0, 1)))]:
                first[name] = 0.9 * first.get(name, 0) + 0.1 * g
                second[name] = 0.999 * second.get(name, 0) + 0.001 * g * g
                holder[key] = holder[key] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
        model.losses.append(total / max(z.size, 1))
    return model


def fit_autoencoder(windows: DataFrame, hidden: int = 16, epochs: int = 20, seed: int = 1, limit: int = TRAIN_WINDOWS) -> Autoencoder:
    """Learn to reconstruct `xs` from at most `limit` windows, the least by a hash of vehicle and fix; without windows the model stays as drawn."""
    draw = F.xxhash64("vehicle_id", "fix_id")
    rows = windows.select("xs", draw.alias("draw"), "vehicle_id", "fix_id").orderBy("draw", "vehicle_id", "fix_id").limit(limit).select("xs").collect()
    return train(np.array([r["xs"] for r in rows], float) if rows else np.zeros((0, 1)), hidden, epochs, seed)


def reconstruction_mse(windows: DataFrame, model: Autoencoder) -> DataFrame:
    """windows with `mse`, the autoencoder's error in units of the training variance; null where `xs` is."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for xs in batches:
            known, errors = xs[xs.notna()], pd.Series(np.nan, index=xs.index, dtype=float)
            if len(known):
                errors[known.index] = model.mse(np.stack(known.to_list()).astype(float))
            yield errors

    return windows.withColumn("mse", score("xs"))


def threshold(scored: DataFrame, level: float = 0.99, exact: bool = True) -> DataFrame:
    """One row (cut): the quantile of the errors, rounded to 6 places; scored is read twice, so it should be stored; exact=False takes a sketch within one in 10,000 of the rank."""
    if exact:
        return exact_quantiles(scored, (), "mse", [level], stored=True).select(F.round(F.get("q", F.lit(0)), 6).alias("cut"))
    return scored.agg(F.round(F.percentile_approx("mse", F.lit(level), F.lit(10_000)), 6).alias("cut"))


def reject(fixes: DataFrame, scored: DataFrame, cut: DataFrame) -> DataFrame:
    """fixes without those that end a window whose error is above the cut; a fix that ends no full window stays."""
    bad = scored.join(F.broadcast(cut), F.col("mse") > F.col("cut")).select("vehicle_id", "fix_id")
    return fixes.join(bad, ["vehicle_id", "fix_id"], "left_anti")


def above(scored: DataFrame, cut: DataFrame, kept: bool = False) -> DataFrame:
    """The rows of scored whose error is above the cut; kept: those whose isn't, unknown errors among them."""
    return scored.join(F.broadcast(cut), F.col("mse") > F.col("cut"), "left_anti" if kept else "left_semi")


def fix_windows(moved: DataFrame, half: int = HALF, distance: str = "dist_m") -> DataFrame:
    """moved (travel.with_trips) with `steps`, the vectors (speed, displacement), in metres per second, of the fixes up to `half` before and after on the same trip, and `_place`, the fix's own place among them.

    The displacement of a fix is its distance from the fix before on the trip
    over the time between them, at least a second; 0 for the first.  An unknown
    speed counts as the displacement.
    """
    w = Window.partitionBy("vehicle_id", "trip").orderBy(*ORDER)
    past = F.greatest(F.col("u") - F.lag("u").over(w), F.lit(1_000_000)) / 1e6
    rows = moved.withColumn("_moved", F.coalesce((F.col(distance) - F.lag(distance).over(w)) / past, F.lit(0.0)))
    speed = F.when(F.col("speed_kmh").isNull() | F.isnan("speed_kmh"), F.col("_moved")).otherwise(F.col("speed_kmh") / 3.6)
    rows = rows.withColumn("_vector", F.array(speed, "_moved"))
    rows = rows.withColumn("steps", F.collect_list("_vector").over(w.rowsBetween(-half, half)))
    return rows.withColumn("_place", F.least(F.row_number().over(w) - 1, F.lit(half))).drop("_moved", "_vector")


def squared(steps: list, places: list, half: int) -> np.ndarray:
    """Windows of one length, the fix in the middle: short ones are filled up with their first and last vectors."""
    out = np.zeros((len(steps), 2 * half + 1, 2))
    for k, (vectors, place) in enumerate(zip(steps, places)):
        at = np.clip(np.arange(2 * half + 1) - half + int(place), 0, len(vectors) - 1)
        out[k] = np.array([list(v) for v in vectors], float)[at]
    return out


def fit_fixes(windows: DataFrame, half: int = HALF, hidden: int = 16, epochs: int = 20, seed: int = 1, limit: int = TRAIN_WINDOWS) -> Autoencoder:
    """A GRU autoencoder of the vectors in at most `limit` windows of fixes, the least by a hash of vehicle and fix."""
    draw = F.xxhash64("vehicle_id", "fix_id")
    rows = windows.select("steps", "_place", draw.alias("draw"), "vehicle_id", "fix_id").orderBy("draw", "vehicle_id", "fix_id").limit(limit).select("steps", "_place").collect()
    return train(squared([r["steps"] for r in rows], [r["_place"] for r in rows], half), hidden, epochs, seed, robust=True)


def by_reconstruction(windows: DataFrame, half: int = HALF, model: Autoencoder | None = None) -> DataFrame:
    """windows (fix_windows) with `error`, how far a fix's own vector is from what the autoencoder, by default one that learned from them, makes of it."""
    model = model or fit_fixes(windows, half)

    @F.pandas_udf("double")
    def error(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for steps, places in batches:
            yield pd.Series(model.errors(squared(steps.to_list(), places.to_list(), half), half) if len(steps) else [], dtype=float)

    return windows.withColumn("error", error("steps", "_place"))


def by_displacement(windows: DataFrame) -> DataFrame:
    """windows with `error`, the square of the fix's displacement: a rule without a model."""
    own = F.get(F.col("steps"), F.col("_place").cast("int"))
    return windows.withColumn("error", F.round(F.get(own, F.lit(1)) * F.get(own, F.lit(1)), 6))


def reject_fixes(moved: DataFrame, score: Callable[[DataFrame], DataFrame] = by_reconstruction, level: float | None = 0.99, least: float = LEAST_SCORE, half: int = HALF, distance: str = "dist_m") -> DataFrame:
    """moved (with_trips) without the fixes that are out of place: GPS jumps and impossible speeds.

    A fix's score is the error of the step into it and of the step out of it, so
    a fix that jumps away scores for both and its neighbours for one.  It goes if
    its score is above `least` and above the level's quantile of all scores (a
    sketch; none: `least` alone), and above those of the fixes before and after
    it on its trip, of equal ones the first.
    """
    w = Window.partitionBy("vehicle_id", "trip").orderBy(*ORDER)
    columns = moved.columns
    rows = score(fix_windows(moved, half, distance)).select(*columns, "error")
    rows = rows.withColumn("mse", F.col("error") + F.coalesce(F.lead("error").over(w), F.lit(0.0)))
    cut = least
    if level is not None:
        rows = table(rows, "scores")
        cut = max(least, threshold(rows, level, exact=False).first()["cut"] or least)
    before, after = F.coalesce(F.lag("mse").over(w), F.lit(-1.0)), F.coalesce(F.lead("mse").over(w), F.lit(-1.0))
    out = (F.col("mse") > least) & (F.col("mse") >= cut) & (F.col("mse") > before) & (F.col("mse") >= after)
    return rows.withColumn("_out", out).filter("not _out").select(*columns)
