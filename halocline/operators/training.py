"""Fitting the networks, data-parallel: tasks add up gradients, the driver takes the step.

What reaches the driver per step is at most `FAN_IN` gradient vectors per model. Several models
(seeds, fluxes) are fitted in the same passes over the data.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from halocline.functions.hashing import hash_uniform
from halocline.operators.metrics import fit_scales
from halocline.operators.network import OUTPUTS, FluxModel, forward, new_model, sigmoid
from halocline.operators.sampling import split_random

FAN_IN = 64
VAR_FLOOR = 1e-6
SCORES = ["mse", "r2", "nll", "res_mean", "res_var"]


@dataclass
class FitParams:
    """Training settings; the schedule cuts the rate at 1/2, 3/4 and 7/8 of the epochs, or on a plateau."""

    epochs: int = 20
    batches: int = 4                # steps per epoch; a step uses about 1/batches of the rows
    reshuffle: bool = True          # batches are drawn anew for every epoch
    lr: float = 5e-3
    gamma: float = 0.2
    weight_decay: float = 0.0
    early_stopping: bool = False
    patience: int = 5
    factor: float = 0.1
    max_stale: int = 10
    dropout: float = 0.0
    loss: str = "nll"               # nll, mse (mean only), var_mse (variance head against squared residuals)
    fix_mean: bool = False
    seed: int = 0


class KeyedDraws:
    """Uniform draws that belong to rows: the same for a row's hash, step and place whatever rows stand around it."""

    def __init__(self, hashes: np.ndarray, seed: int, tick: int):
        self.hashes, self.salt, self.calls = hashes.astype(np.int64).view(np.uint64), (seed * 1_000_003 + tick) % 2**32, 0

    def random(self, shape: tuple[int, int]) -> np.ndarray:
        self.calls += 1
        z = self.hashes[:, None] + np.uint64(0x9E3779B97F4A7C15) * (np.arange(1, shape[1] + 1, dtype=np.uint64) + np.uint64((self.salt * 4096 + self.calls) * 65536 % 2**64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53


def _activations(layers, x, dropout, rng):
    """Inputs of every layer, and the last linear output."""
    hs, masks = [x], []
    for w, b in layers[:-1]:
        h = sigmoid(hs[-1] @ w.T + b)
        keep = (rng.random(h.shape) >= dropout) / (1 - dropout) if dropout > 0 else None
        masks.append(keep)
        hs.append(h if keep is None else h * keep)
    w, b = layers[-1]
    return hs, masks, hs[-1] @ w.T + b


def _gradient(layers, hs, masks, delta):
    """Gradients of all layers from the derivative at the last linear output."""
    grads = []
    for n in range(len(layers) - 1, -1, -1):
        grads.append((delta.T @ hs[n], delta.sum(axis=0)))
        if n:
            back = delta @ layers[n][0]
            h = hs[n]
            if masks[n - 1] is not None:
                back = back * masks[n - 1]
                h = np.divide(h, masks[n - 1], out=np.zeros_like(h), where=masks[n - 1] > 0)
            delta = back * h * (1 - h)
    return grads[::-1]


def flat(layers) -> np.ndarray:
    return np.concatenate([a.ravel() for w, b in layers for a in (w, b)])


def unflat(vector: np.ndarray, like) -> list:
    out, at = [], 0
    for w, b in like:
        out.append((vector[at:at + w.size].reshape(w.shape), vector[at + w.size:at + w.size + b.size]))
        at += w.size + b.size
    return out


def _output(name: str, z: np.ndarray, norm: np.ndarray | None, degree: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Value of a head from its last linear output, and the derivative; a homogeneous head scales with the norm of its inputs."""
    if degree is None:
        fn, slope = OUTPUTS[name]
        y = fn(z)
        return y, slope(z, y)
    scale = norm**degree
    return scale * z, np.broadcast_to(scale, z.shape)


def batch_gradient(model: FluxModel, s: np.ndarray, y: np.ndarray, w: np.ndarray, p: FitParams, rng) -> tuple[float, np.ndarray]:
    """Loss sum and flat gradient sum (mean head, then variance head) over scaled rows.

    With a degree, what `apply` predicts is fitted: norm^degree times the network of the unit vector.
    """
    norm = None
    if model.degree is not None:
        norm = np.linalg.norm(s, axis=1, keepdims=True)
        s = s / norm
    hm, km, zm = _activations(model.mean, s, 0.0 if p.fix_mean or p.loss == "var_mse" else p.dropout, rng)
    mean, dm = _output(model.mean_activation, zm, norm, model.degree)
    err = mean - y
    if p.loss == "mse":
        g = _gradient(model.mean, hm, km, 2 * w * err * dm)
        return float((w * err**2).sum()), np.concatenate([flat(g), np.zeros(flat(model.var).size)])
    hv, kv, zv = _activations(model.var, s, p.dropout, rng)
    raw, dv = _output(model.var_activation, zv, norm, model.degree)
    if p.loss == "var_mse":
        off = raw - err**2
        gv = _gradient(model.var, hv, kv, 2 * w * off * dv)
        return float((w * off**2).sum()), np.concatenate([np.zeros(flat(model.mean).size), flat(gv)])
    var = np.maximum(raw, VAR_FLOOR)
    loss = float((w * 0.5 * (np.log(var) + err**2 / var)).sum())
    gv = _gradient(model.var, hv, kv, w * 0.5 * (1 / var - err**2 / var**2) * dv)
    gm = np.zeros(flat(model.mean).size) if p.fix_mean else flat(_gradient(model.mean, hm, km, w * err / var * dm))
    return loss, np.concatenate([gm, flat(gv)])


class Adam:
    """One optimiser state per model."""

    def __init__(self, size: int):
        self.m, self.v, self.t = np.zeros(size), np.zeros(size), 0

    def step(self, params: np.ndarray, grad: np.ndarray, lr: float, decay: float, active: np.ndarray) -> np.ndarray:
        self.t += 1
        grad = np.where(active, grad + decay * params, 0.0)
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad**2
        move = (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)
        return params - lr * np.where(active, move, 0.0)


def pack(df: DataFrame, models: dict[str, FluxModel], key: str, w: str | None, held: dict[str, str]) -> DataFrame:
    """Narrow training table: key, all inputs, all outputs, weight, and one held-out flag per model."""
    xs = list(dict.fromkeys(k for m in models.values() for k in m.ikeys))
    ys = list(dict.fromkeys(k for m in models.values() for k in m.okeys))
    cols = [F.col(c).cast("double").alias(f"x_{c}") for c in xs] + [F.col(c).cast("double").alias(f"y_{c}") for c in ys]
    flags = [(F.col(held[n]) != "train").cast("int").alias(f"h_{n}") for n in models]
    return df.select(F.col(key).alias("_key"), F.xxhash64(key).alias("_hash"), *cols, (F.col(w).cast("double") if w else F.lit(1.0)).alias("_w"), *flags).dropna()


def _arrays(pdf: pd.DataFrame, model: FluxModel):
    x = pdf[[f"x_{k}" for k in model.ikeys]].to_numpy()
    y = (pdf[[f"y_{k}" for k in model.okeys]].to_numpy() - np.asarray(model.ymean)) / np.asarray(model.yscale)
    return model.features(x), y, pdf["_w"].to_numpy()[:, None]


def _add_up(parts: DataFrame, n_parts: int) -> list:
    """Sum of equally long vectors per model, through a bounded number of intermediate rows."""
    if n_parts > FAN_IN:
        def add(pdf):
            return pd.DataFrame({"model": [pdf["model"].iloc[0]], "loss": [pdf["loss"].sum()], "n": [pdf["n"].sum()],
                                 "g": [np.sum(np.stack(pdf["g"].to_list()), axis=0)]})
        lane = F.pmod(F.spark_partition_id(), F.lit(FAN_IN))
        parts = parts.withColumn("_lane", lane).groupBy("model", "_lane").applyInPandas(add, "model string, loss double, n double, g array<double>")
    return parts.collect()


def _step(rows: DataFrame, models: dict[str, FluxModel], p: FitParams, tick: int, n_parts: int) -> dict:
    def grads(batches):
        acc = {}
        for pdf in batches:
            for n, m in models.items():
                part = pdf[pdf[f"h_{n}"] == 0]
                if len(part):
                    s, y, w = _arrays(part, m)
                    rng = KeyedDraws(part["_hash"].to_numpy(), p.seed, tick)
                    loss, g = batch_gradient(m, s, y, w, p, rng)
                    a = acc.setdefault(n, [0.0, 0.0, 0.0])
                    a[0], a[1], a[2] = a[0] + loss, a[1] + y.size, a[2] + g
        yield pd.DataFrame([(n, a[0], float(a[1]), a[2].tolist()) for n, a in acc.items()], columns=["model", "loss", "n", "g"])

    out = {}
    for r in _add_up(rows.mapInPandas(grads, "model string, loss double, n double, g array<double>"), n_parts):
        loss, n, g = out.get(r["model"], (0.0, 0.0, 0.0))
        out[r["model"]] = (loss + r["loss"], n + r["n"], g + np.asarray(r["g"]))
    return out


def _scores(rows: DataFrame, models: dict[str, FluxModel], n_parts: int) -> dict:
    """Scores on scaled data per model and role: sums in tasks, ratios on the driver."""
    def sums(batches):
        acc = {}
        for pdf in batches:
            for n, m in models.items():
                for role, part in (("train", pdf[pdf[f"h_{n}"] == 0]), ("valid", pdf[pdf[f"h_{n}"] == 1])):
                    if not len(part):
                        continue
                    s, y, w = _arrays(part, m)
                    mean = forward(m.mean, s, m.mean_activation, m.degree)
                    var = np.maximum(forward(m.var, s, m.var_activation, m.degree), VAR_FLOOR)
                    e = mean - y
                    v = np.array([y.size, (w * e**2).sum(), (w * y**2).sum(), (w * 0.5 * (np.log(var) + e**2 / var)).sum(),
                                  (w * e / np.sqrt(var)).sum(), (w * e**2 / var).sum()])
                    k = f"{n}|{role}"
                    acc[k] = acc.get(k, 0.0) + v
        yield pd.DataFrame([(k, 0.0, 0.0, v.tolist()) for k, v in acc.items()], columns=["model", "loss", "n", "g"])

    tot = {}
    for r in _add_up(rows.mapInPandas(sums, "model string, loss double, n double, g array<double>"), n_parts):
        tot[r["model"]] = tot.get(r["model"], 0.0) + np.asarray(r["g"])
    out = {}
    for k, v in tot.items():
        n, mse = v[0], v[1] / v[0]
        out[tuple(k.split("|"))] = dict(zip(SCORES, (mse, 1 - mse / (v[2] / n) if v[2] else float("nan"), v[3] / n, v[4] / n, v[5] / n)))
    return out


def spread_and_cache(rows: DataFrame) -> tuple[DataFrame, int]:
    """Cache rows that are read many times; few input partitions are spread over the cores once."""
    width = rows.sparkSession.sparkContext.defaultParallelism
    held = rows.cache()
    n = held.select(F.spark_partition_id().alias("p")).distinct().count()
    if n >= width:
        return held, n
    wide = held.repartition(width).cache()
    wide.count()
    held.unpersist()
    return wide, width


def fit(rows: DataFrame, models: dict[str, FluxModel], p: FitParams) -> tuple[dict[str, FluxModel], list[tuple]]:
    """Fit all models on a table made by `pack`; returns the models and the log (model, epoch, role, metric, value)."""
    rows, n_parts = spread_and_cache(rows)
    drawn = None
    models = dict(models)
    state = {n: Adam(flat(m.mean).size + flat(m.var).size) for n, m in models.items()}
    lr = {n: p.lr for n in models}
    best, stale, waited, done, log = {}, {}, {}, set(), []
    cuts = {int(p.epochs / 2), int(p.epochs * 3 / 4), int(p.epochs * 7 / 8)}
    for epoch in range(p.epochs):
        live = {n: m for n, m in models.items() if n not in done}
        if not live:
            break
        loss = {n: 0.0 for n in live}
        if p.batches > 1 and (drawn is None or p.reshuffle):
            # Batches are drawn once an epoch and stored in their order: its steps together read the rows once.
            if drawn is not None:
                drawn.unpersist()
            draw = hash_uniform(p.seed * 100003 + (epoch if p.reshuffle else 0), F.col("_key"))
            drawn = rows.withColumn("_batch", F.floor(draw * p.batches).cast("int")).sortWithinPartitions("_batch").cache()
        for b in range(p.batches):
            part = rows if drawn is None else drawn.filter(F.col("_batch") == b)
            for n, (total, count, g) in _step(part, live, p, epoch * p.batches + b, n_parts).items():
                m = live[n]
                size = flat(m.mean).size
                active = np.ones(len(g), dtype=bool)
                active[:size] = not (p.fix_mean or p.loss == "var_mse")
                active[size:] = p.loss != "mse"
                theta = state[n].step(np.concatenate([flat(m.mean), flat(m.var)]), g / count, lr[n], p.weight_decay, active)
                live[n] = replace(m, mean=unflat(theta[:size], m.mean), var=unflat(theta[size:], m.var))
                loss[n] += total / count / p.batches
        models.update(live)
        got = _scores(rows, live, n_parts)
        for n in live:
            log += [(n, epoch, "train", "loss", float(loss[n])), (n, epoch, "train", "lr", float(lr[n]))]
            for role in ("train", "valid"):
                log += [(n, epoch, role, k, float(v)) for k, v in got.get((n, role), {}).items()]
            if p.early_stopping:
                now = got.get((n, "valid"), got.get((n, "train"), {})).get("mse" if p.loss == "mse" else "nll", float("nan"))
                better = now < best.get(n, float("inf"))
                best[n] = min(now, best.get(n, float("inf")))
                stale[n] = 0 if better else stale.get(n, 0) + 1
                waited[n] = 0 if better else waited.get(n, 0) + 1
                if waited[n] > p.patience:
                    lr[n], waited[n] = lr[n] * p.factor, 0
                if stale[n] >= p.max_stale:
                    done.add(n)
            elif epoch + 1 in cuts:
                lr[n] *= p.gamma
    if drawn is not None:
        drawn.unpersist()
    rows.unpersist()
    return models, log


def scales_of(df: DataFrame, ikeys: list[str], okeys: list[str], w: str | None) -> dict:
    """Weighted input and output scales, from one aggregate."""
    r = fit_scales(df, list(dict.fromkeys([*ikeys, *okeys])), w).first().asDict()
    return {"xmean": [r[f"{k}_mean"] for k in ikeys], "xscale": [r[f"{k}_scale"] or 1.0 for k in ikeys],
            "ymean": [r[f"{k}_mean"] for k in okeys], "yscale": [r[f"{k}_scale"] or 1.0 for k in okeys]}


def fit_gaussian(df: DataFrame, ikeys: list[str], okeys: list[str], key: str, hidden: list[int] = (32, 16), w: str | None = None,
                 ratio: float = 0.2, seed: int = 0, params: FitParams | None = None, two_step: bool = False, **kw) -> tuple[FluxModel, list]:
    """Mean and variance together by weighted Gaussian likelihood, or mean first and variance after."""
    fitted, log = fit_sweep(df, {"model": {"okeys": list(okeys), "seed": seed}}, ikeys, key, hidden, w, ratio, params, two_step, **kw)
    return fitted["model"], log


def fit_sweep(df: DataFrame, grid: dict[str, dict], ikeys: list[str], key: str, hidden: list[int] = (32, 16), w: str | None = None,
              ratio: float = 0.2, params: FitParams | None = None, two_step: bool = False, **kw) -> tuple[dict[str, FluxModel], list]:
    """One model per grid entry {name: {okeys, seed}}, all fitted in the same passes over the data."""
    p = params or FitParams()
    used = list(dict.fromkeys([*ikeys, *(o for g in grid.values() for o in g["okeys"]), *([w] if w else [])]))
    rows = df.dropna("any", subset=used)
    held, models = {}, {}
    for n, g in grid.items():
        role = f"_role{g['seed']}"
        if role not in rows.columns:
            rows = split_random(rows, key, g["seed"], ratio, role)
        held[n] = role
        scales = scales_of(rows.filter(F.col(role) == "train"), ikeys, g["okeys"], w)
        models[n] = new_model(list(ikeys), list(g["okeys"]), list(hidden), g["seed"], scales, **kw)
    packed = pack(rows, models, key, w, held)
    if not two_step:
        return fit(packed, models, p)
    models, first = fit(packed, models, replace(p, loss="mse"))
    models, second = fit(packed, models, replace(p, loss="nll", fix_mean=True))
    return models, [(n, e, r, f"step1_{k}", v) for n, e, r, k, v in first] + second


def fit_variance_mse(df: DataFrame, model: FluxModel, key: str, w: str | None = None, params: FitParams | None = None) -> tuple[FluxModel, list]:
    """Variance head fitted to the squared residuals of a given mean."""
    p = replace(params or FitParams(), loss="var_mse")
    rows = split_random(df.dropna("any", subset=[*model.ikeys, *model.okeys]), key, p.seed, 0.2, "_role")
    fitted, log = fit(pack(rows, {"model": model}, key, w, {"model": "_role"}), {"model": model}, p)
    return fitted["model"], log


def log_table(spark: SparkSession, log: list[tuple]) -> DataFrame:
    """The training log as a table; its size is epochs x models x scores."""
    return spark.createDataFrame(log, "model string, epoch int, role string, metric string, value double")
