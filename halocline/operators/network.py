"""Small networks that predict a mean and a variance per flux, applied in Arrow batches."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from halocline.functions.thermo import rhcalc
from halocline.operators.quality import rotate_stress, wind_parts
from halocline.schema import require_columns

Layers = list  # of (weight matrix, bias vector)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


# name -> (function, derivative given the input and the output)
OUTPUTS = {
    "no": (lambda z: z, lambda z, y: np.ones_like(z)),
    "square": (lambda z: z * z, lambda z, y: 2 * z),
    "exponential": (np.exp, lambda z, y: y),
    "softplus": (lambda z: np.logaddexp(0.0, z), lambda z, y: sigmoid(z)),
}


def init_layers(n_in: int, hidden: list[int], n_out: int, rng: np.random.Generator) -> Layers:
    """Uniform start within 1/sqrt(inputs), weights and biases alike."""
    sizes = [n_in, *hidden, n_out]
    return [(rng.uniform(-1, 1, (b, a)) / math.sqrt(a), rng.uniform(-1, 1, b) / math.sqrt(a)) for a, b in zip(sizes, sizes[1:])]


def forward(layers: Layers, x: np.ndarray, activation: str, degree: float | None = None) -> np.ndarray:
    """Sigmoid network. `degree` makes it homogeneous: |x|^degree times the network of x/|x|, without output function."""
    norm = np.linalg.norm(x, axis=1, keepdims=True) if degree is not None else None
    h = x / norm if degree is not None else x
    for w, b in layers[:-1]:
        h = sigmoid(h @ w.T + b)
    w, b = layers[-1]
    z = h @ w.T + b
    return norm**degree * z if degree is not None else OUTPUTS[activation][0](z)


@dataclass
class FluxModel:
    """A mean and a variance network with the scales of inputs and outputs."""

    ikeys: list[str]
    okeys: list[str]
    mean: Layers
    var: Layers
    xmean: list[float]
    xscale: list[float]
    ymean: list[float]
    yscale: list[float]
    mean_activation: str = "no"
    var_activation: str = "exponential"
    degree: float | None = None
    diff: tuple[str, str] | None = None     # appends the difference of two scaled inputs as a fixed extra feature
    log: list = field(default_factory=list)

    def features(self, x: np.ndarray) -> np.ndarray:
        s = (x - np.asarray(self.xmean)) / np.asarray(self.xscale)
        if self.diff:
            a, b = (self.ikeys.index(n) for n in self.diff)
            s = np.hstack([s, s[:, [a]] - s[:, [b]]])
        return s

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and variance in physical units; the variance scales with the square of the output scale."""
        s, scale = self.features(x), np.asarray(self.yscale)
        m = forward(self.mean, s, self.mean_activation, self.degree) * scale + np.asarray(self.ymean)
        return m, forward(self.var, s, self.var_activation, self.degree) * scale**2

    def config(self) -> dict:
        keys = ("ikeys", "okeys", "xmean", "xscale", "ymean", "yscale", "mean_activation", "var_activation", "degree", "diff")
        return {k: getattr(self, k) for k in keys}

    def rows(self) -> list[tuple]:
        """(head, layer, i, j, w); j = -1 holds the bias."""
        out = []
        for head in ("mean", "var"):
            for n, (w, b) in enumerate(getattr(self, head)):
                out += [(head, n, i, j, float(w[i, j])) for i in range(w.shape[0]) for j in range(w.shape[1])]
                out += [(head, n, i, -1, float(v)) for i, v in enumerate(b)]
        return out

    @classmethod
    def restore(cls, config: dict, rows: list[tuple]) -> "FluxModel":
        heads = {}
        for head in ("mean", "var"):
            layers = []
            for n in range(1 + max(r[1] for r in rows if r[0] == head)):
                cells = [r for r in rows if r[0] == head and r[1] == n]
                w = np.zeros((1 + max(c[2] for c in cells), 1 + max(c[3] for c in cells)))
                b = np.zeros(w.shape[0])
                for _, _, i, j, v in cells:
                    if j < 0:
                        b[i] = v
                    else:
                        w[i, j] = v
                layers.append((w, b))
            heads[head] = layers
        config = dict(config)
        config["diff"] = tuple(config["diff"]) if config.get("diff") else None
        return cls(**heads, **config)


def new_model(ikeys: list[str], okeys: list[str], hidden: list[int], seed: int = 0, scales: dict | None = None, **kw) -> FluxModel:
    rng = np.random.default_rng(seed)
    n_in = len(ikeys) + (1 if kw.get("diff") else 0)
    n, m = len(ikeys), len(okeys)
    s = scales or {"xmean": [0.0] * n, "xscale": [1.0] * n, "ymean": [0.0] * m, "yscale": [1.0] * m}
    return FluxModel(list(ikeys), list(okeys), init_layers(n_in, hidden, m, rng), init_layers(n_in, hidden, m, rng), **s, **kw)


def predict(df: DataFrame, models: dict[str, FluxModel]) -> DataFrame:
    """Add `<name>_mean` and `<name>_var` per model (and output, when a model has several).

    All models run in one pass over the rows. A model is a few thousand numbers and travels
    with the function.
    """
    ikeys = list(dict.fromkeys(k for m in models.values() for k in m.ikeys))
    require_columns(df, ikeys)
    names = {n: [n if len(m.okeys) == 1 else f"{n}_{o}" for o in m.okeys] for n, m in models.items()}
    fields = [f"{o}_{what}" for n in models for o in names[n] for what in ("mean", "var")]

    @F.pandas_udf(", ".join(f"`{f}` double" for f in fields))
    def run(s: pd.DataFrame) -> pd.DataFrame:
        out = {}
        for n, m in models.items():
            with np.errstate(all="ignore"):
                mean, var = m.apply(s[m.ikeys].to_numpy(dtype=float))
            for j, o in enumerate(names[n]):
                out[f"{o}_mean"], out[f"{o}_var"] = mean[:, j], var[:, j]
        return pd.DataFrame(out)

    rows = df.withColumn("_y", run(F.struct(*[F.col(k).cast("double").alias(k) for k in ikeys])))
    return rows.select(*df.columns, *[F.when(~F.isnan(F.col(f"_y.`{f}`")), F.col(f"_y.`{f}`")).alias(f) for f in fields])


def predict_fluxes(df: DataFrame, sh: FluxModel, lh: FluxModel, m: FluxModel, total: str = "heat", strict_reference: bool = False) -> DataFrame:
    """Mean and std of sensible, latent and stress in x, y, along the wind given by `cos`, `sin`.

    Heat is blank where the total heat flux is missing (`strict_reference`: or zero).
    """
    p = predict(df, {"_qh": sh, "_ql": lh, "_m": m})
    keep = F.col(total).isNotNull() & ((F.col(total) != 0) if strict_reference else F.lit(True))
    cols = {}
    for tag in ("qh", "ql"):
        cols[f"{tag}_ann"] = F.when(keep, F.col(f"_{tag}_mean"))
        cols[f"{tag}_std"] = F.when(keep, F.sqrt(F.col(f"_{tag}_var")))
    out = p.withColumns(cols).withColumn("_m_std", F.sqrt("_m_var"))
    out = rotate_stress(out, "_m_mean", "_m_std", prefix="_t")
    return out.select(*df.columns, *cols, F.col("_tx").alias("taux_ann"), F.col("_ty").alias("tauy_ann"),
                      F.col("_tx_std").alias("taux_std"), F.col("_ty_std").alias("tauy_std"))


def ann_flux(df: DataFrame, sh: FluxModel, lh: FluxModel, m: FluxModel) -> DataFrame:
    """Raw state (ux, uy, To, Ta, p, q) to stress and heat fluxes; works on rows of any grid."""
    require_columns(df, ["ux", "uy", "To", "Ta", "p", "q"])
    g = wind_parts(df, eps=1e-8)
    g = g.withColumns({"tsea": F.col("To"), "tair": F.col("Ta"), "rh": rhcalc("Ta", F.col("p") / 100.0, "q")})
    out = rotate_stress(predict(g, {"Qs": sh, "Ql": lh, "_m": m}), "_m_mean")
    return out.select(*df.columns, "taux", "tauy", F.col("Qs_mean").alias("Qs"), F.col("Ql_mean").alias("Ql"))


def add_fluxes(df: DataFrame, models: dict[str, FluxModel]) -> DataFrame:
    """Mean and variance columns of the four fluxes: names `LH`, `SH`, `M`, `M_cross` and `<name>_var`."""
    p = predict(df, models)
    return p.withColumnsRenamed({f"{n}_mean": n for n in models})


def member_stats(df: DataFrame, members: list[str], name: str) -> DataFrame:
    """Mean and population std across member columns of a row."""
    n = len(members)
    mean = sum((F.col(c) for c in members[1:]), F.col(members[0])) / n
    df = df.withColumn(f"{name}_mean", mean)
    dev = [(F.col(c) - F.col(f"{name}_mean")) ** 2 for c in members]
    return df.withColumn(f"{name}_std", F.sqrt(sum(dev[1:], dev[0]) / n))


def predict_ensemble(df: DataFrame, models: list[FluxModel]) -> DataFrame:
    """Mean and std over models of the predicted mean (`y`) and of the predicted variance (`sigma`)."""
    p = predict(df, {f"_e{i}": m for i, m in enumerate(models)})
    p = member_stats(p, [f"_e{i}_mean" for i in range(len(models))], "y")
    p = member_stats(p, [f"_e{i}_var" for i in range(len(models))], "sigma")
    return p.select(*df.columns, "y_mean", "y_std", "sigma_mean", "sigma_std")


def response_map(grid: DataFrame, models: dict[str, FluxModel]) -> DataFrame:
    """Predicted mean and std of each model on a feature grid, long over models."""
    p = predict(grid, models)
    parts = F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"{n}_mean").alias("mean"), F.sqrt(F.col(f"{n}_var")).alias("std")) for n in models])
    return p.select(*grid.columns, F.inline(parts))
