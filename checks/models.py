"""Small fixed networks for the checks, and the same networks as SQL."""

from __future__ import annotations

from halocline.operators.network import new_model

IKEYS = ["U", "tsea", "tair", "rh", "p"]
SCALES = {"xmean": [8.0, 20.0, 19.0, 78.0, 101000.0], "xscale": [4.0, 6.0, 6.0, 10.0, 900.0]}


def demo(okey: str, seed: int, ymean: float, yscale: float, hidden=(6,), **kw):
    return new_model(IKEYS, [okey], list(hidden), seed, SCALES | {"ymean": [ymean], "yscale": [yscale]}, **kw)


SH, LH = demo("hsc", 1, -10.0, 15.0), demo("hlc", 2, -80.0, 40.0)
M, M_CROSS = demo("taucx", 3, 0.1, 0.08), demo("taucy", 4, 0.0, 0.02)


def net_sql(model, head, names=None):
    """A one-hidden-layer network as an SQL expression in physical units."""
    names = names or model.ikeys
    (w1, b1), (w2, b2) = getattr(model, head)
    xs = [f"(({n})-{m!r}::DOUBLE)/{s!r}::DOUBLE" for n, m, s in zip(names, model.xmean, model.xscale)]
    if model.diff:
        a, b = (model.ikeys.index(d) for d in model.diff)
        xs.append(f"({xs[a]}-{xs[b]})")
    hidden = [f"1e0/(1e0+exp(-({' + '.join(f'{float(v)!r}::DOUBLE*{x}' for v, x in zip(row, xs))} + {float(b)!r}::DOUBLE)))" for row, b in zip(w1, b1)]
    z = " + ".join(f"{float(v)!r}::DOUBLE*({h})" for v, h in zip(w2[0], hidden)) + f" + {float(b2[0])!r}::DOUBLE"
    act = model.mean_activation if head == "mean" else model.var_activation
    y = {"no": f"({z})", "exponential": f"exp({z})", "square": f"pow({z}, 2)", "softplus": f"ln(1e0+exp({z}))"}[act]
    s, m = model.yscale[0], model.ymean[0]
    return f"({y}*{s!r}::DOUBLE + {m!r}::DOUBLE)" if head == "mean" else f"({y}*{s * s!r}::DOUBLE)"
