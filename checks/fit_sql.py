"""The fits of one-hidden-layer networks as SQL: every step of every epoch is a chain of CTEs."""

from __future__ import annotations

from checks.q_sampling import uni
from halocline.operators.network import new_model
from halocline.operators.training import SCORES, FitParams, flat


def _num(v) -> str:
    return f"{float(v)!r}::DOUBLE"


def rows_sql(tag, src, key, ikeys, okey, seed, w, scales=None, ratio=0.2):
    """Scaled rows of one model: `d` with x0.., y, w, held."""
    wt = w or "1e0"
    held = f"row_number() OVER (ORDER BY substr(md5('{seed}:' || {key}), 1, 12), {key}) <= floor((SELECT count(*) FROM {src})*{ratio!r}::DOUBLE)"
    parts = [f"{tag}r AS MATERIALIZED (SELECT *, {held} AS held, {wt} AS wt_ FROM {src})"]
    if scales is None:
        cols = [*ikeys, okey]
        parts.append(f"{tag}m AS (SELECT " + ", ".join(f"avg({c}*wt_) AS c{i}" for i, c in enumerate(cols)) + f" FROM {tag}r WHERE NOT held)")
        parts.append(f"{tag}s AS (SELECT " + ", ".join(f"any_value(c{i}) AS c{i}, sqrt(avg(pow({c}-c{i}, 2)*wt_)) AS s{i}" for i, c in enumerate(cols))
                     + f" FROM {tag}r CROSS JOIN {tag}m WHERE NOT held)")
    else:
        pairs = [*zip(scales["xmean"], scales["xscale"]), (scales["ymean"][0], scales["yscale"][0])]
        parts.append(f"{tag}s AS (SELECT " + ", ".join(f"{_num(m)} AS c{i}, {_num(s)} AS s{i}" for i, (m, s) in enumerate(pairs)) + ")")
    n = len(ikeys)
    xs = ", ".join(f"({c}-c{i})/s{i} AS x{i}" for i, c in enumerate(ikeys))
    parts.append(f"{tag}d AS MATERIALIZED (SELECT {key} AS k_, {xs}, ({okey}-c{n})/s{n} AS y, wt_ AS w, held FROM {tag}r CROSS JOIN {tag}s)")
    return parts


def fit_parts(tag, data, ni, nh, start, p: FitParams, label, first=None, prefix=""):
    """CTEs of one fit on `data`, and the SELECT of its log. `first` names a CTE that holds the starting parameters."""
    size = ni * nh + 2 * nh + 1
    total = 2 * size
    w1 = lambda base, j, i: f"p.p{base + j * ni + i}"
    b1 = lambda base, j: f"p.p{base + ni * nh + j}"
    w2 = lambda base, j: f"p.p{base + ni * nh + nh + j}"
    b2 = lambda base: f"p.p{base + size - 1}"
    active = range(total)
    if p.loss == "mse":
        active = range(size)
    elif p.loss == "var_mse" or p.fix_mean:
        active = range(size, total)
    init = ", ".join([*(f"{_num(v)} AS p{i}" if first is None else f"p{i}" for i, v in enumerate(start)),
                      *(f"0e0 AS m{i}, 0e0 AS v{i}" for i in range(total)), "0e0 AS loss"])
    parts = [f"{tag}p0 AS MATERIALIZED (SELECT {init}{'' if first is None else f' FROM {first}'})"]

    def forward(name, src_p, where):
        hid = ", ".join([*(f"1e0/(1e0+exp(-({' + '.join(f'{w1(0, j, i)}*x{i}' for i in range(ni))} + {b1(0, j)}))) AS a{j}" for j in range(nh)),
                         *(f"1e0/(1e0+exp(-({' + '.join(f'{w1(size, j, i)}*x{i}' for i in range(ni))} + {b1(size, j)}))) AS c{j}" for j in range(nh))])
        xs = ", ".join(f"x{i}" for i in range(ni))
        return [f"{name}h AS (SELECT {xs}, y, w, held, {hid} FROM {data} CROSS JOIN {src_p} p {where})",
                f"{name}o AS (SELECT h.*, {' + '.join(f'{w2(0, j)}*a{j}' for j in range(nh))} + {b2(0)} - y AS e, "
                f"exp({' + '.join(f'{w2(size, j)}*c{j}' for j in range(nh))} + {b2(size)}) AS raw FROM {name}h h CROSS JOIN {src_p} p)",
                f"{name}v AS MATERIALIZED (SELECT *, greatest(raw, 1e-6) AS var FROM {name}o)"]

    step, lr, logs = 0, p.lr, []
    cuts = {int(p.epochs / 2), int(p.epochs * 3 / 4), int(p.epochs * 7 / 8)}
    loss = {"nll": "w*0.5e0*(ln(var)+e*e/var)", "mse": "w*e*e", "var_mse": "w*pow(raw-e*e, 2)"}[p.loss]
    dm = {"nll": "w*e/var", "mse": "2e0*w*e", "var_mse": "0e0"}[p.loss]
    dv = {"nll": "w*0.5e0*(1e0/var-e*e/(var*var))*raw", "mse": "0e0", "var_mse": "2e0*w*(raw-e*e)*raw"}[p.loss]
    for epoch in range(p.epochs):
        losses = []
        for b in range(p.batches):
            old, new, name = f"{tag}p{step}", f"{tag}p{step + 1}", f"{tag}t{step}"
            parts += forward(name, old, f"WHERE NOT held AND floor({uni(p.seed * 100003 + (epoch if p.reshuffle else 0), 'k_')}*{p.batches}) = {b}")
            sums = []
            for base, h, d in ((0, "a", dm), (size, "c", dv)):
                sums += [f"sum({d}*{h}{j}*(1e0-{h}{j})*x{i}) AS g{base + j * ni + i}" for j in range(nh) for i in range(ni)]
                sums += [f"sum({d}*{h}{j}*(1e0-{h}{j})) AS g{base + ni * nh + j}" for j in range(nh)]
                sums += [f"sum({d}*{h}{j}) AS g{base + ni * nh + nh + j}" for j in range(nh)] + [f"sum({d}) AS g{base + size - 1}"]
            parts.append(f"{name}g AS MATERIALIZED (SELECT count(*) AS n, sum({loss}) AS l, {', '.join(sums)} FROM {name}v)")
            t, cols = step + 1, []
            for i in range(total):
                base, at = (0, i) if i < size else (size, i - size)
                hidden = at // ni if at < ni * nh else (at - ni * nh if at < ni * nh + nh else None)
                grad = f"(g{i}/n)" if hidden is None else f"({w2(base, hidden)}*g{i}/n)"
                if i not in active:
                    cols += [f"p.p{i} AS p{i}, 0e0 AS m{i}, 0e0 AS v{i}"]
                    continue
                m, v = f"(0.9e0*p.m{i}+0.1e0*{grad})", f"(0.999e0*p.v{i}+0.001e0*{grad}*{grad})"
                cols.append(f"p.p{i} - {_num(lr)}*({m}/{_num(1 - 0.9**t)})/(sqrt({v}/{_num(1 - 0.999**t)})+1e-8) AS p{i}, {m} AS m{i}, {v} AS v{i}")
            parts.append(f"{new} AS MATERIALIZED (SELECT {', '.join(cols)}, l/n AS loss FROM {old} p CROSS JOIN {name}g)")
            losses.append(new)
            step += 1
        name = f"{tag}e{epoch}"
        parts += forward(name, f"{tag}p{step}", "")
        parts.append(f"{name}s AS (SELECT CASE WHEN held THEN 'valid' ELSE 'train' END AS role, avg(w*e*e) AS mse, 1e0-avg(w*e*e)/avg(w*y*y) AS r2, "
                     f"avg(w*0.5e0*(ln(var)+e*e/var)) AS nll, avg(w*e/sqrt(var)) AS res_mean, avg(w*e*e/var) AS res_var FROM {name}v GROUP BY held)")
        mean_loss = " + ".join(f"(SELECT loss FROM {c})" for c in losses)
        logs += [f"SELECT {epoch}::INT AS epoch, 'train' AS role, '{prefix}loss' AS metric, ({mean_loss})/{p.batches} AS value",
                 f"SELECT {epoch}::INT, 'train', '{prefix}lr', {_num(lr)}"]
        logs += [f"SELECT {epoch}::INT, role, '{prefix}{k}', {k} FROM {name}s" for k in SCORES]
        if epoch + 1 in cuts:
            lr *= p.gamma
    return parts, f"SELECT '{label}' AS model, * FROM (" + " UNION ALL ".join(logs) + ")", f"{tag}p{step}"


def gaussian_sql(src, key, ikeys, okey, nh, p: FitParams, seed=0, w=None, label="model", tag="f"):
    model = new_model(list(ikeys), [okey], [nh], seed)
    start = [*flat(model.mean), *flat(model.var)]
    parts = rows_sql(tag, src, key, ikeys, okey, seed, w)
    more, log, _ = fit_parts(tag, f"{tag}d", len(ikeys), nh, start, p, label)
    return parts + more, log


def predictions_sql(src, key, ikeys, okey, nh, p: FitParams, seed=0, w=None, tag="f"):
    """CTEs of a fit, and the SELECT of what the fitted model predicts for every row in physical units."""
    parts = rows_sql(tag, src, key, ikeys, okey, seed, w)
    model = new_model(list(ikeys), [okey], [nh], seed)
    more, _, last = fit_parts(tag, f"{tag}d", len(ikeys), nh, [*flat(model.mean), *flat(model.var)], p, "model")
    n, size = len(ikeys), len(ikeys) * nh + 2 * nh + 1

    def head(base):
        unit = lambda j: f"p{base + n * nh + nh + j}/(1e0+exp(-({' + '.join(f'p{base + j * n + i}*x{i}' for i in range(n))} + p{base + n * nh + j})))"
        return " + ".join(unit(j) for j in range(nh)) + f" + p{base + size - 1}"

    return parts + more, (f"SELECT k_ AS {key}, ({head(0)})*s{n} + c{n} AS mean, exp({head(size)})*s{n}*s{n} AS var FROM {tag}d CROSS JOIN {last} CROSS JOIN {tag}s")


def two_step_sql(src, key, ikeys, okey, nh, p: FitParams, seed=0, w=None):
    from dataclasses import replace
    model = new_model(list(ikeys), [okey], [nh], seed)
    start = [*flat(model.mean), *flat(model.var)]
    parts = rows_sql("f", src, key, ikeys, okey, seed, w)
    one, log1, last = fit_parts("f", "fd", len(ikeys), nh, start, replace(p, loss="mse"), "model", prefix="step1_")
    two, log2, _ = fit_parts("h", "fd", len(ikeys), nh, start, replace(p, loss="nll", fix_mean=True), "model", first=last)
    return parts + one + two, f"{log1} UNION ALL {log2}"


def variance_sql(src, key, model, p: FitParams):
    from dataclasses import replace
    scales = {k: getattr(model, k) for k in ("xmean", "xscale", "ymean", "yscale")}
    parts = rows_sql("f", src, key, model.ikeys, model.okeys[0], p.seed, None, scales)
    start = [*flat(model.mean), *flat(model.var)]
    nh = model.mean[0][0].shape[0]
    more, log, _ = fit_parts("f", "fd", len(model.ikeys), nh, start, replace(p, loss="var_mse"), "model")
    return parts + more, log
