"""Bulk-flux queries."""

from pyspark.sql import functions as F

from checks.q_functions import es, psit_sql, psiu_sql
from checks.registry import query
from checks.views import using, view
from halocline.operators import bulk as B, quality as Q
from halocline.sources import tables as L


def obs(spark, sf):
    return Q.complete_cases(view(spark, sf, "obs"), ["U"])


def _at(sql, z):
    """A stability expression in `z`, evaluated at another argument."""
    import re
    return "(" + re.sub(r"\bz\b", f"({z})", sql) + ")"


def psit(z):
    return _at(psit_sql(), z)


def psiu(z, kind="26"):
    return _at(psiu_sql("0.7e0", "15e0", "10.15e0") if kind == "26" else psiu_sql("1e0", "18e0", "10e0"), z)


def solver_sql(version="3.6", src="obs_ok", humidity="rh", cool=False, light="141.75e0"):
    """The ten sweeps as ten chained steps, without waves and ice."""
    k = "0.4e0"
    if version == "3.6":
        prep = f"""c0 AS (SELECT *, p/1e2 AS mb, p/1e2 - 0.125e0*zt AS pat, -0.0575e0*35e0 + 0.00171052e0*pow(35e0,1.5e0) - 0.0002154996e0*35e0*35e0 AS tf,
      9.7803267715e0*(1e0 + 0.0052790414e0*pow(sin(radians(lat)),2) + 0.0000232718e0*pow(sin(radians(lat)),4)
      + 0.0000001262e0*pow(sin(radians(lat)),6) + 0.0000000007e0*pow(sin(radians(lat)),8)) AS g FROM {src}),
    c1 AS (SELECT *, 622e0*0.98e0*{es('tsea', 'mb')}/(mb-0.378e0*0.98e0*{es('tsea', 'mb')})/1e3 AS qs,
      {'qair' if humidity == 'qair' else f"622e0*0.01e0*rh*{es('tair', 'pat')}/(pat-0.378e0*0.01e0*rh*{es('tair', 'pat')})/1e3"} AS q, g/1004.67e0 AS lapse FROM c0),"""
        cool_sql = "(2.2e-5*pow(tsea-1e0,0.82e0)-5e-5) + (2.1e-5*pow(tsea+3.2e0,0.79e0)-(2.2e-5*pow(tsea-1e0,0.82e0)-5e-5))*35e0/35e0 AS al, 7.5e-4*35e0 AS be"
    else:
        prep = f"""c0 AS (SELECT *, p/1e2 AS mb, p/1e2 AS pat,
      9.7803267715e0*(1e0 + 0.0052790414e0*pow(sin(radians(lat)),2) + 0.0000232718e0*pow(sin(radians(lat)),4)
      + 0.0000001262e0*pow(sin(radians(lat)),6) + 0.0000000007e0*pow(sin(radians(lat)),8)) AS g FROM {src}),
    c1 AS (SELECT *, 622e0*0.98e0*{es('tsea', 'mb')}/(mb-0.378e0*0.98e0*{es('tsea', 'mb')})/1e3 AS qs,
      {'qair' if humidity == 'qair' else f"621.97e0*rh/1e2*{es('tair', 'mb')}/(mb-0.378e0*rh/1e2*{es('tair', 'mb')})/1e3"} AS q, 0.0098e0 AS lapse FROM c0),"""
        cool_sql = "2.1e-5*pow(tsea+3.2e0,0.79e0) AS al, 0.026e0 AS be"
    jc = "1e0" if cool else "0e0"
    tv = "tsr*(1e0+0.61e0*q)" if version == "3.6" else "tsr"
    steps = [prep + f"""
    c2 AS (SELECT *, tair+273.16e0 AS ta, (2.501e0-0.00237e0*tsea)*1e6 AS le, pat*1e2/(287.1e0*(tair+273.16e0)*(1e0+0.61e0*q)) AS rhoa,
      1.326e-5*(1e0+6.542e-3*tair+8.301e-6*tair*tair-4.84e-9*tair*tair*tair) AS visa, tsea-tair-lapse*zt AS dt0, qs-q AS dq,
      {cool_sql}, {light} AS sw FROM c1),
    c3 AS (SELECT *, 0.622e0*le*qs/(287.1e0*pow(tsea+273.16e0,2)) AS wetc, 16e0*g*4000e0*pow(1022e0*1e-6,3)/(0.36e0*rhoa*rhoa) AS bigc,
      sqrt(U*U+0.25e0) AS ut, sqrt(U*U+0.25e0)*ln(10e0/1e-4)/ln(zu/1e-4) AS u10,
      0.97e0*(5.67e-8*pow(tsea-0.3e0*{jc}+273.16e0,4)-370e0) AS lwn FROM c2),
    c4 AS (SELECT *, 0.011e0*pow(0.035e0*u10,2)/g+0.11e0*visa/(0.035e0*u10) AS zo1,
      -g*zu/ta*(dt0-0.3e0*{jc}+0.61e0*ta*dq)/(ut*ut) AS rib, -zu/600e0/0.004e0/pow(1.2e0,3) AS ribc FROM c3),
    c5 AS (SELECT *, 10e0/exp({k}/(0.00115e0/({k}/ln(10e0/zo1)))) AS zot1 FROM c4),
    c6 AS (SELECT *, {k}*({k}/ln(zt/zot1))/pow({k}/ln(zu/zo1),2) AS cc FROM c5),
    c7 AS (SELECT *, cc*rib*(1e0+3e0*rib/cc) > 50 AS fr, zu/(CASE WHEN rib < 0 THEN cc*rib/(1e0+rib/ribc) ELSE cc*rib*(1e0+3e0*rib/cc) END) AS l0 FROM c6),
    s0 AS MATERIALIZED (SELECT *, ut*{k}/(ln(zu/zo1)-{psiu('zu/l0', '40')}) AS usr, -(dt0-0.3e0*{jc})*{k}/(ln(zt/zot1)-{psit('zt/l0')}) AS tsr,
      -(dq-wetc*0.3e0*{jc})*{k}/(ln(zq/zot1)-{psit('zq/l0')}) AS qsr, 0.0017e0*least(u10,19e0)-0.005e0 AS ch, 0e0 AS zo, 0e0 AS l, 0e0 AS zoq,
      0.3e0 AS sk, 1e-3 AS dz, 0e0 AS uf, 0e0 AS tf1, 0e0 AS qf, 0e0 AS lf, 0e0 AS sf FROM c7)"""]
    for i in range(1, 11):
        keep = "usr AS uf, tsr AS tf1, qsr AS qf, l AS lf, heat*dz/0.6e0 AS sf" if i == 1 else ""
        steps.append(f"""
    a{i} AS (SELECT * REPLACE (zu/({k}*g*zu/ta*(tsr+0.61e0*ta*qsr)/(usr*usr)) AS l, ch*usr*usr/g+0.11e0*visa/usr AS zo) FROM s{i - 1}),
    b{i} AS (SELECT * REPLACE (least(1.6e-4, 5.8e-5/pow(zo*usr/visa,0.72e0)) AS zoq) FROM a{i}),
    d{i} AS (SELECT * REPLACE (ut*{k}/(ln(zu/zo)-{psiu('zu/l')}) AS usr, -(dt0-sk*{jc})*{k}/(ln(zt/zoq)-{psit('zt/l')}) AS tsr,
      -(dq-wetc*sk*{jc})*{k}/(ln(zq/zoq)-{psit('zq/l')}) AS qsr) FROM b{i}),
    e{i} AS (SELECT *, -g/ta*usr*({tv}+0.61e0*ta*qsr) AS bf, -rhoa*1004.67e0*usr*tsr AS hs, -rhoa*le*usr*qsr AS hl FROM d{i}),
    f{i} AS (SELECT * REPLACE (sqrt(U*U+pow(CASE WHEN bf > 0 THEN 1.2e0*pow(greatest(bf,0)*600e0,0.333e0) ELSE 0.2e0 END,2)) AS ut),
      lwn+hs+hl-sw*(0.065e0+11e0*dz-6.6e-5/dz*(1e0-exp(-dz/8e-4))) AS heat, 1e-6/(sqrt(rhoa/1022e0)*usr) AS film FROM e{i}),
    g{i} AS (SELECT *, al*heat+be*hl*4000e0/le AS alq FROM f{i}),
    h{i} AS (SELECT * REPLACE (CASE WHEN alq > 0 THEN 6e0/pow(1e0+pow(bigc*greatest(alq,0)/pow(usr,4),0.75e0),0.333e0)*film ELSE least(1e-2,6e0*film) END AS dz) FROM g{i}),
    i{i} AS (SELECT * REPLACE (heat*dz/0.6e0 AS sk, 0.97e0*(5.67e-8*pow(tsea-heat*dz/0.6e0*{jc}+273.16e0,4)-370e0) AS lwn,
      0.0017e0*least(usr/{k}*(U/ut)*ln(10e0/zo),19e0)-0.005e0 AS ch{', ' + keep if keep else ''}) FROM h{i}),
    s{i} AS MATERIALIZED (SELECT * EXCLUDE (bf, hs, hl, heat, film, alq) FROM i{i})""")
    steps.append(f"""
    fin AS (SELECT * REPLACE (CASE WHEN fr THEN uf ELSE usr END AS usr, CASE WHEN fr THEN tf1 ELSE tsr END AS tsr, CASE WHEN fr THEN qf ELSE qsr END AS qsr,
      CASE WHEN fr THEN lf ELSE l END AS l, CASE WHEN fr THEN sf ELSE sk END AS sk) FROM s10),
    sol AS (SELECT *, rhoa*usr*usr/(ut/U) AS o_tau, -rhoa*1004.67e0*usr*tsr AS o_hs, -rhoa*le*usr*qsr AS o_hl,
      usr*usr/(ut/U)/ut/greatest(0.1e0,U) AS o_cd, -usr*tsr/ut/(dt0-sk*{jc}) AS o_ch, -usr*qsr/ut/(dq-wetc*sk*{jc}) AS o_ce FROM fin)""")
    return ",".join(steps)


OK = "obs_ok AS (SELECT * FROM obs WHERE U IS NOT NULL), "
SIX = "SELECT event_id, o_tau AS tau, o_hs AS hs, o_hl AS hl, o_cd AS cd, o_ch AS ch, o_ce AS ce FROM sol"


@query("b2_bulk_36", using("obs", extra=OK + solver_sql()) + SIX, keys="event_id", digits=7)
def b2(spark, sf):
    return B.bulk36(obs(spark, sf)).select("event_id", "tau", "hs", "hl", "cd", "ch", "ce")


@query("b2_bulk_36_cool_skin", using("obs", extra=OK + solver_sql(cool=True)) + SIX, keys="event_id", digits=6)
def b2b(spark, sf):
    return B.bulk36(obs(spark, sf), cool_skin=True).select("event_id", "tau", "hs", "hl", "cd", "ch", "ce")


@query("b3_bulk_35", using("obs", extra=OK + solver_sql("3.5", cool=True)) + SIX, keys="event_id", digits=6)
def b3(spark, sf):
    return B.bulk35(obs(spark, sf), extended=False).select("event_id", "tau", "hs", "hl", "cd", "ch", "ce")


TEN = f"""x AS (SELECT *, U/ut AS calm, {psiu('zu/l')} AS pu, {psiu('1e1/l')} AS pu10, {psit('zt/l')} AS pt, {psit('1e1/l')} AS pt10 FROM sol),
  y AS (SELECT *, U + usr/0.4e0*calm*(ln(1e1/zu)-pu10+pu) AS w10, tair + tsr/0.4e0*(ln(1e1/zt)-pt10+pt) + g/1004.67e0*(zt-1e1) AS t10,
    1e3*(q + qsr/0.4e0*(ln(1e1/zq)-pt10+pt)) AS q10 FROM x)
  SELECT event_id, o_tau AS tau, o_hs AS hs, o_hl AS hl, o_cd AS cd, o_ch AS ch, o_ce AS ce, usr, tsr, qsr, zo, zoq, 1e3/l AS inverse_mol, zu/l AS zeta,
    sk AS dt_skin, 1e3*wetc*sk AS dq_skin, rhoa, le, 1e3*q AS q, 1e3*(qs-wetc*sk) AS qs, 36e2*o_hl/le AS evap, w10 AS u10, t10, q10,
    w10 + pu10*usr/0.4e0*calm AS u10n, t10 + pt10*tsr/0.4e0 AS t10n, q10 + pt10*1e3*qsr/0.4e0 AS q10n,
    1e2*((mb*q10/1e3)/(0.622e0+0.378e0*q10/1e3))/({es('t10', 'mb')}) AS rh10,
    U + pu*usr/0.4e0*calm AS un, 0.16e0/pow(ln(1e1/zo),2) AS cdn10, 0.16e0/(ln(1e1/zo)*ln(1e1/zoq)) AS chn10,
    -rhoa*1004.67e0*usr*(tsr+0.61e0*ta*qsr) AS hb, -rhoa*1004.67e0*usr*(tsr+0.51e0*ta*qsr) AS hb_sonic,
    rhoa*(1.61e0*o_hl/le/(1e0+1.61e0*q)/rhoa + o_hs/rhoa/1004.67e0/ta)*q*le AS hl_webb, 0.095e0*rhoa*(w10 + pu10*usr/0.4e0*calm)*usr*usr AS dissipation,
    dq, dt0 AS dt, ut, ut/U AS gf FROM y"""
ALL35 = ["event_id", "tau", "hs", "hl", "cd", "ch", "ce", "usr", "tsr", "qsr", "zo", "zoq", "inverse_mol", "zeta", "dt_skin", "dq_skin", "rhoa", "le", "q", "qs",
         "evap", "u10", "t10", "q10", "u10n", "t10n", "q10n", "rh10", "un", "cdn10", "chn10", "hb", "hb_sonic", "hl_webb", "dissipation", "dq", "dt", "ut", "gf"]


@query("b3_bulk_35_all_outputs", using("obs", extra=OK + solver_sql("3.5", cool=True) + ", " + TEN.split("\n  SELECT event_id")[0])
       + "SELECT event_id" + TEN.split("\n  SELECT event_id")[1], keys="event_id", digits=6)
def b3b(spark, sf):
    o = obs(spark, sf).select("event_id", "U", "tsea", "tair", "rh", "p", "zu", "zt", "zq", "lat")
    solved = B.bulk35(o, prefix="_o_").withColumn("_o_inverse_mol", 1e3 / F.col("_o_mol"))  # the length itself has no bound
    return solved.select("event_id", *[F.col(f"_o_{c}").alias(c) for c in ALL35[1:]])


@query("b4_profile_at_height", using("obs", extra=OK + solver_sql()) + f""", pr AS (SELECT *, U/ut AS calm, {psiu('2e0/l')} AS pu2, {psiu('zu/l')} AS pu,
    {psit('2e0/l')} AS pt2, {psit('zt/l')} AS pt FROM sol),
  rf AS (SELECT *, U + usr/0.4e0*calm*(ln(2e0/zu) - pu2 + pu) AS u2, tair + tsr/0.4e0*(ln(2e0/zt) - pt2 + pt) + g/1004.67e0*(zt-2e0) AS t2,
    1e3*(q + qsr/0.4e0*(ln(2e0/zq) - pt2 + pt)) AS q2, p/1e2 - 0.125e0*2e0 AS p2 FROM pr)
  SELECT event_id, u2 AS u_ref, t2 AS t_ref, q2 AS q_ref, 1e2*(p2*q2/1e3/(0.622e0+0.378e0*q2/1e3))/({es('t2', 'p2')}) AS rh_ref,
    u2 + pu2*usr/0.4e0*calm AS un_ref, t2 + pt2*tsr/0.4e0 AS tn_ref, q2 + pt2*1e3*qsr/0.4e0 AS qn_ref FROM rf""", keys="event_id", digits=6)
def b4(spark, sf):
    return B.profile_at(obs(spark, sf), 2.0).select("event_id", "u_ref", "t_ref", "q_ref", "rh_ref", "un_ref", "tn_ref", "qn_ref")


@query("b1_apply_bulk", using("obs", extra=OK + solver_sql(humidity="qair")) + """SELECT event_id, -o_hl AS hlb, -o_hs AS hsb, o_tau AS taubx,
  0e0 AS tauby FROM sol""", keys="event_id", digits=7)
def b1(spark, sf):
    return B.apply_bulk(obs(spark, sf)).select("event_id", "hlb", "hsb", "taubx", "tauby")


@query("b5_bulk_on_grid", using("obs", extra=OK + solver_sql(humidity="qair")) + """SELECT event_id,
  CASE WHEN qc = 0 THEN -o_hl END AS hlb, CASE WHEN qc = 0 THEN -o_hs END AS hsb,
  CASE WHEN qc = 0 THEN o_tau*cos(radians(wdir)) END AS tau_bx, CASE WHEN qc = 0 THEN o_tau*sin(radians(wdir)) END AS tau_by FROM sol""",
       keys="event_id", digits=6)
def b5(spark, sf):
    o = obs(spark, sf).withColumns({"ux": F.col("U") * F.cos(F.radians("wdir")), "uy": F.col("U") * F.sin(F.radians("wdir")),
                                    "mask": 1 - F.col("qc")}).drop("U")
    return B.bulk_grid(o, "mask").select("event_id", "hlb", "hsb", "tau_bx", "tau_by")


def _algo(name, version, cool):
    return (f"SELECT * FROM (WITH {solver_sql(version, humidity='qair', cool=cool)} "
            f"SELECT '{name}' AS algo, event_id, -o_hl AS hlb, -o_hs AS hsb, o_tau AS taubx FROM sol) AS {name}")


ALGOS = " UNION ALL ".join(_algo(*a) for a in (("bulk36", "3.6", False), ("bulk35", "3.5", True), ("bulk35_noskin", "3.5", False)))


@query("b6_compare_algorithms", using("obs", extra=OK.rstrip(", ")) + ALGOS, keys="algo, event_id", digits=6)
def b6(spark, sf):
    o = obs(spark, sf).select("event_id", "U", "tsea", "tair", "qair", "p", "zu", "zt", "zq", "lat")
    return B.compare_algos(o, ["bulk36", "bulk35", "bulk35_noskin"]).select("algo", "event_id", "hlb", "hsb", "taubx")


COEF = f"""co AS (SELECT *, 622e0*0.98e0*{es('tsea')}/(p/1e2-0.378e0*0.98e0*{es('tsea')})/1e3 AS qsea, (2.501e0-0.00237e0*tsea)*1e6 AS le,
   (tair+273.15e0)*(1e0+0.61e0*qair) AS tv, (p-12.5e0*zq)/(287.1e0*(tair+273.15e0)*(1e0+0.61e0*qair)) AS rho FROM obs_ok)"""


@query("b7_exchange_coefficients", using("obs", extra=OK + COEF) + """SELECT event_id, rho AS rhoair,
  hlc/(U*(qair-qsea)*le*rho) AS CE, hsc/nullif(U*(tair+0.0098e0*zt-tsea)*1004.67e0*rho, 0) AS CT, taucx/(U*U*rho) AS CD,
  hlb/(U*(qair-qsea)*le*rho) AS bulk_CE, hsb/nullif(U*(tair+0.0098e0*zt-tsea)*1004.67e0*rho, 0) AS bulk_CT, taubx/(U*U*rho) AS bulk_CD,
  CASE WHEN taucx >= 0 THEN taucx*sqrt(taucx/rho)/(0.4e0*9.8e0*(hsc/1004.67e0/tv + 0.61e0*hlc/le + 1e-8)) END AS MOL FROM co""",
       keys="event_id", digits=6)
def b7(spark, sf):
    return B.exchange_coeffs(obs(spark, sf)).select("event_id", "rhoair", "CE", "CT", "CD", "bulk_CE", "bulk_CT", "bulk_CD", "MOL")


POINT = "pt AS (SELECT event_id, U, tsea, tair, rh, p, 1e1 AS zu, 1e1 AS zt, 1e1 AS zq, 4.5e1 AS lat FROM obs WHERE U IS NOT NULL), "


@query("b8_flux_point", using("obs", extra=POINT + solver_sql(src="pt")) + SIX, keys="event_id", digits=7)
def b8(spark, sf):
    o = obs(spark, sf).select("event_id", "U", "tsea", "tair", "rh", "p")
    return B.flux_point(o).select("event_id", "tau", "hs", "hl", "cd", "ch", "ce")


@query("b9_flux_difference", using("obs") + """SELECT event_id, hsc-hsb AS dq_s, hlc-hlb AS dq_l, (hsc-hsb)+(hlc-hlb) AS dq_total
  FROM obs""", keys="event_id")
def b9(spark, sf):
    return B.flux_delta(view(spark, sf, "obs"), ("hsc", "hlc")).select("event_id", "dq_s", "dq_l", "dq_total")


RAW = "raw AS (SELECT *, -hsc AS r_hs, -hlc AS r_hl, qair*1e3 AS qa, p/1e2 AS dummy1 FROM obs WHERE U IS NOT NULL), "


@query("s1_cruise_loader", using("obs", extra=OK + solver_sql(humidity="qair")) + """SELECT event_id, pcode, U, tsea, tair, qair, p, rh, wdir,
  hsc, hlc, taucx, -o_hl AS hlb, -o_hs AS hsb, o_tau AS taubx FROM sol""", keys="event_id, pcode", digits=6)
def s1(spark, sf):
    src = view(spark, sf, "obs").select(
        "event_id", "time", "pcode", "U", F.col("tsea").alias("tsnk"), F.col("tair").alias("ta"), (F.col("qair") * 1e3).alias("qa"),
        (F.col("p") / 100).alias("dummy1"), F.col("rh").alias("dummy2"), F.col("wdir").alias("dir"), "zu", "zt", "zq", "lon", "lat",
        "taucx", "taucy", (-F.col("hsc")).alias("hsc"), (-F.col("hlc")).alias("hlc"))
    return L.load_cruise(src, keep=["event_id"]).select("event_id", "pcode", "U", "tsea", "tair", "qair", "p", "rh", "wdir", "hsc", "hlc",
                                                        "taucx", "hlb", "hsb", "taubx")


@query("s2_campaign_loader", using("obs") + """SELECT event_id, taucx, taucy, hsc, hlc, U, tsea, tair, qair, rh, zu, zt, zt AS zq, wdir,
  tair AS cspd FROM obs WHERE U IS NOT NULL""", keys="event_id")
def s2(spark, sf):
    o = view(spark, sf, "obs")
    src = o.select("event_id", F.col("taucx").alias("tau_streamwise_cov"), F.col("taucy").alias("tau_crossstream_cov"),
                   F.col("taubx").alias("tau_bulk"), F.col("hlc").alias("hl_cov"), F.col("hsc").alias("hs_cov"), F.col("U").alias("wspd"),
                   "tsea", "tair", (F.col("qair") * 1e3).alias("qair"), F.col("rh").alias("rhair"), "zu", F.col("zt").alias("ztq"), "wdir",
                   F.col("tair").alias("cspd"), F.col("tsea").alias("cdir"), F.col("rh").alias("wave_height"),
                   F.col("rh").alias("wave_period"), F.col("qc").alias("wave_flag"))
    return L.load_campaign(src, keep=["event_id"]).select("event_id", "taucx", "taucy", "hsc", "hlc", "U", "tsea", "tair", "qair", "rh",
                                                          "zu", "zt", "zq", "wdir", "cspd")
