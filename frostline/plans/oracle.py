"""Independent SQL (DuckDB dialect) for every registered query.

Written from the semantics, in the plain global-window style (ORDER BY over the
whole table, scalar subqueries, LIMIT 1), so it cross-checks the bucketed Spark
plans.  Each query starts from the same ``events`` adapter projection.
"""

from __future__ import annotations

from frostline.functions.thermal import EM_STAGE_KEYS
from frostline.schema import (
    DASHBOARD_KEYS, METRICS_LATEST_COLUMNS, MINMAX_24H_COLUMNS, PRETTY_NAMES, READING_COLUMNS,
    RUNTIME_PUMPS, STATE_KEYS,
)
from frostline.sources.events import oracle_readings_cte

R = oracle_readings_cte()
AS_OF = "(SELECT max(ts_eastern) FROM readings)"
HOURS = "3600000000.0"
STARTS_PUMPS = ["pulse_tube", "turbo_1", "scroll_1", "scroll_2"]
RUNTIME_COLS = [f"total_hours_{p}" for p in RUNTIME_PUMPS]


def _d(dev: bool, comma: bool = True) -> str:
    return ("device_id, " if comma else "device_id") if dev else ""


def _part(dev: bool) -> str:
    return "PARTITION BY device_id " if dev else ""


def _group(dev: bool) -> str:
    return " GROUP BY device_id" if dev else ""


def _runtime(dev: bool) -> str:
    sums = ", ".join(
        f"CAST(SUM(CASE WHEN pu IS NOT NULL AND COALESCE({p}, 0) >= 0.5 THEN us - pu ELSE 0 END) AS DOUBLE)"
        f" / {HOURS} AS total_hours_{p}" for p in RUNTIME_PUMPS)
    return (f"SELECT {_d(dev)}{sums} FROM (SELECT {_d(dev)}epoch_us(ts_eastern) AS us, "
            f"LAG(epoch_us(ts_eastern)) OVER ({_part(dev)}ORDER BY ts_eastern) AS pu, "
            f"{', '.join(RUNTIME_PUMPS)} FROM readings){_group(dev)}")


def _cold_total(dev: bool) -> str:
    return (f"SELECT {_d(dev)}CAST(SUM(CASE WHEN T_MXC < 0.02 AND nu IS NOT NULL THEN nu - us ELSE 0 END)"
            f" AS DOUBLE) / {HOURS} AS hours_below_20mK_total FROM (SELECT {_d(dev)}T_MXC, "
            f"epoch_us(ts_eastern) AS us, LEAD(epoch_us(ts_eastern)) OVER ({_part(dev)}ORDER BY ts_eastern)"
            f" AS nu FROM readings){_group(dev)}")


def _streak(dev: bool) -> str:
    corr = "r.device_id = a.device_id AND " if dev else ""
    return (f"SELECT {_d(dev)}CASE WHEN a.lv < 0.02 THEN CAST(epoch_us(a.lt) - epoch_us(COALESCE("
            f"(SELECT min(r.ts_eastern) FROM readings r WHERE {corr}r.ts_eastern > a.lw), a.mn)) AS DOUBLE)"
            f" / {HOURS} ELSE 0.0 END AS hours_below_20mK_current FROM (SELECT {_d(dev)}"
            f"max(ts_eastern) AS lt, arg_max_null(T_MXC, ts_eastern) AS lv, "
            f"max(ts_eastern) FILTER (WHERE T_MXC >= 0.02) AS lw, min(ts_eastern) AS mn "
            f"FROM readings{_group(dev)}) a")


def _window(dev: bool, hours: int = 24) -> str:
    lags = ", ".join(f"LAG({p}) OVER ({_part(dev)}ORDER BY ts_eastern) AS prev_{p}" for p in STARTS_PUMPS)
    starts = ", ".join(
        f"CAST(SUM(CASE WHEN COALESCE(prev_{p}, 0) < 0.5 AND COALESCE({p}, 0) >= 0.5 THEN 1 ELSE 0 END)"
        f" AS BIGINT) AS {p}_starts_24h" for p in STARTS_PUMPS)
    mm = ", ".join(f"{f}({c}) AS {c}_{f}_24h" for c in MINMAX_24H_COLUMNS for f in ("min", "max"))
    return (f"SELECT {_d(dev)}{mm}, {starts} FROM (SELECT {_d(dev)}{', '.join(MINMAX_24H_COLUMNS)}, "
            f"{', '.join(STARTS_PUMPS)}, {lags} FROM readings "
            f"WHERE ts_eastern >= {AS_OF} - INTERVAL {hours} HOUR){_group(dev)}")


def _latest(dev: bool, cols, where: str = "") -> str:
    values = [c for c in cols if c != "ts_eastern"]
    order = ", ".join(["ts_eastern DESC", *[f"{c} DESC NULLS LAST" for c in values]])
    return (f"SELECT {_d(dev)}{', '.join(cols)} FROM (SELECT *, row_number() OVER ({_part(dev)}ORDER BY {order}) AS rn "
            f"FROM readings {where}) WHERE rn = 1")


def _metrics(dev: bool) -> str:
    lcols = [c for c in METRICS_LATEST_COLUMNS if c not in RUNTIME_COLS]
    out = []
    for c in METRICS_LATEST_COLUMNS:
        out.append(f"rh.{c}" if c in RUNTIME_COLS else f"l.{c}")
    out += [f"w.{c}_{f}_24h" for c in MINMAX_24H_COLUMNS for f in ("min", "max")]
    out += ["c.hours_below_20mK_total", "s.hours_below_20mK_current"]
    out += [f"w.{p}_starts_24h" for p in STARTS_PUMPS]
    if dev:
        joins = ("l LEFT JOIN w USING (device_id) LEFT JOIN rh USING (device_id) "
                 "LEFT JOIN c USING (device_id) LEFT JOIN s USING (device_id)")
        head = "l.device_id, "
    else:
        joins = "l, w, rh, c, s"
        head = ""
    return (f"{R}, l AS ({_latest(dev, lcols)}), w AS ({_window(dev)}), rh AS ({_runtime(dev)}), "
            f"c AS ({_cold_total(dev)}), s AS ({_streak(dev)})\nSELECT {head}{', '.join(out)} FROM {joins}")


def _unpivot(cols, where: str = "", dev: bool = False, value: str = "value") -> str:
    return (f"(UNPIVOT (SELECT {_d(dev)}ts_eastern, {', '.join(cols)} FROM readings {where}) "
            f"ON {', '.join(cols)} INTO NAME key VALUE {value})")


def _in_window(hours: int) -> str:
    return f"WHERE ts_eastern >= {AS_OF} - INTERVAL {hours} HOUR"


def _series_starts(src: str, dev: bool) -> str:
    g = "device_id, key" if dev else "key"
    on = "USING (device_id, key)" if dev else "USING (key)"
    return (f"SELECT {g}, CASE WHEN count(*) < 2 THEN CAST(0 AS BIGINT) ELSE CAST(SUM(CASE WHEN "
            f"COALESCE(pv, 0.0) < 0.5 AND value >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) END AS starts FROM ("
            f"SELECT s.*, LAG(s.value) OVER (PARTITION BY {', '.join('s.' + x for x in g.split(', '))} "
            f"ORDER BY s.ts_eastern) AS pv FROM {src} s JOIN (SELECT {g}, max(ts_eastern) AS mx FROM {src} "
            f"GROUP BY {g}) e {on} WHERE s.ts_eastern >= e.mx - INTERVAL 24 HOUR) GROUP BY {g}")


def _time_below(dev: bool) -> str:
    return (f"SELECT {_d(dev)}'T_MXC' AS key, COALESCE(CAST(SUM(CASE WHEN value < 0.02 AND nu IS NOT NULL "
            f"AND nu - us >= 0 THEN nu - us ELSE 0 END) AS DOUBLE) / {HOURS}, 0.0) AS hours_below FROM ("
            f"SELECT {_d(dev)}T_MXC AS value, epoch_us(ts_eastern) AS us, LEAD(epoch_us(ts_eastern)) OVER "
            f"({_part(dev)}ORDER BY ts_eastern) AS nu FROM readings WHERE T_MXC IS NOT NULL){_group(dev)}")


def _slope(src: str, dev: bool) -> str:
    """W7 over a series CTE ``src`` with columns (device_id?, key, ts_eastern, value)."""
    g = "device_id, key" if dev else "key"
    using = "USING (device_id, key)" if dev else "USING (key)"
    sg = ", ".join("s." + x for x in g.split(", "))
    return (
        f"SELECT {g}, CASE WHEN n >= 2 AND cnt >= 2 AND dus > 0 THEN (v1 - v0) / (CAST(dus AS DOUBLE) / {HOURS})"
        f" END AS slope_per_h FROM (SELECT {g}, max(n) AS n, count(value) AS cnt, arg_min(value, ts_eastern) AS v0,"
        f" arg_max(value, ts_eastern) AS v1, epoch_us(max(ts_eastern) FILTER (WHERE value IS NOT NULL)) - "
        f"epoch_us(min(ts_eastern) FILTER (WHERE value IS NOT NULL)) AS dus FROM ("
        f"SELECT t.* FROM (SELECT s.*, e.n, s.ts_eastern >= e.mx - INTERVAL 3 HOUR AS in_w, row_number() OVER "
        f"(PARTITION BY {sg} ORDER BY s.ts_eastern DESC) AS rd FROM {src} s JOIN (SELECT {g}, "
        f"max(ts_eastern) AS mx, count(*) AS n FROM {src} GROUP BY {g}) e {using}) t JOIN (SELECT {g}, "
        f"count(*) FILTER (WHERE in_w) AS wn FROM (SELECT s.*, s.ts_eastern >= e.mx - INTERVAL 3 HOUR AS in_w "
        f"FROM {src} s JOIN (SELECT {g}, max(ts_eastern) AS mx FROM {src} GROUP BY {g}) e {using}) "
        f"GROUP BY {g}) c {using} WHERE (c.wn >= 2 AND t.in_w) OR (c.wn < 2 AND t.rd <= 12)) GROUP BY {g})")


def _fresh(snap: str, hist_src: str, keys, dev: bool) -> str:
    """Snapshot CTE ``snap`` (wide, one row per device) + long series ``hist_src``."""
    g = "device_id, key" if dev else "key"
    d = "device_id, " if dev else ""
    sv = " UNION ALL ".join(f"SELECT {d}'{k}' AS key, ts_eastern AS sts, CAST({k} AS DOUBLE) AS sv FROM {snap}"
                            for k in keys)
    klist = ", ".join(f"'{k}'" for k in keys)
    return (f"SELECT {g}, CASE WHEN hv IS NOT NULL AND (sts IS NULL OR (hts IS NOT NULL AND hts >= sts)) "
            f"THEN hv ELSE COALESCE(sv, hv) END AS value FROM ({sv}) sn FULL OUTER JOIN (SELECT {g}, "
            f"arg_max(value, ts_eastern) AS hv, max(ts_eastern) FILTER (WHERE value IS NOT NULL) AS hts FROM "
            f"{hist_src} WHERE key IN ({klist}) GROUP BY {g}) hi USING ({g})")


def _pivot(src: str, keys, dev: bool) -> str:
    cols = ", ".join(f"max(value) FILTER (WHERE key = '{k}') AS {k}" for k in keys)
    return f"SELECT {_d(dev)}{cols} FROM {src}{_group(dev)}"


def _f(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _chain_sql(cols: dict) -> dict:
    """E1 as SQL expressions over stage temperature expressions; returns teff per
    stage.  Constants written out: Planck, Boltzmann, 5 GHz, a room of 300 K, and
    losses of 0, 20, 20 and 20 dB (factors 1, 100, 100, 100)."""
    hfk = "(6.62607015e-34::DOUBLE * 5e9::DOUBLE / 1.380649e-23::DOUBLE)"

    def tn(t):
        return (f"(CASE WHEN {t} IS NULL OR isnan({t}) OR isinf({t}) OR {t} <= 0 THEN NULL ELSE "
                f"1.0 / (exp({hfk} / greatest({t}, 1e-9::DOUBLE)) - 1.0) END)")

    def teff(n):
        return (f"(CASE WHEN {n} IS NULL OR isnan({n}) OR isinf({n}) OR {n} < 0 THEN NULL ELSE "
                f"{hfk} / ln(1.0 + 1.0 / greatest({n}, 1e-20::DOUBLE)) END)")

    n_in = tn("300.0::DOUBLE")
    out = {}
    for s, loss in zip(EM_STAGE_KEYS, (1, 100, 100, 100), strict=True):
        if loss > 1:
            n_in = f"({n_in} / {loss}.0::DOUBLE + (1.0::DOUBLE - 1.0::DOUBLE / {loss}.0::DOUBLE) * {tn(cols[s])})"
        out[s] = teff(n_in)
    return out


def _classify_sql(mxc, still, pon, sl, lv, age) -> str:
    """The decision list, thresholds and texts written out (first match wins)."""
    mk = lambda v: f"printf('%.1f', {v} * 1000.0) || ' mK'"

    def arm(when, label, detail, tone):
        return f" WHEN {when} THEN struct_pack(label := '{label}', detail := {detail}, tone := '{tone}')\n"

    def text(t):
        return f"'{t}'"

    d = lambda x: f"CAST({x} AS DOUBLE)"
    up = f"(CASE WHEN {mxc} < {d(0.05)} THEN {d(0.006)} ELSE {d(0.01)} END)"
    has_still = f"{still} IS NOT NULL"
    return "CASE" + "".join([
        arm(f"{mxc} IS NULL AND {lv} IS NOT NULL AND {age} IS NOT NULL AND {age} <= 3.0 AND {lv} <= {d(0.009)} AND {pon}", "Below sensor range",
            f"'Last valid MXC point was ' || {mk(lv)} || '; the fridge appears colder than the readable sensor floor.'", "sensor-floor"),
        arm(f"{mxc} IS NULL", "Unknown", text("MXC reading unavailable."), "default"),
        arm(f"{mxc} >= 20.0 OR ({has_still} AND {still} >= 250.0)", "Warm", text("Cryostat is still near ambient temperature and far from base."), "default"),
        arm(f"{sl} IS NOT NULL AND {sl} >= {up}", "Warming up", text("MXC is trending warmer."), "warming"),
        arm(f"{mxc} <= {d(0.01)} OR ({mxc} <= {d('0.01')} + {d('0.005')} AND ({sl} IS NULL OR abs({sl}) <= {d(0.004)}))", "At base",
            f"'MXC is at ' || {mk(mxc)} || ' and within the base-temperature band.'", "base"),
        arm(f"{pon} AND ({mxc} >= 1.0 OR ({has_still} AND {still} >= 10.0))", "Precooling",
            text("Cryostat is far above base and still in the warm part of the cooldown."), "cooling"),
        arm(f"{sl} IS NOT NULL AND {sl} <= -{up}", "Cooling down", text("MXC is still trending colder."), "cooling"),
        arm(f"NOT {pon} AND ({mxc} >= {d(0.02)} OR ({has_still} AND {still} > 1.0))", "Warming up", text("Cooling hardware is not fully engaged."), "warming"),
        arm(f"{pon} AND {mxc} >= {d(0.02)}", "Cooling down", text("Cooling hardware is active above base temperature."), "cooling"),
        arm(f"{mxc} < {d(0.02)}", "At base", text("Cryostat is holding near its base temperature."), "base"),
    ]) + " ELSE struct_pack(label := 'Cooling down', detail := 'Cryostat is settling toward a colder state.', tone := 'cooling') END"


def _pumps_on(prefix: str = "") -> str:
    return "(" + " OR ".join(f"COALESCE({prefix}{p} >= 0.5, false)" for p in STATE_KEYS) + ")"


def _fridge(dev: bool, hours: int) -> str:
    keys = ["T_MXC", "T_Still", *STATE_KEYS]
    g = "device_id, " if dev else ""
    using = "USING (device_id)" if dev else "ON true"
    lcols = ["ts_eastern", *DASHBOARD_KEYS]
    hist = f"(SELECT * FROM ser WHERE ts_eastern >= {AS_OF} - INTERVAL {hours} HOUR)"
    return (
        f"{R}, snap AS ({_latest(dev, lcols)}), ser AS (SELECT * FROM {_unpivot(DASHBOARD_KEYS, dev=dev)}), "
        f"hist AS {hist}, fresh AS ({_pivot('(' + _fresh('snap', 'hist', keys, dev) + ')', keys, dev)}), "
        f"mx AS (SELECT * FROM hist WHERE key = 'T_MXC'), sl AS ({_slope('mx', dev)}), "
        f"lv AS (SELECT {g}arg_max(value, ts_eastern) AS lv, max(ts_eastern) AS lvts FROM mx{_group(dev)}), "
        f"lt AS (SELECT {g}max(ts_eastern) AS hts FROM hist{_group(dev)}), "
        f"allin AS (SELECT {'snap.device_id, ' if dev else ''}snap.ts_eastern AS sts, fresh.T_MXC AS mxc, fresh.T_Still AS still, "
        f"{', '.join('fresh.' + p + ' AS ' + p for p in STATE_KEYS)}, sl.slope_per_h AS sl, lv.lv, lv.lvts, lt.hts "
        f"FROM snap LEFT JOIN fresh {using} LEFT JOIN sl {using} LEFT JOIN lv {using} LEFT JOIN lt {using}), "
        f"cls AS (SELECT *, {_classify_sql('mxc', 'still', _pumps_on(), 'sl', 'lv', 'greatest(0.0, CAST(epoch_us(greatest(sts, hts)) - epoch_us(lvts) AS DOUBLE) / ' + HOURS + ')')} AS c FROM allin)\n"
        f"SELECT {g}c.label AS label, c.detail AS detail, c.tone AS tone FROM cls")


def _state_hours() -> str:
    """Every bucket end by itself: the points up to there, their last three hours, or else their last twelve."""
    b, lb = 3600000000, 3 * 3600000000
    last = ", ".join(f"arg_max({p}, us) AS {p}" for p in STATE_KEYS)
    ff = ", ".join(f"last_value({p} IGNORE NULLS) OVER wf AS {p}" for p in STATE_KEYS)
    sl = f"(CASE WHEN cnt >= 2 AND dus > 0 THEN (v1 - v0) / (CAST(dus AS DOUBLE) / {HOURS}) END)"
    age = f"greatest(0.0, CAST(lst - lvts AS DOUBLE) / {HOURS})"
    return (
        f"{R}, b AS (SELECT epoch_us(ts_eastern) AS us, epoch_us(ts_eastern) - (epoch_us(ts_eastern) % {b}) AS b, "
        f"T_MXC AS mxc, T_Still AS still, {', '.join(STATE_KEYS)} FROM readings), "
        f"pts AS (SELECT us, mxc FROM b WHERE mxc IS NOT NULL), "
        f"p AS (SELECT b, min(us) AS fst, max(us) AS lst, arg_max_null(mxc, us) AS own, arg_max(still, us) AS still, {last} FROM b GROUP BY b), "
        f"ends AS (SELECT p.b, max(q.us) AS end_us FROM p JOIN pts q ON q.us <= p.lst GROUP BY p.b), "
        f"w AS (SELECT e.b, q.us, q.mxc, q.us >= e.end_us - {lb} AS in_w, row_number() OVER (PARTITION BY e.b ORDER BY q.us DESC) AS rd "
        f"FROM ends e JOIN pts q ON q.us <= e.end_us), "
        f"wn AS (SELECT b, count(*) FILTER (WHERE in_w) AS n FROM w GROUP BY b), "
        f"sl AS (SELECT b, count(*) AS cnt, max(us) - min(us) AS dus, arg_min(mxc, us) AS v0, arg_max(mxc, us) AS v1, max(us) AS lvts "
        f"FROM w JOIN wn USING (b) WHERE (n >= 2 AND in_w) OR (n < 2 AND rd <= 12) GROUP BY b), "
        f"t AS (SELECT p.b, fst, lst, own, v1 AS lv, lvts, cnt, dus, v0, v1, last_value(still IGNORE NULLS) OVER wf AS still, {ff}, "
        f"lead(fst) OVER (ORDER BY p.b) AS nfst FROM p LEFT JOIN sl USING (b) "
        f"WINDOW wf AS (ORDER BY p.b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), "
        f"c AS (SELECT ({_classify_sql('own', 'still', _pumps_on(), sl, 'lv', age)}).label AS label, "
        f"COALESCE(nfst, lst) - fst AS dur FROM t)\n"
        f"SELECT label, CAST(SUM(dur) AS DOUBLE) / {HOURS} AS hours, count(*) AS buckets FROM c GROUP BY label")


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["runtime_hours"] = f"{R}\n{_runtime(False)}"
    q["runtime_hours_by_device"] = f"{R}\n{_runtime(True)}"
    q["cold_hours_total"] = f"{R}\n{_cold_total(False)}"
    q["cold_streak"] = f"""{R}, latest AS (SELECT ts_eastern, T_MXC FROM readings ORDER BY ts_eastern DESC LIMIT 1),
last_warm AS (SELECT MAX(ts_eastern) AS ts FROM readings WHERE T_MXC >= 0.02)
SELECT CASE WHEN (SELECT T_MXC FROM latest) < 0.02 THEN CAST(epoch_us((SELECT ts_eastern FROM latest)) - epoch_us(
  COALESCE((SELECT MIN(ts_eastern) FROM readings WHERE ts_eastern > (SELECT ts FROM last_warm)),
           (SELECT MIN(ts_eastern) FROM readings))) AS DOUBLE) / {HOURS} ELSE 0.0 END AS hours_below_20mK_current"""
    q["cold_streak_by_device"] = f"{R}\n{_streak(True)}"
    sp = ", ".join(f"{p}_starts_24h" for p in STARTS_PUMPS)
    q["pump_starts_24h"] = f"{R}\nSELECT {sp} FROM ({_window(False)})"
    every = "(SELECT DISTINCT device_id FROM readings)"
    q["pump_starts_24h_by_device"] = f"{R}\nSELECT device_id, {sp} FROM {every} LEFT JOIN ({_window(True)}) USING (device_id)"
    mm = ", ".join(f"{f}({c}) AS {c}_{f}_24h" for c in MINMAX_24H_COLUMNS for f in ("min", "max"))
    q["minmax_24h"] = f"{R}\nSELECT {mm} FROM readings {_in_window(24)}"
    q["minmax_24h_by_device"] = (f"{R}\nSELECT device_id, {mm.replace('min(', 'min(w.').replace('max(', 'max(w.')} FROM {every} d "
                                 f"LEFT JOIN (SELECT * FROM readings {_in_window(24)}) w USING (device_id) GROUP BY device_id")
    q["latest_reading"] = f"{R}\n{_latest(False, METRICS_LATEST_COLUMNS)}"
    q["latest_per_device"] = f"{R}\n{_latest(True, METRICS_LATEST_COLUMNS)}"
    sel = ", ".join(f"rh.{c}" if c in RUNTIME_COLS else f"l.{c}" for c in READING_COLUMNS)
    q["latest_overlay"] = (f"{R}, l AS (SELECT * FROM readings ORDER BY ts_eastern DESC LIMIT 1), "
                           f"rh AS ({_runtime(False)})\nSELECT {sel} FROM l, rh")
    q["metrics_snapshot"] = _metrics(False)
    q["metrics_by_device"] = _metrics(True)
    q["health"] = (f"{R}\nSELECT 'ok' AS status, count(*) AS rows, count(DISTINCT source_file) AS files, "
                   f"max(ts_eastern) AS latest_ts_eastern FROM readings")
    q["history_mxc"] = f"{R}\nSELECT ts_eastern, T_MXC AS value FROM readings {_in_window(24)}"
    q["history_sampled"] = (
        f"{R}, w AS (SELECT ts_eastern, T_MXC AS value, row_number() OVER (ORDER BY ts_eastern) - 1 AS p, "
        f"count(*) OVER () AS n FROM readings {_in_window(720)})\n"
        f"SELECT ts_eastern, value FROM w WHERE n <= 100 OR p % CAST(ceil(n / 100.0) AS BIGINT) = 0 OR p = n - 1")
    q["history_payload"] = (
        f"{R}, w AS (SELECT ts_eastern, T_MXC AS value, row_number() OVER (ORDER BY ts_eastern) - 1 AS p, "
        f"count(*) OVER () AS n FROM readings {_in_window(720)})\n"
        f"SELECT ts_eastern, value FROM w WHERE n <= 1200 OR p % CAST(ceil(n / 1200.0) AS BIGINT) = 0 OR p = n - 1")
    dk = ", ".join(DASHBOARD_KEYS)
    q["dashboard_series"] = (
        f"{R}, w AS (SELECT ts_eastern, {dk}, row_number() OVER (ORDER BY ts_eastern) - 1 AS p, "
        f"count(*) OVER () AS n FROM readings {_in_window(168)}), s AS (SELECT ts_eastern, {dk} FROM w "
        f"WHERE n <= 100 OR p % CAST(ceil(n / 100.0) AS BIGINT) = 0 OR p = n - 1)\n"
        f"SELECT key, ts_eastern, value FROM (UNPIVOT s ON {dk} INTO NAME key VALUE value)")
    st = _unpivot(STATE_KEYS)
    q["duty_cycle"] = (f"{R}\nSELECT key, avg(CASE WHEN value >= 0.5 THEN CAST(1.0 AS DOUBLE) ELSE "
                       f"CAST(0.0 AS DOUBLE) END) * 100.0 AS duty_pct FROM {st} GROUP BY key")
    q["series_starts"] = f"{R}, st AS (SELECT * FROM {st})\n{_series_starts('st', False)}"
    q["series_starts_by_device"] = (f"{R}, st AS (SELECT * FROM {_unpivot(STATE_KEYS, dev=True)})\n"
                                    f"{_series_starts('st', True)}")
    q["hours_below"] = f"{R}\n{_time_below(False)}"
    q["hours_below_by_device"] = f"{R}\n{_time_below(True)}"
    q["mxc_slope"] = f"{R}, mx AS (SELECT * FROM {_unpivot(['T_MXC'])})\n{_slope('mx', False)}"
    q["mxc_slope_by_device"] = f"{R}, mx AS (SELECT * FROM {_unpivot(['T_MXC'], dev=True)})\n{_slope('mx', True)}"
    q["last_valid_point"] = (f"{R}\nSELECT key, arg_max(value, ts_eastern) AS value, max(ts_eastern) AS ts_eastern "
                             f"FROM {_unpivot(DASHBOARD_KEYS)} GROUP BY key")
    from frostline.schema import FLOW_KEYS, PRESSURE_KEYS, TEMPERATURE_KEYS
    dim = ([(k, "temperature", "'K'") for k in TEMPERATURE_KEYS] + [(k, "pressure", "'mbar'") for k in PRESSURE_KEYS]
           + [(k, "flow", "NULL") for k in FLOW_KEYS] + [(k, "state", "NULL") for k in STATE_KEYS]
           + [(f"total_hours_{p}", "runtime", "'h'") for p in RUNTIME_PUMPS])
    dim_sql = " UNION ALL ".join(f"SELECT '{k}' AS key, '{PRETTY_NAMES.get(k, k)}' AS label, '{g}' AS grp, "
                                 f"CAST({u} AS VARCHAR) AS unit" for k, g, u in dim)
    q["labeled_last_values"] = (
        f"{R}, lv AS (SELECT key, arg_max(value, ts_eastern) AS value, max(ts_eastern) AS ts_eastern "
        f"FROM {_unpivot(DASHBOARD_KEYS)} GROUP BY key), dim AS ({dim_sql})\n"
        f"SELECT lv.key, dim.label, dim.grp, dim.unit, lv.value, lv.ts_eastern FROM lv LEFT JOIN dim USING (key)")
    q["freshest_values"] = (
        f"{R}, snap AS ({_latest(False, ['ts_eastern', *DASHBOARD_KEYS])}), "
        f"hist AS (SELECT * FROM {_unpivot(DASHBOARD_KEYS, _in_window(24))})\n"
        f"{_fresh('snap', 'hist', DASHBOARD_KEYS, False)}")
    cols = ["ts_eastern", *DASHBOARD_KEYS]
    fb = _latest(True, cols, f"WHERE ts_eastern < {AS_OF} - INTERVAL 24 HOUR")
    q["overlay_records"] = (
        f"{R}, p AS ({_latest(True, cols)}), f AS ({fb})\nSELECT device_id, "
        + ", ".join(f"COALESCE(p.{c}, f.{c}) AS {c}" for c in cols) + " FROM p FULL OUTER JOIN f USING (device_id)")
    q["overlay_series"] = (
        f"{R}, s AS (SELECT * FROM {_unpivot(DASHBOARD_KEYS, dev=True)}), "
        f"p AS (SELECT * FROM s {_in_window(24)}), f AS (SELECT * FROM s {_in_window(72)})\n"
        f"SELECT device_id, key, ts_eastern, value FROM p UNION ALL SELECT device_id, key, ts_eastern, value FROM f "
        f"WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.device_id = f.device_id AND p.key = f.key)")
    stages = ", ".join(f"arg_max(value, ts_eastern) FILTER (WHERE key = '{s}') AS {s}" for s in EM_STAGE_KEYS)
    sm = (f"SELECT m AS ts_eastern, {', '.join(EM_STAGE_KEYS)} FROM (SELECT date_trunc('minute', ts_eastern) AS m, "
          f"{stages} FROM {_unpivot(EM_STAGE_KEYS)} GROUP BY 1)")
    q["stage_minutes"] = f"{R}\n{sm}"
    ch = _chain_sql({s: s for s in EM_STAGE_KEYS})
    q["em_history"] = (f"{R}, sm AS ({sm}), ch AS (SELECT ts_eastern, "
                       + ", ".join(f"{ch[s]} AS {s}" for s in EM_STAGE_KEYS) + " FROM sm)\n"
                       + " UNION ALL ".join(f"SELECT '{s}' AS key, ts_eastern, round({s}, 6) AS value FROM ch"
                                            for s in EM_STAGE_KEYS))
    missing = "NULLIF(concat_ws(', ', " + ", ".join(
        f"CASE WHEN {s} IS NULL THEN '{PRETTY_NAMES[s]}' END" for s in EM_STAGE_KEYS) + "), '')"
    complete = " AND ".join(f"{s} IS NOT NULL" for s in EM_STAGE_KEYS)
    def em_latest(dev: bool) -> str:
        g = "device_id, " if dev else ""
        ser = _unpivot(DASHBOARD_KEYS, dev=dev)
        fr = _pivot("(" + _fresh("snap", "ser", EM_STAGE_KEYS, dev) + ")", EM_STAGE_KEYS, dev)
        return (f"{R}, snap AS ({_latest(dev, ['ts_eastern', *DASHBOARD_KEYS])}), ser AS (SELECT * FROM {ser}), "
                f"fr AS ({fr})\nSELECT {g}{', '.join(EM_STAGE_KEYS)}, {missing} AS missing_stages, "
                + ", ".join(f"CASE WHEN {complete} THEN round({ch[s]}, 6) END AS teff_{s}" for s in EM_STAGE_KEYS)
                + " FROM fr")

    q["em_latest"] = em_latest(False)
    q["em_latest_by_device"] = em_latest(True)
    q["fridge_state"] = _fridge(False, 24)
    q["fridge_state_by_device"] = _fridge(True, 72)
    q["state_hours"] = _state_hours()
    win = _unpivot(STATE_KEYS, _in_window(24))
    cur = " UNION ALL ".join(f"SELECT '{p}' AS key, {p} AS cv FROM l" for p in STATE_KEYS)
    hrs = " UNION ALL ".join(f"SELECT '{p}' AS key, total_hours_{p} AS hours FROM rh" for p in RUNTIME_PUMPS)
    sts = " UNION ALL ".join(f"SELECT '{p}' AS key, {p}_starts_24h AS w4 FROM ws" for p in STARTS_PUMPS)
    q["ops_summary"] = (
        f"{R}, l AS (SELECT * FROM readings ORDER BY ts_eastern DESC LIMIT 1), rh AS ({_runtime(False)}), "
        f"ws AS ({_window(False)}), win AS (SELECT * FROM {win}), duty AS (SELECT key, avg(CASE WHEN value >= 0.5 "
        f"THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END) * 100.0 AS duty_pct FROM win GROUP BY key), "
        f"w5 AS ({_series_starts('win', False)})\n"
        f"SELECT key, CASE WHEN cv IS NULL OR isnan(cv) THEN 'Unknown' WHEN cv >= 0.5 THEN 'On' ELSE 'Off' END "
        f"AS state, hours, duty_pct, COALESCE(w4, w5.starts) AS starts_24h FROM ({cur}) c LEFT JOIN ({hrs}) h "
        f"USING (key) LEFT JOIN ({sts}) s USING (key) LEFT JOIN duty USING (key) LEFT JOIN w5 USING (key)")
    q["cold_summary"] = (
        f"{R}, w6 AS (SELECT COALESCE(CAST(SUM(CASE WHEN value < 0.02 AND nu IS NOT NULL THEN nu - us ELSE 0 END)"
        f" AS DOUBLE) / {HOURS}, 0.0) AS wh FROM (SELECT T_MXC AS value, epoch_us(ts_eastern) AS us, "
        f"LEAD(epoch_us(ts_eastern)) OVER (ORDER BY ts_eastern) AS nu FROM readings WHERE T_MXC IS NOT NULL "
        f"AND ts_eastern >= {AS_OF} - INTERVAL 24 HOUR)), w2 AS ({_cold_total(False)})\n"
        f"SELECT wh AS window_hours_below_20mK, COALESCE(hours_below_20mK_total, wh) AS total_hours_below_20mK, "
        f"hours_below_20mK_total IS NULL AS total_is_window FROM w6, w2")
    mcols = [*METRICS_LATEST_COLUMNS, *[f"{c}_{f}_24h" for c in MINMAX_24H_COLUMNS for f in ("min", "max")],
             "hours_below_20mK_total", "hours_below_20mK_current", *[f"{p}_starts_24h" for p in STARTS_PUMPS]]
    snap_sel = []
    for c in mcols:
        if c in DASHBOARD_KEYS:
            snap_sel.append(f"COALESCE(m.{c}, lv.{c}) AS {c}")
        elif c == "ts_eastern":
            snap_sel.append("COALESCE(m.ts_eastern, lt.hts, h.lts) AS ts_eastern")
        else:
            snap_sel.append(f"m.{c}")
    metrics_body = _metrics(False).rsplit("\nSELECT ", 1)
    q["snapshot"] = (
        f"{metrics_body[0]}, m AS (SELECT {metrics_body[1]}), hist AS (SELECT * FROM "
        f"{_unpivot(DASHBOARD_KEYS, _in_window(24))}), lv AS ("
        + _pivot("(SELECT key, arg_max(value, ts_eastern) AS value FROM hist GROUP BY key)", DASHBOARD_KEYS, False)
        + "), lt AS (SELECT max(ts_eastern) AS hts FROM hist), h AS (SELECT max(ts_eastern) AS lts FROM readings)\n"
        f"SELECT {', '.join(snap_sel)} FROM m, lv, lt, h")
    keyed = _metrics(True).rsplit("\nSELECT ", 1)
    q["snapshot_by_device"] = (
        f"{keyed[0]}, m AS (SELECT {keyed[1]}), hist AS (SELECT * FROM "
        f"{_unpivot(DASHBOARD_KEYS, _in_window(24), True)}), lv AS ("
        + _pivot("(SELECT device_id, key, arg_max(value, ts_eastern) AS value FROM hist GROUP BY device_id, key)", DASHBOARD_KEYS, True)
        + "), lt AS (SELECT device_id, max(ts_eastern) AS hts FROM hist GROUP BY device_id), h AS (SELECT max(ts_eastern) AS lts FROM readings)\n"
        f"SELECT m.device_id, {', '.join(snap_sel)} FROM m LEFT JOIN lv USING (device_id) LEFT JOIN lt USING (device_id), h")
    def miss(x, body):
        return f"CASE WHEN {x} IS NULL OR isnan({x}) THEN '—' ELSE {body} END"

    def ftemp(x, always_mk):
        arm = f"WHEN abs({x}) < 1.0 THEN format('{{:,.1f}} mK', {x} * 1000.0) " if always_mk else ""
        return miss(x, f"CASE {arm}WHEN abs({x}) < 0.1 THEN printf('%.1f mK', {x} * 1000.0) "
                       f"WHEN abs({x}) < 10 THEN printf('%.3f K', {x}) ELSE printf('%.2f K', {x}) END")

    fp = miss("P1", "CASE WHEN P1 = 0 THEN '0 mbar' WHEN abs(P1) < 0.01 OR abs(P1) >= 1000 THEN printf('%.2e mbar', P1) "
                    "WHEN abs(P1) < 1 THEN printf('%.4f mbar', P1) WHEN abs(P1) < 100 THEN printf('%.3f mbar', P1) "
                    "ELSE printf('%.1f mbar', P1) END")
    fem = miss("T_Still", "CASE WHEN abs(T_Still) < 0.5 THEN format('{:,.1f} mK', T_Still * 1000.0) "
                          "WHEN abs(T_Still) < 10 THEN printf('%.3f K', T_Still) ELSE printf('%.2f K', T_Still) END")
    flow = miss("Flow", "printf('%.4f', Flow)")
    hours = miss("total_hours_pulse_tube", "format('{:,.1f} h', total_hours_pulse_tube)")
    count = miss("pulse_tube_starts_24h", "CAST(CAST(round_even(pulse_tube_starts_24h, 0) AS BIGINT) AS VARCHAR)")
    state = ("CASE WHEN pulse_tube IS NULL OR isnan(pulse_tube) THEN 'Unknown' "
             "WHEN pulse_tube >= 0.5 THEN 'On' ELSE 'Off' END")
    mb = _metrics(True).rsplit("\nSELECT ", 1)
    q["formatted_metrics"] = (
        f"{mb[0]}, m AS (SELECT {mb[1]})\nSELECT device_id, {ftemp('T_MXC', True)} AS mxc, "
        f"{ftemp('T_50K', False)} AS t50k, {fp} AS p1, {flow} AS flow, {hours} AS pt_hours, {count} AS pt_starts, "
        f"{state} AS pt_state, {fem} AS still_em FROM m")
    d2 = " UNION ALL ".join(
        f"SELECT device_id, '{p}' AS key, {p} AS cv FROM l" for p in STATE_KEYS)
    h2 = " UNION ALL ".join(f"SELECT device_id, '{p}' AS key, total_hours_{p} AS h FROM rh" for p in STATE_KEYS)
    prev = ", ".join(f"LAG({p}) OVER (PARTITION BY device_id ORDER BY ts_eastern) AS prev_{p}" for p in STATE_KEYS)
    c2 = " UNION ALL ".join(
        f"SELECT device_id, '{p}' AS key, 100.0 * (avg(CASE WHEN {p} >= 0.5 THEN 1.0::DOUBLE WHEN {p} IS NOT NULL THEN 0.0::DOUBLE END)) AS duty, "
        f"sum(CASE WHEN coalesce(prev_{p}, 0) < 0.5 AND coalesce({p}, 0) >= 0.5 THEN 1 ELSE 0 END) AS n FROM lagged GROUP BY device_id" for p in STATE_KEYS)
    q["formatted_ops"] = (
        f"{R}, l AS ({_latest(True, ['ts_eastern', *STATE_KEYS])}), rh AS ({_runtime(True)}), lagged AS (SELECT *, {prev} FROM readings)\n"
        f"SELECT device_id, key, CASE WHEN cv IS NULL THEN 'Unknown' WHEN cv >= 0.5 THEN 'On' ELSE 'Off' END AS state, "
        f"CASE WHEN cv IS NULL THEN '#64748b' WHEN cv >= 0.5 THEN '#16a34a' ELSE '#dc2626' END AS chip, "
        f"{miss('h', 'format(' + chr(39) + '{:,.1f} h' + chr(39) + ', h)')} AS hours, {miss('duty', 'printf(' + chr(39) + '%.1f%%' + chr(39) + ', duty)')} AS duty, "
        f"CAST(n AS VARCHAR) AS starts FROM ({d2}) d JOIN ({h2}) h USING (device_id, key) JOIN ({c2}) c USING (device_id, key)")
    q["request_errors"] = (
        "WITH a AS (SELECT event_id, CAST(floor(value * 100) AS BIGINT) - 5 AS hours, "
        "CASE WHEN event_id % 5 <> 0 THEN event_id % 11000 END AS max_points FROM events)\n"
        "SELECT *, CASE WHEN hours IS NULL OR hours NOT BETWEEN 1 AND 8760 THEN 'hours must be an integer in [1, 8760], got ' || coalesce(CAST(hours AS VARCHAR), 'None') "
        "ELSE 'max_points must be an integer in [100, 10000], got ' || CAST(max_points AS VARCHAR) END AS error FROM a "
        "WHERE hours IS NULL OR hours NOT BETWEEN 1 AND 8760 OR max_points NOT BETWEEN 100 AND 10000")
    record = _metrics(False).rsplit("\nSELECT ", 1)
    points = q["dashboard_series"].rsplit("\nSELECT", 1)[0].replace(R, "", 1)
    rec = " UNION ALL ".join(f"SELECT 'metrics' AS part, '{c}' AS key, ts_eastern, CAST({c} AS DOUBLE) AS value FROM m" for c in mcols if c != "ts_eastern")
    q["dashboard"] = (
        f"{record[0]}, m AS (SELECT {record[1]}){points.replace(' w AS (', ' ws AS (').replace('FROM w ', 'FROM ws ').replace(', s AS (', ', pts AS (')}\n{rec} UNION ALL "
        f"SELECT 'series' AS part, key, ts_eastern, value FROM (UNPIVOT pts ON {dk} INTO NAME key VALUE value)")
    kinds = " UNION ALL ".join(
        [f"SELECT DISTINCT CAST(ts_eastern AS DATE) AS d, '{c}' AS kind FROM readings WHERE {c} IS NOT NULL"
         for c in ("T_50K", "T_4K", "T_Still", "T_MXC", "Flow")]
        + [f"SELECT DISTINCT CAST(ts_eastern AS DATE) AS d, '{k}' AS kind FROM readings" for k in ("channels", "maxigauge")])
    q["path_check"] = (
        f"{R}, d AS (SELECT DISTINCT strftime(CAST(ts_eastern AS DATE), '%y-%m-%d') AS day FROM readings)\n"
        "SELECT true AS logs_root_exists, (SELECT count(*) FROM d) AS source_count, "
        "(SELECT string_agg(day, ', ' ORDER BY day) FROM (SELECT day FROM d ORDER BY day LIMIT 5)) AS sample_sources")
    q["sync_summary"] = (
        f"{R}, d AS (SELECT DISTINCT CAST(ts_eastern AS DATE) AS day FROM readings), "
        "s AS (SELECT DISTINCT date_trunc('second', ts_eastern) AS sec FROM readings)\n"
        "SELECT 'ok' AS status, (SELECT count(*) FROM d) AS sources_seen, CAST(0 AS BIGINT) AS sources_changed, "
        "CAST(0 AS BIGINT) AS sources_synced, (SELECT count(*) FROM d) AS tracked_sources, "
        "(SELECT count(*) FROM s) AS rows_total, (SELECT max(sec) FROM s) AS latest_ts_eastern")
    q["changed_sources"] = (
        f"{R}, k AS ({kinds})\nSELECT strftime(d, '%y-%m-%d') AS source_day, count(*) AS n_files, "
        f"true AS has_bytes, true AS has_mtime FROM k GROUP BY d")
    simple = ["T_50K", "T_4K", "T_Still", "T_MXC", "Flow"]
    every = ["P1", "P2", "P3", "P4", "P5", "P6", "scroll_1", "scroll_2", "turbo_1", "pulse_tube"]
    q["ingest_roundtrip"] = (
        f"{R}, r AS (SELECT *, date_trunc('second', ts_eastern) AS sec FROM readings)\n"
        "SELECT sec AS ts_eastern, "
        + ", ".join(f"arg_max({c}, ts_eastern) AS {c}" for c in simple) + ", "
        + ", ".join(f"arg_max_null({c}, ts_eastern) AS {c}" for c in every)
        + ", strftime(sec, '%y-%m-%d') AS source_day FROM r GROUP BY sec")
    def per_second(src, day="strftime(sec, '%y-%m-%d')"):
        """The rows that the logs of ``src`` give: per second the last value of each column."""
        return ("SELECT sec AS ts_eastern, " + ", ".join(f"arg_max({c}, ts_eastern) AS {c}" for c in simple) + ", "
                + ", ".join(f"arg_max_null({c}, ts_eastern) AS {c}" for c in every)
                + f", {day} AS source_day FROM (SELECT *, date_trunc('second', ts_eastern) AS sec FROM {src}) GROUP BY sec")

    q["ingest_second_pass"] = (
        f"{R}\nSELECT *, (SELECT count(DISTINCT CAST(ts_eastern AS DATE)) FROM readings WHERE day(ts_eastern) % 2 = 0) AS sources_rebuilt "
        f"FROM ({per_second('readings')})")
    q["ingest_overlap"] = (
        f"{R}, b AS (SELECT * REPLACE (P1 * 2.0 AS P1, CAST(NULL AS DOUBLE) AS T_MXC) FROM readings "
        f"WHERE hour(ts_eastern) >= 6 AND hour(ts_eastern) < 12 AND event_id % 2 = 0), first AS ({per_second('readings')}), "
        f"later AS ({per_second('b', day=chr(39).join(['strftime(sec, ', '%y-%m-%d', ') || ', 'b', '']))})\n"
        f"SELECT * FROM later UNION ALL SELECT * FROM first WHERE ts_eastern NOT IN (SELECT ts_eastern FROM later)")
    from_logs = (R.replace("WITH readings AS", "WITH ev AS") + ", readings AS (SELECT *, "
                 + ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in RUNTIME_COLS) + f" FROM ({per_second('ev')}))")
    q["store_metrics"] = _metrics(False).replace(R, from_logs, 1)
    mark = "coalesce(CAST({} AS VARCHAR), '')"
    text = (" || ".join(["strftime(ts_eastern, '%d-%m-%y,%H:%M:%S')", "',0'"]
                        + [f"',{k},' || {mark.format(c)}" for k, c in (("turbo1", "turbo_1"), ("scroll1", "scroll_1"), ("scroll2", "scroll_2"), ("pulsetube", "pulse_tube"))]))
    q["changed_sources_grown"] = (
        f"{R}, l AS (SELECT CAST(ts_eastern AS DATE) AS d, hour(ts_eastern) AS h, length({text}) + 1 AS n FROM readings), "
        f"s AS (SELECT d, day(d) % 3 AS part, sum(n)::BIGINT AS size_bytes, "
        f"(CASE WHEN day(d) % 3 = 2 THEN sum(n) WHEN day(d) % 3 = 1 THEN sum(n) FILTER (WHERE h < 12) END)::BIGINT AS size_before FROM l GROUP BY d)\n"
        f"SELECT strftime(d, '%y-%m-%d') AS source_day, CASE WHEN size_before IS NULL THEN 'new' WHEN size_bytes > size_before THEN 'grown' "
        f"WHEN part = 2 THEN 'same' ELSE 'rewritten' END AS status, size_before, size_bytes FROM s")
    q["stream_minutes"] = (
        f"{R}\nSELECT key, m AS ts_eastern, value FROM (SELECT key, date_trunc('minute', ts_eastern) AS m, "
        f"arg_max(value, ts_eastern) AS value FROM {_unpivot(DASHBOARD_KEYS)} GROUP BY key, m)")
    starts_all = ", ".join(
        f"CAST(SUM(CASE WHEN COALESCE(pv_{p}, 0) < 0.5 AND COALESCE({p}, 0) >= 0.5 THEN 1 ELSE 0 END) AS BIGINT)"
        f" AS {p}_starts" for p in RUNTIME_PUMPS)
    lag_all = ", ".join(f"LAG({p}) OVER (PARTITION BY device_id ORDER BY ts_eastern) AS pv_{p}" for p in RUNTIME_PUMPS)
    q["stream_counters"] = (
        f"{R}, rh AS ({_runtime(True)}), st AS (SELECT device_id, {starts_all}, count(*) AS n FROM (SELECT device_id, "
        f"{', '.join(RUNTIME_PUMPS)}, {lag_all} FROM readings) GROUP BY device_id)\n"
        f"SELECT rh.*, {', '.join('st.' + p + '_starts' for p in RUNTIME_PUMPS)}, n AS rows "
        f"FROM rh JOIN st USING (device_id)")
    mm24 = ", ".join(f"{f}({c}) AS {c}_{f}_24h" for c in MINMAX_24H_COLUMNS for f in ("min", "max"))
    q["stream_minmax_by_device"] = (
        f"{R}, w AS (SELECT r.*, date_trunc('hour', ts_eastern) - to_hours(k) AS ws FROM readings r, "
        f"range(0, 24) t(k))\nSELECT device_id, ws + INTERVAL 24 HOUR AS window_end, {mm24} FROM w "
        f"GROUP BY device_id, ws")
    q["stream_minmax"] = (
        f"{R}, w AS (SELECT r.*, date_trunc('hour', ts_eastern) - to_hours(k) AS ws FROM readings r, "
        f"range(0, 24) t(k))\nSELECT ws + INTERVAL 24 HOUR AS window_end, {mm24} FROM w GROUP BY ws")
    mmh = ", ".join(f"{f}({c}) AS {c}_{f}" for c in MINMAX_24H_COLUMNS for f in ("min", "max"))
    q["stream_hours_closed"] = (
        f"{R}, h AS (SELECT *, date_trunc('hour', ts_eastern) AS hour FROM readings)\nSELECT hour, {mmh} FROM h "
        f"WHERE hour + INTERVAL 1 HOUR <= {AS_OF} - INTERVAL 20 DAY GROUP BY hour")
    for dev in (False, True):
        n = f"SELECT {_d(dev)}count(*) AS rows, max(ts_eastern) AS latest_ts FROM readings{_group(dev)}"
        joins = " JOIN ".join(f"({sub}) {t}" + (" USING (device_id)" if dev and t != "rh" else "" if t == "rh" else " ON true") for t, sub in (
            ("rh", _runtime(dev)), ("c", _cold_total(dev)), ("s", _streak(dev)), ("n", n)))
        q["equi_depth_stats" + ("_by_device" if dev else "")] = (
            f"{R}\nSELECT {'rh.device_id, ' if dev else ''}{', '.join('rh.' + c for c in RUNTIME_COLS)}, c.hours_below_20mK_total, "
            f"s.hours_below_20mK_current, n.rows, n.latest_ts FROM {joins}")
    return q


ORACLE = build()
