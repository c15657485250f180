"""DuckDB SQL for every registered query that has a closed form."""

from __future__ import annotations

from opsmetrics.operators.digits import LEAST_GAP, MOST_DIGITS
from opsmetrics.operators.segments import SEGMENT_LABELS
from opsmetrics.operators.summary import GAUGE_SECTORS
from opsmetrics.plans.registry import (
    CUT_PERIOD, LEAD, LEADS, PERIOD, QUANTILES, RATE_LIMITS, SPAN, TOP_N)

LOG = """
log AS (
  SELECT CAST(year(d) * 100 + month(d) AS INTEGER) AS yr_mo, d AS call_date,
         team_lead_name, agent_name, calls, handle_time,
         CASE WHEN l_returnflag = 'R' THEN calls * 45 // 100 ELSE 0 END AS call_regen,
         offer AS calls_with_offer, accept AS calls_with_accept,
         accept * (100 - 5 * discount) // 100 AS calls_offer_applied,
         CASE WHEN l_linestatus = 'O' THEN calls * 16 // 100 ELSE 0 END AS transfers
  FROM (SELECT *, offer * (100 - 4 * tax) // 100 AS accept
        FROM (SELECT *, calls * (100 - discount) // 100 AS offer
              FROM (SELECT CAST(l_shipdate AS DATE) AS d, n_name AS team_lead_name,
                           s_name AS agent_name, l_returnflag, l_linestatus,
                           CAST(l_quantity AS BIGINT) AS calls,
                           CAST(floor(l_extendedprice) AS BIGINT) AS handle_time,
                           CAST(round(l_discount * 100) AS BIGINT) AS discount,
                           CAST(round(l_tax * 100) AS BIGINT) AS tax
                    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
                    JOIN nation ON s_nationkey = n_nationkey))))"""


def _fact(source: str = "log", name: str = "fact") -> str:
    return f"""
{name} AS (
  SELECT yr_mo, call_date, team_lead_name, agent_name, calls, handle_time,
         handle_time::DOUBLE / NULLIF(calls, 0) AS handle_time_avg,
         call_regen, call_regen::DOUBLE / NULLIF(calls, 0) AS call_regen_rate,
         calls_with_offer,
         calls_with_offer::DOUBLE / NULLIF(calls, 0) AS calls_with_offer_rate,
         calls_with_accept,
         calls_with_accept::DOUBLE / NULLIF(calls, 0) AS calls_with_accept_rate,
         calls_offer_applied,
         calls_offer_applied::DOUBLE / NULLIF(calls, 0) AS calls_offer_applied_rate,
         call_transfers, call_transfers::DOUBLE / NULLIF(calls, 0) AS call_transfer_rate,
         calls_with_accept - calls_offer_applied AS call_breakage_count,
         (calls_with_accept - calls_offer_applied)::DOUBLE
           / NULLIF(calls_with_accept, 0) AS call_breakage_rate
  FROM (SELECT yr_mo, call_date, team_lead_name, agent_name,
               sum(calls)::BIGINT AS calls, sum(handle_time)::BIGINT AS handle_time,
               sum(call_regen)::BIGINT AS call_regen,
               sum(calls_with_offer)::BIGINT AS calls_with_offer,
               sum(calls_with_accept)::BIGINT AS calls_with_accept,
               sum(calls_offer_applied)::BIGINT AS calls_offer_applied,
               sum(transfers)::BIGINT AS call_transfers
        FROM {source} GROUP BY ALL))"""


FACT = LOG + "," + _fact()

TARGETS = """
months AS (
  SELECT DISTINCT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS yr_mo
  FROM lineitem WHERE month(l_shipdate) <> 12),
wide AS (
  SELECT yr_mo,
         CAST(760 + 2 * (yr_mo % 100) AS DOUBLE) / 1.0 AS aht,
         CAST(150 + (yr_mo % 100) AS DOUBLE) / 1000.0 AS call_regen,
         CAST(70 + (yr_mo % 100) AS DOUBLE) / 1000.0 AS transfers,
         CAST(500 + (yr_mo % 100) AS DOUBLE) / 1000.0 AS applied_per_call,
         CAST(190 + (yr_mo % 100) AS DOUBLE) / 1000.0 AS breakage
  FROM months),
joinable AS (
  SELECT yr_mo, applied_per_call AS calls_offer_applied_rate_target,
         breakage AS call_breakage_rate_target, call_regen AS call_regen_rate_target,
         transfers AS transfer_rate_target, aht / 60.0::DOUBLE AS handle_time_avg_target
  FROM wide)"""


def _summary(source: str = "fact") -> str:
    return f"""
summary AS (
  SELECT agent_name, avg(calls) AS calls_avg, sum(calls)::BIGINT AS calls_total,
         avg(handle_time_avg / 60.0::DOUBLE) AS handle_time_avg,
         avg(call_regen_rate) AS call_regen,
         avg(call_transfer_rate) AS call_transfer_rate,
         avg(call_breakage_rate) AS call_breakage_rate,
         avg(calls_offer_applied_rate) AS calls_offer_applied_rate,
         avg(calls_with_offer_rate) AS calls_with_offer_rate,
         avg(calls_with_accept_rate) AS calls_with_accept_rate,
         sum(calls_with_offer)::BIGINT AS calls_with_offer,
         sum(calls_with_accept)::BIGINT AS calls_with_accept,
         sum(calls_offer_applied)::BIGINT AS calls_offer_applied,
         sum(call_breakage_count)::BIGINT AS call_breakage_count
  FROM {source} GROUP BY agent_name)"""


SUMMARY = FACT + "," + _summary()

_LEAD_LIST = ", ".join(f"'{lead}'" for lead in LEADS)
SELECTED = LOG + f""",
chosen AS (
  SELECT * FROM log
  WHERE call_date BETWEEN DATE '{PERIOD[0]}' AND DATE '{PERIOD[1]}'
    AND agent_name IN (SELECT agent_name FROM log
                       WHERE team_lead_name IN ({_LEAD_LIST})))""" \
    + "," + _fact("chosen") + "," + _summary()

CUT = LOG + f""",
chosen AS (
  SELECT * FROM log
  WHERE call_date BETWEEN DATE '{CUT_PERIOD[0]}' AND DATE '{CUT_PERIOD[1]}')""" \
    + "," + _fact("chosen") + "," + _summary()

SUMMARY_RATES = ["handle_time_avg", "call_regen", "call_transfer_rate", "call_breakage_rate",
                 "calls_offer_applied_rate", "calls_with_offer_rate",
                 "calls_with_accept_rate"]
SUMMARY_COUNTS = ["calls_total", "calls_with_offer", "calls_with_accept",
                  "calls_offer_applied", "call_breakage_count"]

FEATURE_NAMES = ["calls_with_offer_rate", "calls_with_accept_rate", "call_transfer_rate",
                 "call_breakage_rate", "call_regen_rate", "calls_offer_applied_rate"]
FEATURES = FACT + """,
features AS (
  SELECT agent_name, """ + ", ".join(f"avg({f}) AS {f}" for f in FEATURE_NAMES) + """
  FROM fact GROUP BY agent_name)"""

BRIDGE = FEATURES + """,
bridge AS (SELECT DISTINCT agent_name, team_lead_name FROM log)"""

ASSIGNED = BRIDGE + """,
assigned AS (
  SELECT f.*, b.team_lead_name AS cluster
  FROM features f JOIN bridge b USING (agent_name))"""

WEEKLY = LOG + """,
weekly AS (
  SELECT CAST((dayofyear(call_date) - 1) // 7 + 1 AS INTEGER) AS week_num,
         sum(calls)::BIGINT AS calls
  FROM log GROUP BY 1)"""

MONTHLY = LOG + """,
monthly AS (
  SELECT year(call_date)::INTEGER AS year, month(call_date)::INTEGER AS month_num,
         monthname(call_date) AS month, sum(calls)::BIGINT AS calls
  FROM log GROUP BY ALL)"""


def _round(names: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


def _percent(ratio: str) -> str:
    """Percent text with one decimal, rounded half up in magnitude."""
    tenths = f"CAST(floor(abs({ratio}) * 1000 + 0.5) AS BIGINT)"
    return (f"CASE WHEN {ratio} < 0 AND {tenths} > 0 THEN '-' ELSE '' END "
            f"|| ({tenths} // 10) || '.' || ({tenths} % 10) || '%'")


def _number(value: str) -> str:
    return f"format('{{:,}}', CAST(round_even({value}, 0) AS BIGINT))"


def _sector(rate: str) -> str:
    cases = " ".join(f"WHEN {rate}_pct BETWEEN {low} AND {high} THEN '{name}'"
                     for name, low, high in GAUGE_SECTORS[rate])
    return f"CASE {cases} END AS {rate}_sector"


def _bins(rate: str) -> str:
    cases = " ".join(f"WHEN {rate} <= {limit}::DOUBLE THEN '{name}'"
                     for limit, name in RATE_LIMITS)
    return f"CASE {cases} ELSE 'high' END"


def _scorecard_rates(base: str) -> str:
    pct = ", ".join(f"round(round_even({r}, 3) * 100, 1) AS {r}_pct" for r in GAUGE_SECTORS)
    means = ", ".join(f"avg({r}) AS {r}" for r in SUMMARY_RATES)
    return f"""WITH {base},
means AS (SELECT {means} FROM summary),
gauges AS (SELECT *, {pct} FROM means)
SELECT {_round(SUMMARY_RATES)}, {", ".join(f"{r}_pct" for r in GAUGE_SECTORS)},
       {", ".join(_sector(r) for r in GAUGE_SECTORS)}
FROM gauges"""


def _summary_rows(base: str) -> str:
    return f"""WITH {base}
SELECT agent_name, {_round(["calls_avg"] + SUMMARY_RATES)}, {", ".join(SUMMARY_COUNTS)}
FROM summary"""


def _trailing(value: str, k: int, window: str, head: str) -> str:
    rows = f"({window} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return (f"CASE WHEN row_number() OVER ({window}) < {k} THEN {head} "
            f"WHEN count({value}) OVER {rows} = {k} THEN avg({value}) OVER {rows} END")


PROFILE = ASSIGNED + f""",
profile AS (
  SELECT a.cluster, b.team_lead_name, a.agent_name, calls_with_offer_rate,
         calls_with_accept_rate, call_transfer_rate, call_breakage_rate, call_regen_rate,
         {_bins("calls_offer_applied_rate")} AS calls_offer_applied_rate_bin,
         avg(calls_offer_applied_rate) AS avg_offer_applied_rate
  FROM assigned a LEFT JOIN bridge b ON a.agent_name = b.agent_name
  GROUP BY ALL)"""

_PROFILE_ROWS = ("cluster, team_lead_name, agent_name, calls_offer_applied_rate_bin, "
                 + _round(FEATURE_NAMES[:5] + ["avg_offer_applied_rate"]))

_SQUARES = "count(*) * (" + " + ".join(f"var_pop({f})" for f in FEATURE_NAMES) + ")"

SMOOTH = LOG + f""",
days AS (
  SELECT call_date, sum(calls)::BIGINT AS calls,
         date_diff('day', DATE '1970-01-01', call_date)::DOUBLE AS x
  FROM log GROUP BY call_date),
indexed AS (SELECT *, row_number() OVER (ORDER BY x) AS i FROM days),
size AS (SELECT count(*) AS n, CAST(floor({SPAN} * count(*) + 0.00001) AS BIGINT) AS q
         FROM indexed),
runs AS (
  SELECT i, x, lead(x, (SELECT q - 1 FROM size)::INTEGER) OVER (ORDER BY i) AS last_x
  FROM indexed),
bandwidths AS (
  SELECT p.i, p.x, min(greatest(p.x - r.x, r.last_x - p.x)) AS h
  FROM indexed p CROSS JOIN size
  JOIN runs r ON r.i BETWEEN p.i - q + 1 AND p.i AND r.last_x IS NOT NULL
  GROUP BY p.i, p.x),
near AS (
  SELECT b.i, o.i AS j, o.calls, (o.x - b.x) / b.h AS u,
         pow(1 - pow(abs((o.x - b.x) / b.h), 3), 3) AS w
  FROM bandwidths b CROSS JOIN size
  JOIN indexed o ON o.i BETWEEN b.i - q + 1 AND b.i + q - 1 AND abs(o.x - b.x) < b.h),
moments AS (
  SELECT i, count(*) AS points, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2,
         sum(w * u * u * u) AS s3, sum(w * u * u * u * u) AS s4
  FROM near GROUP BY i),
cofactors AS (
  SELECT i, points, s2 * s4 - s3 * s3 AS c0, s2 * s3 - s1 * s4 AS c1, s1 * s3 - s2 * s2 AS c2,
         s0 * (s2 * s4 - s3 * s3) + s1 * (s2 * s3 - s1 * s4) + s2 * (s1 * s3 - s2 * s2) AS det
  FROM moments),
levers AS MATERIALIZED (
  SELECT n.i, n.j, n.calls, w * (c0 + c1 * u + c2 * u * u) / det AS l
  FROM near n JOIN cofactors c ON n.i = c.i
  WHERE points >= 3 AND det > 1e-12),
fits AS (SELECT i, sum(l * calls) AS smooth, sum(l * l) AS spread FROM levers GROUP BY i),
residual AS MATERIALIZED (
  SELECT i, j, CASE WHEN i = j THEN 1 - l ELSE -l END AS r FROM levers
  UNION ALL
  SELECT i, i, 1.0::DOUBLE FROM indexed WHERE i NOT IN (SELECT i FROM levers)),
products AS (
  SELECT a.i AS i, b.i AS j, sum(a.r * b.r) AS m
  FROM residual a JOIN residual b ON a.j = b.j AND a.i <= b.i GROUP BY a.i, b.i),
moments_of_residuals AS (
  SELECT (SELECT sum(r * r) FROM residual) AS d1,
         (SELECT sum(CASE WHEN i = j THEN m * m ELSE 2 * m * m END) FROM products) AS d2,
         (SELECT sum(pow(calls - smooth, 2)) FROM indexed JOIN fits USING (i)) AS squares),
freedoms AS (
  SELECT d1, squares, d1 * d1 / d2 AS f,
         exp(lgamma((d1 * d1 / d2 + 1) / 2) - lgamma(d1 * d1 / d2 / 2))
           / sqrt(d1 * d1 / d2 * pi()) AS c
  FROM moments_of_residuals),
newton AS (
  SELECT 0 AS step, 1.96::DOUBLE AS t, d1, squares, f, c FROM freedoms
  UNION ALL
  SELECT step + 1,
    t - (0.5 + c * t / 3000 * list_sum([
           (CASE WHEN k IN (0, 1000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)
             * pow(1 + pow(t * k / 1000, 2) / f, -(f + 1) / 2) FOR k IN range(1001)]) - 0.975)
      / (c * pow(1 + t * t / f, -(f + 1) / 2)), d1, squares, f, c
  FROM newton WHERE step < 30),
scale AS (SELECT squares / d1 AS s2, t FROM newton WHERE step = 30)"""

_SIX = "range(6)"


def _dominant(source: str, name: str) -> str:
    """The unit eigenvector of the largest eigenvalue of a 6 x 6 matrix (a list of 36),
    by repeated squaring; its largest loading is positive."""
    square = (f"list_transform(range(36), lambda p: list_sum(list_transform({_SIX}, "
              f"lambda k: m[(p // 6) * 6 + k + 1] * m[k * 6 + p % 6 + 1])))")
    trace = f"list_sum(list_transform({_SIX}, lambda k: sq[k * 7 + 1]))"
    return f"""
{name}_power AS (
  SELECT 0 AS step, m FROM {source}
  UNION ALL
  SELECT step + 1, list_transform(sq, lambda v: v / {trace})
  FROM (SELECT step, {square} AS sq FROM {name}_power WHERE step < 48)),
{name}_top AS (
  SELECT m, list_position(d, list_max(d)) - 1 AS j
  FROM (SELECT m, list_transform({_SIX}, lambda k: m[k * 7 + 1]) AS d
        FROM {name}_power WHERE step = 48)),
{name} AS (
  SELECT list_transform({_SIX}, lambda k: m[k * 6 + j + 1] / sqrt(m[j * 7 + 1])) AS axis
  FROM {name}_top)"""


def _score(axis: str) -> str:
    return " + ".join(f"({f} - avg({f}) OVER ()) * {axis}[{i}]"
                      for i, f in enumerate(FEATURE_NAMES, 1))


PROJECTION = FEATURES + """,
covariance AS (
  SELECT [""" + ", ".join(f"covar_samp({a}, {b})"
                          for a in FEATURE_NAMES for b in FEATURE_NAMES) + """] AS m
  FROM features),""" + _dominant("covariance", "first_axis") + f""",
deflated AS (
  SELECT list_transform(range(36), lambda p: m[p + 1] - size * axis[p // 6 + 1] * axis[p % 6 + 1])
           AS m
  FROM (SELECT m, axis, list_sum(list_transform(range(36), lambda p:
                 m[p + 1] * axis[p // 6 + 1] * axis[p % 6 + 1])) AS size
        FROM covariance CROSS JOIN first_axis)),""" + _dominant("deflated", "second_axis")

_AXES = range(1, len(FEATURE_NAMES) + 1)
_DISTANCE = " + ".join(f"(v{i} - c{i}) ** 2" for i in _AXES)


def _lloyd(ks: str) -> str:
    """Lloyd's iterations of 100 starts for the numbers of centers in ``ks``, each until its
    centers stand still, and the best start of each number."""
    v, c, new = (", ".join(f"{x}{i}" for i in _AXES) for x in ("v", "c", "new"))
    moved = " OR ".join(f"abs(new{i} - c{i}) > 1e-15 + 1e-12 * abs(c{i})" for i in _AXES)
    return f""",
points AS (
  SELECT agent_name, {", ".join(f"{f} AS v{i}" for i, f in zip(_AXES, FEATURE_NAMES))}
  FROM features),
starts AS (
  SELECT s, {v}, row_number() OVER (
           PARTITION BY s ORDER BY md5(agent_name || '|' || s), agent_name) AS place
  FROM points CROSS JOIN range(1, 101) t(s)),
lloyd AS (
  SELECT k, s, 0 AS step, true AS moving, place AS c, {", ".join(f"v{i} AS c{i}" for i in _AXES)},
         0::BIGINT AS n, 0::DOUBLE AS ss
  FROM starts JOIN {ks} t(k) ON place <= k
  UNION ALL
  SELECT k, s, step + 1, bool_or({moved}) OVER (PARTITION BY k, s), c, {new}, n, ss
  FROM (
    SELECT l.k, l.s, l.step, l.c, {", ".join(f"l.c{i}" for i in _AXES)},
           {", ".join(f"coalesce(m{i} / m.n, l.c{i}) AS new{i}" for i in _AXES)},
           coalesce(m.n, 0) AS n, coalesce(m.ss, 0) AS ss
    FROM lloyd l LEFT JOIN (
      SELECT k, s, near.c AS c, count(*) AS n, sum(near.d) AS ss,
             {", ".join(f"sum(v{i}) AS m{i}" for i in _AXES)}
      FROM (SELECT k, s, agent_name, min({{'d': {_DISTANCE}, 'c': c}}) AS near,
                   {", ".join(f"any_value(v{i}) AS v{i}" for i in _AXES)}
            FROM lloyd CROSS JOIN points WHERE moving GROUP BY k, s, agent_name)
      GROUP BY k, s, near.c) m ON m.k = l.k AND m.s = l.s AND m.c = l.c
    WHERE l.moving)),
fits AS (
  SELECT k, s, max(step) AS iter, sum(ss) AS within, count(*) FILTER (n > 0) AS found
  FROM lloyd WHERE NOT moving GROUP BY k, s),
best AS (
  SELECT * FROM fits
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(within, 12), s) = 1)"""


SEGMENTED = BRIDGE + _lloyd("range(3, 4)") + f""",
centers AS (
  SELECT lloyd.*, row_number() OVER (
           ORDER BY c{len(FEATURE_NAMES)}, {", ".join(f"c{i}" for i in _AXES)}) AS number
  FROM lloyd JOIN best USING (k, s) WHERE NOT moving AND n > 0),
assigned AS (
  SELECT f.*, cluster
  FROM features f JOIN (
    SELECT agent_name, number::VARCHAR AS cluster FROM points CROSS JOIN centers
    QUALIFY row_number() OVER (PARTITION BY agent_name ORDER BY {_DISTANCE}, c) = 1)
  USING (agent_name))"""

ORACLE = {
    "call_log": f"""WITH {LOG}
SELECT yr_mo, call_date, team_lead_name, agent_name, calls, handle_time,
       call_regen::BIGINT AS call_regen, calls_with_offer, calls_with_accept,
       calls_offer_applied, transfers::BIGINT AS transfers
FROM log""",

    "targets_wide": f"""WITH {TARGETS}
SELECT yr_mo, aht, call_regen, transfers, applied_per_call, breakage FROM wide""",

    "targets_joinable": f"WITH {TARGETS} SELECT * FROM joinable",

    "agent_daily_fact": f"WITH {FACT} SELECT * FROM fact",

    "agent_daily_vs_target": f"""WITH {FACT},{TARGETS}
SELECT fact.*, joinable.* EXCLUDE (yr_mo),
       handle_time_avg / 60.0::DOUBLE AS handle_time_avg_min
FROM fact LEFT JOIN joinable ON fact.yr_mo = joinable.yr_mo""",

    "agent_period_summary": _summary_rows(SUMMARY),
    "agent_period_summary_selected": _summary_rows(SELECTED),
    "agent_period_summary_from_totals": _summary_rows(CUT),

    "scorecard_totals": f"""WITH {SUMMARY}
SELECT round(coalesce(sum(calls_avg), 0), 6) AS calls_by_day_avg,
       {", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {c}" for c in SUMMARY_COUNTS)}
FROM summary""",

    "scorecard_rates": _scorecard_rates(SUMMARY),
    "scorecard_rates_selected": _scorecard_rates(SELECTED),

    "scorecard_text": f"""WITH {SUMMARY},
totals AS (
  SELECT coalesce(sum(calls_avg), 0) AS calls_by_day_avg,
         {", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {c}" for c in SUMMARY_COUNTS)},
         avg(handle_time_avg) AS handle_time_avg,
         {", ".join(f"round_even(avg({r}), 3) AS {r}" for r in SUMMARY_RATES[1:5])}
  FROM summary)
SELECT {_number("calls_by_day_avg")} AS calls_by_day_avg_text,
       {", ".join(f"{_number(c)} AS {c}_text" for c in SUMMARY_COUNTS)},
       format('{{:,.2f}}', handle_time_avg) AS handle_time_avg_text,
       {", ".join(f"{_percent(r)} AS {r}_text" for r in SUMMARY_RATES[1:4])},
       'Offer Applied Rate: ' || {_percent("calls_offer_applied_rate")}
         AS calls_offer_applied_rate_text
FROM totals""",

    "filter_choices": f"""WITH {LOG}
SELECT 'date_start' AS choice, 1::BIGINT AS position, min(call_date)::VARCHAR AS value FROM log
UNION ALL
SELECT 'date_end', 1, max(call_date)::VARCHAR FROM log
UNION ALL
SELECT 'team_lead', row_number() OVER (ORDER BY team_lead_name), team_lead_name
FROM (SELECT DISTINCT team_lead_name FROM log)""",

    "agents_of_lead": f"""WITH {LOG}
SELECT DISTINCT agent_name FROM log WHERE team_lead_name = '{LEAD}'""",

    "calls_per_day": f"""WITH {LOG}
SELECT call_date, sum(calls)::BIGINT AS calls,
       'Date: ' || call_date::VARCHAR || chr(10) || 'Calls: ' || sum(calls)::VARCHAR
         AS label_text
FROM log GROUP BY call_date""",

    "calls_per_day_smoothed": f"""WITH RECURSIVE {SMOOTH}
SELECT call_date, calls, round(smooth, 4) AS smooth,
       round(smooth - t * sqrt(s2 * spread), 4) AS lower,
       round(smooth + t * sqrt(s2 * spread), 4) AS upper
FROM indexed LEFT JOIN fits USING (i) CROSS JOIN scale""",

    "calls_weekly": f"WITH {WEEKLY} SELECT * FROM weekly",

    "calls_weekly_change": f"""WITH {WEEKLY},
lagged AS (
  SELECT *, coalesce(lag(calls) OVER (ORDER BY week_num), calls) AS calls_lag_1 FROM weekly),
changed AS (
  SELECT *, calls - calls_lag_1 AS diff_1,
         (calls - calls_lag_1)::DOUBLE / NULLIF(calls_lag_1, 0) AS pct_diff_1 FROM lagged)
SELECT *, {_percent("pct_diff_1")} AS pct_diff_1_chr FROM changed""",

    "calls_weekly_change_digits": f"""WITH {WEEKLY},
lagged AS (
  SELECT *, coalesce(lag(calls) OVER (ORDER BY week_num), calls) AS calls_lag_1 FROM weekly),
changed AS (
  SELECT *, calls - calls_lag_1 AS diff_1,
         (calls - calls_lag_1)::DOUBLE / NULLIF(calls_lag_1, 0) AS pct_diff_1 FROM lagged),
percents AS (SELECT DISTINCT pct_diff_1 * 100 AS pct FROM changed WHERE isfinite(pct_diff_1)),
gaps AS (SELECT pct - lag(pct) OVER (ORDER BY pct) AS gap FROM percents),
smallest AS (SELECT min(gap) AS gap FROM gaps),
fine AS (
  SELECT CASE WHEN gap >= {LEAST_GAP!r} THEN 1 - floor(log10(gap))::INTEGER END AS d
  FROM smallest),
needed AS (
  SELECT coalesce(least(greatest(
           CASE WHEN (SELECT bool_and(round_even(pct * pow(10.0::DOUBLE, d), 0) % 10 = 0)
                      FROM percents)
                THEN d - 1 ELSE d END, 0), {MOST_DIGITS}), 0) AS d
  FROM fine),
units AS (
  SELECT changed.*, d, pow(10.0::DOUBLE, d)::BIGINT AS base,
         floor(abs(pct_diff_1) * (100 * pow(10.0::DOUBLE, d)) + 0.5)::BIGINT AS n
  FROM changed CROSS JOIN needed)
SELECT * EXCLUDE (d, base, n),
       CASE WHEN pct_diff_1 < 0 AND n > 0 THEN '-' ELSE '' END || (n // base)
       || CASE WHEN d > 0 THEN '.' || lpad((n % base)::VARCHAR, d, '0') ELSE '' END
       || '%' AS pct_text
FROM units""",

    "calls_weekly_rolling": f"""WITH {WEEKLY}
SELECT week_num, calls,
       {_trailing("calls", 2, "ORDER BY week_num", "0")} AS roll_mean_2,
       {_trailing("calls", 4, "ORDER BY week_num", "0")} AS roll_mean_4
FROM weekly""",

    "calls_monthly": f"WITH {MONTHLY} SELECT * FROM monthly",

    "calls_monthly_vs_first": f"""WITH {MONTHLY},
firsts AS (
  SELECT *, first_value(calls) OVER (PARTITION BY year ORDER BY month_num) AS calls_first
  FROM monthly),
changed AS (
  SELECT *, calls - calls_first AS diff_first,
         (calls - calls_first)::DOUBLE / NULLIF(calls_first, 0) AS pct_diff_first FROM firsts)
SELECT *, {_percent("pct_diff_first")} AS pct_diff_first_chr FROM changed""",

    "calls_monthly_cumulative": f"""WITH {MONTHLY}
SELECT *, (sum(calls) OVER (PARTITION BY year ORDER BY month_num
           ROWS UNBOUNDED PRECEDING))::BIGINT AS cumulative_calls FROM monthly""",

    "calls_cumulative_by_month": f"""WITH {MONTHLY}
SELECT *, (sum(calls) OVER (PARTITION BY month_num ORDER BY year
           ROWS UNBOUNDED PRECEDING))::BIGINT AS cumulative_calls FROM monthly""",

    "weekly_offers_rolling3": f"""WITH {LOG},
weeks AS (
  SELECT team_lead_name, agent_name,
         CAST(call_date + (6 - dayofweek(call_date))::INTEGER AS DATE) AS week_end,
         sum(calls_offer_applied)::BIGINT AS total_offers_applied
  FROM log GROUP BY ALL)
SELECT *, {_trailing("total_offers_applied", 3,
                     "PARTITION BY team_lead_name, agent_name ORDER BY week_end",
                     "NULL")} AS rolling_avg_3
FROM weeks""",

    "top_agents": f"""WITH {LOG},
totals AS (
  SELECT agent_name, sum(calls)::BIGINT AS total_calls,
         sum(calls_offer_applied)::BIGINT AS offers_applied FROM log GROUP BY 1),
limits AS (
  SELECT min(total_calls) AS least
  FROM (SELECT total_calls FROM totals ORDER BY total_calls DESC LIMIT {TOP_N})),
lumped AS (
  SELECT CASE WHEN total_calls >= least THEN agent_name ELSE 'Other' END AS agent_name,
         sum(total_calls)::BIGINT AS total_calls,
         sum(offers_applied)::BIGINT AS offers_applied
  FROM totals CROSS JOIN limits GROUP BY 1),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY agent_name = 'Other', offers_applied DESC, agent_name)
           AS agent_order FROM lumped),
shares AS (
  SELECT *, (sum(offers_applied) OVER (ORDER BY agent_order))::DOUBLE
           / (SELECT sum(offers_applied) FROM lumped)::DOUBLE AS cum_pct,
         format('{{:,}}', offers_applied) AS offers_applied_text,
         CAST(CASE WHEN agent_order < (SELECT count(*) FROM lumped) THEN agent_order END
              AS INTEGER) AS rank
  FROM ordered),
texts AS (SELECT *, {_percent("cum_pct")} AS cum_pct_text FROM shares)
SELECT *, 'Rank: ' || coalesce(rank::VARCHAR, 'NA') || chr(10) || 'Offers Applied: '
       || offers_applied_text || chr(10) || 'CumPct: ' || cum_pct_text AS label_text
FROM texts""",

    "agent_metric_long": f"""WITH {FEATURES},
ranked AS (
  SELECT *, row_number() OVER (ORDER BY agent_name DESC) AS agent_order FROM features),
long AS (
  SELECT agent_name, agent_order, unnest([
    {{'metric': 'Offer Rate', 'pct': calls_with_offer_rate, 'metric_order': 1}},
    {{'metric': 'Accept Rate', 'pct': calls_with_accept_rate, 'metric_order': 2}},
    {{'metric': 'Applied Rate', 'pct': calls_offer_applied_rate, 'metric_order': 3}},
    {{'metric': 'Breakage Rate', 'pct': call_breakage_rate, 'metric_order': 4}},
    {{'metric': 'Transfer Rate', 'pct': call_transfer_rate, 'metric_order': 5}}
  ], recursive := true) FROM ranked),
texts AS (SELECT *, {_percent("pct")} AS pct_text FROM long)
SELECT agent_name, agent_order, metric, round(pct, 6) AS pct,
       metric_order::INTEGER AS metric_order, pct_text,
       'Agent: ' || agent_name || chr(10) || metric || ': ' || coalesce(pct_text, 'NA')
         AS label_text
FROM texts""",

    "agent_features": f"""WITH {FEATURES}
SELECT agent_name, {_round(FEATURE_NAMES)} FROM features""",

    "rate_quantiles": f"""WITH {FEATURES}
SELECT unnest({QUANTILES}::DOUBLE[]) AS probability,
       unnest(list_transform(quantile_cont(calls_offer_applied_rate, {QUANTILES}),
                             lambda v: round(v, 6))) AS quantile
FROM features""",

    "rate_bins": f"""WITH {FEATURES}
SELECT agent_name, round(calls_offer_applied_rate, 6) AS calls_offer_applied_rate,
       {_bins("calls_offer_applied_rate")} AS calls_offer_applied_rate_bin
FROM (SELECT agent_name, calls_offer_applied_rate FROM features)""",

    "agent_lead_bridge": f"""WITH {LOG}
SELECT DISTINCT agent_name, team_lead_name FROM log""",

    "agent_projection": f"""WITH RECURSIVE {PROJECTION}
SELECT agent_name, round({_score("a.axis")}, 6) AS x, round({_score("b.axis")}, 6) AS y
FROM features CROSS JOIN first_axis a CROSS JOIN second_axis b""",

    "segment_quality": f"""WITH {ASSIGNED}
SELECT cluster, count(*) AS size, round({_SQUARES}, 8) AS withinss,
       {", ".join(f"round(avg({f}), 8) AS center_{f}" for f in FEATURE_NAMES)}
FROM assigned GROUP BY cluster""",

    "segment_totals": f"""WITH {ASSIGNED},
within AS (SELECT {_SQUARES} AS ss FROM assigned GROUP BY cluster),
sums AS (SELECT (SELECT {_SQUARES} FROM assigned) AS totss, sum(ss) AS tot_withinss,
                count(*) AS clusters FROM within)
SELECT round(totss, 8) AS totss, round(tot_withinss, 8) AS tot_withinss, clusters,
       round(totss - tot_withinss, 8) AS betweenss FROM sums""",

    "segment_profile_by_lead": f"WITH {PROFILE} SELECT {_PROFILE_ROWS} FROM profile",

    "segment_members_by_lead": f"""WITH {PROFILE}
SELECT {_PROFILE_ROWS} FROM profile WHERE cluster = '{LEAD}'""",
}

# The same with the K-means segment as the cluster.
ORACLE |= {
    name + suffix: ORACLE[name + known].replace(f"WITH {ASSIGNED}", f"WITH RECURSIVE {SEGMENTED}", 1)
    for name, known, suffix in (
        ("segment_quality", "", "_kmeans"), ("segment_totals", "", "_kmeans"),
        ("segment_profile", "_by_lead", ""))}
ORACLE |= {
    "segment_kmeans": f"WITH RECURSIVE {SEGMENTED} SELECT agent_name, cluster FROM assigned",

    "segment_members": ORACLE["segment_profile"] + " WHERE cluster = '3'",

    "kmeans_sweep": f"""WITH RECURSIVE {FEATURES}{_lloyd("range(2, 11)")},
total AS (SELECT {_SQUARES} AS totss FROM features)
SELECT 1 AS centers, round(totss, 8) AS totss, round(totss, 8) AS tot_withinss,
       0.0::DOUBLE AS betweenss, 1 AS iter, 1 AS clusters_found, true AS converged FROM total
UNION ALL
SELECT k::INTEGER, round(totss, 8), round(within, 8), round(totss - within, 8),
       iter::INTEGER, found::INTEGER, true FROM best CROSS JOIN total""",

    "segment_labels": f"""WITH RECURSIVE {SEGMENTED}{PROJECTION.removeprefix(FEATURES)},
names AS (
  SELECT * FROM (VALUES {", ".join(map(str, SEGMENT_LABELS))}) t(cluster, cluster_label))
SELECT round({_score("a.axis")}, 6) AS x, round({_score("b.axis")}, 6) AS y, agent_name, cluster,
       team_lead_name, cluster_label,
       concat('Agent: ', agent_name, chr(10), 'Lead: ', team_lead_name, chr(10), 'Cluster: ',
              cluster) AS short_label_text,
       concat(short_label_text, chr(10), cluster_label) AS label_text
FROM assigned LEFT JOIN bridge USING (agent_name) LEFT JOIN names USING (cluster)
CROSS JOIN first_axis a CROSS JOIN second_axis b""",
}

# The same over the selection: other rows under the same name.
ORACLE |= {
    f"{name}_selected": ORACLE[name].replace(f"WITH {SUMMARY}", f"WITH {SELECTED}", 1)
    for name in ("scorecard_totals", "scorecard_text")}
ORACLE |= {
    f"{name}_selected": ORACLE[name].replace(LOG, SELECTED, 1)
    .replace("FROM log GROUP BY", "FROM chosen GROUP BY")
    for name in ("calls_per_day", "calls_per_day_smoothed")}
