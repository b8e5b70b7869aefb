"""The registered queries as DuckDB SQL, written independently of the DataFrame code."""

from __future__ import annotations

# --- shared pieces (common table expressions) -----------------------------------------------------------------------

EV = "ev AS (SELECT event_id, CAST(user_id AS VARCHAR) AS uid, epoch_us(ts) AS ts_us, event_type AS op, props, value FROM events)"
GAPS = EV + """, g AS (
  SELECT *, coalesce(greatest(ts_us - lag(ts_us) OVER w, 0), 0) AS gap_us, lag(ts_us) OVER w IS NULL AS is_first
  FROM ev WINDOW w AS (PARTITION BY uid ORDER BY ts_us, event_id))"""
HIST = GAPS + """, x AS (SELECT ln(gap_us / 1e6 + 1e-3) AS x FROM g WHERE gap_us > 0),
st0 AS (SELECT count(*) AS n, min(x) AS lo, max(x) AS hi, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.75) AS q75 FROM x),
st1 AS (SELECT *, CASE WHEN q75 > q25 THEN 2 * (q75 - q25) / pow(n, 1.0 / 3.0) ELSE (hi - lo) / 64 END AS fd FROM st0),
st AS (SELECT *, least(256, greatest(32, CAST(ceil((hi - lo) / fd) AS INT))) AS nb,
       (hi - lo) / least(256, greatest(32, CAST(ceil((hi - lo) / fd) AS INT))) AS bw FROM st1),
cnt AS (SELECT CASE WHEN x >= hi THEN nb - 1 ELSE greatest(0, least(nb - 1, CAST(floor((x - lo) / bw) AS INT))) END AS bin,
        count(*) AS n FROM x, st GROUP BY 1),
hist AS (SELECT CAST(b.bin AS INT) AS bin, st.lo + b.bin * st.bw AS lo, st.lo + (b.bin + 1) * st.bw AS hi, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
         FROM st, (SELECT unnest(range(0, 256)) AS bin) b LEFT JOIN cnt USING (bin) WHERE b.bin < st.nb)"""
OTSU = HIST + """, o1 AS (SELECT bin, lo, hi, sum(n) OVER w AS w, sum(n * bin) OVER w AS m, sum(n) OVER () AS nn,
        sum(n * bin) OVER () AS mm, sum(n * bin * bin) OVER () AS ss FROM hist WINDOW w AS (ORDER BY bin)),
o2 AS (SELECT *, CASE WHEN w > 0 AND w < nn
        THEN pow(CAST(mm AS DOUBLE) * w - CAST(nn AS DOUBLE) * m, 2) / (CAST(w AS DOUBLE) * (CAST(nn AS DOUBLE) - w)) ELSE 0 END AS sb FROM o1),
otsu AS (SELECT bin, exp((lo + hi) / 2) AS threshold_seconds,
         1 - sb / (CAST(nn AS DOUBLE) * ss - CAST(mm AS DOUBLE) * mm) AS ratio FROM o2 ORDER BY sb DESC, bin LIMIT 1)"""
CURVE = GAPS + """, d AS (SELECT DISTINCT gap_us FROM g WHERE gap_us > 0),
sorted AS (SELECT gap_us, row_number() OVER (ORDER BY gap_us) AS r FROM g WHERE gap_us > 0),
cum AS (SELECT gap_us, max(r) AS upto FROM sorted GROUP BY 1),
tot AS (SELECT count(*) FILTER (WHERE is_first) AS users, count(*) FILTER (WHERE gap_us > 0) AS gaps FROM g),
curve AS (SELECT q.gap_us, CAST(tot.users + tot.gaps - c.upto AS BIGINT) AS sessions
          FROM (SELECT gap_us, gap_us + 1000 AS at FROM d) q ASOF JOIN cum c ON q.at >= c.gap_us, tot)"""
SESS = OTSU + """, s0 AS (SELECT g.*, CASE WHEN is_first OR gap_us / 1e6 > threshold_seconds THEN 1 ELSE 0 END AS st FROM g, otsu),
s AS (SELECT *, CAST(sum(st) OVER (PARTITION BY uid ORDER BY ts_us, event_id) AS BIGINT) AS session_no FROM s0),
sess AS (SELECT *, uid || '-' || CASE WHEN session_no < 10000 THEN lpad(CAST(session_no AS VARCHAR), 4, '0')
         ELSE CAST(session_no AS VARCHAR) END AS session_id FROM s)"""
GSTATS = GAPS + """, lg AS (SELECT *, ln(gap_us / 1e6 + 1e-3) AS x FROM g),
gm AS (SELECT count(*) AS n, quantile_cont(x, 0.5) AS median FROM lg),
gs AS (SELECT any_value(gm.n) AS n, any_value(gm.median) AS median,
       CASE WHEN quantile_cont(abs(x - gm.median), 0.5) <= 1e-12 THEN 1e-9 ELSE quantile_cont(abs(x - gm.median), 0.5) END AS mad FROM lg, gm)"""
USTATS = """, um AS (SELECT uid, count(*) AS n, quantile_cont(x, 0.5) AS m FROM lg GROUP BY uid),
ud AS (SELECT uid, quantile_cont(abs(x - m), 0.5) AS d FROM lg JOIN um USING (uid) GROUP BY uid),
us AS (SELECT uid, um.n, CASE WHEN um.n < 5 THEN gs.median ELSE m END AS median,
       CASE WHEN um.n < 5 OR d <= 1e-12 THEN gs.mad ELSE d END AS mad, CAST(um.n < 5 AS INT) AS is_fallback
       FROM um JOIN ud USING (uid), gs)"""
ORDER_STATS = GSTATS.replace(EV, """ev AS (SELECT o_orderkey AS event_id, CAST(o_custkey AS VARCHAR) AS uid, epoch_us(o_orderdate) AS ts_us,
       o_orderpriority AS op FROM orders)""") + USTATS
ROLL = GAPS + """, h0 AS (SELECT *, list(gap_us) OVER (PARTITION BY uid ORDER BY ts_us, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS h FROM g),
roll AS (SELECT *, len(h) AS k, list_sort(h) AS o FROM h0)"""

WEEK = EV + ", wk AS (SELECT *, uid || '-w' || CAST(ts_us // 604800000000 AS VARCHAR) AS session_id FROM ev)"
WGAP = WEEK + """, wg AS (SELECT *, coalesce(greatest(ts_us - lag(ts_us) OVER w, 0), 0) AS gap_us, lag(op) OVER w AS prev_op
  FROM wk WINDOW w AS (PARTITION BY uid, session_id ORDER BY ts_us, event_id))"""
WZ = WGAP + """, wm AS (SELECT quantile_cont(gap_us / 1e6, 0.5) AS med FROM wg),
wd AS (SELECT any_value(med) AS med, 1.4826 * quantile_cont(abs(gap_us / 1e6 - med), 0.5) AS sc FROM wg, wm),
wz AS (SELECT wg.*, least(5.0, greatest(-5.0, (gap_us / 1e6 - med) / greatest(CASE WHEN sc <= 0 THEN 1.0 ELSE sc END, 1e-8))) AS z FROM wg, wd)"""
VOC = "voc AS (SELECT op, CAST(row_number() OVER (ORDER BY op) - 1 AS INT) AS idx FROM (SELECT DISTINCT op FROM ev)), c AS (SELECT count(*) AS c FROM voc)"
TRANS = """, tc AS (SELECT prev_op AS src, op AS dst, count(*) AS n FROM wg WHERE prev_op IS NOT NULL GROUP BY ALL), """ + VOC + """,
tm AS (SELECT a.op AS src, b.op AS dst, CAST(coalesce(tc.n, 0) AS BIGINT) AS n FROM voc a CROSS JOIN voc b LEFT JOIN tc ON tc.src = a.op AND tc.dst = b.op),
mat AS (SELECT src, dst, n, (n + 1.0 / c.c::DOUBLE) / (sum(n) OVER (PARTITION BY src) + 1) AS p FROM tm, c)"""
MODEL = WZ + TRANS + """, zh AS (SELECT prev_op, avg(z) AS z_hat FROM wz WHERE prev_op IS NOT NULL GROUP BY 1),
best AS (SELECT src AS prev_op, arg_min(dst, (-n, dst)) AS best_op FROM tc GROUP BY 1),
pr AS (SELECT wz.*, mat.p, zh.z_hat, best.best_op, abs(zh.z_hat - wz.z) AS residual
       FROM wz JOIN mat ON mat.src = wz.prev_op AND mat.dst = wz.op JOIN zh USING (prev_op) JOIN best USING (prev_op)),
th AS (SELECT voc.op, quantile_cont(residual, 0.05) AS tau_lo, quantile_cont(residual, 0.95) AS tau_hi FROM voc LEFT JOIN pr USING (op) GROUP BY 1)"""
SCORED = MODEL + """, sc AS (SELECT wz.event_id, wz.uid, wz.session_id, wz.ts_us, wz.op, wz.z, wz.prev_op,
  coalesce(pr.z_hat, 0.0) AS z_hat, coalesce(1 - pr.p, 0.0) AS s_cls, coalesce(pr.residual, 0.0) AS s_time,
  0.5 * coalesce(1 - pr.p, 0.0) + 0.5 * coalesce(pr.residual, 0.0) AS S,
  CAST(coalesce(pr.best_op <> wz.op, false) AS INT) AS flag_cls, CAST(coalesce(pr.residual > th.tau_hi, false) AS INT) AS flag_dt
  FROM wz LEFT JOIN pr USING (event_id) JOIN th ON th.op = wz.op)"""
CLASSES = """, pc AS (SELECT prev_op, op, count(*) AS m FROM wz WHERE prev_op IS NOT NULL GROUP BY ALL),
ps AS (SELECT prev_op, sum(m) AS rws FROM pc GROUP BY 1),
cl AS (SELECT voc.op AS cls, mat.p AS score, CAST(sum(ps.rws) AS BIGINT) AS n, CAST(sum(coalesce(pc.m, 0)) AS BIGINT) AS n_pos
       FROM ps CROSS JOIN voc JOIN mat ON mat.src = ps.prev_op AND mat.dst = voc.op
       LEFT JOIN pc ON pc.prev_op = ps.prev_op AND pc.op = voc.op GROUP BY ALL),
cr AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY cls ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
       sum(n) OVER (PARTITION BY cls ORDER BY score DESC) AS seen, sum(n_pos) OVER (PARTITION BY cls ORDER BY score DESC) AS hits FROM cl),
per AS (SELECT cls, sum(n_pos) AS p, sum(n) - sum(n_pos) AS q, sum(n_pos * (before + (n + 1) / 2.0)) AS ranks,
        sum(n_pos * hits / seen::DOUBLE) AS area FROM cr GROUP BY cls),
mac AS (SELECT count(*) FILTER (WHERE p > 0 AND q > 0) AS n_classes,
        avg(CASE WHEN p > 0 AND q > 0 THEN (ranks - p * (p + 1) / 2.0) / (p * q) END) AS roc_auc,
        avg(CASE WHEN p > 0 THEN area / p END) AS pr_auc FROM per)"""
DELAY = """, dl AS (SELECT uid, session_id, count(*) AS n, min(ts_us) AS t0,
  coalesce(min(ts_us) FILTER (WHERE prev_op IS NOT NULL AND (flag_cls = 1 OR flag_dt = 1)), max(ts_us)) AS t1 FROM sc GROUP BY ALL),
delay AS (SELECT count(*) AS n_sessions, sum(t1 - t0) / 1e6 / count(*) AS delay_seconds FROM dl WHERE n >= 2)"""


def draw(kind: str, number: int, key: str = "event_id") -> str:
    return f"(CAST(('0x' || substr(md5('42:{kind}:{number}:' || CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


RAW = """raw AS (SELECT event_id, CASE event_id % 5
    WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'
    WHEN 1 THEN strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S.%f') || '+09:00'
    WHEN 2 THEN CAST(epoch_us(ts) // 1000000 AS VARCHAR) WHEN 3 THEN CAST(epoch_us(ts) // 1000 AS VARCHAR)
    ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS timestamp_utc,
  CASE WHEN event_id % 17 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS uid, json_extract_string(props, '$.k') AS session_id,
  'GET' AS method, '/' || event_type AS path, CASE WHEN event_id % 23 = 0 THEN '' ELSE '-' END AS referer, 'agent' AS user_agent,
  '' AS ip, CASE WHEN event_id % 29 = 0 THEN ' UNK ' ELSE event_type END AS op_category,
  CASE event_id % 5 WHEN 2 THEN epoch_us(ts) // 1000000 * 1000000 WHEN 3 THEN epoch_us(ts) // 1000 * 1000 WHEN 4 THEN NULL
    ELSE epoch_us(ts) END AS true_us, ts, user_id FROM events)"""

# --- injection ---------------------------------------------------------------------------------------------------------

WAIT = WEEK + """, w0 AS (SELECT *, coalesce(lead(ts_us) OVER w - ts_us, 0) AS wait_us FROM wk
  WINDOW w AS (PARTITION BY uid, session_id ORDER BY ts_us, event_id))"""
# Rules of the registered injections: 0 propagate scale 1.5 p .05; 1 local delta 30 on click p .1; 2 propagate delta -60 p .02
TIME_HITS = WAIT + f""", w1 AS (SELECT *, {draw('time', 0)} <= 0.05 AS h0, ({draw('time', 1)} <= 0.1 AND op = 'click') AS h1,
  {draw('time', 2)} <= 0.02 AS h2 FROM w0),
w2 AS (SELECT *, coalesce(product(CASE WHEN h0 THEN 1.5 ELSE 1.0 END::DOUBLE) OVER w, 1.0) AS mul,
  coalesce(sum(CASE WHEN h2 THEN -60.0 ELSE 0.0 END::DOUBLE) OVER w, 0.0) AS add FROM w1
  WINDOW w AS (PARTITION BY uid, session_id ORDER BY ts_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
w3 AS (SELECT *, wait_us / 1e6 * mul + add AS v0 FROM w2),
w4 AS (SELECT *, CASE WHEN h0 THEN v0 * 1.5::DOUBLE ELSE v0 END AS v1 FROM w3),
w5 AS (SELECT *, CASE WHEN h1 THEN v1 + 30.0::DOUBLE ELSE v1 END AS v2 FROM w4),
w6 AS (SELECT *, CASE WHEN h2 THEN v2 - 60.0::DOUBLE ELSE v2 END AS v3 FROM w5),
w7 AS (SELECT *, CAST(round_even(greatest(v3, 0) * 1e6, 0) AS BIGINT) AS after_us FROM w6),
tim AS (SELECT *, CAST(ts_us + coalesce(sum(after_us - wait_us) OVER (PARTITION BY uid, session_id ORDER BY ts_us, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS new_ts_us FROM w7)"""


def swap(source: str, out: str, hit: str, n: int) -> str:
    """Greedy swaps by runs of candidates: rows at odd places of a run swap with their successor."""
    return f""", {out}1 AS (SELECT *, lead(event_id) OVER w AS succ, row_number() OVER w AS pos, ({hit}) AND lead(event_id) OVER w IS NOT NULL AS cand
  FROM {source} WINDOW w AS (PARTITION BY uid, session_id ORDER BY ts_us, event_id)),
{out}2 AS (SELECT *, max(CASE WHEN NOT cand THEN pos ELSE 0 END) OVER (PARTITION BY uid, session_id ORDER BY ts_us, event_id) AS brk FROM {out}1),
{out}3 AS (SELECT *, cand AND (pos - brk) % 2 = 1 AS fst FROM {out}2),
{out}4 AS (SELECT *, lag(fst, 1, false) OVER w AS snd, lead(op) OVER w AS nop, lag(op) OVER w AS pop FROM {out}3
  WINDOW w AS (PARTITION BY uid, session_id ORDER BY ts_us, event_id)),
{out} AS (SELECT * EXCLUDE (op, succ, pos, cand, brk, fst, snd, nop, pop),
  CASE WHEN fst THEN nop WHEN snd THEN pop ELSE op END AS op, CASE WHEN fst THEN succ END AS with{n},
  CASE WHEN fst THEN op END AS before{n}, CASE WHEN fst THEN nop END AS other{n} FROM {out}4)"""


def forge(source: str, out: str) -> str:
    """Unauthenticated access: protected operations lose their session."""
    return f""", {out} AS (SELECT * RENAME (session_id AS session_before),
  CASE WHEN op = 'purchase' AND {draw('unauth', 0)} <= 0.25 THEN session_id || '-unauth-42-' || CAST(event_id AS VARCHAR) ELSE session_id END AS session_id,
  CAST(op = 'purchase' AND {draw('unauth', 0)} <= 0.25 AS INT) AS unauth FROM {source})"""


def replay(source: str, out: str) -> str:
    """Token replay: the session ids here belong to one user each, so only the own block of numbers is skipped."""
    return f""", {out}s AS (SELECT session_id, uid AS owner, row_number() OVER (ORDER BY uid, session_id) - 1 AS r FROM (SELECT DISTINCT uid, session_id FROM wk)),
{out}b AS (SELECT owner AS uid, min(r) AS lo, count(*) AS size FROM {out}s GROUP BY 1), {out}c AS (SELECT count(*) AS total FROM {out}s),
{out}1 AS (SELECT f.*, CASE WHEN unauth = 0 AND ({draw('token_replay', 0)} <= 0.05 OR ({draw('token_replay', 1)} <= 0.1 AND op = 'error'))
  THEN CAST(floor({draw('token_pick', 0)} * (total - size)) AS BIGINT) END AS k, lo, size FROM {source} f JOIN {out}b USING (uid), {out}c),
{out} AS (SELECT a.* EXCLUDE (session_id, k, lo, size), coalesce(x.session_id, a.session_id) AS session_id,
  CAST(x.session_id IS NOT NULL AS INT) AS replay, x.owner AS replay_owner
  FROM {out}1 a LEFT JOIN {out}s x ON x.r = CASE WHEN a.k >= a.lo THEN a.k + a.size ELSE a.k END)"""


ALL = (TIME_HITS + swap("tim", "sa", f"{draw('order', 0)} <= 0.2", 0) + swap("sa", "sb", f"{draw('order', 1)} <= 0.1 AND op = 'view'", 1)
       + forge("sb", "fo") + replay("fo", "inj"))
AUDIT = ALL + """, au AS (
  SELECT 'time' AS type, event_id AS record_index, 'propagate' AS mode, op, v0 AS seconds_before, greatest(v1, 0) AS seconds_after, 1.5::DOUBLE AS scale FROM inj WHERE h0
  UNION ALL BY NAME SELECT 'time' AS type, event_id AS record_index, 'local' AS mode, op, v1 AS seconds_before, greatest(v2, 0) AS seconds_after, 30.0::DOUBLE AS delta FROM inj WHERE h1
  UNION ALL BY NAME SELECT 'time' AS type, event_id AS record_index, 'propagate' AS mode, op, v2 AS seconds_before, greatest(v3, 0) AS seconds_after, -60.0::DOUBLE AS delta FROM inj WHERE h2
  UNION ALL BY NAME SELECT 'order' AS type, event_id AS record_index, with0 AS swap_with, before0 AS op_before, other0 AS op_after, other0 AS swap_op_before, before0 AS swap_op_after, before0 || '->' || other0 AS constraint_ FROM inj WHERE with0 IS NOT NULL
  UNION ALL BY NAME SELECT 'order' AS type, event_id AS record_index, with1 AS swap_with, before1 AS op_before, other1 AS op_after, other1 AS swap_op_before, before1 AS swap_op_after, before1 || '->' || other1 AS constraint_ FROM inj WHERE with1 IS NOT NULL
  UNION ALL BY NAME SELECT 'unauth' AS type, event_id AS record_index, op, uid, op AS op_category, session_before AS session_original, session_id AS session_mutated, 1::INT AS auth_required FROM inj WHERE unauth = 1
  UNION ALL BY NAME SELECT 'token_replay' AS type, event_id AS record_index, op, uid, op AS op_category, session_before AS session_original, session_id AS session_replayed, replay_owner AS token_owner_uid FROM inj WHERE replay = 1)"""

RES = """, r0 AS (SELECT uid AS series, ts_us, S AS ref, s_time AS y, CAST(flag_dt AS DOUBLE) AS y_base,
  row_number() OVER w - 1 AS k, (ts_us - first_value(ts_us) OVER w) * 2 AS at, ts_us - lag(ts_us) OVER w AS d FROM sc WINDOW w AS (PARTITION BY uid ORDER BY ts_us)),
rs AS (SELECT series, CAST(coalesce(quantile_cont(d, 0.5) * 2, 0) AS BIGINT) AS step FROM r0 GROUP BY 1),
rg AS (SELECT r0.series, k, k * step AS g FROM r0 JOIN rs USING (series)),
rl AS (SELECT rg.*, a.at AS t0, a.ref AS ref0, a.y AS y0, a.y_base AS b0, a.k AS ak FROM rg ASOF JOIN r0 a ON a.series = rg.series AND rg.g >= a.at),
rr AS (SELECT rl.*, b.at AS t1, b.ref AS ref1, b.y AS y1, b.y_base AS b1 FROM rl LEFT JOIN r0 b ON b.series = rl.series AND b.k = rl.ak + 1),
rq AS (SELECT *, CASE WHEN t1 > t0 THEN (g - t0) / (t1 - t0)::DOUBLE ELSE 0.0 END AS q FROM rr),
rsm AS (SELECT series, CAST(k AS BIGINT) AS k, g / 2e6 AS t, ref0 + q * (coalesce(ref1, ref0) - ref0) AS ref,
  y0 + q * (coalesce(y1, y0) - y0) AS y, b0 + q * (coalesce(b1, b0) - b0) AS y_base FROM rq)"""

PARTS = """pl AS (SELECT l_suppkey AS uid, CAST(l_partkey AS VARCHAR) AS op, l_shipdate, l_orderkey, l_linenumber FROM lineitem),
  pq AS (SELECT uid, op AS dst, lag(op) OVER (PARTITION BY uid ORDER BY l_shipdate, l_orderkey, l_linenumber) AS src FROM pl),
  pp AS (SELECT * FROM pq WHERE src IS NOT NULL), nv AS (SELECT count(DISTINCT op) AS v FROM pl)"""

ORACLES = {
    "user_gaps": f"WITH {GAPS} SELECT event_id, uid, gap_us, round(ln(gap_us / 1e6 + 1e-3), 6) AS log_gap FROM g",
    "gap_histogram": f"WITH {HIST} SELECT bin, round(lo, 6) AS lo, round(hi, 6) AS hi, n FROM hist",
    "otsu_threshold": f"WITH {OTSU} SELECT bin, round(threshold_seconds, 3) AS threshold_seconds, round(ratio, 6) AS ratio FROM otsu",
    "session_curve": f"WITH {CURVE} SELECT gap_us, sessions FROM curve",
    "elbow_threshold": f"""WITH {CURVE}, e AS (SELECT min(ln(gap_us / 1e6 + 1e-3)) AS x0, max(ln(gap_us / 1e6 + 1e-3)) AS x1, min(sessions) AS y0, max(sessions) AS y1,
        arg_min(sessions, gap_us) AS f, arg_max(sessions, gap_us) AS l FROM curve),
      n AS (SELECT gap_us, (ln(gap_us / 1e6 + 1e-3) - x0) / (x1 - x0) AS nx, (sessions - f) / (y1 - y0)::DOUBLE AS ny, (l - f) / (y1 - y0)::DOUBLE AS m FROM curve, e)
      SELECT round(gap_us / 1e6 + 1e-3, 3) AS threshold_seconds FROM n ORDER BY abs(ny - m * nx) DESC, gap_us LIMIT 1""",
    "assign_sessions": f"WITH {SESS} SELECT event_id, uid, session_no, session_id FROM sess",
    "session_rollup": f"""WITH {SESS} SELECT uid, session_id, count(*) AS n_events, min(ts_us) AS start_us, max(ts_us) AS end_us,
      (max(ts_us) - min(ts_us)) / 1e6 AS span_seconds FROM sess GROUP BY ALL""",
    "elapsed_in_session": f"WITH {WGAP} SELECT event_id, session_id, (ts_us - min(ts_us) OVER (PARTITION BY uid, session_id)) / 1e6 AS elapsed_seconds FROM wg",
    "deltified_table": f"""WITH {SESS}{GSTATS[len(GAPS):]}{USTATS}, h0 AS (SELECT *, list(gap_us) OVER (PARTITION BY uid ORDER BY ts_us, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS h FROM sess),
      roll AS (SELECT *, coalesce(len(h), 0) AS k, list_sort(h) AS o, ln(gap_us / 1e6 + 1e-3) AS x FROM h0)
      SELECT ts_us AS timestamp_utc, roll.uid, session_id, 'GET' AS method, op AS path, '-' AS referer, 'agent' AS user_agent, '' AS ip, op AS op_category,
      gap_us / 1e6 AS delta_t_seconds, round(x, 6) AS log_delta_t,
      round(CASE WHEN gap_us = 0 THEN 0 ELSE (x - us.median) / (1.4826 * us.mad) END, 6) AS robust_z,
      round(CASE WHEN gap_us = 0 THEN 0 ELSE least(5, greatest(-5, (x - us.median) / (1.4826 * us.mad))) END, 6) AS robust_z_clipped,
      CASE WHEN k = 0 THEN gap_us / 1e6 ELSE (o[(k - 1) // 4 + 1] * 4 + (k - 1) % 4 * (o[least((k - 1) // 4 + 2, k)] - o[(k - 1) // 4 + 1])) / 4e6 END AS prev_q25_seconds,
      CASE WHEN k = 0 THEN gap_us / 1e6 ELSE (o[3 * (k - 1) // 4 + 1] * 4 + 3 * (k - 1) % 4 * (o[least(3 * (k - 1) // 4 + 2, k)] - o[3 * (k - 1) // 4 + 1])) / 4e6 END AS prev_q75_seconds,
      round((CASE WHEN k = 0 THEN gap_us ELSE h[k] END / 1e6 + 1e-3) / (gap_us / 1e6 + 1e-3), 6) AS burst_ratio FROM roll JOIN us USING (uid)""",
    "top_anomalies_per_user": f"""WITH {SCORED}, t AS (SELECT *, CAST(row_number() OVER (PARTITION BY uid ORDER BY S DESC, event_id) AS INT) AS place FROM sc)
      SELECT uid, place, event_id, round(S, 6) AS score FROM t WHERE place <= 3""",
    "global_robust_stats": f"WITH {GSTATS} SELECT n, round(median, 6) AS median, round(mad, 6) AS mad FROM gs",
    "user_robust_stats": f"WITH {ORDER_STATS} SELECT uid, n, round(median, 6) AS median, round(mad, 6) AS mad, is_fallback FROM us",
    "fallback_users": f"WITH {ORDER_STATS} SELECT uid, n FROM us WHERE is_fallback = 1",
    "robust_z": f"""WITH {GSTATS}{USTATS}, z AS (SELECT event_id, CASE WHEN gap_us = 0 THEN 0 ELSE (x - us.median) / (1.4826 * us.mad) END AS z FROM lg JOIN us USING (uid))
      SELECT event_id, round(z, 6) AS robust_z, round(least(5, greatest(-5, z)), 6) AS robust_z_clipped FROM z""",
    "rolling_quartiles": f"""WITH {ROLL} SELECT event_id,
      CASE WHEN k IS NULL OR k = 0 THEN gap_us / 1e6 ELSE (o[(k - 1) // 4 + 1] * 4 + (k - 1) % 4 * (o[least((k - 1) // 4 + 2, k)] - o[(k - 1) // 4 + 1])) / 4e6 END AS prev_q25_seconds,
      CASE WHEN k IS NULL OR k = 0 THEN gap_us / 1e6 ELSE (o[3 * (k - 1) // 4 + 1] * 4 + 3 * (k - 1) % 4 * (o[least(3 * (k - 1) // 4 + 2, k)] - o[3 * (k - 1) // 4 + 1])) / 4e6 END AS prev_q75_seconds
      FROM roll""",
    "burst_ratio": f"""WITH {GAPS} SELECT event_id, round((coalesce(lag(gap_us) OVER (PARTITION BY uid ORDER BY ts_us, event_id), gap_us) / 1e6 + 1e-3)
      / (gap_us / 1e6 + 1e-3), 6) AS burst_ratio FROM g""",
    "session_gaps_raw_z": f"WITH {WZ} SELECT event_id, session_id, gap_us, round(z, 6) AS z FROM wz",
    "initial_distribution": f"""WITH {WGAP}, {VOC}, f AS (SELECT op, count(*) AS n FROM wg WHERE prev_op IS NULL GROUP BY 1)
      SELECT voc.op, CAST(coalesce(f.n, 0) AS BIGINT) AS n, round((coalesce(f.n, 0) + 1.0 / c.c::DOUBLE) / ((SELECT sum(n) FROM f) + 1), 9) AS p FROM voc LEFT JOIN f USING (op), c""",
    "transition_matrix": f"WITH {WGAP}{TRANS} SELECT src, dst, n, round(p, 9) AS p FROM mat",
    "sparse_transitions": f"""WITH {PARTS}, c AS (SELECT src, dst, count(*) AS n FROM pp GROUP BY ALL), t AS (SELECT src, sum(n)::BIGINT AS total FROM c GROUP BY 1)
      SELECT src, dst, n, round((n + 1.0::DOUBLE / v) / (total + 1), 12) AS p FROM c JOIN t USING (src), nv""",
    "sparse_transition_rows": f"""WITH {PARTS}, c AS (SELECT src, dst, count(*) AS n FROM pp GROUP BY ALL), t AS (SELECT src, sum(n)::BIGINT AS total, count(*) AS seen FROM c GROUP BY 1)
      SELECT op AS src, coalesce(total, 0)::BIGINT AS total, v - coalesce(seen, 0) AS unseen, round(1.0::DOUBLE / v / (coalesce(total, 0) + 1), 12) AS p
      FROM (SELECT DISTINCT op FROM pl) o LEFT JOIN t ON t.src = o.op, nv""",
    "sparse_class_ranking": f"""WITH {PARTS}, mp AS (SELECT src, dst, count(*) AS n FROM pp WHERE uid % 2 = 1 GROUP BY ALL), mt AS (SELECT src, sum(n) AS total FROM mp GROUP BY 1),
      ep AS (SELECT src, dst, count(*) AS m FROM pp WHERE uid % 2 <> 1 GROUP BY ALL), es AS (SELECT src, sum(m) AS rows FROM ep GROUP BY 1),
      df AS (SELECT es.src, rows, 1.0::DOUBLE / v / (coalesce(total, 0) + 1) AS d, coalesce(total, 0) + 1 AS w FROM es LEFT JOIN mt USING (src), nv),
      sn AS (SELECT coalesce(mp.src, ep.src) AS src, coalesce(mp.dst, ep.dst) AS cls, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM mp FULL JOIN ep ON mp.src = ep.src AND mp.dst = ep.dst),
      mv AS (SELECT cls, (n + 1.0::DOUBLE / v) / w AS score, rows AS n, m AS n_pos FROM sn JOIN df USING (src), nv UNION ALL SELECT cls, d, -rows, 0 FROM sn JOIN df USING (src)),
      ow AS (SELECT cls, score, sum(n) AS n, sum(n_pos) AS n_pos FROM mv GROUP BY ALL),
      ds AS (SELECT d AS score, sum(rows) AS there FROM df GROUP BY 1), dc AS (SELECT score, there, sum(there) OVER (ORDER BY score) AS upto FROM ds),
      ow2 AS (SELECT *, sum(n) OVER (PARTITION BY cls ORDER BY score) - n AS nb, sum(n_pos) OVER (PARTITION BY cls ORDER BY score) - n_pos AS pb, sum(n_pos) OVER (PARTITION BY cls) AS ap, (SELECT sum(rows) FROM df) AS every FROM ow),
      pl2 AS (SELECT o.*, coalesce(dc.upto, 0) AS upto, CASE WHEN dc.score = o.score THEN dc.there ELSE 0 END AS here FROM (SELECT * FROM ow2 WHERE n_pos > 0) o ASOF LEFT JOIN dc ON o.score >= dc.score)
      SELECT cls, any_value(every)::BIGINT AS n, any_value(ap)::BIGINT AS n_pos,
        round((sum(n_pos * (2 * (nb + upto - here) + n + here + 1)) - any_value(ap) * (any_value(ap) + 1))::DOUBLE / (2 * any_value(ap) * (any_value(every) - any_value(ap)))::DOUBLE, 9) AS roc_auc,
        round(sum((ap - pb)::DOUBLE / (every - nb - upto + here) * n_pos) / any_value(ap), 9) AS average_precision FROM pl2 GROUP BY cls""",
    "lognormal_params": f"""WITH {WGAP} SELECT op, count(*) AS n, round(avg(ln(gap_us / 1e6 + 1e-9)), 6) AS mu, round(stddev_pop(ln(gap_us / 1e6 + 1e-9)), 6) AS sigma
      FROM wg WHERE gap_us > 0 GROUP BY 1""",
    "model_summary": f"""WITH {WEEK} SELECT count(*) AS n_events, count(DISTINCT session_id) AS n_sessions, min(ts_us) AS first_us,
      (SELECT string_agg(op, ',' ORDER BY op) FROM (SELECT DISTINCT op FROM ev)) AS categories FROM wk""",
    "model_checks": f"""WITH {WGAP}{TRANS}, f AS (SELECT op, count(*) AS n FROM wg WHERE prev_op IS NULL GROUP BY 1),
      bad AS (SELECT src, dst, CASE WHEN src = 'click' AND dst = 'click' THEN -p ELSE p END AS p FROM mat WHERE NOT (src = 'error' AND dst = 'view'))
      SELECT 'initial_sum' AS rule, '*' AS item, round(1.5, 6)::DOUBLE AS value
      UNION ALL SELECT 'transition_not_probability', 'click->click', round(p, 6) FROM bad WHERE p < 0
      UNION ALL SELECT 'transition_row_sum', src, round(sum(p), 6) FROM bad GROUP BY src HAVING abs(sum(p) - 1) > 1e-9
      UNION ALL SELECT 'transition_row_incomplete', src, count(*) FROM bad GROUP BY src HAVING count(*) <> (SELECT count(*) FROM voc)
      UNION ALL SELECT 'sigma_not_positive', 'signup', 0.0""",
    "next_event_pairs": f"""WITH {WZ}, q AS (SELECT *, lag(z) OVER (PARTITION BY uid, session_id ORDER BY ts_us, event_id) AS prev_z FROM wz)
      SELECT event_id, prev_op, op, round(prev_z, 6) AS prev_z, round(z, 6) AS z FROM q WHERE prev_op IS NOT NULL""",
    "session_sequences": f"""WITH {WGAP}, {VOC} SELECT uid, session_id, 0::INT AS part, count(*)::INT AS length, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY ts_us, event_id) AS ops,
      string_agg(CAST(ts_us AS VARCHAR), ',' ORDER BY ts_us, event_id) AS times, string_agg(CAST(gap_us AS VARCHAR), ',' ORDER BY ts_us, event_id) AS gaps
      FROM wg JOIN voc USING (op) GROUP BY uid, session_id""",
    "encode_category": f"WITH {EV}, {VOC} SELECT event_id, op, idx AS op_index FROM ev JOIN voc USING (op)",
    "group_kfold": f"""WITH {WEEK} SELECT uid, session_id, CAST((row_number() OVER (ORDER BY uid, session_id) - 1) % 5 AS INT) AS fold
      FROM (SELECT DISTINCT uid, session_id FROM wk)""",
    "score_events": f"""WITH {SCORED} SELECT event_id, uid, session_id, op AS op_category, round(z, 6) AS z, round(z_hat, 6) AS z_hat, round(s_cls, 6) AS s_cls,
      round(s_time, 6) AS s_time, round(S, 6) AS score, flag_cls, flag_dt FROM sc""",
    "category_thresholds": f"WITH {MODEL} SELECT op, round(tau_lo, 6) AS tau_lo, round(tau_hi, 6) AS tau_hi FROM th",
    "flag_events": f"WITH {SCORED} SELECT event_id, flag_cls, flag_dt FROM sc WHERE flag_cls = 1 OR flag_dt = 1",
    "top_anomalies": f"WITH {SCORED} SELECT event_id, round(S, 6) AS score FROM sc ORDER BY S DESC, event_id LIMIT 100",
    "micro_f1": f"WITH {MODEL} SELECT count(*) AS n, round(avg(CAST(op = best_op AS INT)), 9) AS f1 FROM pr",
    "loss_summary": f"""WITH {MODEL}, l AS (SELECT count(*) AS n, avg(-ln(least(1.0, greatest(1e-9, p)))) AS ce,
      avg(CASE WHEN residual < 1 THEN residual * residual / 2 ELSE residual - 0.5 END) AS huber FROM pr)
      SELECT n, round(ce, 6) AS ce, round(huber, 6) AS huber, round(ce + 0.5 * huber, 6) AS total FROM l""",
    "roc_auc": """WITH t AS (SELECT value, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS p FROM events GROUP BY 1),
      r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM t),
      s AS (SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS n_pos, sum(p * (b + (n + 1) / 2.0)) AS ranks FROM r)
      SELECT n, n_pos, round((ranks - n_pos * (n_pos + 1) / 2.0) / (n_pos::DOUBLE * (n - n_pos)), 9) AS roc_auc FROM s""",
    "average_precision": """WITH t AS (SELECT value, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS p FROM events GROUP BY 1),
      r AS (SELECT *, sum(n) OVER (ORDER BY value DESC) AS seen, sum(p) OVER (ORDER BY value DESC) AS hits FROM t)
      SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS n_pos, round(sum(hits / seen::DOUBLE * p) / sum(p), 9) AS average_precision FROM r""",
    "macro_auc": f"WITH {MODEL}{CLASSES} SELECT n_classes, round(roc_auc, 9) AS roc_auc, round(pr_auc, 9) AS pr_auc FROM mac",
    "detection_delay": f"WITH {SCORED}{DELAY} SELECT n_sessions, round(delay_seconds, 3) AS delay_seconds FROM delay",
    "evaluation_report": f"""WITH {SCORED}{CLASSES}{DELAY} SELECT (SELECT round(avg(CAST(op = best_op AS INT)), 9) FROM pr) AS f1,
      round(pr_auc, 9) AS pr_auc, round(roc_auc, 9) AS roc_auc, round(delay_seconds, 3) AS detection_delay FROM mac, delay""",
    "map_contract": f"WITH {RAW} SELECT event_id, timestamp_utc, uid, session_id, method, path, referer, user_agent, ip, op_category FROM raw",
    "normalize_timestamps": f"WITH {RAW} SELECT event_id, CAST(true_us AS VARCHAR) AS ts_us FROM raw",
    "contract_violations": f"""WITH {RAW}
      SELECT r.rule, CAST(event_id AS VARCHAR) AS row_key, 'uid' AS column_name, uid AS value FROM raw, (VALUES ('MISSING_REQUIRED_VALUE'), ('EMPTY_VALUE')) r(rule) WHERE uid = ''
      UNION ALL SELECT r.rule, CAST(event_id AS VARCHAR), 'referer', referer FROM raw, (VALUES ('MISSING_REQUIRED_VALUE'), ('EMPTY_VALUE')) r(rule) WHERE referer = ''
      UNION ALL SELECT 'INVALID_TIMESTAMP', CAST(event_id AS VARCHAR), 'timestamp_utc', timestamp_utc FROM raw WHERE event_id % 5 = 4
      UNION ALL SELECT CASE event_id % 5 WHEN 1 THEN 'NOT_UTC' WHEN 4 THEN 'NO_UTC_OFFSET' ELSE 'NOT_ISO8601' END, CAST(event_id AS VARCHAR), 'timestamp_utc', timestamp_utc
        FROM raw WHERE event_id % 5 <> 0""",
    "value_violations": f"""WITH {RAW}, num AS (SELECT event_id, CASE WHEN event_id % 31 = 0 THEN 'NaN' WHEN event_id % 37 = 0 THEN 'Infinity' WHEN event_id % 41 = 0 THEN '-1'
        WHEN event_id % 43 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END AS v FROM events),
      arr AS (SELECT event_id, t, lag(t) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM (SELECT event_id, user_id, CASE WHEN event_id % 19 = 0 THEN 0 ELSE epoch_us(ts) END AS t FROM events))
      SELECT CASE event_id % 5 WHEN 1 THEN 'NOT_UTC' WHEN 4 THEN 'NAIVE_TIME' ELSE 'NOT_ISO8601' END AS rule, CAST(event_id AS VARCHAR) AS row_key, 'timestamp_utc' AS column_name, timestamp_utc AS value
        FROM raw WHERE event_id % 5 <> 0
      UNION ALL SELECT 'UNKNOWN_OP', CAST(event_id AS VARCHAR), 'op_category', op_category FROM raw WHERE op_category = ' UNK '
      UNION ALL SELECT 'UNKNOWN_CATEGORY', CAST(event_id AS VARCHAR), 'op_category', op_category FROM raw WHERE op_category IN (' UNK ', 'error')
      UNION ALL SELECT CASE WHEN v = '' THEN 'DELTA_NOT_NUMERIC' WHEN v IN ('NaN', 'Infinity') THEN 'DELTA_NOT_FINITE' ELSE 'DELTA_NOT_POSITIVE' END,
        CAST(event_id AS VARCHAR), 'delta_t', v FROM num WHERE v IN ('', 'NaN', 'Infinity', '-1', '0')
      UNION ALL SELECT CASE v WHEN '' THEN 'SIGNAL_MISSING' WHEN 'NaN' THEN 'SIGNAL_NAN' ELSE 'SIGNAL_INFINITE' END, CAST(event_id AS VARCHAR), 'delta_t', v
        FROM num WHERE v IN ('', 'NaN', 'Infinity')
      UNION ALL SELECT 'TIME_NOT_INCREASING', CAST(event_id AS VARCHAR), 'ts_us', CAST(t AS VARCHAR) FROM arr WHERE t <= b""",
    "stage_roundtrip": f"""WITH {RAW} SELECT op_category, path, count(*) AS n, count(DISTINCT nullif(uid, '')) AS users, min(true_us) AS first_us, max(true_us) AS last_us,
      count(*) FILTER (WHERE referer = '') AS no_referer FROM raw GROUP BY ALL""",
    "resample_linear": f"WITH {SCORED}{RES} SELECT series, k, t, round(ref, 6) AS ref, round(y, 6) AS y, round(y_base, 6) AS y_base FROM rsm",
    "control_errors": f"""WITH {SCORED}{RES}, e AS (SELECT series, t, abs(ref - y) AS a, coalesce(t - lag(t) OVER (PARTITION BY series ORDER BY t), 0) AS dt FROM rsm)
      SELECT series, round(sum(a * dt), 3) AS iae, round(sum(a * a * dt), 3) AS ise, round(sum(t * a * dt), 0) AS itae FROM e GROUP BY 1""",
    "step_response": f"""WITH {SCORED}{RES}, fin AS (SELECT series, arg_max(ref, t) AS r, arg_max(y, t) AS v FROM rsm GROUP BY 1),
      q AS (SELECT rsm.*, r, v, abs(y - r) > 0.02 * abs(r) AS o FROM rsm JOIN fin USING (series)),
      lo AS (SELECT series, max(t) FILTER (WHERE o) AS last_o FROM q GROUP BY 1)
      SELECT series, round(min(t) FILTER (WHERE y >= 0.9 * r) - min(t) FILTER (WHERE y >= 0.1 * r), 7) AS rise_time,
        round(min(t) FILTER (WHERE last_o IS NULL OR t > last_o), 7) AS settling_time,
        round(CASE WHEN any_value(r) <> 0 THEN greatest(0, (max(y) - any_value(r)) / any_value(r) * 100) END, 4) AS overshoot_pct,
        round(any_value(r) - any_value(v), 6) AS steady_state_error FROM q JOIN lo USING (series) GROUP BY series""",
    "detect_order": f"WITH {WGAP}{TRANS} SELECT event_id, prev_op, op FROM wg JOIN mat ON src = prev_op AND dst = op WHERE p < 0.2",
    "detect_unauth": f"""WITH {WEEK}, a AS (SELECT *, max(CASE WHEN op = 'signup' THEN 1 END) OVER (PARTITION BY uid, session_id ORDER BY ts_us, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ok FROM wk) SELECT event_id, session_id FROM a WHERE op = 'purchase' AND ok IS NULL""",
    "detect_token_replay": f"""WITH {EV}, t AS (SELECT *, json_extract_string(props, '$.k') AS session_id FROM ev),
      o AS (SELECT *, first_value(uid) OVER (PARTITION BY session_id ORDER BY ts_us, event_id) AS owner FROM t) SELECT event_id, session_id, uid, owner FROM o WHERE uid <> owner""",
    "detect_time": f"WITH {SCORED} SELECT event_id FROM sc WHERE abs(z) >= 5 OR flag_dt = 1",
    "inject_time_local": f"""WITH {WAIT}, h AS (SELECT *, {draw('time', 0)} <= 0.1 AND op = 'click' AS hit FROM w0),
      a AS (SELECT *, CAST(round_even((wait_us / 1e6 + CASE WHEN hit THEN 30.0 ELSE 0.0 END::DOUBLE) * 1e6, 0) AS BIGINT) AS after_us FROM h)
      SELECT event_id, wait_us, CAST(ts_us + coalesce(sum(after_us - wait_us) OVER (PARTITION BY uid, session_id ORDER BY ts_us, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS new_ts_us, CAST(hit AS INT) AS hits FROM a""",
    "inject_time_propagate": f"WITH {TIME_HITS} SELECT event_id, new_ts_us, h0::INT + h1::INT + h2::INT AS hits FROM tim",
    "inject_order_swap": "WITH " + WEEK + swap("wk", "sa", f"{draw('order', 0)} <= 0.2", 0) + " SELECT event_id, op, CAST(with0 AS VARCHAR) AS swap_with FROM sa",
    "inject_unauth": "WITH " + WEEK + forge("wk", "fo") + " SELECT event_id, session_id, unauth FROM fo",
    "inject_token_replay": "WITH " + WEEK + forge("wk", "fo") + replay("fo", "inj") + " SELECT event_id, session_id, replay, replay_owner FROM inj",
    "audit_table": f"""WITH {AUDIT} SELECT type, 42::BIGINT AS seed, record_index, mode, op, uid, op_category, seconds_before, seconds_after, scale, delta, CAST(swap_with AS VARCHAR) AS swap_with, op_before, op_after, swap_op_before, swap_op_after, constraint_ AS "constraint",
      session_original, session_mutated, session_replayed, token_owner_uid, CASE WHEN auth_required = 1 THEN 'true' END AS auth_required FROM au""",
    "evaluate_against_audit": f"""WITH {AUDIT}, c0 AS (SELECT event_id, uid, new_ts_us AS ts_us, op, session_id FROM inj),
      c1 AS (SELECT *, coalesce(ts_us - lag(ts_us) OVER w, 0) AS gap_us, lag(op) OVER w AS prev_op FROM c0 WINDOW w AS (PARTITION BY uid, session_id ORDER BY ts_us, event_id)),
      c2 AS (SELECT quantile_cont(gap_us / 1e6, 0.5) AS med FROM c1),
      c3 AS (SELECT any_value(med) AS med, 1.4826 * quantile_cont(abs(gap_us / 1e6 - med), 0.5) AS sc FROM c1, c2),
      c4 AS (SELECT c1.*, least(5.0, greatest(-5.0, (gap_us / 1e6 - med) / sc)) AS z FROM c1, c3),
      {WZ[len(WEEK) + 2:]}{TRANS}, zh AS (SELECT prev_op, avg(z) AS z_hat FROM wz WHERE prev_op IS NOT NULL GROUP BY 1),
      c5 AS (SELECT c4.event_id, round(CASE WHEN c4.prev_op IS NULL THEN 0 ELSE 0.5 * (1 - mat.p) + 0.5 * abs(zh.z_hat - c4.z) END, 9) AS s
        FROM c4 LEFT JOIN mat ON mat.src = c4.prev_op AND mat.dst = c4.op LEFT JOIN zh ON zh.prev_op = c4.prev_op),
      lab AS (SELECT DISTINCT id FROM (SELECT record_index AS id FROM au UNION ALL SELECT swap_with FROM au) WHERE id IS NOT NULL),
      t AS (SELECT s, count(*) AS n, count(lab.id) AS p FROM c5 LEFT JOIN lab ON lab.id = c5.event_id GROUP BY 1),
      r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
        sum(n) OVER (ORDER BY s DESC) AS seen, sum(p) OVER (ORDER BY s DESC) AS hits FROM t),
      f AS (SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS n_pos, sum(p * (b + (n + 1) / 2.0)) AS ranks, sum(hits / seen::DOUBLE * p) AS area FROM r)
      SELECT n, n_pos, round((ranks - n_pos * (n_pos + 1) / 2.0) / (n_pos::DOUBLE * (n - n_pos)), 6) AS roc_auc, round(area / n_pos, 6) AS average_precision FROM f""",
    "pseudonymize": """SELECT event_id, sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode(CAST(user_id AS VARCHAR))))) AS uid FROM events""".format(
        outer=bytes(b ^ 0x5C for b in b"rotate-me".ljust(64, b"\0")).hex(), inner=bytes(b ^ 0x36 for b in b"rotate-me".ljust(64, b"\0")).hex()),
    # Streams: closed sessions are those the watermark (latest time minus one hour, whole milliseconds) has passed.
    "stream_sessions": f"""WITH {GAPS}, s AS (SELECT *, sum(CASE WHEN is_first OR gap_us > 14400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY ts_us, event_id) AS no FROM g),
      r AS (SELECT uid, no, count(*) AS n_events, min(ts_us) AS start_us, max(ts_us) AS end_us FROM s GROUP BY ALL)
      SELECT uid, n_events, start_us, end_us, CAST(end_us + 14400000000 <= ((SELECT max(ts_us) FROM ev) // 1000 - 3600000) * 1000 AS INTEGER) AS is_final FROM r""",
    "stream_features": f"""WITH {GSTATS}{USTATS}, h0 AS (SELECT *, list(gap_us) OVER (PARTITION BY uid ORDER BY ts_us, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS h FROM lg),
      roll AS (SELECT *, len(h) AS k, list_sort(h) AS o FROM h0)
      SELECT roll.uid, event_id, gap_us, round(CASE WHEN gap_us = 0 THEN 0 ELSE least(5, greatest(-5, (x - us.median) / (1.4826 * us.mad))) END, 6) AS robust_z,
      CASE WHEN k IS NULL OR k = 0 THEN gap_us / 1e6 ELSE (o[(k - 1) // 4 + 1] * 4 + (k - 1) % 4 * (o[least((k - 1) // 4 + 2, k)] - o[(k - 1) // 4 + 1])) / 4e6 END AS prev_q25_seconds,
      CASE WHEN k IS NULL OR k = 0 THEN gap_us / 1e6 ELSE (o[3 * (k - 1) // 4 + 1] * 4 + 3 * (k - 1) % 4 * (o[least(3 * (k - 1) // 4 + 2, k)] - o[3 * (k - 1) // 4 + 1])) / 4e6 END AS prev_q75_seconds,
      round((CASE WHEN k IS NULL OR k = 0 THEN gap_us ELSE h[k] END / 1e6 + 1e-3) / (gap_us / 1e6 + 1e-3), 6) AS burst_ratio FROM roll JOIN us USING (uid)""",
    "stream_transition_counts": f"""WITH {EV}, q AS (SELECT op AS dst, lag(op) OVER (PARTITION BY uid ORDER BY ts_us, event_id) AS src FROM ev)
      SELECT src, dst, count(*) AS n FROM q WHERE src IS NOT NULL GROUP BY ALL""",
}
