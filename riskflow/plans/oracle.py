"""The same queries in SQL for DuckDB, over the given parquet tables."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

TX = """tx AS (
  SELECT event_id AS transaction_id, user_id AS payer_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS payee_id,
    CAST(value AS DECIMAL(18,2)) AS amount, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS amt, ts, epoch_us(ts) AS us,
    epoch_us(ts) // 1000000 AS s, event_type AS channel,
    CAST((user_id*131 % 120) - 60 + (event_id*7 % 5)*0.01 AS DOUBLE) AS geo_lat,
    CAST((user_id*197 % 300) - 150 + (event_id*3 % 7)*0.01 AS DOUBLE) AS geo_lng,
    CASE WHEN user_id % 10 = 3 THEN 1 ELSE 0 END AS is_sar
  FROM events)"""
TXL = """tx AS (
  SELECT md5(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice*100) AS BIGINT),
      strftime(l_shipdate, '%Y-%m-%d'))) AS transaction_id, o_custkey AS payer_id, 1000000 + l_suppkey AS payee_id,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS amt,
    l_shipdate AS ts, epoch_us(CAST(l_shipdate AS TIMESTAMP)) AS us, epoch_us(CAST(l_shipdate AS TIMESTAMP)) // 1000000 AS s,
    o_orderpriority AS channel
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def b(expr: str, name: str = "") -> str:
    """Integer output."""
    return f"CAST({expr} AS BIGINT) AS {name or expr}"


def r(expr: str, name: str = "", digits: int = 6) -> str:
    """Rounded double output."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name or expr}"


def add(name: str, *parts: str, base: str = TX) -> None:
    """The last part is the select; earlier parts are further CTEs."""
    ORACLE[name] = "WITH RECURSIVE " + ",\n".join([base, *parts[:-1]]) + "\n" + parts[-1]


def flag(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


def pattern(bases, col="amount") -> str:
    whole = f"CAST(round({col}) AS BIGINT)"
    return "CASE " + " ".join(f"WHEN {whole} % {x} = 0 THEN 'ROUND_{x}'" for x in bases) + " ELSE 'NOT_ROUND' END"


SMALL, LARGE = (100, 50, 10), (1000, 500, 100)
SCORE = "amt / (amt + 50.0)"

# ---- row-level features
add("basic_features", f"""SELECT transaction_id, {r('amt', 'amount')}, {r('ln(1 + amt)', 'amount_log')}, {b('hour(ts)', 'hour_of_day')},
  {b('isodow(ts) - 1', 'day_of_week')}, {b(flag('isodow(ts) >= 6'), 'is_weekend')},
  {b(flag('hour(ts) >= 22 OR hour(ts) <= 6'), 'is_night')}, {b(flag("channel = 'click'"), 'channel_click')},
  {b(flag("channel = 'view'"), 'channel_view')}, {b(flag("channel = 'purchase'"), 'channel_purchase')}, {b('1', 'has_geo')},
  {b(flag('amt % 100 = 0'), 'is_round_100')}, {b(flag('amt % 5 = 0'), 'is_round_5')} FROM tx""")
add("amount_pattern", f"""SELECT transaction_id, {pattern(LARGE)} AS amount_pattern,
  CASE WHEN amt < 1000 THEN 'A' WHEN amt < 10000 THEN 'B' WHEN amt < 50000 THEN 'C' ELSE 'D' END AS amount_bin FROM tx""", base=TXL)


def haversine(a1, o1, a2, o2):
    return (f"2 * 6371.0088 * asin(sqrt(least(1.0, power(sin((radians({a2}) - radians({a1})) / 2), 2) + cos(radians({a1})) * cos(radians({a2})) "
            f"* power(sin((radians({o2}) - radians({o1})) / 2), 2))))")


add("geo_hops", f"""SELECT transaction_id, concat(CAST(round(geo_lat, 2) AS VARCHAR), '_', CAST(round(geo_lng, 2) AS VARCHAR)) AS cell,
  {r(haversine('geo_lat', 'geo_lng', '0.0', '0.0'), 'km_from_origin', 4)} FROM tx""")
LEVEL = "CASE WHEN score >= 0.9 THEN 'CRITICAL' WHEN score >= 0.7 THEN 'HIGH' WHEN score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END"
add("decisions", f"s1 AS (SELECT *, {SCORE} AS score, payee_id / 100.0 AS confidence FROM tx)",
    f"s2 AS (SELECT *, {LEVEL} AS risk_level FROM s1)",
    f"""SELECT transaction_id, {r('score')}, risk_level,
  CASE risk_level WHEN 'CRITICAL' THEN CASE WHEN confidence > 0.8 THEN 'P1' ELSE 'P2' END
    WHEN 'HIGH' THEN CASE WHEN confidence > 0.7 THEN 'P2' ELSE 'P3' END
    WHEN 'MEDIUM' THEN CASE WHEN confidence > 0.6 THEN 'P3' ELSE 'P4' END ELSE 'P4' END AS alert_priority,
  CASE risk_level WHEN 'CRITICAL' THEN 'IMMEDIATE_BLOCK_AND_INVESTIGATE' WHEN 'HIGH' THEN 'BLOCK_AND_INVESTIGATE'
    WHEN 'MEDIUM' THEN 'INVESTIGATE_WITHIN_24H' ELSE 'MONITOR' END AS recommended_action,
  {b("CASE risk_level WHEN 'CRITICAL' THEN 120 WHEN 'HIGH' THEN 90 WHEN 'MEDIUM' THEN 45 ELSE 15 END + CASE WHEN payee_id < 10 THEN 30 ELSE 0 END", 'investigation_minutes')},
  CASE WHEN CAST(concat('0x', substr(md5(concat('champion:', transaction_id)), 1, 8)) AS BIGINT) % 10000 < 1000 THEN 'challenger' ELSE 'champion' END AS arm
  FROM s2""")
add("focal_loss", f"p AS (SELECT *, greatest(least({SCORE}, 1 - 1e-8), 1e-8) AS p FROM tx)",
    "q AS (SELECT channel, CASE WHEN is_sar = 1 THEN p ELSE 1 - p END AS pt, CASE WHEN is_sar = 1 THEN 0.25 ELSE 0.75 END AS a FROM p)",
    f"SELECT channel, {r('avg(-a * power(1 - pt, 2.0) * ln(pt))', 'focal_loss')} FROM q GROUP BY channel")


# ---- windows
def rng(w, excl=False, col="s"):
    return f"PARTITION BY payer_id ORDER BY {col} RANGE BETWEEN {w} PRECEDING AND {'1 PRECEDING' if excl else 'CURRENT ROW'}"


VELOCITY = f"""vel AS (SELECT *, count(*) OVER ({rng(86400)}) AS c1, count(*) OVER ({rng(604800)}) AS c7,
  count(*) OVER ({rng(2592000)}) AS c30, CAST(sum(amount) OVER ({rng(86400)}) AS DOUBLE) AS a1,
  count(DISTINCT payee_id) OVER ({rng(86400)}) AS p1, count(DISTINCT channel) OVER ({rng(86400)}) AS h1 FROM tx)"""
VSEL = f"""{b('c1', 'tx_count_24h')}, {b('c7', 'tx_count_7d')}, {b('c30', 'tx_count_30d')}, {r('a1', 'total_amount_24h')},
  {b('p1', 'unique_payees_24h')}, {b('h1', 'unique_channels_24h')}"""
add("velocity", VELOCITY, f"SELECT transaction_id, payer_id, {VSEL}, {r('c1 / c7', 'velocity_ratio_24h_7d')} FROM vel")
add("velocity_large", VELOCITY, f"SELECT transaction_id, {VSEL} FROM vel", base=TXL)
add("velocity_1h", f"SELECT transaction_id, {b(f'count(*) OVER ({rng(3600)})', 'tx_count_1h')} FROM tx")
add("high_velocity", f"v AS (SELECT transaction_id, count(*) OVER ({rng(86400)}) AS c FROM tx)",
    f"SELECT transaction_id, {b('c', 'tx_count_24h')}, {b(flag('c > (SELECT quantile_cont(c, 0.95) FROM v)'), 'high_velocity_flag')} FROM v")
add("edge_running", "q AS (SELECT payer_id, quantile_cont(amt, 0.95) AS p95 FROM tx GROUP BY 1)",
    f"""SELECT transaction_id, {b('count(*) OVER w', 'edge_weight')}, {r('sum(amount) OVER w', 'cumulative_amount')},
  {b(flag("datesub('second', lag(ts) OVER (PARTITION BY payer_id, payee_id ORDER BY us, transaction_id), ts) < 300"), 'rapid_sequence_signal')},
  {b(flag('amt > p95'), 'high_amount_signal')} FROM tx JOIN q USING (payer_id)
  WINDOW w AS (PARTITION BY payer_id, payee_id ORDER BY us, transaction_id ROWS UNBOUNDED PRECEDING)""")
BYP = "(PARTITION BY payer_id ORDER BY us, transaction_id)"


def seq(bases, band, k=5, strict=False):
    seen = f"sum(CASE WHEN amount BETWEEN {band[0]} AND {band[1]} THEN 1 ELSE 0 END)" if strict else "count(*)"
    return f"""seq AS (SELECT *, row_number() OVER {BYP} AS pos, lag(amt, 1) OVER {BYP} AS l1, lag(amt, 2) OVER {BYP} AS l2,
  lag(amt, 3) OVER {BYP} AS l3, datesub('minute', lag(ts) OVER {BYP}, ts) AS gap, {pattern(bases)} AS pat,
  count(DISTINCT payee_id) OVER (PARTITION BY payer_id ORDER BY us, transaction_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS div5,
  CASE WHEN amount BETWEEN {band[0]} AND {band[1]} AND {seen} OVER (PARTITION BY payer_id ORDER BY us, transaction_id
    ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) >= {k} THEN 1 ELSE 0 END AS smurf,
  avg(amt) OVER (PARTITION BY payer_id) AS pmean, stddev_samp(amt) OVER (PARTITION BY payer_id) AS pstd FROM tx)"""


RUNS = """runs0 AS (SELECT payer_id, pat, gap, row_number() OVER (PARTITION BY payer_id ORDER BY us, transaction_id)
    - row_number() OVER (PARTITION BY payer_id, pat ORDER BY us, transaction_id) AS grp FROM seq),
  runs1 AS (SELECT payer_id, pat, grp, count(*) AS len, sum(gap) AS g, count(gap) AS gn FROM runs0 GROUP BY ALL),
  runs AS (SELECT payer_id, pat, sum(len) AS n, sum(g) / nullif(sum(gn), 0) AS mgap, max(len) AS longest FROM runs1 GROUP BY ALL)"""
SEQ = seq(SMALL, (98, 99.99))
add("sequence_base", SEQ, f"""SELECT transaction_id, {b('pos', 'seq_position')}, {r('l1', 'prev_amount_1')}, {r('l2', 'prev_amount_2')},
  {r('l3', 'prev_amount_3')}, {b('gap', 'time_gap_minutes')}, pat AS amount_pattern, {b('div5', 'payee_diversity_5tx')} FROM seq""")
add("smurfing", seq(LARGE, (9800, 9999)), f"SELECT transaction_id, {b('smurf', 'potential_smurfing')} FROM seq", base=TXL)
add("smurfing_strict", seq(SMALL, (98, 99.99), 2, True), f"SELECT transaction_id, {b('smurf', 'potential_smurfing')} FROM seq")
add("velocity_spike", SEQ, f"SELECT transaction_id, {b(flag('gap < 240 AND amt > pmean * 1.5'), 'velocity_spike')} FROM seq")
add("layering", SEQ, f"SELECT transaction_id, {b(flag('div5 >= 4 AND gap < 600'), 'potential_layering')} FROM seq")
RSEL = f"SELECT payer_id, pat AS amount_pattern, {b('n', 'pattern_count')}, {r('mgap', 'avg_time_gap')}, {b('longest', 'max_run_length')} FROM runs"
add("run_lengths", SEQ, RUNS, RSEL)
add("run_lengths_large", seq(LARGE, (9800, 9999)), RUNS, RSEL, base=TXL)
Z = "(amt - pmean) / nullif(pstd, 0)"
add("amount_zscore", SEQ, f"SELECT transaction_id, {r(Z, 'amount_zscore')} FROM seq")
FLAGS = f"""sf AS (SELECT seq.*, {flag('gap < 30 AND amt > pmean * 1.5')} AS spike, {flag('div5 >= 4 AND gap < 60')} AS layer,
  {Z} AS z, n, longest FROM seq LEFT JOIN runs USING (payer_id, pat)),
  sfp AS (SELECT *, CASE WHEN amt < 100 AND smurf = 1 AND longest >= 3 THEN 'STRUCTURING_PATTERN'
  WHEN spike = 1 AND layer = 1 THEN 'LAYERING_PATTERN' WHEN n > 10 AND pat <> 'NOT_ROUND' THEN 'ROUND_AMOUNT_PATTERN'
  ELSE 'NORMAL' END AS seqpat FROM sf)"""
add("sequence_features", SEQ, RUNS, FLAGS, f"""SELECT transaction_id, {b('pos', 'seq_position')}, {b('gap', 'time_gap_minutes')},
  pat AS amount_pattern, {b('div5', 'payee_diversity_5tx')}, {b('smurf', 'potential_smurfing')}, {b('spike', 'velocity_spike')},
  {b('layer', 'potential_layering')}, {b('longest', 'max_run_length')}, {b('n', 'pattern_count')},
  seqpat AS sequence_risk_pattern, {r('z', 'amount_zscore')} FROM sfp""")
add("latest_n", "q AS (SELECT transaction_id, payer_id, row_number() OVER (PARTITION BY payer_id ORDER BY us DESC, transaction_id DESC) AS rn FROM tx)",
    "SELECT transaction_id, payer_id, rn FROM q WHERE rn <= 50")

# ---- profiles
EVT = """evt0 AS (SELECT payer_id, quantile_cont(amt, 0.95) AS p95 FROM tx GROUP BY 1),
  evt AS (SELECT payer_id, max(p95) AS p95, count(*) FILTER (amt > p95) AS nx, stddev_samp(amt) / avg(amt) AS cv
    FROM tx JOIN evt0 USING (payer_id) GROUP BY 1)"""
add("evt_profile", EVT, f"SELECT payer_id, {r('p95', 'evt_threshold_p95')}, {b('nx', 'extreme_count')}, {r('cv', 'tail_index_proxy')} FROM evt")
BURST = """gaps AS (SELECT payer_id, s, s - lag(s) OVER (PARTITION BY payer_id ORDER BY us, transaction_id) AS g FROM tx),
  gagg AS (SELECT payer_id, avg(g) AS m, stddev_samp(g) AS sd, var_samp(g) AS v FROM gaps GROUP BY 1),
  bins AS (SELECT payer_id, s // 3600 AS bin, count(*) AS c FROM tx GROUP BY 1, 2),
  bagg AS (SELECT payer_id, sum(c) / (max(bin) - min(bin) + 1) AS rate, sum(c * c) / (max(bin) - min(bin) + 1) AS sq FROM bins GROUP BY 1),
  burst AS (SELECT *, v / nullif(m, 0) AS fano, CASE WHEN v / nullif(m, 0) > 2 THEN 'BURSTY' WHEN v / nullif(m, 0) < 0.5 THEN 'REGULAR' ELSE 'NORMAL' END AS label FROM gagg JOIN bagg USING (payer_id))"""
add("burst_profile", BURST, f"""SELECT payer_id, {r('m', 'mean_interval', 4)}, {r('sd', 'std_interval', 4)}, {r('fano', 'fano_interval', 3)},
  {r('v / nullif(m * m, 0)', 'cv2_interval', 5)}, {r('(sq - rate * rate) / rate', 'fano_counts', 5)}, label AS burstiness_pattern FROM burst""")
GEO = f"""cells AS (SELECT payer_id, round(geo_lat, 2) AS a, round(geo_lng, 2) AS o, count(*) AS c FROM tx GROUP BY ALL),
  probs AS (SELECT payer_id, c / sum(c) OVER (PARTITION BY payer_id) AS p FROM cells),
  ent AS (SELECT payer_id, -sum(p * ln(p)) AS h, count(*) AS locs FROM probs GROUP BY 1),
  moves AS (SELECT payer_id, geo_lat AS a2, geo_lng AS o2, lag(geo_lat) OVER {BYP} AS a1, lag(geo_lng) OVER {BYP} AS o1 FROM tx),
  hops AS (SELECT payer_id, max({haversine('a1', 'o1', 'a2', 'o2')}) FILTER (a1 IS NOT NULL) AS hop FROM moves GROUP BY 1),
  geo AS (SELECT * FROM ent JOIN hops USING (payer_id))"""
add("geo_profile", GEO, f"SELECT payer_id, {r('h', 'geo_entropy')}, {b('locs', 'unique_locations')}, {r('hop', 'max_geo_distance', 4)} FROM geo")
NET = """pop AS (SELECT payee_id, count(*) AS seen FROM tx GROUP BY 1),
  net AS (SELECT payer_id, count(DISTINCT payee_id) AS deg, CAST(sum(amount) AS DOUBLE) / count(*) AS mean, sum(amt * ln(1 + seen)) AS proxy
    FROM tx JOIN pop USING (payee_id) GROUP BY 1)"""
add("network_profile", NET, f"SELECT payer_id, {b('deg', 'out_degree')}, {r('mean', 'avg_tx_amount')}, {r('proxy', 'pagerank_proxy', 3)} FROM net")
ENT = """estat AS (SELECT payer_id, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total, CAST(sum(amount) AS DOUBLE) / count(*) AS mean,
  stddev_samp(amt) AS sd, count(DISTINCT payee_id) AS payees, count(DISTINCT channel) AS channels,
  count(DISTINCT CAST(ts AS DATE)) AS days, count(*) FILTER (amt > 100) AS hi,
  count(*) FILTER (hour(ts) >= 22 OR hour(ts) <= 6) AS night, count(*) FILTER (channel = 'error') AS atm, max(is_sar) AS sar
  FROM tx GROUP BY 1)"""
add("entity_stats", ENT, f"""SELECT payer_id, {b('n', 'total_transactions')}, {r('total', 'total_amount')}, {r('mean', 'avg_amount')},
  {r('sd', 'std_amount')}, {b('payees', 'unique_payees')}, {b('channels', 'unique_channels')}, {b('days', 'active_days')},
  {b('hi', 'high_amount_count')}, {b('night', 'night_tx_count')}, {b('atm', 'atm_tx_count')} FROM estat""")
BEHAVE = """beh AS (SELECT vel.*, evt.p95, nx, cv, fano, m AS gapmean, label, h, hop, locs, deg, proxy, c1 / nullif(c7, 0) AS ratio,
  a1 / nullif(evt.p95, 0) AS aer, CASE WHEN c1 > (SELECT quantile_cont(c1, 0.95) FROM vel) THEN 1 ELSE 0 END AS hv,
  CASE WHEN amt > evt.p95 THEN 1 ELSE 0 END AS extreme, CASE WHEN locs > 10 THEN 1 ELSE 0 END AS disp
  FROM vel LEFT JOIN evt USING (payer_id) LEFT JOIN burst USING (payer_id) LEFT JOIN geo USING (payer_id) LEFT JOIN net USING (payer_id))"""
add("behavioral_features", VELOCITY, EVT, BURST, GEO, NET, BEHAVE, f"""SELECT transaction_id, {b('c1', 'tx_count_24h')},
  {r('p95', 'evt_threshold_p95')}, {b('nx', 'extreme_count')}, {r('cv', 'tail_index_proxy')}, {r('fano', 'fano_interval', 3)},
  {r('h', 'geo_entropy')}, {b('locs', 'unique_locations')}, {b('deg', 'out_degree')}, {r('aer', 'amount_evt_ratio')},
  label AS burstiness_pattern, {b('hv', 'high_velocity_flag')}, {b('extreme', 'extreme_amount_flag')}, {b('disp', 'geo_dispersion_flag')} FROM beh""")

# ---- encodings and edges
WOE = """eb AS (SELECT *, CASE WHEN mean < 100 THEN 'a0' WHEN mean < 1000 THEN 'a1' WHEN mean < 10000 THEN 'a2' ELSE 'a3' END AS ba,
    CASE WHEN n < 10 THEN 'v0' WHEN n < 50 THEN 'v1' WHEN n < 200 THEN 'v2' ELSE 'v3' END AS bv,
    CASE WHEN payees < 5 THEN 'd0' WHEN payees < 20 THEN 'd1' ELSE 'd2' END AS bd FROM estat),
  lb AS (SELECT ba AS bin, sar FROM eb UNION ALL SELECT bv, sar FROM eb UNION ALL SELECT bd, sar FROM eb),
  tot AS (SELECT count(*) FILTER (sar = 0) AS tg, count(*) FILTER (sar = 1) AS tb FROM eb),
  lc AS (SELECT bin, count(*) FILTER (sar = 0) AS g, count(*) FILTER (sar = 1) AS bd FROM lb GROUP BY 1),
  lw AS (SELECT bin, CASE WHEN g = 0 OR bd = 0 OR tg = 0 OR tb = 0 THEN 0 ELSE ln((g / tg) / (bd / tb)) END AS woe, g / nullif(tg, 0) - bd / nullif(tb, 0) AS diff FROM lc, tot),
  woe AS (SELECT eb.payer_id, sar, wa.woe AS woe_amount, wv.woe AS woe_volume, wd.woe AS woe_diversity, wa.woe * wa.diff AS iv_amount,
    wv.woe * wv.diff AS iv_volume, wd.woe * wd.diff AS iv_diversity
    FROM eb JOIN lw wa ON wa.bin = ba JOIN lw wv ON wv.bin = bv JOIN lw wd ON wd.bin = eb.bd)"""
WCOLS = ", ".join(r(f"{m}_{x}") for m in ("woe", "iv") for x in ("amount", "volume", "diversity"))
add("woe_fixed", ENT, WOE, f"SELECT payer_id, {b('sar', 'is_sar')}, {WCOLS} FROM woe")


def woe_q(features):
    """Quantile WOE of (name, expression) pairs."""
    edges = ", ".join(f"list_distinct([{', '.join(f'quantile_cont({e}, {p})' for p in (0.2, 0.4, 0.6, 0.8))}]) AS e_{n}, quantile_cont({e}, 0) AS lo_{n}, quantile_cont({e}, 1) AS hi_{n}"
                      for n, e in features)
    rows = " UNION ALL ".join(
        f"SELECT transaction_id, '{n}' AS feature, CAST(len(list_filter(e_{n}, lambda q: q < {e} AND q > lo_{n} AND q < hi_{n})) AS VARCHAR) AS bin, channel = 'error' AS y FROM tx, cuts"
        for n, e in features)
    return f"""cuts AS (SELECT {edges} FROM tx), long AS ({rows}),
  cnt AS (SELECT feature, bin, count(*) FILTER (NOT y) AS good, count(*) FILTER (y) AS bad FROM long GROUP BY 1, 2),
  shr AS (SELECT *, good / sum(good) OVER (PARTITION BY feature) AS g, bad / sum(bad) OVER (PARTITION BY feature) AS bb FROM cnt),
  ww AS (SELECT *, ln(greatest(g, 1e-6) / greatest(bb, 1e-6)) AS woe FROM shr),
  iv AS (SELECT *, sum((g - bb) * woe) OVER (PARTITION BY feature) AS iv FROM ww)"""


add("woe_quantile", woe_q([("amount", "amt"), ("k", "CAST(payee_id AS DOUBLE)"), ("geo_lat", "geo_lat")]),
    f"""SELECT feature, bin, {b('good')}, {b('bad')}, {r('woe')}, {r('iv')}, {b('dense_rank() OVER (ORDER BY iv DESC, feature)', 'rank')},
  CASE WHEN iv < 0.02 THEN 'NONE' WHEN iv < 0.1 THEN 'WEAK' WHEN iv < 0.3 THEN 'MEDIUM' ELSE 'STRONG' END AS strength FROM iv""")
add("woe_applied", woe_q([("amount", "amt"), ("k", "CAST(payee_id AS DOUBLE)")]),
    f"""SELECT transaction_id, {r("max(woe) FILTER (feature = 'amount')", 'woe_amount')}, {r("max(woe) FILTER (feature = 'k')", 'woe_k')}
  FROM long JOIN ww USING (feature, bin) GROUP BY 1""")
EDGES = """edges AS (SELECT payer_id AS src, payee_id AS dst, CAST(sum(amount) AS DOUBLE) AS total, CAST(sum(amount) AS DOUBLE) / count(*) AS mean,
  count(*) AS n, coalesce(stddev_samp(amt), 0) AS sd, min(us) AS t0, max(us) AS t1, ln(1 + CAST(sum(amount) AS DOUBLE)) AS w
  FROM tx WHERE payer_id <> payee_id GROUP BY 1, 2)"""
add("build_edges", EDGES, f"""SELECT src, dst, {b('n', 'transaction_count')}, {b('t0', 'first_transaction')}, {b('t1', 'last_transaction')},
  {r('total', 'total_amount')}, {r('mean', 'avg_amount')}, {r('sd', 'amount_std')}, {r('w', 'weight')}, {r('n / 30', 'velocity_score')},
  {r('sd / (mean + 1e-6)', 'amount_concentration')},
  {r('CASE WHEN n <= 1 THEN 0 WHEN t1 <= t0 THEN 1 ELSE least(n / ((t1 - t0) / 86400000000) / 10, 1) END', 'suspicious_timing')} FROM edges""")
GRAPH = """pairs AS (SELECT payer_id AS src, payee_id AS dst, CAST(sum(amount) AS DOUBLE) AS total, count(*) AS n, CAST(sum(amount) AS DOUBLE) / count(*) AS mean FROM tx GROUP BY 1, 2),
  degs AS (SELECT src, count(*) AS d FROM pairs GROUP BY 1),
  strong AS (SELECT * FROM pairs WHERE n >= 2),
  qs AS (SELECT quantile_cont(total, 0.9) AS q1, quantile_cont(CAST(n AS DOUBLE), 0.9) AS q2, quantile_cont(mean, 0.8) AS q3 FROM strong),
  comm AS (SELECT s.src, s.dst, count(*) AS common FROM strong s JOIN pairs x ON x.src = s.src JOIN pairs y ON y.src = s.dst AND y.dst = x.dst GROUP BY 1, 2),
  ge AS (SELECT s.*, coalesce(common, 0) AS common, coalesce(common / (a.d + z.d - common), 0) AS jac,
    CASE WHEN total > q1 AND n > q2 THEN 'HIGH_RISK' WHEN mean > q3 THEN 'MEDIUM_RISK' ELSE 'LOW_RISK' END AS cat
    FROM strong s CROSS JOIN qs LEFT JOIN comm c ON c.src = s.src AND c.dst = s.dst LEFT JOIN degs a ON a.src = s.src LEFT JOIN degs z ON z.src = s.dst)"""
add("graph_edges", GRAPH, f"""SELECT src AS source_node, dst AS target_node, {r('total', 'total_amount')}, {b('n', 'transaction_count')},
  {r('mean', 'avg_amount')}, {b('n', 'max_edge_weight')}, {b(flag('common > 0'), 'bridge_indicator')}, {r('jac', 'jaccard_similarity')},
  cat AS edge_risk_category, {b(flag('n > 100'), 'potential_structuring')}, {b(flag('common > 0'), 'community_bridge')} FROM ge""")
META = """ends AS (SELECT dst AS id, 1 AS inc, total, n FROM edges UNION ALL SELECT src, 0, total, n FROM edges),
  meta0 AS (SELECT id, sum(inc) AS ind, sum(1 - inc) AS outd, coalesce(CAST(sum(CAST(total AS DECIMAL(28,2))) FILTER (inc = 1) AS DOUBLE), 0) AS ina,
    coalesce(CAST(sum(CAST(total AS DECIMAL(28,2))) FILTER (inc = 0) AS DOUBLE), 0) AS outa, coalesce(sum(n) FILTER (inc = 1), 0) AS inn,
    coalesce(sum(n) FILTER (inc = 0), 0) AS outn FROM ends GROUP BY 1),
  meta AS (SELECT *, ind + outd AS deg, ina - outa AS net, ina + outa AS flow, inn + outn AS txs, abs(ina - outa) / (ina + outa + 1e-6) AS imb,
    (ind + outd) / nullif((SELECT count(*) FROM meta0) - 1, 0) AS dc FROM meta0)"""
add("node_metadata", EDGES, META, f"""SELECT id, {b('ind', 'in_degree')}, {b('outd', 'out_degree')}, {r('ina', 'in_amount')}, {r('outa', 'out_amount')},
  {b('inn', 'in_transactions')}, {b('outn', 'out_transactions')}, {b('deg', 'total_degree')}, {r('net', 'net_flow')}, {r('flow', 'total_flow')},
  {b('txs', 'total_transactions')}, {r('imb', 'flow_imbalance')}, {r('dc', 'degree_centrality')}, {r('ina / (inn + 1e-6)', 'avg_in_amount')},
  {r('outa / (outn + 1e-6)', 'avg_out_amount')} FROM meta""")
add("degree_centrality", EDGES, META, f"""SELECT id, {r('dc', 'degree')}, {r('ind / ((SELECT count(*) FROM meta) - 1)', 'in_degree')},
  {r('outd / ((SELECT count(*) FROM meta) - 1)', 'out_degree')} FROM meta""")
UEDGES = "ued AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(w) AS w, sum(total) AS total FROM edges GROUP BY 1, 2)"
add("undirected_edges", EDGES, UEDGES, f"SELECT a, b, {r('w')}, {r('total', 'total_amount')} FROM ued")
# all rows lie within 30 days of the newest one
MASTER = """cut AS (SELECT max(us) - 2592000000000 AS c30 FROM tx)"""
add("ml_features", VELOCITY, EVT, BURST, GEO, NET, BEHAVE, SEQ, RUNS, FLAGS, ENT, WOE, GRAPH, f"""SELECT beh.transaction_id, beh.payer_id, beh.payee_id,
  beh.us, {r('beh.amt', 'amount')}, beh.channel, {VSEL}, {r('ratio', 'velocity_ratio_24h_7d')}, {r('aer', 'amount_evt_ratio')},
  {r('fano', 'fano_interval', 3)}, {r('h', 'geo_entropy')}, {r('hop', 'max_geo_distance', 4)}, {b('deg', 'out_degree')},
  {r('proxy', 'pagerank_proxy', 3)}, {b('hv', 'high_velocity_flag')}, {b('extreme', 'extreme_amount_flag')}, {b('disp', 'geo_dispersion_flag')},
  cat AS edge_risk_category, {b('CASE WHEN ge.n IS NULL THEN NULL WHEN ge.n > 100 THEN 1 ELSE 0 END', 'graph_structuring_flag')},
  {b('CASE WHEN ge.n IS NULL THEN NULL WHEN common > 0 THEN 1 ELSE 0 END', 'community_bridge')},
  {b('smurf', 'potential_smurfing')}, {b('spike', 'velocity_spike')}, {b('layer', 'potential_layering')}, {b('longest', 'max_run_length')},
  {r('z', 'amount_zscore')}, {b(flag("seqpat <> 'NORMAL'"), 'sequence_anomaly_flag')}, {WCOLS}, {b('sar', 'target_label')},
  {b("hv + extreme + disp + CASE WHEN cat = 'HIGH_RISK' THEN 1 ELSE 0 END + smurf + layer + CASE WHEN seqpat <> 'NORMAL' THEN 1 ELSE 0 END", 'composite_risk_score')}
  FROM beh LEFT JOIN ge ON ge.src = beh.payer_id AND ge.dst = beh.payee_id LEFT JOIN sfp ON sfp.transaction_id = beh.transaction_id
  LEFT JOIN woe ON woe.payer_id = beh.payer_id""")

# ---- data preparation
DIRTY = """dirty AS (SELECT transaction_id, payer_id, payee_id, us, CASE WHEN transaction_id % 50 = 7 THEN -amount ELSE amount END AS amount,
  CASE WHEN transaction_id % 40 = 3 THEN geo_lat + 100 ELSE geo_lat END AS geo_lat, CASE WHEN transaction_id % 30 = 1 THEN NULL ELSE channel END AS channel FROM tx)"""
add("recent_scan", "SELECT transaction_id FROM tx WHERE us >= (SELECT max(us) FROM tx) - 604800000000")
add("validate_tx", DIRTY, """SELECT transaction_id, concat_ws(',', CASE WHEN channel IS NULL THEN 'channel_missing' END,
  CASE WHEN amount <= 0 THEN 'amount_not_positive' END, CASE WHEN geo_lat NOT BETWEEN -90 AND 90 THEN 'geo_lat_out_of_range' END) AS failed FROM dirty""")
add("dq_profile", DIRTY, " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {r(f'1 - count({c}) / count(*)', 'null_rate')}, {b(f'count(DISTINCT {c})', 'distinct_values')},
  CAST(min({c}) AS VARCHAR) AS minimum, CAST(max({c}) AS VARCHAR) AS maximum, {b(flag(f'1 - count({c}) / count(*) < 0.05'), 'acceptable')} FROM dirty"""
    for c in ("transaction_id", "payer_id", "channel", "us")))
add("scd2", "chg AS (SELECT payer_id, channel, us, transaction_id, lag(channel) OVER (PARTITION BY payer_id ORDER BY us, transaction_id) AS old FROM tx)",
    f"""SELECT payer_id, channel, us AS valid_from, lead(us) OVER w AS valid_to, {b(flag('lead(us) OVER w IS NULL'), 'is_current')} FROM chg
  WHERE old IS NULL OR old <> channel WINDOW w AS (PARTITION BY payer_id ORDER BY us, transaction_id)""")
add("screen", "listed AS (SELECT payee_id AS id, min(channel) AS kind FROM tx WHERE amount > 300 GROUP BY 1)",
    f"""SELECT transaction_id, a.kind AS payer_list, z.kind AS payee_list, {b(flag('a.kind IS NOT NULL OR z.kind IS NOT NULL'), 'watchlist_hit')}
  FROM tx LEFT JOIN listed a ON a.id = payer_id LEFT JOIN listed z ON z.id = payee_id""")
ORACLE["dedup_requests"] = f"""WITH RECURSIVE {TX},
  rq AS (SELECT transaction_id, us, md5(concat('{{"payer_id":', payer_id, ',"payee_id":', payee_id, ',"channel":"', channel, '"}}')) AS request_hash FROM tx),
  nx AS (SELECT request_hash, us, min(us) OVER (PARTITION BY request_hash ORDER BY us RANGE BETWEEN 259200000001 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM rq),
  computed(request_hash, us) AS (SELECT request_hash, min(us) FROM rq GROUP BY 1
    UNION SELECT c.request_hash, nx.later FROM computed c JOIN nx USING (request_hash, us) WHERE nx.later IS NOT NULL)
SELECT transaction_id, request_hash, {b(flag("us NOT IN (SELECT us FROM computed c WHERE c.request_hash = rq.request_hash)"), "reused")} FROM rq"""
ORACLE["resolve_entities"] = """WITH RECURSIVE ids AS (SELECT c_custkey AS id, concat('t', c_nationkey, regexp_replace(CAST(CAST(floor(c_acctbal / 20) AS BIGINT) AS VARCHAR), '[^A-Z0-9]', '', 'g')) AS k FROM customer
    UNION SELECT c_custkey, concat('d', regexp_replace(upper(c_mktsegment), '[^A-Z0-9]', '', 'g'), regexp_replace(CAST(CAST(floor(c_acctbal / 5) AS BIGINT) AS VARCHAR), '[^A-Z0-9]', '', 'g')) FROM customer),
  links AS (SELECT DISTINCT x.id AS a, y.id AS b FROM ids x JOIN ids y USING (k)),
  reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT a AS c_custkey, min(CAST(b AS VARCHAR)) AS entity_id FROM reach GROUP BY 1"""

# ---- point in time
D1 = "PARTITION BY payer_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING"
PIT24 = f"""pit AS (SELECT *, count(*) OVER ({D1}) AS n, coalesce(CAST(sum(amount) OVER ({D1}) AS DOUBLE), 0) AS total,
  count(DISTINCT payee_id) OVER ({D1}) AS np, coalesce(stddev_samp(amt) OVER ({D1}), 0) AS sd FROM tx),
  pit24 AS (SELECT *, coalesce(total / nullif(n, 0), 0) AS mean FROM pit)"""
P24 = f"""{b('n', 'tx_count_24h')}, {r('total', 'total_amount_24h')}, {b('np', 'unique_payees_24h')}"""
add("pit_24h", PIT24, f"""SELECT transaction_id, {P24}, {r('sd', 'amount_std_24h')}, {r('mean', 'amount_mean_24h')},
  {r('amt / greatest(mean, 1)', 'amount_vs_mean_ratio')} FROM pit24""")
add("pit_24h_large", PIT24, f"SELECT transaction_id, {P24}, {r('mean', 'amount_mean_24h')} FROM pit24", base=TXL)


def pit_tail(cap, order="us"):
    return f"""th0 AS (SELECT *, list(amt ORDER BY {order}) OVER (PARTITION BY payer_id ORDER BY us RANGE BETWEEN 2592000000000 PRECEDING AND 1 PRECEDING) AS h0 FROM tx),
  th1 AS (SELECT *, CASE WHEN len(h0) > {cap} THEN h0[len(h0) - {cap} + 1:] ELSE h0 END AS h FROM th0),
  th2 AS (SELECT *, coalesce(len(h), 0) >= 10 AS ok, list_aggregate(h, 'quantile_cont', 0.95) AS p95, list_avg(h) AS m, list_aggregate(h, 'stddev_pop') AS sd FROM th1),
  th3 AS (SELECT *, list_filter(h, lambda x: x > p95) AS ex FROM th2),
  tail AS (SELECT transaction_id, CASE WHEN ok THEN p95 ELSE amt END AS p95t, CASE WHEN ok AND amt > p95 THEN 1 ELSE 0 END AS above,
    CASE WHEN ok AND amt > p95 AND len(ex) > 0 THEN (amt - list_avg(ex)) / (list_aggregate(ex, 'stddev_pop') + 1e-8) ELSE 0 END AS exz,
    CASE WHEN ok THEN least(sd * sd / (m + 1e-8), 10) ELSE 1 END AS disp,
    CASE WHEN ok THEN (len(list_filter(h, lambda x: x < amt)) + len(list_filter(h, lambda x: x <= amt))
      + CASE WHEN list_contains(h, amt) THEN 1 ELSE 0 END) / (2.0 * len(h)) ELSE 0.5 END AS pct,
    CASE WHEN ok THEN (amt - m) / (sd + 1e-8) ELSE 0 END AS z FROM th3)"""


TSEL = f"""{r('p95t', 'evt_p95_threshold', 5)}, {b('above', 'amount_above_evt')}, {r('exz', 'evt_excess_zscore', 2)},
  {r('disp', 'amount_dispersion', 5)}, {r('pct', 'amount_percentile', 5)}, {r('z', 'amount_zscore', 5)}"""
add("pit_tail", pit_tail(1000), f"SELECT transaction_id, {TSEL} FROM tail")
add("pit_tail_short", pit_tail(20), f"SELECT transaction_id, {TSEL} FROM tail")


def behaviour(size):
    return f"""bh0 AS (SELECT *, CAST(round(amount) AS BIGINT) AS whole, lag(us) OVER {BYP} AS pus, lag(amount) OVER {BYP} AS pamt FROM tx),
  bh1 AS (SELECT transaction_id, payer_id, us, amt, list({{'us': us, 'pus': pus, 'ch': channel, 'rnd': CASE WHEN whole % 10 = 0 THEN 1 ELSE 0 END + CASE WHEN whole % 5 = 0 THEN 1 ELSE 0 END,
    'rapid': (us - pus) // 60000000 < 600, 'sim': abs(amount - pamt) < 20 AND amount > 30}} ORDER BY us, transaction_id)
    OVER (PARTITION BY payer_id ORDER BY us RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING) AS h0 FROM bh0),
  bh2 AS (SELECT *, coalesce(CASE WHEN len(h0) > {size} THEN h0[len(h0) - {size} + 1:] ELSE h0 END, []) AS h FROM bh1),
  bh AS (SELECT *, len(h) AS n, greatest(len(h), 1) AS per FROM bh2)"""


BSEL = f"""{b('bh.n', 'recent_tx_count')}, {r('coalesce(list_sum(list_transform(h, lambda x: x.rnd)), 0) / per', 'round_amount_ratio', 5)},
  {r('len(list_filter(h, lambda x: x.pus >= bh.us - 604800000000 AND x.rapid)) / per', 'rapid_sequence_ratio', 5)},
  {r('len(list_filter(h, lambda x: x.pus >= bh.us - 604800000000 AND x.sim)) / per', 'similar_amount_ratio', 5)},
  {b('greatest(list_unique(list_transform(h, lambda x: x.ch)), 1)', 'channel_diversity')},
  {b(flag('CAST(bh.amt * 100 AS BIGINT) % 1000 = 0'), 'amount_is_round_10')}, {b(flag('CAST(bh.amt * 100 AS BIGINT) % 500 = 0'), 'amount_is_round_5')}"""
add("pit_behaviour", behaviour(20), f"SELECT transaction_id, {BSEL.replace(', 5)', ', 6)')} FROM bh".replace(", 5) + 0.0", ", 6) + 0.0"))
M1 = "RANGE BETWEEN 2592000000000 PRECEDING AND 1 PRECEDING"
PNET = f"""nw AS (SELECT transaction_id, count(DISTINCT payee_id) OVER (PARTITION BY payer_id ORDER BY us {M1}) AS od,
    count(DISTINCT payer_id) OVER (PARTITION BY payee_id ORDER BY us {M1}) AS idg,
    list(payee_id) OVER (PARTITION BY payer_id ORDER BY us {M1}) AS seen,
    count(*) OVER (PARTITION BY payer_id, payee_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM tx),
  pnet AS (SELECT *, coalesce(list_max(map_values(list_histogram(seen))), 0) AS peak FROM nw)"""
NSEL = f"""{b('od', 'payer_out_degree')}, {b('idg', 'payee_in_degree')}, {b('peak', 'max_tx_to_counterparty')},
  {b(flag('prev > 0'), 'is_repeated_counterparty')}, {b('prev', 'previous_tx_count')}"""
add("pit_network", PNET, f"SELECT transaction_id, {NSEL}, {r('ln(1 + od * idg)', 'network_centrality_proxy')} FROM pnet")
add("online_features", PIT24, pit_tail(1000, "us, transaction_id"), behaviour(50), PNET, f"""SELECT pit24.transaction_id, {r('pit24.amt', 'amount', 5)}, {r('ln(1 + pit24.amt)', 'amount_log', 5)},
  {b('hour(ts)', 'hour_of_day')}, {b('isodow(ts) - 1', 'day_of_week')}, {b(flag('isodow(ts) >= 6'), 'is_weekend')},
  {b(flag('hour(ts) >= 22 OR hour(ts) <= 6'), 'is_night')}, {b(flag("channel = 'click'"), 'channel_click')},
  {b(flag("channel = 'view'"), 'channel_view')}, {b(flag("channel = 'purchase'"), 'channel_purchase')}, {b('1', 'has_geo')},
  {b('pit24.n', 'tx_count_24h')}, {r('total', 'total_amount_24h', 5)}, {b('np', 'unique_payees_24h')}, {r('sd', 'amount_std_24h', 5)},
  {r('mean', 'amount_mean_24h', 5)}, {r('pit24.amt / greatest(mean, 1)', 'amount_vs_mean_ratio', 5)}, {TSEL}, {BSEL}, {NSEL},
  {r('ln(1 + od * idg)', 'network_centrality_proxy', 5)}
  FROM pit24 JOIN tail USING (transaction_id) JOIN bh USING (transaction_id) JOIN pnet USING (transaction_id)""")
add("asof_interval", f"""SELECT l.transaction_id, {b('count(e.us)', 'errors_24h')}, {r('coalesce(sum(e.amount), 0)', 'error_amount_24h')} FROM tx l LEFT JOIN tx e
  ON e.payer_id = l.payer_id AND e.channel = 'error' AND e.us >= l.us - 86400000000 AND e.us < l.us GROUP BY 1""")

# ---- graph
NODES = "nodes AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), nn AS (SELECT count(*) AS n FROM nodes)"


SETTLED = 30  # rounds by which ranks no longer change in the digits compared


def unrolled_pagerank(k, alpha=0.85, jump="(SELECT 1.0 / n FROM nn)"):
    """k rounds as chained CTEs; ``jump`` is the teleport share of node ``id``."""
    parts = ["outw AS (SELECT src, sum(w) AS sw FROM edges GROUP BY 1)",
             "lnk AS MATERIALIZED (SELECT e.src, e.dst, w / sw AS share FROM edges e JOIN outw USING (src))",
             f"jmp AS MATERIALIZED (SELECT id, {jump} AS j FROM nodes)",
             "x0 AS MATERIALIZED (SELECT id, (SELECT 1.0 / n FROM nn) AS x FROM nodes)"]
    for i in range(k):
        parts.append(f"""x{i + 1} AS MATERIALIZED (SELECT jmp.id, {alpha} * (coalesce(got, 0) + j * (SELECT coalesce(sum(x), 0) FROM x{i} WHERE id NOT IN (SELECT src FROM outw))) + {1 - alpha} * j AS x
  FROM jmp LEFT JOIN (SELECT dst, sum(x * share) AS got FROM lnk JOIN x{i} ON src = x{i}.id GROUP BY 1) g ON g.dst = jmp.id)""")
    return parts


add("pagerank", EDGES, NODES, *unrolled_pagerank(SETTLED), f"SELECT id, {r('x', 'pagerank', 9)} FROM x{SETTLED}")
SEEDS = "CASE WHEN id IN (SELECT payer_id FROM tx WHERE is_sar = 1) THEN 1.0 ELSE 0 END / (SELECT count(*) FROM nodes WHERE id IN (SELECT payer_id FROM tx WHERE is_sar = 1))"
add("propagate_risk", EDGES, NODES, *unrolled_pagerank(SETTLED, jump=SEEDS), f"SELECT id, {r('x', 'risk', 9)} FROM x{SETTLED}")
BOTH = "bw AS MATERIALIZED (SELECT a AS src, b AS dst, w FROM ued UNION ALL SELECT b, a, w FROM ued)"


def unrolled_eigen(k):
    parts = ["v0 AS MATERIALIZED (SELECT id, (SELECT 1.0 / n FROM nn) AS x FROM nodes)"]
    for i in range(k):
        parts.append(f"y{i} AS MATERIALIZED (SELECT v.id, v.x + sum(w * o.x) AS x FROM v{i} v JOIN bw ON bw.dst = v.id JOIN v{i} o ON o.id = bw.src GROUP BY v.id, v.x)")
        parts.append(f"v{i + 1} AS MATERIALIZED (SELECT id, x / (SELECT sqrt(sum(x * x)) FROM y{i}) AS x FROM y{i})")
    return parts


add("eigenvector", EDGES, NODES, UEDGES, BOTH, *unrolled_eigen(SETTLED), f"SELECT id, {r('x', 'eigenvector', 8)} FROM v{SETTLED}")
COMP = """reach(id, c) AS (SELECT id, id FROM nodes UNION SELECT bw.dst, reach.c FROM reach JOIN bw ON bw.src = reach.id WHERE reach.c < bw.dst),
  comp AS (SELECT id, min(c) AS component FROM reach GROUP BY 1)"""
add("components", EDGES, NODES, UEDGES, BOTH, COMP, "SELECT id, component FROM comp")
ORACLE["order_components"] = """WITH RECURSIVE l AS (SELECT DISTINCT concat('p', l_partkey) AS a, concat('o', l_orderkey) AS b FROM lineitem),
  bw AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
  reach(id, c) USING KEY (id) AS (SELECT a, min(least(a, b)) FROM bw GROUP BY 1
    UNION SELECT bw.b, min(reach.c) FROM reach JOIN bw ON bw.a = reach.id JOIN recurring.reach known ON known.id = bw.b WHERE reach.c < known.c GROUP BY 1)
SELECT id, c AS component FROM reach"""


def unrolled_labels(k):
    parts = ["l0 AS MATERIALIZED (SELECT id, id AS label FROM nodes)"]
    for i in range(k):
        parts.append(f"""c{i} AS (SELECT bw.dst AS id, label, count(*) AS n FROM bw JOIN l{i} ON l{i}.id = bw.src GROUP BY 1, 2),
  l{i + 1} AS MATERIALIZED (SELECT id, arg_min(label, struct_pack(a := -n, b := label)) AS label FROM c{i} GROUP BY 1)""")
    return parts


LABELS = [EDGES, NODES, UEDGES, BOTH, *unrolled_labels(5)]
add("label_propagation", *LABELS, "SELECT 'label_propagation' AS method, id AS node, label AS community_id FROM l5")
add("community_report", *LABELS, META, f"""SELECT 'label_propagation' AS method, label AS community_id, {b('count(*)', 'size')},
  array_to_string(list_slice(list_sort(list(meta.id)), 1, 10), ',') AS members, {r('sum(flow)', 'total_flow', 4)},
  {r('sum(flow) / count(*)', 'avg_flow_per_member', 4)}, {b('sum(txs)', 'total_transactions')},
  {r('sum(txs) / count(*)', 'avg_transactions_per_member', 4)}, {r('avg(dc)', 'avg_degree', 4)} FROM l5 JOIN meta USING (id) GROUP BY label""")
RISK = """rk0 AS (SELECT *, least(2 * coalesce(dc, 0) + 100 * pr, 1) AS cr, CASE WHEN flow > 0 THEN greatest(least(log10(flow) / 6, 1), 0) ELSE 0 END AS vr,
    CASE WHEN txs > 0 THEN least(txs / 30 / 50, 1) ELSE 0 END AS sr, CASE WHEN outd / greatest(ind, 1) > 10 OR outd / greatest(ind, 1) < 0.1 THEN 0.8 ELSE 0.1 END AS st FROM metap),
  rk AS (SELECT *, least(0.25 * cr + 0.25 * vr + 0.2 * imb + 0.2 * sr + 0.1 * st, 1) AS total_risk FROM rk0)"""
add("entity_risk", EDGES, NODES, META, *unrolled_pagerank(SETTLED), f"metap AS (SELECT meta.*, x AS pr FROM meta JOIN x{SETTLED} USING (id))", RISK,
    f"SELECT id, {r('cr', 'centrality_risk')}, {r('vr', 'volume_risk')}, {r('imb', 'imbalance_risk')}, {r('sr', 'velocity_risk')}, {r('st', 'structural_risk')}, {r('total_risk', 'composite_risk')} FROM rk")
add("network_summary", EDGES, NODES, UEDGES, BOTH, COMP, META, "metap AS (SELECT *, 0 AS pr FROM meta)", RISK,
    "cs AS (SELECT component, count(*) AS size FROM comp GROUP BY 1)",
    f"""SELECT {b('(SELECT n FROM nn)', 'nodes')}, {b('(SELECT count(*) FROM cs)', 'components')}, {b('(SELECT max(size) FROM cs)', 'largest_component')},
  {b('(SELECT count(*) FROM edges)', 'edges')}, {r('avg(total_risk)', 'mean_risk')}, {r('stddev_pop(total_risk)', 'std_risk')},
  {b('count(*) FILTER (total_risk > 0.7)', 'high_risk_entities')}, {b('count(*) FILTER (total_risk < 0.3)', 'low_risk_entities')},
  {r('(SELECT count(*) FROM edges) / (SELECT n * (n - 1) FROM nn)', 'density')}, {r('(SELECT max(size) FROM cs) / (SELECT n FROM nn)', 'connectivity_ratio')} FROM rk""")
add("entity_patterns", *LABELS, META, "ud AS (SELECT src AS id, count(*) AS nb FROM bw GROUP BY 1)", "lsz AS (SELECT label, count(*) AS size FROM l5 GROUP BY 1)",
    "pb AS (SELECT meta.*, nb, size FROM meta JOIN ud USING (id) JOIN l5 USING (id) JOIN lsz USING (label))",
    f"""SELECT id, 'hub' AS pattern, CASE WHEN nb < 300 THEN 'medium' ELSE 'high' END AS severity, {r('least(nb / 600, 1)', 'score')} FROM pb WHERE nb > 60
  UNION ALL SELECT id, 'high_velocity', 'medium', {r('least(txs / 750, 1)', 'score')} FROM pb WHERE txs > 150
  UNION ALL SELECT id, 'flow_imbalance', 'medium', {r('imb', 'score')} FROM pb WHERE imb > 0.5
  UNION ALL SELECT id, 'isolated_community', 'low', {r('1 / size', 'score')} FROM pb WHERE size < 5""")
add("entity_neighbours", EDGES, "SELECT src AS id, 'out' AS direction, dst AS neighbour FROM edges UNION ALL SELECT dst, 'in', src FROM edges")
add("khop", EDGES, META, "f0 AS (SELECT id, outa / (outn + 1e-6) AS f, outd AS g FROM meta)",
    "f1 AS (SELECT dst AS id, avg(f) AS f, avg(g) AS g FROM edges JOIN f0 ON src = id GROUP BY 1)",
    "f2 AS (SELECT dst AS id, avg(f) AS f, avg(g) AS g FROM edges JOIN f1 ON src = id GROUP BY 1)",
    f"""SELECT f0.id, {r('f0.f', 'avg_out_amount')}, {r('f0.g', 'out_degree')}, {r('f1.f', 'avg_out_amount_hop1')}, {r('f1.g', 'out_degree_hop1')},
  {r('f2.f', 'avg_out_amount_hop2')}, {r('f2.g', 'out_degree_hop2')} FROM f0 LEFT JOIN f1 USING (id) LEFT JOIN f2 USING (id)""")

# ---- validation and drift
SC = """sc AS (SELECT *, amt / (amt + 50.0) AS p1, (payee_id + 1) / 102.0 AS p2, CASE WHEN channel = 'error' THEN 1 ELSE 0 END AS y,
  CASE WHEN channel = 'click' THEN 1 ELSE 0 END AS t, transaction_id % 2 AS z, CAST((payee_id + 10) / 120.0 AS DOUBLE) AS e,
  CAST(payee_id AS DOUBLE) AS k, CAST(hour(ts) AS DOUBLE) AS h, day(ts) AS dom FROM tx)"""


def shares(days=False):
    """Bin shares of two features in both halves of the month; per day of the second half when asked."""
    parts = []
    for f in ("amt", "k"):
        parts.append(f"""SELECT '{f}' AS feature, len(list_filter(list_distinct(e_{f}), lambda q: q < {f})) AS bin, dom, dom > 15 AS cur FROM sc, ed WHERE {f} IS NOT NULL""")
    cuts = ", ".join(f"[{', '.join(f'quantile_cont({f}, {i / 10})' for i in range(1, 10))}] AS e_{f}" for f in ("amt", "k"))
    head = f"ed AS (SELECT {cuts} FROM sc WHERE dom <= 15), bl AS ({' UNION ALL '.join(parts)})"
    if days:
        return head + """, re AS (SELECT feature, bin, count(*) AS e FROM bl WHERE NOT cur GROUP BY 1, 2),
  dy AS (SELECT DISTINCT dom AS day FROM bl WHERE cur), ac AS (SELECT dom AS day, feature, bin, count(*) AS a FROM bl WHERE cur GROUP BY 1, 2, 3),
  gd AS (SELECT day, feature, bin, e, coalesce(a, 0) AS a FROM dy CROSS JOIN re LEFT JOIN ac USING (day, feature, bin)),
  sh AS (SELECT day, feature, e / sum(e) OVER w AS pe, a / sum(a) OVER w AS pa, abs(sum(e) OVER o / sum(e) OVER w - sum(a) OVER o / sum(a) OVER w) AS gap FROM gd
    WINDOW w AS (PARTITION BY day, feature), o AS (PARTITION BY day, feature ORDER BY bin ROWS UNBOUNDED PRECEDING))"""
    return head + """, bc AS (SELECT feature, bin, count(*) FILTER (NOT cur) AS e, count(*) FILTER (cur) AS a FROM bl GROUP BY 1, 2),
  sh AS (SELECT feature, e / sum(e) OVER (PARTITION BY feature) AS pe, a / sum(a) OVER (PARTITION BY feature) AS pa FROM bc)"""


PSI = "sum((greatest(pa, 1e-8) - greatest(pe, 1e-8)) * ln(greatest(pa, 1e-8) / greatest(pe, 1e-8)))"
JSD = "sum(0.5 * greatest(pe, 1e-10) * ln(greatest(pe, 1e-10) / greatest((pe + pa) / 2, 1e-10)) + 0.5 * greatest(pa, 1e-10) * ln(greatest(pa, 1e-10) / greatest((pe + pa) / 2, 1e-10)))"
GAPPY = SC.replace("sc AS", "full_sc AS", 1) + """,
  sc AS (SELECT * REPLACE (CASE WHEN transaction_id % 7 <> 0 AND transaction_id % 11 <> 0 THEN amt END AS amt) FROM full_sc)"""
add("psi_nulls", GAPPY, shares(), f"SELECT feature, {r(PSI, 'psi')}, CASE WHEN {PSI} < 0.1 THEN 'STABLE' WHEN {PSI} < 0.25 THEN 'MINOR' ELSE 'MAJOR' END AS verdict FROM sh GROUP BY 1")
add("psi", SC, shares(), f"SELECT feature, {r(PSI, 'psi')}, CASE WHEN {PSI} < 0.1 THEN 'STABLE' WHEN {PSI} < 0.25 THEN 'MINOR' ELSE 'MAJOR' END AS verdict FROM sh GROUP BY 1")
add("js_divergence", SC, shares(), f"SELECT feature, {r(JSD, 'jsd')}, CASE WHEN {JSD} < 0.1 THEN 'SIMILAR' ELSE 'DIFFERENT' END AS verdict FROM sh GROUP BY 1")
JSD8 = JSD.replace("1e-10", "1e-8").replace("greatest((pe + pa) / 2, 1e-8)", "((greatest(pe, 1e-8) + greatest(pa, 1e-8)) / 2)")
for name, source in (("drift_report", SC), ("drift_nulls", GAPPY)):
    add(name, source, shares(True), f"""SELECT day, feature, {r(PSI, 'psi')}, {r(JSD8, 'jsd')}, {r('max(gap)', 'ks_binned')},
  CASE WHEN {PSI} < 0.1 THEN 'OK' WHEN {PSI} < 0.25 THEN 'WARN' ELSE 'CRITICAL' END AS alert FROM sh GROUP BY 1, 2""")
add("ks_2samp", SC, "g AS (SELECT amt, count(*) FILTER (dom <= 15) AS a, count(*) FILTER (dom > 15) AS z FROM sc GROUP BY 1)",
    "c AS (SELECT sum(a) OVER (ORDER BY amt) / sum(a) OVER () - sum(z) OVER (ORDER BY amt) / sum(z) OVER () AS gap FROM g)",
    f"""SELECT 'ks_2samp' AS test, {r('(SELECT max(abs(gap)) FROM c)', 'statistic')},
  {r('(avg(amt) FILTER (dom <= 15) - avg(amt) FILTER (dom > 15)) / sqrt((var_pop(amt) FILTER (dom <= 15) + var_pop(amt) FILTER (dom > 15)) / 2)', 'effect_size')} FROM sc""")
add("arch_lm", SC, f"q AS (SELECT payer_id, p1 * p1 AS a, lag(p1 * p1) OVER {BYP} AS l FROM sc)",
    f"SELECT payer_id, {b('count(*)', 'n')}, {r('regr_r2(a, l)', 'r2')}, {r('count(*) * regr_r2(a, l)', 'lm')} FROM q WHERE l IS NOT NULL GROUP BY 1")
add("burst_test", "g AS (SELECT payer_id, s, s - lag(s) OVER (PARTITION BY payer_id ORDER BY s, transaction_id) AS g FROM tx)",
    "q AS (SELECT payer_id, count(g) AS n, avg(g) AS m, var_pop(g) AS v, count(*) AS c, max(s) - min(s) AS span FROM g GROUP BY 1)",
    f"""SELECT payer_id, {b('n')}, {r('m', 'mean_interval', 4)}, {r('v', 'var_interval', 2)}, {r('v / m', 'fano', 4)}, {r('(n - 1) * v / m', 'chi2', 2)},
  {r('m / (span / (2 * c))', 'clark_evans', 4)}, CASE WHEN v / m > 1.5 THEN 'BURSTY' WHEN v / m < 0.67 THEN 'REGULAR' ELSE 'POISSON' END AS verdict FROM q""")
GPD = """th AS (SELECT channel, quantile_cont(amt, 0.95) AS u FROM sc GROUP BY 1),
  ex AS (SELECT channel, u, amt - u AS y, row_number() OVER (PARTITION BY channel ORDER BY amt) AS j, count(*) OVER (PARTITION BY channel) AS n FROM sc JOIN th USING (channel) WHERE amt > u),
  mo AS (SELECT channel, max(u) AS u, max(n) AS n, avg(y) AS a0, sum((n - j) / (n - 1) * y) / max(n) AS a1 FROM ex GROUP BY 1),
  gp AS (SELECT *, 2 - a0 / (a0 - 2 * a1) AS xi, 2 * a0 * a1 / (a0 - 2 * a1) AS sigma FROM mo WHERE n >= 10)"""
TAILP = "CASE WHEN 1 + xi * y / sigma <= 0 THEN 0 ELSE power(greatest(1 + xi * y / sigma, 1e-300), -1 / xi) END"
add("gpd_moments", SC, GPD, f"tie AS (SELECT channel, y, max(j) AS hi, min(j) - 1 AS lo FROM ex GROUP BY 1, 2)",
    f"ks AS (SELECT channel, max(greatest(abs(hi / gp.n - (1 - {TAILP})), abs((1 - {TAILP}) - lo / gp.n))) AS ks FROM tie JOIN gp USING (channel) GROUP BY 1)",
    f"SELECT channel, {b('n')}, {r('u', 'threshold')}, {r('xi')}, {r('sigma')}, {r('ks')} FROM gp JOIN ks USING (channel)")
add("gpd_score", SC, GPD, f"q AS (SELECT transaction_id, amt - u AS y, xi, sigma FROM sc LEFT JOIN gp USING (channel))",
    f"SELECT transaction_id, {r(f'CASE WHEN y > 0 THEN {TAILP} ELSE 1 END', 'tail_probability')} FROM q")
add("gpd_var", SC, GPD, f"""SELECT channel, {r('u + sigma / xi * (power(total / n * (1 - 0.99), -xi) - 1)', 'tail_var', 5)}
  FROM gp JOIN (SELECT channel, count(*) AS total FROM sc GROUP BY 1) USING (channel)""")
add("mean_excess", SC, "q AS (SELECT q, quantile_cont(amt, q) AS u FROM sc, (SELECT unnest([0.5]) AS q) GROUP BY q)" if False else
    "q AS (" + " UNION ALL ".join(f"SELECT {v} AS q, quantile_cont(amt, {v}) AS u FROM sc" for v in (0.5, 0.75, 0.9, 0.95, 0.99)) + ")",
    f"SELECT {r('q')}, {r('u', 'threshold')}, {b('count(*)', 'n')}, {r('avg(amt - u)', 'mean_excess')} FROM sc JOIN q ON amt > u GROUP BY q, u")
add("mcnemar", SC, "q AS (SELECT (p1 >= 0.5) = (y = 1) AS a, (p2 >= 0.5) = (y = 1) AS z FROM sc)",
    "c AS (SELECT count(*) FILTER (a AND z) AS n11, count(*) FILTER (a AND NOT z) AS n10, count(*) FILTER (NOT a AND z) AS n01, count(*) FILTER (NOT a AND NOT z) AS n00 FROM q)",
    f"SELECT 'mcnemar' AS test, {r('CASE WHEN n10 + n01 < 10 THEN least(n10, n01) ELSE power(abs(n10 - n01) - 1, 2) / (n10 + n01) END', 'statistic')}, {r('n11')}, {r('n10')}, {r('n01')}, {r('n00')} FROM c")
add("importance_stability", SC, "l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, dom % 5 AS fold, avg({c}) AS v FROM sc GROUP BY 2" for c in ("p1", "p2", "e", "h")) + ")",
    "rk AS (SELECT feature, v, rank() OVER (PARTITION BY fold ORDER BY v DESC) + (count(*) OVER (PARTITION BY fold, v) - 1) / 2 AS rk FROM l)",
    "f AS (SELECT feature, sum(rk) AS rs, count(*) AS n, stddev_pop(v) / avg(v) AS cv FROM rk GROUP BY 1)",
    "w AS (SELECT 12 * sum(power(rs - n * 2.5, 2)) / (max(n) * max(n) * (64 - 4)) AS w, max(n) AS n, avg(cv) AS cv FROM f)",
    f"SELECT 'importance_stability' AS test, {r('w', 'statistic')}, {r('cv', 'mean_cv')}, {r('n * 3 * w', 'friedman')} FROM w")
add("hosmer_lemeshow", SC, f"ed AS (SELECT [{', '.join(f'quantile_cont(p1, {i / 10})' for i in range(1, 10))}] AS ed FROM sc)",
    "g AS (SELECT len(list_filter(ed, lambda q: q <= p1)) AS bin, sum(y) AS o, sum(p1) AS e, count(*) AS n FROM sc, ed GROUP BY 1)",
    f"SELECT 'hosmer_lemeshow' AS test, {r('sum(power(o - e, 2) / (e * (1 - e / n)))', 'statistic', 4)}, {r('count(*)', 'bins', 4)} FROM g")


def auc_sql(p):
    return f"(SELECT (sum(CASE WHEN y = 1 THEN mid ELSE 0 END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) FROM (SELECT y, rank() OVER (ORDER BY {p}) + (count(*) OVER (PARTITION BY {p}) - 1) / 2 AS mid FROM sc))"


add("auc", SC, f"SELECT 'auc' AS test, {r(auc_sql('p1'), 'statistic')}, {r('sum(y)', 'n1')}, {r('count(*) - sum(y)', 'n0')} FROM sc")
add("auc_compare", SC, f"v AS (SELECT {auc_sql('p1')} AS a1, {auc_sql('p2')} AS a2, sum(y) AS n1, count(*) - sum(y) AS n0 FROM sc)",
    f"SELECT 'auc_compare' AS test, {r('(a1 - a2) / sqrt(a1 * (1 - a1) / n1 + a2 * (1 - a2) / n0)', 'statistic')}, {r('a1', 'auc1')}, {r('a2', 'auc2')} FROM v")
add("runs_test", SC, "q AS (SELECT us, transaction_id, (y - p2) / sqrt(p2 * (1 - p2)) AS res FROM sc)",
    "u AS (SELECT us, transaction_id, res > (SELECT median(res) FROM q) AS up FROM q)", "l AS (SELECT up, lag(up) OVER (ORDER BY us, transaction_id) AS was FROM u)",
    "c AS (SELECT count(*) FILTER (up <> was) + 1 AS runs, count(*) FILTER (up) AS n1, count(*) FILTER (NOT up) AS n2 FROM l)",
    f"SELECT 'runs_test' AS test, {r('(runs - (2.0 * n1 * n2 / (n1 + n2) + 1)) / sqrt(2.0 * n1 * n2 * (2.0 * n1 * n2 - n1 - n2) / (power(n1 + n2, 2) * (n1 + n2 - 1)))', 'statistic')}, {r('runs')}, {r('n1')}, {r('n2')} FROM c")
add("vif", SC, f"v AS (SELECT 1 / (1 - power(corr(amt, h), 2)) AS v FROM sc)",
    f"SELECT f AS feature, {r('v', 'vif')}, CASE WHEN v < 5 THEN 'LOW' WHEN v < 10 THEN 'MODERATE' ELSE 'HIGH' END AS verdict FROM v, (SELECT unnest(['amt', 'h']) AS f)")
add("breusch_pagan", SC, f"SELECT 'breusch_pagan' AS test, {r('count(*) * regr_r2(power(y - p1, 2), p1)', 'statistic')}, {r('count(*)', 'n')} FROM sc")
PR = """ds AS (SELECT p2, count(*) AS n, sum(y) AS pos FROM sc GROUP BY 1),
  cu AS (SELECT p2, n, pos, sum(n) OVER (ORDER BY p2 DESC) AS fl, sum(pos) OVER (ORDER BY p2 DESC) AS tp, sum(n) OVER () AS tot, sum(pos) OVER () AS tpos FROM ds)"""
add("pr_curve", SC, PR, f"SELECT {r('p2', 'threshold')}, {r('tp / fl', 'precision')}, {r('tp / tpos', 'recall')} FROM cu")
add("evaluate", SC, PR, f"""SELECT {r('sum(pos / tpos * tp / fl)', 'average_precision')}, {r('max(tp) FILTER (p2 >= 0.6) / max(fl) FILTER (p2 >= 0.6)', 'precision')},
  {r('max(tp) FILTER (p2 >= 0.6) / max(tpos)', 'recall')}, {r('max(fl) FILTER (p2 >= 0.6) / max(tot)', 'workload')}, {r('max(tp) FILTER (fl <= 0.2 * tot) / max(tpos)', 'recall_at_workload')} FROM cu""")
add("optimal_threshold", SC, "qs AS (" + " UNION ALL ".join(f"SELECT {i} AS pct, quantile_cont(p1, {i / 100}) AS u FROM sc" for i in range(100)) + ")",
    "cst AS (SELECT pct, u, sum(CASE WHEN p1 >= u THEN 1 ELSE 0 END) AS fl, sum(CASE WHEN p1 >= u THEN y ELSE 0 END) AS tp, sum(y) AS tpos, count(*) AS n FROM sc, qs GROUP BY 1, 2)",
    "c2 AS (SELECT *, 10.0 * (tpos - tp) + (fl - tp) + 0.1 * fl AS cost FROM cst WHERE fl / n <= 0.2)",
    f"SELECT {r('u', 'threshold')}, {r('cost')}, {r('fl / n', 'workload')} FROM c2 ORDER BY round(c2.cost, 9), pct LIMIT 1")
add("roc_threshold", SC, PR, f"""SELECT {r('p2', 'threshold')}, {r('tp / tpos', 'tpr')}, {r('(fl - tp) / (tot - tpos)', 'fpr')}, {r('tp / tpos - 0.1 * (fl - tp) / (tot - tpos)', 'gain')}
  FROM cu ORDER BY round(tp / tpos - 0.1 * (fl - tp) / (tot - tpos), 9) DESC, p2 DESC LIMIT 1""")
LV = f"lv AS (SELECT *, {LEVEL.replace('score', 'p1')} AS risk_level FROM sc)"
add("batch_summary", SC, LV, f"""SELECT {b('count(*)', 'successful_predictions')}, {b('0', 'failed_predictions')}, {', '.join(b(f"count(*) FILTER (risk_level = '{x}')", x.lower() + '_count') for x in ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW'))},
  {b("count(*) FILTER (risk_level IN ('HIGH', 'CRITICAL'))", 'high_risk_count')}, {r("100.0 * count(*) FILTER (risk_level IN ('HIGH', 'CRITICAL')) / count(*)", 'high_risk_percentage')}, {r('avg(p1)', 'average_risk_score')} FROM lv""")
add("risk_rollup", SC, LV, f"SELECT channel, risk_level, dom AS day, {b('grouping(channel, risk_level, dom)', 'level')}, {b('count(*)', 'n')}, {r('avg(p1)', 'mean_score')} FROM lv GROUP BY ROLLUP (channel, risk_level, dom)")
add("fairness", SC, "g AS (SELECT payer_id % 4 AS grp, count(*) AS n, avg(CASE WHEN p1 >= 0.6 THEN 1.0 ELSE 0 END) AS fr, avg(CASE WHEN p1 >= 0.6 THEN 1.0 ELSE 0 END) FILTER (y = 1) AS tpr, avg(CASE WHEN p1 >= 0.6 THEN 1.0 ELSE 0 END) FILTER (y = 0) AS fpr FROM sc GROUP BY 1)",
    f"SELECT grp, {b('n')}, {r('fr', 'flag_rate')}, {r('tpr')}, {r('fpr')}, {r('max(fr) OVER () - min(fr) OVER ()', 'parity_gap')}, {r('greatest(max(tpr) OVER () - min(tpr) OVER (), max(fpr) OVER () - min(fpr) OVER ())', 'odds_gap')} FROM g")
add("mutual_info", "j AS (SELECT channel, hour(ts) AS hr, count(*) AS c FROM tx GROUP BY 1, 2), n AS (SELECT sum(c) AS n FROM j)",
    "ea AS (SELECT -sum(c / n * log2(c / n)) AS h FROM (SELECT channel, sum(c) AS c FROM j GROUP BY 1), n), eb AS (SELECT -sum(c / n * log2(c / n)) AS h FROM (SELECT hr, sum(c) AS c FROM j GROUP BY 1), n), ej AS (SELECT -sum(c / n * log2(c / n)) AS h FROM j, n)",
    f"SELECT {r('ea.h', 'entropy_a')}, {r('eb.h', 'entropy_b')}, {r('ej.h', 'entropy_joint')}, {r('ea.h + eb.h - ej.h', 'mutual_info')} FROM ea, eb, ej")
add("kl_divergence", SC, "c AS (SELECT channel, count(*) FILTER (dom <= 15) AS a, count(*) FILTER (dom > 15) AS z FROM sc GROUP BY 1), s AS (SELECT a / sum(a) OVER () AS p, greatest(z / sum(z) OVER (), 1e-10) AS q FROM c)",
    f"SELECT {r('sum(CASE WHEN p > 0 THEN p * log2(p / q) ELSE 0 END)', 'kl')} FROM s")
add("top_reasons", SC, "l AS (SELECT transaction_id, 'c1' AS f, p1 - 0.5 AS v FROM sc UNION ALL SELECT transaction_id, 'c2', p2 - 0.5 FROM sc UNION ALL SELECT transaction_id, 'c3', e - 0.4 FROM sc)",
    "k AS (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY abs(v) DESC, f) AS rn FROM l)",
    f"SELECT transaction_id, string_agg(f, ',' ORDER BY rn) AS features, {r('max(v) FILTER (rn = 1)', 'largest')} FROM k WHERE rn <= 2 GROUP BY 1")
add("transitions", f"q AS (SELECT channel AS state, lead(channel) OVER {BYP} AS next_state FROM tx), c AS (SELECT state, next_state, count(*) AS n FROM q WHERE next_state IS NOT NULL GROUP BY 1, 2)",
    f"SELECT state, next_state, {b('n')}, {r('n / sum(n) OVER (PARTITION BY state)', 'probability')} FROM c")

# ---- causal
Z95 = 1.959963984540054


def effect(src):
    return f"SELECT {r('ate')}, {r('se')}, {r(f'ate - {Z95} * se', 'ci_low')}, {r(f'ate + {Z95} * se', 'ci_high')} FROM {src}"


add("ate_ipw", SC, "q AS (SELECT t, t * amt / e AS a, (1 - t) * amt / (1 - e) AS c FROM sc)",
    "v AS (SELECT avg(a) - avg(c) AS ate, sqrt(var_pop(a) / sum(t) + var_pop(c) / sum(1 - t)) AS se FROM q)", effect("v"))
add("ate_dr_given", SC, "m AS (SELECT *, 60 + k * 0.01 AS mu0, 61 + h * 0.1 AS mu1 FROM sc)",
    "q AS (SELECT mu1 - mu0 + t * (amt - mu1) / e - (1 - t) * (amt - mu0) / (1 - e) AS s FROM m)", "v AS (SELECT avg(s) AS ate, stddev_pop(s) / sqrt(count(*)) AS se FROM q)", effect("v"))
add("balance", SC, " UNION ALL ".join(f"""SELECT '{c}' AS covariate, {r(f'avg({c}) FILTER (t = 1)', 'treated_mean')}, {r(f'avg({c}) FILTER (t = 0)', 'control_mean')},
  {r(f'abs(avg({c}) FILTER (t = 1) - avg({c}) FILTER (t = 0)) / sqrt((var_samp({c}) FILTER (t = 1) + var_samp({c}) FILTER (t = 0)) / 2)', 'smd')},
  {b(flag(f'abs(avg({c}) FILTER (t = 1) - avg({c}) FILTER (t = 0)) / sqrt((var_samp({c}) FILTER (t = 1) + var_samp({c}) FILTER (t = 0)) / 2) > 0.1'), 'unbalanced')} FROM sc""" for c in ("k", "h", "amt")))
add("overlap", SC, "g AS (SELECT p1, sum(t) AS a, sum(1 - t) AS z FROM sc GROUP BY 1), c AS (SELECT sum(a) OVER (ORDER BY p1) / sum(a) OVER () - sum(z) OVER (ORDER BY p1) / sum(z) OVER () AS gap FROM g)",
    f"SELECT {r('greatest(min(p1) FILTER (t = 1), min(p1) FILTER (t = 0))', 'overlap_low')}, {r('least(max(p1) FILTER (t = 1), max(p1) FILTER (t = 0))', 'overlap_high')}, {r('(SELECT max(abs(gap)) FROM c)', 'ks')} FROM sc")
add("rosenbaum", SC, "o AS (SELECT t, amt, row_number() OVER (PARTITION BY t ORDER BY e, transaction_id) AS k FROM sc)",
    "d AS (SELECT round(a.amt - c.amt, 9) AS d FROM o a JOIN o c ON a.k = c.k AND a.t = 1 AND c.t = 0 WHERE round(a.amt - c.amt, 9) <> 0)",
    "m AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS rk FROM d)",
    "w AS (SELECT sum(rk) FILTER (d > 0) AS w, sum(rk) AS s1, sum(rk * rk) AS s2, count(*) AS n FROM m), gm AS (SELECT unnest([1.0, 1.25, 1.5, 2.0, 3.0]) AS g)",
    f"SELECT {r('g', 'gamma')}, {b('n', 'pairs')}, {r('w', 'w_plus')}, {r('(w - g / (1 + g) * s1) / sqrt(g / (1 + g) / (1 + g) * s2)', 'z_upper')}, {r('(w - 1 / (1 + g) * s1) / sqrt(g / (1 + g) / (1 + g) * s2)', 'z_lower')} FROM w, gm")
add("iv_2sls", SC, f"SELECT {r('covar_pop(amt, z) / covar_pop(h, z)', 'iv_estimate', 5)}, {r('covar_pop(amt, z) / var_pop(z)', 'reduced_form', 5)}, {r('regr_r2(h, z) / ((1 - regr_r2(h, z)) / (count(*) - 2))', 'partial_f', 5)} FROM sc")
MED = "cv AS (SELECT covar_pop(t, k) AS tk, covar_pop(t, amt) AS ta, covar_pop(k, amt) AS ka, var_pop(t) AS tt, var_pop(k) AS kk FROM sc), cf AS (SELECT tk / tt AS a, ta / tt AS c, (ka * tt - tk * ta) / (tt * kk - tk * tk) AS bb, (ta * kk - tk * ka) / (tt * kk - tk * tk) AS cp FROM cv)"
add("mediation", SC, MED, f"SELECT {r('a', 'a', 5)}, {r('bb', 'b', 5)}, {r('c', 'total', 5)}, {r('cp', 'direct', 5)}, {r('a * bb', 'indirect', 5)}, {r('a * bb / c', 'proportion', 5)} FROM cf")
add("causal_diagnostics", SC, f"ed AS (SELECT [{', '.join(f'quantile_cont(p2, {i / 5})' for i in range(1, 5))}] AS ed FROM sc)", "g AS (SELECT *, len(list_filter(ed, lambda q: q < p2)) AS stratum FROM sc, ed)",
    f"SELECT stratum, {b('sum(t)', 'treated')}, {b('sum(1 - t)', 'control')}, {r('avg(amt) FILTER (t = 1)', 'treated_mean')}, {r('avg(amt) FILTER (t = 0)', 'control_mean')}, {r('avg(amt) FILTER (t = 1) - avg(amt) FILTER (t = 0)', 'effect')}, {r('avg(p2)', 'mean_score')} FROM g GROUP BY 1")
add("score_histogram", SC, f"SELECT t AS arm, {b('least(floor(e * 30), 29)', 'bin')}, {b('count(*)', 'n')} FROM sc GROUP BY 1, 2")

# ---- resampling
add("bayes_linreg", SC, "g AS (SELECT count(*) / 2500.0 + 0.01 AS a, sum(h) / 2500.0 AS bb, sum(h * h) / 2500.0 + 0.01 AS d, sum(amt) / 2500.0 AS y0, sum(h * amt) / 2500.0 AS y1 FROM sc)",
    f"SELECT 'intercept' AS term, {r('(d * y0 - bb * y1) / (a * d - bb * bb)', 'mean', 5)}, {r('sqrt(d / (a * d - bb * bb))', 'sd', 5)} FROM g UNION ALL SELECT 'h', {r('(a * y1 - bb * y0) / (a * d - bb * bb)', 'mean', 5)}, {r('sqrt(a / (a * d - bb * bb))', 'sd', 5)} FROM g")
add("stress", SC, "sn AS (SELECT unnest(['base', 'surge', 'night']) AS scenario, unnest([1.0, 2.0, 1.5]) AS ma, unnest([1.0, 1.0, 0.5]) AS mh), q AS (SELECT scenario, amt * ma / (amt * ma + 50.0 + h * mh) AS s FROM sc, sn)",
    f"SELECT scenario, {r('avg(s)', 'mean_score')}, {r('stddev_pop(s)', 'std_score')}, {r('max(s)', 'max_score')}, {r('avg(CASE WHEN s > 0.7 THEN 1.0 ELSE 0 END)', 'high_share')} FROM q GROUP BY 1")
NV = {0.95: (1.6448536269514722, 0.10313564037537139), 0.99: (2.3263478740408408, 0.026652142203457764)}
add("var_es", "q AS (SELECT channel, amt - 60 AS ret FROM tx)",
    "c AS (" + " UNION ALL ".join(f"SELECT channel, {lv} AS level, quantile_cont(ret, {1 - lv:.2f}) AS q, -(avg(ret) - {z} * stddev_samp(ret)) AS nv, -(avg(ret) - stddev_samp(ret) * {dn} / {1 - lv:.2f}) AS ne FROM q GROUP BY 1" for lv, (z, dn) in NV.items()) + ")",
    f"SELECT channel, {r('level', 'level', 5)}, {r('-max(q)', 'var', 5)}, {r('-avg(ret)', 'es', 5)}, {r('max(nv)', 'normal_var', 5)}, {r('max(ne)', 'normal_es', 5)} FROM q JOIN c USING (channel) WHERE ret <= q GROUP BY channel, level")
add("ensemble_uncertainty", SC, f"SELECT transaction_id, {r('(p1 + p2 + e) / 3', 'ensemble_mean')}, {r('sqrt((power(p1 - (p1 + p2 + e) / 3, 2) + power(p2 - (p1 + p2 + e) / 3, 2) + power(e - (p1 + p2 + e) / 3, 2)) / 9)', 'ensemble_std')} FROM sc")

# ---- models
CL = "cl AS (SELECT " + ", ".join(f"CASE WHEN y = 1 THEN greatest(least({p}, 1 - 1e-6), 1e-6) ELSE 1 - greatest(least({p}, 1 - 1e-6), 1e-6) END AS l{i}" for i, p in enumerate(("p1", "p2", "e"))) + " FROM sc)"


def em(k):
    parts = [CL, "w0 AS MATERIALIZED (SELECT 1 / 3 AS a, 1 / 3 AS bb, 1 / 3 AS c)"]
    for i in range(k):
        tot = "(a * l0 + bb * l1 + c * l2)"
        parts.append(f"w{i + 1} AS MATERIALIZED (SELECT sum(a * l0 / {tot}) / count(*) AS a, sum(bb * l1 / {tot}) / count(*) AS bb, sum(c * l2 / {tot}) / count(*) AS c FROM cl, w{i})")
    return parts


add("fusion_em", SC, *em(50), f"SELECT 'p1' AS model, {r('a', 'weight', 8)} FROM w50 UNION ALL SELECT 'p2', {r('bb', 'weight', 8)} FROM w50 UNION ALL SELECT 'e', {r('c', 'weight', 8)} FROM w50")
add("fused_score", SC, f"SELECT transaction_id, {r('p1 * 0.5 + p2 * 0.3 + e * 0.2', 'risk_score')}, {b(flag('p1 * 0.5 + p2 * 0.3 + e * 0.2 >= 0.55'), 'flagged')} FROM sc")
add("anomaly_blend", SC, "bd AS (SELECT min(amt) AS la, max(amt) AS ha, min(k) AS lk, max(k) AS hk FROM sc WHERE dom <= 15)",
    f"SELECT transaction_id, {r('(least(greatest((amt - la) / (ha - la), 0), 1) + 1 - least(greatest((k - lk) / (hk - lk), 0), 1)) / 2', 'anomaly')} FROM sc, bd")
add("time_folds", f"c AS (SELECT [{', '.join(f'quantile_cont(CAST(us AS DOUBLE), {i}/6.0)' for i in range(1, 6))}] AS c FROM tx)",
    "g AS (SELECT us, len(list_filter(c, lambda q: q <= us)) AS fold FROM tx, c)", f"SELECT fold, {b('count(*)', 'n')}, {b('min(us)', 'first_us')} FROM g GROUP BY 1")
add("conformal", SC, "cal AS (SELECT CASE WHEN y = 1 THEN 1 - p2 ELSE p2 END AS s FROM sc WHERE transaction_id % 2 = 0)",
    "rk AS (SELECT s, row_number() OVER (ORDER BY s) AS rn, count(*) OVER () AS n FROM cal), lim AS (SELECT min(s) AS b FROM rk WHERE rn >= ceil((n + 1) * (1 - 0.2)))",
    f"SELECT transaction_id, {b('CASE WHEN p2 <= b THEN 1 ELSE 0 END + CASE WHEN 1 - p2 <= b THEN 1 ELSE 0 END', 'set_size')}, {b('CASE WHEN y = 1 THEN 1 - p2 <= b ELSE p2 <= b END', 'covered')} FROM sc, lim WHERE transaction_id % 2 = 1")
add("survival", SC, "q AS (SELECT floor(amt / 5) AS wk, count(*) AS n, sum(y) AS ev FROM sc GROUP BY 1), z AS (SELECT wk, ev, sum(n) OVER (ORDER BY wk DESC) AS risk FROM q)",
    f"SELECT {r('wk', 'time')}, {b('ev', 'events')}, {b('risk', 'at_risk')}, {r('CASE WHEN bool_or(ev >= risk) OVER w THEN 0 ELSE exp(sum(CASE WHEN ev < risk THEN ln(1 - ev / risk) ELSE 0 END) OVER w) END', 'survival')}, {r('sum(ev / risk) OVER w', 'hazard')} FROM z WINDOW w AS (ORDER BY wk)")


def concentrated(k):
    """k rounds of keeping the closest four fifths and fitting them again."""
    fit = "SELECT avg(amt) AS ma, avg(k) AS mk, var_pop(amt) AS vaa, var_pop(k) AS vkk, covar_pop(amt, k) AS vak"
    far = "(vkk * power(amt - ma, 2) - 2 * vak * (amt - ma) * (k - mk) + vaa * power(k - mk, 2)) / (vaa * vkk - vak * vak)"
    parts = [f"m0 AS MATERIALIZED ({fit} FROM sc)"]
    for i in range(k):
        parts.append(f"f{i} AS MATERIALIZED (SELECT amt, k, {far} AS far FROM sc, m{i})")
        parts.append(f"m{i + 1} AS MATERIALIZED ({fit} FROM f{i} WHERE far <= (SELECT quantile_cont(far, 0.8) FROM f{i}))")
    return parts, far


ROBUST, FAR = concentrated(30)
add("elliptic", SC, *ROBUST, f"SELECT transaction_id, {r(FAR, 'elliptic', 5)} FROM sc, m30")

# ---- streaming operators in batch form
add("stream_counters", SC, f"""SELECT {b("epoch_us(date_trunc('hour', ts))", 'window_start')}, channel, {b('count(*)', 'n')}, {r('sum(amount)', 'total_amount')},
  {b('count(*) FILTER (amt > 100)', 'high_amount_count')} FROM sc GROUP BY 1, 2""")
add("stream_velocity", "w AS (SELECT payer_id, amount, (us // 3600000000 - i) * 3600000000 AS ws FROM tx, (SELECT unnest(range(24)) AS i))",
    f"SELECT payer_id, {b('ws', 'window_start')}, {b('count(*)', 'n')}, {r('sum(amount)', 'total_amount')} FROM w GROUP BY 1, 2")
add("stream_sessions", f"g AS (SELECT payer_id, us, amount, CASE WHEN us - lag(us) OVER {BYP} < 1800000000 THEN 0 ELSE 1 END AS fresh FROM tx)",
    "n AS (SELECT *, sum(fresh) OVER (PARTITION BY payer_id ORDER BY us) AS sid FROM g)",
    f"SELECT payer_id, {b('min(us)', 'session_start')}, {b('max(us) + 1800000000', 'session_end')}, {b('count(*)', 'n')}, {r('sum(amount)', 'total_amount')} FROM n GROUP BY payer_id, sid")


# ---- nearest neighbours: all pairs

add("local_outliers", """f AS (SELECT c_custkey AS id, c_acctbal AS a, count(o_orderkey)::DOUBLE AS b, coalesce(sum(o_totalprice), 0.0) AS c
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)""",
    """z AS (SELECT id, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS a, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS b,
  (c - avg(c) OVER ()) / stddev_pop(c) OVER () AS c FROM f)""",
    """near AS (SELECT q, p, d, row_number() OVER (PARTITION BY q ORDER BY d, p) AS i FROM (
  SELECT q.id AS q, p.id AS p, sqrt((q.a - p.a) * (q.a - p.a) + (q.b - p.b) * (q.b - p.b) + (q.c - p.c) * (q.c - p.c)) AS d FROM z q, z p) QUALIFY i <= 21)""",
    "kth AS (SELECT q AS p, max(d) AS kdist FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, p) AS j FROM near WHERE p <> q) WHERE j <= 20 GROUP BY 1)",
    """density AS (SELECT q AS p, 1 / greatest(avg(greatest(d, kdist)), 1e-10) AS lrd FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, p) AS j FROM near WHERE p <> q) JOIN kth USING (p) WHERE j <= 20 GROUP BY 1)""",
    f"""SELECT q AS c_custkey, {r("avg(lrd) * greatest(avg(greatest(d, kdist)), 1e-10)", "lof", 5)}
  FROM near JOIN kth USING (p) JOIN density USING (p) WHERE i <= 20 GROUP BY 1""")


# ---- most likely paths: the same recursion over each payer's rows

_STATES = "(SELECT list(DISTINCT channel ORDER BY channel) FROM tx)"
_SHARE = "CAST(floor(1000000 * ln((coalesce(n, 0) + 1)::DOUBLE / (sum(coalesce(n, 0)) OVER (PARTITION BY {0}) + count(*) OVER (PARTITION BY {0})))) AS BIGINT)"
add("likely_path", """o AS (SELECT transaction_id, payer_id, channel, row_number() OVER w AS i, lag(channel) OVER w AS before,
  CASE WHEN amt < 10 THEN 'A' WHEN amt < 50 THEN 'B' WHEN amt < 100 THEN 'C' WHEN amt < 200 THEN 'D' ELSE 'E' END AS band
  FROM tx WINDOW w AS (PARTITION BY payer_id ORDER BY us, transaction_id))""",
    "s AS (SELECT DISTINCT channel AS s FROM tx), g AS (SELECT DISTINCT band AS g FROM o)",
    f"""firsts AS (SELECT list(v ORDER BY s) AS start FROM (SELECT s, {_SHARE.format("1")} AS v FROM s LEFT JOIN (
  SELECT channel AS s, count(*) AS n FROM o WHERE i = 1 GROUP BY 1) USING (s)))""",
    f"""moves AS (SELECT list(line ORDER BY a) AS move FROM (SELECT a, list(v ORDER BY s) AS line FROM (SELECT a, s.s, {_SHARE.format("a")} AS v
  FROM (SELECT s AS a FROM s) CROSS JOIN s LEFT JOIN (SELECT before AS a, channel AS s, count(*) AS n FROM o WHERE i > 1 GROUP BY 1, 2) USING (a, s)) GROUP BY a))""",
    f"""emits AS (SELECT g, list(v ORDER BY s) AS emit FROM (SELECT g.g, s.s, CAST(floor(1000000 * ln((coalesce(n, 0) + 1)::DOUBLE /
    (sum(coalesce(n, 0)) OVER (PARTITION BY s.s) + count(*) OVER (PARTITION BY s.s) + 1))) AS BIGINT) AS v
  FROM g CROSS JOIN s LEFT JOIN (SELECT band AS g, channel AS s, count(*) AS n FROM o GROUP BY 1, 2) USING (g, s)) GROUP BY g)""",
    f"""walk AS (
  SELECT payer_id, i, list_transform(start, lambda x, j: x + emit[j]) AS score, list_transform(start, lambda x, j: [j]) AS path
  FROM o JOIN emits ON g = band, firsts WHERE i = 1
  UNION ALL
  SELECT payer_id, i, list_transform(best, lambda x, j: list_max(x) + emit[j]),
    list_transform(best, lambda x, j: list_append(path[list_position(x, list_max(x))], j)) FROM (
    SELECT w.payer_id, o.i, w.path, emit, list_transform(w.score, lambda x, j: list_transform(w.score, lambda y, k: y + move[k][j])) AS best
    FROM walk w JOIN o ON o.payer_id = w.payer_id AND o.i = w.i + 1 JOIN emits ON g = band, moves))""",
    "ended AS (SELECT payer_id, path[list_position(score, list_max(score))] AS path FROM walk JOIN (SELECT payer_id, max(i) AS i FROM o GROUP BY 1) USING (payer_id, i))",
    f"SELECT transaction_id, {_STATES}[path[i]] AS path_state FROM o JOIN ended USING (payer_id)")


# ---- the variance recursion, row by row

add("garch_targeted", f"""q AS (SELECT payer_id, {SCORE} - 0.5 AS x, us, transaction_id FROM tx),
e AS (SELECT payer_id, pow(x - avg(x) OVER (PARTITION BY payer_id), 2) AS e, var_pop(x) OVER (PARTITION BY payer_id) AS v, count(*) OVER (PARTITION BY payer_id) AS n,
  row_number() OVER (PARTITION BY payer_id ORDER BY us, transaction_id) AS i FROM q)""",
    """walk AS (SELECT payer_id, i, e, v AS s, v, n FROM e WHERE i = 1 AND n >= 30 AND v > 0
  UNION ALL SELECT w.payer_id, w.i + 1, e.e, w.v * 0.1 + 0.1 * w.e + 0.8 * w.s, w.v, w.n FROM walk w JOIN e ON e.payer_id = w.payer_id AND e.i = w.i + 1)""",
    f"""SELECT payer_id, n, {r("any_value(v) * 0.1", "omega", 5)}, 0.1::DOUBLE AS alpha, 0.8::DOUBLE AS beta, {r("-0.5 * sum(ln(2 * pi()) + ln(s) + e / s)", "log_likelihood", 5)},
  {r("sqrt(arg_max(s, i))", "last_volatility", 5)}, CAST(1 AS BIGINT) AS settled FROM walk GROUP BY payer_id, n""")
