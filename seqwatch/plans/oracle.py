"""SQL text for the queries of the catalogue, written for an engine other than Spark: a second way to the same rows."""

from __future__ import annotations

ALPHA, ALPHAS = 0.3, [0.05, 0.1, 0.2, 0.3, 0.4, 0.5]
TYPES = ["substitution", "abandonment", "omission", "transposition", "repetition"]

BASE = """
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY token) - 1 AS INTEGER) AS id FROM (SELECT DISTINCT event_type AS token FROM events)),
ticks AS (
  SELECT user_id AS trial_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS tick, event_type AS verb, id AS verb_id,
    CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) // 10 AS INTEGER) AS noun_id, CAST(user_id % 5 AS INTEGER) AS recipe, ts, event_id
  FROM events JOIN vocab ON token = event_type),
marked AS (SELECT *, CASE WHEN lag(verb_id) OVER (PARTITION BY trial_id ORDER BY tick) = verb_id THEN 0 ELSE 1 END AS new FROM ticks),
numbered AS (SELECT *, CAST(sum(new) OVER (PARTITION BY trial_id ORDER BY tick ROWS UNBOUNDED PRECEDING) - 1 AS INTEGER) AS seg_idx FROM marked),
segments AS (
  SELECT *, seg_idx = max(seg_idx) OVER (PARTITION BY trial_id) AS is_last FROM (
    SELECT trial_id, recipe, seg_idx, verb_id AS state, min(tick) AS tick_start, CAST(max(tick) + 1 AS INTEGER) AS tick_end, CAST(count(*) AS INTEGER) AS duration
    FROM numbered GROUP BY trial_id, recipe, seg_idx, verb_id)),
pairs AS (SELECT * FROM (SELECT trial_id, recipe, seg_idx, state AS from_state, lead(state) OVER (PARTITION BY trial_id ORDER BY seg_idx) AS to_state FROM segments) WHERE to_state IS NOT NULL),
tc AS (SELECT from_state, to_state, count(*) AS n FROM pairs GROUP BY ALL),
rc AS (SELECT recipe, from_state, to_state, count(*) AS n FROM pairs GROUP BY ALL),
states AS (SELECT DISTINCT state FROM segments),
cells AS (SELECT a.state AS from_state, b.state AS to_state, greatest(coalesce(n, 0) - 1.0::DOUBLE, 1e-12) AS mass
  FROM states a CROSS JOIN states b LEFT JOIN tc ON from_state = a.state AND to_state = b.state WHERE a.state <> b.state),
logp AS (SELECT from_state, to_state, ln(mass) - ln(greatest(sum(mass) OVER (PARTITION BY from_state), 1e-12)) AS logp FROM cells),
scored AS (SELECT s.trial_id, s.tick_start, s.from_state, s.state, -logp AS s_transition
  FROM (SELECT *, lag(state) OVER (PARTITION BY trial_id ORDER BY seg_idx) AS from_state FROM segments) s JOIN logp l ON l.from_state = s.from_state AND l.to_state = s.state),
shares AS (SELECT recipe, n / sum(n) OVER () AS share FROM (SELECT recipe, count(DISTINCT trial_id) AS n FROM ticks GROUP BY recipe)),
pooled AS (SELECT from_state, to_state, n / sum(n) OVER (PARTITION BY from_state) AS share FROM tc WHERE from_state <> to_state),
smooth AS (SELECT r.recipe, p.from_state, p.to_state, coalesce(n, 0) + {tau} * p.share AS n
  FROM (SELECT DISTINCT recipe FROM rc) r CROSS JOIN pooled p LEFT JOIN rc ON rc.recipe = r.recipe AND rc.from_state = p.from_state AND rc.to_state = p.to_state),
rlogp AS (SELECT recipe, from_state, to_state, ln(n / sum(n) OVER (PARTITION BY recipe, from_state)) AS logp FROM smooth WHERE from_state <> to_state),
marginal AS (SELECT from_state, to_state, ln(greatest(sum(share * exp(logp)), 1e-12)) AS logp FROM rlogp JOIN shares USING (recipe) GROUP BY ALL),
hist AS (SELECT state, least(duration, 6) AS d, count(*) AS n FROM segments GROUP BY ALL),
tails AS (SELECT state, d, (total - upto + n) / total AS p_ge, upto / total AS p_le, (upto - n) / total AS p_lt, n / total AS p_eq
  FROM (SELECT *, sum(n) OVER (PARTITION BY state) AS total, sum(n) OVER (PARTITION BY state ORDER BY d ROWS UNBOUNDED PRECEDING) AS upto FROM hist)),
sums AS (SELECT state, sum(n) AS n, sum(n * (d - 1)) AS s, sum(n * (d - 1) * (d - 1)) AS q FROM (SELECT state, least(duration, 50) AS d, count(*) AS n FROM segments GROUP BY ALL) GROUP BY state),
fits AS (SELECT *, CASE WHEN var > mean AND mean > 0 THEN least(mean * mean / (var - mean), 1e4) ELSE 5.0 END AS r FROM (SELECT *, s / n AS mean, q / n - (s / n) * (s / n) AS var FROM sums)),
moments AS (SELECT state, CAST(n AS BIGINT) AS n, CAST(s AS BIGINT) AS s, r, p, 1 + r * (1 - p) / p AS mean_duration FROM (SELECT *, greatest(least(r * n / (r * n + s + 1e-8), 1 - 1e-8), 1e-8) AS p FROM fits))
"""


def tail(name: str, support: str, keys: str, alpha: str) -> str:
    """CTEs that end in `name`: the thresholds of a support (keys, score, mass)."""
    return f""",
{name}_levels AS (SELECT {keys}, round(score, 9) AS threshold, sum(mass) AS mass FROM ({support}) WHERE mass > 0 GROUP BY ALL),
{name}_upto AS (SELECT *, sum(mass) OVER (PARTITION BY {keys} ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (PARTITION BY {keys} ORDER BY threshold DESC) AS level,
  count(*) OVER (PARTITION BY {keys}) AS levels FROM {name}_levels),
{name}_pick AS (SELECT *, least(sum(CASE WHEN upto <= {alpha} + 1e-12 THEN 1 ELSE 0 END) OVER (PARTITION BY {keys}) + 1, levels) AS pick FROM {name}_upto),
{name} AS (SELECT {keys}, threshold FROM {name}_pick WHERE level = pick)"""


TRANSITION = "SELECT from_state, -logp AS score, exp(logp) AS mass FROM logp"


def emission(name: str, token: str, state: str = "verb_id", rows: str = "ticks") -> str:
    return f""",
{name} AS (SELECT a.state, b.token AS {token}, ln((coalesce(n, 0) + 1.0) / sum(coalesce(n, 0) + 1.0) OVER (PARTITION BY a.state)) AS logp
  FROM (SELECT DISTINCT {state} AS state FROM {rows} WHERE {state} IS NOT NULL) a CROSS JOIN (SELECT DISTINCT {token} AS token FROM {rows} WHERE {state} IS NOT NULL) b
  LEFT JOIN (SELECT {state} AS state, {token} AS token, count(*) AS n FROM {rows} WHERE {state} IS NOT NULL GROUP BY ALL) c ON c.state = a.state AND c.token = b.token)"""


CAMERAS = """WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS k FROM lineitem),
views AS (SELECT 'P' || l_orderkey || '_trial' || (k // 5) AS trial_id, ['cam02', 'stereo01', 'webcam01', 'webcam02', 'cam01'][k % 5 + 1] AS camera, 'trial' || (k // 5) AS recipe, l_returnflag || '/' || l_linestatus AS content FROM numbered)
"""


def sql(select: str, more: str = "", tau: float = 5.0) -> str:
    return "WITH " + BASE.replace("{tau}", str(tau)).strip() + more + "\n" + select


def chosen(kind: str) -> str:
    """CTE c_<kind>: the segment at which each trial gets its error."""
    last = 2 if kind == "transposition" else 1
    more = " AND duration >= 2" if kind == "abandonment" else ""
    return f""",
c_{kind} AS (SELECT trial_id, seg_idx AS at, tick_start AS a, tick_end AS z, duration AS d FROM (
  SELECT *, row_number() OVER (PARTITION BY trial_id ORDER BY seg_idx) - 1 AS nth, count(*) OVER (PARTITION BY trial_id) AS legal FROM (
    SELECT *, count(*) OVER (PARTITION BY trial_id) AS ns FROM segments) WHERE ns >= 4 AND seg_idx >= 1 AND seg_idx < ns - {last}{more}) WHERE nth = trial_id % legal)"""


KEEP = "greatest(least(round(d * 0.05), d - 1), 1)"
DEGRADED = {
    "substitution": """,
seen AS (SELECT state, noun_id, count(*) AS n FROM ticks t JOIN segments s ON s.trial_id = t.trial_id AND tick >= tick_start AND tick < tick_end GROUP BY ALL),
rare AS (SELECT trial_id, new_noun FROM (
  SELECT c.trial_id, g.i AS new_noun, row_number() OVER (PARTITION BY c.trial_id ORDER BY coalesce(n, 0), g.i) AS rank
  FROM c_substitution c JOIN segments s ON s.trial_id = c.trial_id AND s.seg_idx = c.at JOIN ticks t ON t.trial_id = c.trial_id AND t.tick = c.a
  CROSS JOIN (SELECT CAST(range AS INTEGER) AS i FROM range(10)) g LEFT JOIN seen ON seen.state = s.state AND seen.noun_id = g.i WHERE g.i <> t.noun_id) WHERE rank = 1),
d_substitution AS (SELECT trial_id, 'substitution' AS error_type, tick, verb_id, CASE WHEN edited THEN new_noun ELSE noun_id END AS noun_id, tick AS src_tick, edited
  FROM (SELECT t.*, new_noun, tick >= a AND tick < z AS edited FROM ticks t JOIN c_substitution USING (trial_id) JOIN rare USING (trial_id)))""",
    "abandonment": f""",
d_abandonment AS (SELECT trial_id, 'abandonment' AS error_type, CAST(row_number() OVER (PARTITION BY trial_id ORDER BY tick) - 1 AS INTEGER) AS tick, verb_id, noun_id, tick AS src_tick, false AS edited
  FROM ticks JOIN c_abandonment USING (trial_id) WHERE tick < a + {KEEP} OR tick >= z)""",
    "omission": """,
d_omission AS (SELECT trial_id, 'omission' AS error_type, CAST(row_number() OVER (PARTITION BY trial_id ORDER BY tick) - 1 AS INTEGER) AS tick, verb_id, noun_id, tick AS src_tick, false AS edited
  FROM ticks JOIN c_omission USING (trial_id) WHERE NOT (tick >= a AND tick < z))""",
    "transposition": """,
d_transposition AS (SELECT trial_id, 'transposition' AS error_type,
    CAST(row_number() OVER (PARTITION BY trial_id ORDER BY CASE WHEN tick < a THEN 0 WHEN tick < z THEN 2 WHEN tick < z2 THEN 1 ELSE 3 END, tick) - 1 AS INTEGER) AS tick, verb_id, noun_id, tick AS src_tick, false AS edited
  FROM ticks JOIN (SELECT c.*, s.tick_end AS z2 FROM c_transposition c JOIN segments s ON s.trial_id = c.trial_id AND s.seg_idx = c.at + 1) USING (trial_id))""",
    "repetition": """,
d_repetition AS (SELECT trial_id, 'repetition' AS error_type, CAST(row_number() OVER (PARTITION BY trial_id ORDER BY place, tick) - 1 AS INTEGER) AS tick, verb_id, noun_id, tick AS src_tick, false AS edited FROM (
  SELECT t.*, CASE WHEN tick < z THEN 0 ELSE 2 END AS place FROM ticks t JOIN c_repetition USING (trial_id)
  UNION ALL SELECT t.*, 1 AS place FROM ticks t JOIN c_repetition USING (trial_id) WHERE tick >= a AND tick < z))""",
}
WINDOWS = {
    "substitution": ("a", "z - 1", "c_substitution"),
    "abandonment": (f"a + {KEEP} - 1", f"a + {KEEP} - 1", "c_abandonment"),
    "omission": ("a", "a", "c_omission"),
    "transposition": ("a", "z2 - 1", "(SELECT c.*, s.tick_end AS z2 FROM c_transposition c JOIN segments s ON s.trial_id = c.trial_id AND s.seg_idx = c.at + 1)"),
    "repetition": ("z", "z + d - 1", "c_repetition"),
}
ALL_CHOSEN = "".join(map(chosen, TYPES))
ALL_WINDOWS = " UNION ALL ".join(f"SELECT trial_id, '{k}' AS error_type, CAST({a} AS INTEGER) AS t0, CAST({b} AS INTEGER) AS t1 FROM {t}" for k, (a, b, t) in WINDOWS.items())
ALL_DEGRADED = (
    ALL_CHOSEN
    + "".join(DEGRADED.values())
    + ",\ndegraded AS ("
    + " UNION ALL ".join(f"SELECT * FROM d_{k}" for k in TYPES)
    + f"),\nwindows AS ({ALL_WINDOWS})"
    + """,
dmarked AS (SELECT *, CASE WHEN lag(verb_id) OVER w = verb_id THEN 0 ELSE 1 END AS new, lead(src_tick) OVER w AS next_src,
  edited OR coalesce(lag(edited) OVER w, false) OR coalesce(lead(edited) OVER w, false) AS by_edit FROM degraded WINDOW w AS (PARTITION BY trial_id, error_type ORDER BY tick)),
dnumbered AS (SELECT *, CAST(sum(new) OVER (PARTITION BY trial_id, error_type ORDER BY tick ROWS UNBOUNDED PRECEDING) - 1 AS INTEGER) AS seg_idx FROM dmarked),
dsteps AS (SELECT trial_id, error_type, seg_idx, verb_id AS state, min(tick) AS tick_start, max(tick) + 1 AS tick_end, CAST(count(*) AS INTEGER) AS duration FROM dnumbered GROUP BY ALL),
truth AS (SELECT s.* FROM dsteps s JOIN windows w ON w.trial_id = s.trial_id AND w.error_type = s.error_type AND tick_start <= t1 AND tick_end > t0),
debris AS (SELECT trial_id, error_type, seg_idx FROM (
  SELECT n.trial_id, n.error_type, n.seg_idx, max(CASE WHEN by_edit OR (n.tick < s.tick_end - 1 AND next_src <> src_tick + 1) THEN 1 ELSE 0 END) AS touched
  FROM dnumbered n JOIN dsteps s USING (trial_id, error_type, seg_idx) GROUP BY ALL) x WHERE touched = 1 AND NOT EXISTS (SELECT 1 FROM truth t WHERE t.trial_id = x.trial_id AND t.error_type = x.error_type AND t.seg_idx = x.seg_idx))"""
)


def flagged(alpha: float, suffix: str = "") -> str:
    """CTEs dflag (flagged degraded steps) and hflag (flagged healthy ticks)."""
    s = suffix
    return (
        tail(f"thr{s}", TRANSITION, "from_state", str(alpha))
        + f""",
dflag{s} AS (SELECT trial_id, error_type, seg_idx, tick_start FROM (SELECT *, lag(state) OVER (PARTITION BY trial_id, error_type ORDER BY seg_idx) AS from_state FROM dsteps) s
  JOIN logp l ON l.from_state = s.from_state AND l.to_state = s.state JOIN thr{s} t ON t.from_state = s.from_state WHERE round(-logp, 9) > threshold),
hflag{s} AS (SELECT trial_id, tick_start AS tick FROM scored JOIN thr{s} USING (from_state) WHERE round(s_transition, 9) > threshold),
outcome{s} AS (SELECT w.trial_id, w.error_type, t0, t1,
    coalesce(max(CASE WHEN tick_start BETWEEN t0 AND t1 + 5 THEN 1 ELSE 0 END), 0) AS detected,
    min(CASE WHEN tick_start BETWEEN t0 AND t1 + 5 THEN tick_start - t0 END) AS latency,
    coalesce(max(CASE WHEN tick_start IS NOT NULL AND tick_start NOT BETWEEN t0 AND t1 + 5 THEN 1 ELSE 0 END), 0) AS stray
  FROM windows w LEFT JOIN dflag{s} f ON f.trial_id = w.trial_id AND f.error_type = w.error_type GROUP BY ALL)"""
    )


SWEEP = "".join(tail(f"thr{k}", TRANSITION, "from_state", str(a)) for k, a in enumerate(ALPHAS)) + (
    ",\nthrs AS (" + " UNION ALL ".join(f"SELECT {a}::DOUBLE AS alpha, * FROM thr{k}" for k, a in enumerate(ALPHAS)) + ")"
    """,
judged AS (SELECT alpha, round(s_transition, 9) > threshold AS f, noun_id % 3 = 0 AS t FROM scored s JOIN thrs USING (from_state) JOIN ticks k ON k.trial_id = s.trial_id AND k.tick = s.tick_start),
grid AS (SELECT alpha, count(*) FILTER (f AND t) AS tp, count(*) FILTER (f AND NOT t) AS fp, count(*) FILTER (NOT f AND t) AS fn, count(*) FILTER (NOT f AND NOT t) AS tn FROM judged GROUP BY alpha),
curve AS (SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(fp / nullif(fp + tn, 0), 0) AS fpr FROM grid)"""
)
CURVE = "alpha, tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(fpr, 6) AS fpr"


def severity(v: str, t: str) -> str:
    return f"CASE WHEN {t} <= 0 THEN 'high' WHEN {v} / {t} < 1.5 THEN 'low' WHEN {v} / {t} < 3 THEN 'medium' ELSE 'high' END"


FRAMES = """,
frames AS (SELECT trial_id, verb_id, noun_id, upto - n + 1 AS start_frame, upto AS end_frame FROM (
  SELECT *, noun_id * 3 + 2 AS n, CAST(sum(noun_id * 3 + 2) OVER (PARTITION BY trial_id ORDER BY tick ROWS UNBOUNDED PRECEDING) AS INTEGER) AS upto FROM ticks))"""


def expanded(value: str, alias: str) -> str:
    return f"""SELECT trial_id, tick, {alias} FROM (
  SELECT *, row_number() OVER (PARTITION BY trial_id, tick ORDER BY n DESC, low) AS rank FROM (
    SELECT trial_id, tick, {alias}, sum(high - low + 1) AS n, min(low) AS low FROM (
      SELECT trial_id, {value} AS {alias}, CAST(tick AS INTEGER) AS tick, greatest(start_frame, tick * 15 + 1) AS low, least(end_frame, (tick + 1) * 15) AS high
      FROM frames, unnest(range((start_frame - 1) // 15, (end_frame - 1) // 15 + 1)) AS u(tick)) GROUP BY ALL)) WHERE rank = 1"""


DUAL = """,
dated AS (SELECT verb_id AS state, noun_id AS token, day(ts) AS day, event_id FROM ticks),
base AS (SELECT state, token, count(*)::DOUBLE AS frozen FROM dated WHERE day <= 15 GROUP BY ALL),
bumps AS (SELECT state, token, count(*) AS b FROM dated WHERE day > 15 AND event_id % 3 = 0 GROUP BY ALL),
dual AS (SELECT state, token, frozen, CASE WHEN b IS NULL THEN frozen ELSE greatest(frozen, least(frozen + b, frozen + 5)) END AS live FROM base LEFT JOIN bumps USING (state, token))"""
MODAL = """,
votes AS (SELECT *, row_number() OVER (PARTITION BY trial_id ORDER BY n DESC, verb_id) AS rank FROM (SELECT trial_id, recipe, verb_id, count(*) AS n FROM ticks GROUP BY ALL)),
modal AS (SELECT trial_id, recipe, verb_id, n FROM votes WHERE rank = 1)"""
TEXTS = """,
smarked AS (SELECT *, CASE WHEN lag(verb_id) OVER w = verb_id AND lag(noun_id) OVER w = noun_id THEN 0 ELSE 1 END AS new FROM ticks WINDOW w AS (PARTITION BY trial_id ORDER BY tick)),
snumbered AS (SELECT *, CAST(sum(new) OVER (PARTITION BY trial_id ORDER BY tick ROWS UNBOUNDED PRECEDING) - 1 AS INTEGER) AS seg_idx FROM smarked),
psteps AS (SELECT trial_id, seg_idx, verb, verb_id, noun_id, min(tick) AS tick_start, CAST(max(tick) + 1 AS INTEGER) AS tick_end, CAST(count(*) AS INTEGER) AS duration FROM snumbered GROUP BY ALL),
texts AS (SELECT *, verb || ' item' || noun_id || ' for ' || duration || CASE WHEN duration = 1 THEN ' second' ELSE ' seconds' END AS text FROM psteps)"""
BRIDGES = """,
paths AS (SELECT x.from_state, y.to_state, x.to_state AS bridge, x.logp + y.logp AS two_hop FROM logp x JOIN logp y ON x.to_state = y.from_state WHERE x.from_state <> y.to_state),
bridges AS (SELECT p.from_state, p.to_state, bridge, two_hop - l.logp AS gain FROM (SELECT *, row_number() OVER (PARTITION BY from_state, to_state ORDER BY round(two_hop, 9) DESC, bridge) AS rank FROM paths) p
  JOIN logp l ON l.from_state = p.from_state AND l.to_state = p.to_state WHERE rank = 1)"""
GAINS = """,
junctions AS (SELECT * FROM (SELECT trial_id, seg_idx, state AS a, lead(state) OVER w AS b, lag(state) OVER w AS before, lead(state, 2) OVER w AS after FROM segments WINDOW w AS (PARTITION BY trial_id ORDER BY seg_idx)) WHERE b IS NOT NULL),
gains AS (SELECT j.trial_id, j.seg_idx, a, b,
    n.logp - o.logp + CASE WHEN before IS NULL THEN 0 ELSE ni.logp - oi.logp END + CASE WHEN after IS NULL THEN 0 ELSE no.logp - oo.logp END AS gain
  FROM junctions j JOIN logp o ON o.from_state = a AND o.to_state = b JOIN logp n ON n.from_state = b AND n.to_state = a
  LEFT JOIN logp oi ON oi.from_state = before AND oi.to_state = a LEFT JOIN logp ni ON ni.from_state = before AND ni.to_state = b
  LEFT JOIN logp oo ON oo.from_state = b AND oo.to_state = after LEFT JOIN logp no ON no.from_state = a AND no.to_state = after
  WHERE (before IS NULL OR before <> b) AND (after IS NULL OR after <> a))"""
CHANNEL_BASE = (
    ",\nafter AS (SELECT *, lag(verb_id) OVER (PARTITION BY trial_id ORDER BY tick) AS prev FROM numbered)"
    + emission("en", "noun_id", "prev", "after")
    + emission("ev", "verb_id", "prev", "after")
    + """,
spine AS (SELECT state, max(d) AS top, unnest(range(1, max(d) + 1)) AS e FROM tails GROUP BY state),
surv AS (SELECT s.state, top, e, first_value(p_ge IGNORE NULLS) OVER (PARTITION BY s.state ORDER BY e ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p FROM spine s LEFT JOIN tails t ON t.state = s.state AND t.d = e),
hst AS (SELECT *, lag(state) OVER (PARTITION BY trial_id ORDER BY seg_idx) AS from_state FROM segments)"""
)
DEGRADED_STEPS = """,
dst AS (SELECT *, lag(state) OVER (PARTITION BY trial_id, error_type ORDER BY seg_idx) AS from_state, seg_idx = max(seg_idx) OVER (PARTITION BY trial_id, error_type) AS is_last, CAST(trial_id % 5 AS INTEGER) AS recipe FROM dsteps),
dticks AS (SELECT *, lag(verb_id) OVER (PARTITION BY trial_id, error_type ORDER BY tick) AS prev FROM dnumbered)"""


def bundle(alphas: list[float]) -> str:
    """CTE bundle: (channel, place, recipe, alpha, threshold)."""
    out, rows = "", []
    supports = {
        "s_verb": ("SELECT state, -logp AS score, exp(logp) AS mass FROM ev", "state", "state", "NULL::INTEGER"),
        "s_noun": ("SELECT state, -logp AS score, exp(logp) AS mass FROM en", "state", "state", "NULL::INTEGER"),
        "s_emit": ("SELECT state, -ev.logp - en.logp AS score, exp(ev.logp + en.logp) AS mass FROM ev JOIN en USING (state)", "state", "state", "NULL::INTEGER"),
        "s_transition": (TRANSITION, "from_state", "from_state", "NULL::INTEGER"),
        "s_recipe_transition": ("SELECT recipe, from_state, m.logp - r.logp AS score, exp(r.logp) AS mass FROM rlogp r JOIN marginal m USING (from_state, to_state)", "recipe, from_state", "from_state", "recipe"),
    }
    for k, a in enumerate(alphas):
        for c, (support, keys, place, recipe) in supports.items():
            out += tail(f"{c}_{k}", support, keys, str(a))
            rows.append(f"SELECT '{c}' AS channel, {place} AS place, {recipe} AS recipe, {a}::DOUBLE AS alpha, threshold FROM {c}_{k}")
        rows += [f"SELECT '{c}', NULL, NULL, {a}::DOUBLE, round(-ln({a}::DOUBLE), 9)" for c in ("s_temporal", "s_dur_two")]
    return out + ",\nbundle AS (" + " UNION ALL ".join(rows) + ")"


def channel_flags(name: str, ticks: str, steps: str, keys: str) -> str:
    """CTE `name`: the scores of all channels above their thresholds."""
    return f""",
{name}_scores AS (
  SELECT {keys}, tick, 's_verb' AS channel, prev AS place, NULL::INTEGER AS recipe, -ev.logp AS value FROM {ticks} t JOIN ev ON ev.state = t.prev AND ev.verb_id = t.verb_id
  UNION ALL SELECT {keys}, tick, 's_noun', prev, NULL, -en.logp FROM {ticks} t JOIN en ON en.state = t.prev AND en.noun_id = t.noun_id
  UNION ALL SELECT {keys}, tick, 's_emit', prev, NULL, -ev.logp - en.logp FROM {ticks} t JOIN ev ON ev.state = t.prev AND ev.verb_id = t.verb_id JOIN en ON en.state = t.prev AND en.noun_id = t.noun_id
  UNION ALL SELECT {keys}, tick, 's_temporal', x.state, NULL, -ln(p) FROM (SELECT *, verb_id AS state, row_number() OVER (PARTITION BY {keys}, seg_idx ORDER BY tick) AS elapsed FROM {ticks}) x JOIN surv ON surv.state = x.state AND surv.e = least(elapsed, 6, top)
  UNION ALL SELECT {keys}, tick_end - 1, 's_dur_two', s.state, NULL, greatest(0, -(ln(2.0) + least(ln(p_ge), ln(p_le)))) FROM {steps} s JOIN tails t ON t.state = s.state AND t.d = least(duration, 6) WHERE NOT is_last
  UNION ALL SELECT {keys}, tick_start, 's_transition', s.from_state, NULL, -logp FROM {steps} s JOIN logp l ON l.from_state = s.from_state AND l.to_state = s.state
  UNION ALL SELECT {keys}, tick_start, 's_recipe_transition', s.from_state, s.recipe, m.logp - r.logp FROM {steps} s JOIN rlogp r ON r.recipe = s.recipe AND r.from_state = s.from_state AND r.to_state = s.state JOIN marginal m ON m.from_state = s.from_state AND m.to_state = s.state),
{name} AS (SELECT s.*, alpha, threshold FROM {name}_scores s JOIN bundle b ON b.channel = s.channel AND (b.place IS NULL OR b.place = s.place) AND (b.place IS NULL OR b.recipe IS NOT DISTINCT FROM s.recipe) WHERE round(value, 9) > threshold)"""


HEALTHY_FLAGS = CHANNEL_BASE + bundle([0.2]) + channel_flags("hf", "after", "hst", "trial_id")
BOTH = ALL_DEGRADED + CHANNEL_BASE + DEGRADED_STEPS


def both_flags(alphas: list[float]) -> str:
    return BOTH + bundle(alphas) + channel_flags("hf", "after", "hst", "trial_id") + channel_flags("df", "dticks", "dst", "trial_id, error_type")


POSITIVE = ",\npositive AS (SELECT trial_id, error_type, seg_idx FROM truth UNION ALL SELECT * FROM debris)"
JUDGED = (
    POSITIVE
    + """,
marks AS (SELECT trial_id || '/' || error_type AS key, tick, channel, alpha FROM df UNION ALL SELECT trial_id::VARCHAR, tick, channel, alpha FROM hf),
world AS (SELECT d.trial_id || '/' || d.error_type AS key, tick, d.seg_idx, true AS e, p.seg_idx IS NOT NULL AS p FROM dnumbered d LEFT JOIN positive p ON p.trial_id = d.trial_id AND p.error_type = d.error_type AND p.seg_idx = d.seg_idx
  UNION ALL SELECT trial_id::VARCHAR, tick, seg_idx, false, false FROM numbered)"""
)
BEST = """,
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recipe ORDER BY n_trials DESC, states) AS rank, count(*) OVER (PARTITION BY recipe) AS n_orders FROM (
  SELECT recipe, states, count(*) AS n_trials FROM (SELECT trial_id, recipe, string_agg(state::VARCHAR, '-' ORDER BY seg_idx) AS states FROM segments GROUP BY ALL) GROUP BY ALL)) WHERE rank = 1)"""
TASK = (
    "'You watch a person do a task, step by step, and judge the last step shown.' || chr(10) || 'Answer in one line: `No Anomaly`, or `TYPE Anomaly. Correct move would have been ACTION ITEM for N seconds`,' || chr(10)"
    " || 'where TYPE is one of substitution, abandonment, omission, transposition, repetition, and action and item are from the lists below. Most steps are fine.'"
)
PROMPTS = (
    TEXTS
    + BEST
    + f""",
vocab_block AS (SELECT a || chr(10) || b AS v FROM (SELECT 'Actions (' || count(*) || '): ' || string_agg(token, ', ' ORDER BY id) AS a FROM vocab), (SELECT 'Items (' || count(*) || '): ' || string_agg('item' || noun_id, ', ' ORDER BY noun_id) AS b FROM (SELECT DISTINCT noun_id FROM ticks))),
usual AS (SELECT recipe, state, trunc(median(duration))::INTEGER AS d FROM segments GROUP BY ALL),
shown AS (SELECT recipe, string_agg(token || ' (~' || d || ' s)', ', ' ORDER BY step) AS steps FROM (SELECT recipe, unnest(string_split(states, '-'))::INTEGER AS state, unnest(range(len(string_split(states, '-')))) AS step FROM best) JOIN usual USING (recipe, state) JOIN vocab ON id = state GROUP BY recipe),
recipe_block AS (SELECT string_agg('recipe ' || recipe || ': ' || steps || ' [in ' || n_trials || ' trials; ' || n_orders || ' orders seen]', chr(10) ORDER BY recipe) AS r FROM shown JOIN best USING (recipe)),
systems AS (SELECT 'plain' AS variant, {TASK} || chr(10) || chr(10) || v AS text FROM vocab_block UNION ALL SELECT 'with recipes', {TASK} || chr(10) || chr(10) || v || chr(10) || chr(10) || r FROM vocab_block, recipe_block)"""
)


def tails_of() -> str:
    """CTE masses: (channel, place, recipe, level, tail), the mass of scores as great or greater; null at the lowest level."""
    rows = [f"SELECT '{c}' AS channel, {place} AS place, {recipe} AS recipe, score, mass FROM ({support})" for c, (support, place, recipe) in {
        "s_verb": ("SELECT state, -logp AS score, exp(logp) AS mass FROM ev", "state", "NULL::INTEGER"),
        "s_noun": ("SELECT state, -logp AS score, exp(logp) AS mass FROM en", "state", "NULL::INTEGER"),
        "s_emit": ("SELECT state, -ev.logp - en.logp AS score, exp(ev.logp + en.logp) AS mass FROM ev JOIN en USING (state)", "state", "NULL::INTEGER"),
        "s_transition": (TRANSITION, "from_state", "NULL::INTEGER"),
        "s_recipe_transition": ("SELECT recipe, from_state, m.logp - r.logp AS score, exp(r.logp) AS mass FROM rlogp r JOIN marginal m USING (from_state, to_state)", "from_state", "recipe"),
    }.items()]
    return ",\nlevels AS (SELECT channel, place, recipe, round(score, 9) AS level, sum(mass) AS mass FROM (" + " UNION ALL ".join(rows) + """) WHERE mass > 0 GROUP BY ALL),
masses AS (SELECT *, CASE WHEN level > min(level) OVER (PARTITION BY channel, place, recipe) THEN sum(mass) OVER (PARTITION BY channel, place, recipe ORDER BY level DESC) END AS tail FROM levels)"""


POINTS = (
    BOTH
    + ",\nbundle AS (SELECT '' AS channel, 0 AS place, 0 AS recipe, 0.1::DOUBLE AS alpha, 0.0::DOUBLE AS threshold WHERE false)"
    + channel_flags("hf", "after", "hst", "trial_id")
    + channel_flags("df", "dticks", "dst", "trial_id, error_type")
    + tails_of()
    + JUDGED
    + """,
heard AS (SELECT key, tick, channel, round(alpha, 9) AS alpha FROM (
  SELECT s.key, tick, s.channel, CASE WHEN s.channel IN ('s_temporal', 's_dur_two') THEN exp(-value) ELSE m.tail END AS alpha FROM (
    SELECT trial_id || '/' || error_type AS key, tick, channel, place, recipe, value FROM df_scores UNION ALL SELECT trial_id::VARCHAR, tick, channel, place, recipe, value FROM hf_scores) s
  LEFT JOIN masses m ON m.channel = s.channel AND m.place = s.place AND m.recipe IS NOT DISTINCT FROM s.recipe AND m.level = round(value, 9)) WHERE round(alpha, 9) < 1),
parted AS (SELECT *, CASE WHEN CAST(split_part(key, '/', 1) AS BIGINT) % 5 = 0 THEN 'test' ELSE 'train' END AS part FROM world),
spoken AS (SELECT p.*, unnest([channel, 'all']) AS channel, alpha FROM parted p JOIN heard USING (key, tick)),
stepped AS (SELECT key, part, seg_idx, bool_or(p) AS p FROM parted GROUP BY ALL),
totals_ AS (SELECT 'step' AS level, part, count(*) FILTER (p) AS positives, count(*) FILTER (NOT p) AS negatives FROM stepped GROUP BY ALL
  UNION ALL SELECT 'trial_loc', part, count(DISTINCT key) FILTER (e), count(DISTINCT key) FILTER (NOT e) FROM parted GROUP BY ALL),
changes AS (
  SELECT 'step' AS level, part, channel, alpha, CASE WHEN p THEN 1 ELSE 0 END AS tp, CASE WHEN p THEN 0 ELSE 1 END AS fp, CASE WHEN p THEN 0 ELSE 1 END AS gone
  FROM (SELECT key, part, seg_idx, channel, min(alpha) AS alpha FROM spoken GROUP BY ALL) JOIN stepped USING (key, part, seg_idx)
  UNION ALL SELECT 'trial_loc', part, channel, alpha, CASE WHEN e AND p THEN 1 ELSE 0 END, CASE WHEN e AND p THEN 0 ELSE 1 END, CASE WHEN e THEN 0 ELSE 1 END
  FROM (SELECT key, part, e, p, channel, min(alpha) AS alpha FROM spoken GROUP BY ALL)
  UNION ALL SELECT level, part, unnest(['s_transition', 's_dur_two', 's_temporal', 's_noun', 's_verb', 's_recipe_transition', 's_emit', 'all']), 0, 0, 0, 0 FROM totals_),
runs_ AS (SELECT level, part, channel, alpha, sum(sum(tp)) OVER w AS tp, sum(sum(fp)) OVER w AS fp, sum(sum(gone)) OVER w AS gone FROM changes GROUP BY level, part, channel, alpha WINDOW w AS (PARTITION BY level, part, channel ORDER BY alpha)),
points AS (SELECT s.level, channel, s.part, alpha, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(positives - tp AS BIGINT) AS fn, CAST(negatives - gone AS BIGINT) AS tn FROM runs_ s JOIN totals_  t ON t.level = s.level AND t.part = s.part)"""
)
RATES = """round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS fpr"""
CELLS = "count(*) FILTER (p AND f) AS tp, count(*) FILTER (NOT p AND f) AS fp, count(*) FILTER (p AND NOT f) AS fn, count(*) FILTER (NOT p AND NOT f) AS tn"
NARRATED = f"""
SELECT trial_id, tick_start AS tick, 's_transition' AS channel, CASE WHEN bridge IS NULL THEN 'out_of_order' ELSE 'missing_step' END AS kind, {severity('s_transition', 'threshold')} AS severity,
  CASE WHEN bridge IS NULL THEN '''' || st.token || ''' came after ''' || fr.token || '''; usually ''' || nx.token || ''' does. Is that right?' ELSE 'Did you skip ''' || br.token || ''' between ''' || fr.token || ''' and ''' || st.token || '''?' END AS text
FROM scored c JOIN thr USING (from_state) LEFT JOIN (SELECT * FROM bridges WHERE gain >= 2) b ON b.from_state = c.from_state AND b.to_state = c.state
  JOIN (SELECT from_state, to_state AS expected, row_number() OVER (PARTITION BY from_state ORDER BY round(logp, 9) DESC, to_state) AS rank FROM logp) x ON x.from_state = c.from_state AND x.rank = 1
  JOIN vocab st ON st.id = c.state JOIN vocab fr ON fr.id = c.from_state JOIN vocab nx ON nx.id = expected LEFT JOIN vocab br ON br.id = bridge
WHERE round(s_transition, 9) > threshold
UNION ALL
SELECT trial_id, CAST(tick_end - 1 AS INTEGER), 's_dur_two', CASE WHEN p_ge < p_le THEN 'retro_stall' ELSE 'left_early' END, {severity('two', 'limit_')},
  '''' || token || CASE WHEN p_ge < p_le THEN ''' took ' || duration || ' ticks; usually about ' || CAST(round(mean_duration) AS INTEGER) || '. Was something wrong?' ELSE ''' ended after ' || duration || ' ticks; usually it takes about ' || CAST(round(mean_duration) AS INTEGER) || '. Was it left early?' END
FROM (SELECT s.*, p_ge, p_le, greatest(0, -(ln(2.0) + least(ln(p_ge), ln(p_le)))) AS two, -ln(0.2::DOUBLE) AS limit_ FROM segments s JOIN tails t ON t.state = s.state AND t.d = least(duration, 6) WHERE NOT is_last) s JOIN vocab ON id = s.state JOIN moments m ON m.state = s.state
WHERE round(two, 9) > round(limit_, 9)
UNION ALL
SELECT trial_id, tick, channel, CASE WHEN channel = 's_noun' THEN 'item_substitution' ELSE 'wrong_action' END, {severity('value', 'threshold')},
  CASE WHEN channel = 's_noun' THEN 'Was ''item' || noun_id || ''' meant here? ''item' || ln_.noun || ''' was expected.' ELSE 'Was ''' || v1.token || ''' meant here? ''' || v2.token || ''' was expected.' END
FROM (SELECT *, row_number() OVER (PARTITION BY trial_id, seg_idx, channel ORDER BY round(value, 9) DESC, tick) AS rank FROM (
    SELECT f.*, a.seg_idx, a.noun_id, a.verb_id, max(value) FILTER (channel = 's_noun') OVER w AS vn, max(value) FILTER (channel = 's_verb') OVER w AS vv FROM hf f JOIN after a ON a.trial_id = f.trial_id AND a.tick = f.tick WHERE channel IN ('s_noun', 's_verb') WINDOW w AS (PARTITION BY f.trial_id, f.tick))
  WHERE round(value, 9) > round(coalesce(CASE WHEN channel = 's_noun' THEN vv ELSE vn END, '-infinity'::DOUBLE), 9)) f
  JOIN (SELECT state, noun_id AS noun, row_number() OVER (PARTITION BY state ORDER BY round(logp, 9) DESC, noun_id) AS rank FROM en) ln_ ON ln_.state = f.place AND ln_.rank = 1
  JOIN (SELECT state, verb_id AS verb, row_number() OVER (PARTITION BY state ORDER BY round(logp, 9) DESC, verb_id) AS rank FROM ev) lv_ ON lv_.state = f.place AND lv_.rank = 1
  JOIN vocab v1 ON v1.id = f.verb_id JOIN vocab v2 ON v2.id = lv_.verb
WHERE f.rank = 1
UNION ALL
SELECT f.trial_id, f.tick, 's_temporal', 'stall', {severity('value', 'threshold')}, 'Still at ''' || token || ''' after ' || (f.tick - tick_start + 1) || ' ticks? Usually it takes about ' || CAST(round(mean_duration) AS INTEGER) || '.'
FROM (SELECT f.*, seg_idx, row_number() OVER (PARTITION BY f.trial_id, seg_idx ORDER BY f.tick) AS rank FROM hf f JOIN after a ON a.trial_id = f.trial_id AND a.tick = f.tick WHERE channel = 's_temporal') f
  JOIN segments s ON s.trial_id = f.trial_id AND s.seg_idx = f.seg_idx JOIN vocab ON id = s.state JOIN moments m ON m.state = s.state WHERE rank = 1"""
LABEL = "CASE WHEN tick = 0 THEN 'SIL' ELSE verb || '_item_' || noun_id END"

SQL: dict[str, str] = {
    "flags_long": sql(f"SELECT trial_id, tick_start AS tick, from_state, state, round(s_transition, 6) AS s_transition, round(threshold, 6) AS threshold, {severity('s_transition', 'threshold')} AS severity FROM scored JOIN thr USING (from_state) WHERE round(s_transition, 9) > threshold", tail("thr", TRANSITION, "from_state", "0.3")),
    "events_ticks": sql("SELECT trial_id, tick, verb, verb_id, noun_id, recipe FROM ticks"),
    "vocab_ids": sql("SELECT * FROM vocab"),
    "canonical_view": "SELECT l_orderkey, l_returnflag, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rank FROM lineitem) WHERE rank = 1",
    "view_disagreement": "SELECT l_orderkey, l_returnflag, count(DISTINCT l_partkey) AS n_contents FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_partkey) > 1",
    "canonical_cameras": CAMERAS + "SELECT trial_id, camera, recipe, content FROM (SELECT *, row_number() OVER (PARTITION BY trial_id ORDER BY CASE camera WHEN 'cam01' THEN 1 WHEN 'cam02' THEN 2 WHEN 'stereo01' THEN 3 WHEN 'webcam01' THEN 4 ELSE 5 END) AS rank FROM views) WHERE rank = 1",
    "camera_disagreements": CAMERAS + "SELECT trial_id, count(DISTINCT content)::INTEGER AS n_contents FROM views GROUP BY ALL HAVING count(DISTINCT content) > 1",
    "operating_points": sql("SELECT level, channel, part, alpha, tp, fp, fn, tn FROM points", POINTS),
    "tuned_points": sql(
        "SELECT t.level, t.channel, round(t.alpha, 6) AS alpha, " + ", ".join(f"{p}.{c} AS {n}_{c}" for p, n in (("t", "train"), ("s", "test")) for c in ("tp", "fp", "fn", "tn")) + ", "
        + ", ".join(f"round({e.format(p=p)}, 6) AS {n}_{r}" for p, n in (("t", "train"), ("s", "test")) for r, e in {
            "accuracy": "({p}.tp + {p}.tn) / ({p}.tp + {p}.fp + {p}.fn + {p}.tn)", "precision": "coalesce({p}.tp / nullif({p}.tp + {p}.fp, 0), 0)", "recall": "coalesce({p}.tp / nullif({p}.tp + {p}.fn, 0), 0)",
            "f1": "coalesce(2 * {p}.tp / nullif(2 * {p}.tp + {p}.fp + {p}.fn, 0), 0)", "fpr": "coalesce({p}.fp / nullif({p}.fp + {p}.tn, 0), 0)"}.items())
        + """ FROM best t LEFT JOIN (SELECT p.*, row_number() OVER (PARTITION BY p.level, p.channel ORDER BY p.alpha DESC) AS rank FROM points p JOIN best b ON b.level = p.level AND b.channel = p.channel AND p.alpha <= b.alpha WHERE p.part = 'test') s
  ON s.level = t.level AND s.channel = t.channel AND s.rank = 1""",
        POINTS + ",\nbest AS (SELECT * FROM points WHERE part = 'train' QUALIFY row_number() OVER (PARTITION BY level, channel ORDER BY round((tp + tn) / (tp + fp + fn + tn), 9) DESC, alpha) = 1)",
    ),
    "ingredient_tests": sql(
        """SELECT participant, item, k, n, round(rate, 6) AS rate, round(p, 6) AS p, rank, rank <= (SELECT coalesce(max(rank) FILTER (p <= rank / m * 0.1), 0) FROM ranked_) AS rejected FROM ranked_""",
        """,
uses AS (SELECT DISTINCT trial_id AS participant, tick // 10 AS trial, noun_id AS item FROM ticks),
each_ AS (SELECT participant, CAST(count(DISTINCT trial) AS INTEGER) AS n FROM uses GROUP BY participant),
rates_ AS (SELECT item, used / total AS rate FROM (SELECT item, count(*) AS used FROM uses GROUP BY item), (SELECT sum(n) AS total FROM each_) WHERE used >= 5 AND used < total),
cells_ AS (SELECT e.participant, r.item, CAST(coalesce(u.k, 0) AS INTEGER) AS k, n, rate FROM each_ e CROSS JOIN rates_ r LEFT JOIN (SELECT participant, item, count(*) AS k FROM uses GROUP BY ALL) u ON u.participant = e.participant AND u.item = r.item WHERE n >= 3),
mass_ AS (SELECT *, lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(rate) + (n - i) * ln(1 - rate) AS m FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM cells_)),
tests_ AS (SELECT participant, item, k, n, rate, round(least(1, sum(exp(m)) FILTER (m <= own + 1e-7)), 9) AS p FROM (SELECT *, max(CASE WHEN i = k THEN m END) OVER (PARTITION BY participant, item) AS own FROM mass_) GROUP BY ALL),
ranked_ AS (SELECT *, CAST(row_number() OVER (ORDER BY p, participant, item) AS INTEGER) AS rank, count(*) OVER () AS m FROM tests_)""",
    ),
    "stall_alarms": sql(
        "SELECT trial_id, ts AS started, state, alarm FROM (SELECT *, ts + to_hours((state + 1) * 6) AS alarm, coalesce(lead(ts) OVER (PARTITION BY trial_id ORDER BY ts), (SELECT max(ts) FROM ticks)) AS until FROM changes_ WHERE before IS NULL OR before <> state) WHERE alarm < until",
        """,
changes_ AS (SELECT *, lag(state) OVER (PARTITION BY trial_id ORDER BY ts) AS before FROM (SELECT trial_id, ts, min(verb_id) AS state FROM ticks GROUP BY ALL))""",
    ),
    "warm_counts": sql(
        "SELECT family, recipe, i, j, round(sum(w * part), 6) AS n FROM cells_ GROUP BY ALL",
        """,
labelled AS (SELECT s.*, r.recipe AS label, w FROM (SELECT *, lag(state) OVER (PARTITION BY trial_id ORDER BY seg_idx) AS before, count(*) OVER (PARTITION BY trial_id) AS of_ FROM segments) s, LATERAL (VALUES (s.recipe, 0.75::DOUBLE), (CAST((s.recipe + 1) % 5 AS INTEGER), 0.25::DOUBLE)) r(recipe, w)),
cells_ AS (SELECT 'pi' AS family, label AS recipe, 0 AS i, 0 AS j, w, 1.0::DOUBLE / of_ AS part FROM labelled UNION ALL SELECT 'init', label, state, 0, w, 1 FROM labelled WHERE before IS NULL
  UNION ALL SELECT 'trans', label, before, state, w, 1 FROM labelled WHERE before IS NOT NULL UNION ALL SELECT 'dur', label, state, least(duration, 6), w, 1 FROM labelled)""",
    ),
    "sequence_evaluation": sql(
        """SELECT error_type, count(*) AS n, sum(hit) AS detected, sum(hit_right) AS named, (SELECT count(DISTINCT trial_id) FROM segments) AS healthy, (SELECT count(DISTINCT trial_id) FROM hverdict) AS healthy_flagged
FROM (SELECT s.trial_id, s.error_type, coalesce(max(CASE WHEN v.seg_idx BETWEEN g0 - 1 AND g1 + 1 THEN 1 ELSE 0 END), 0) AS hit, coalesce(max(CASE WHEN v.seg_idx BETWEEN g0 - 1 AND g1 + 1 AND verdict = s.error_type THEN 1 ELSE 0 END), 0) AS hit_right
  FROM (SELECT trial_id, error_type, min(seg_idx) AS g0, max(seg_idx) AS g1 FROM truth GROUP BY ALL) s LEFT JOIN dverdict v ON v.trial_id = s.trial_id || '/' || s.error_type GROUP BY ALL) GROUP BY error_type""",
        ALL_DEGRADED
        + BRIDGES
        + GAINS
        + ",\ndkeyed AS (SELECT trial_id || '/' || error_type AS trial_id, seg_idx, state, duration FROM dsteps)"
        + GAINS.replace("junctions", "djunctions").replace("\ngains AS", "\ndgains AS").replace("FROM segments WINDOW", "FROM dkeyed WINDOW")
        + tail("swapped_", "SELECT 0 AS k, gain AS score, 1.0::DOUBLE / count(*) OVER () AS mass FROM gains", "k", "0.05")
        + tail("repeated_", "SELECT 0 AS k, duration / mean_duration AS score, 1.0::DOUBLE / count(*) OVER () AS mass FROM segments JOIN moments USING (state)", "k", "0.05")
        + "".join(
            f""",
{name} AS (SELECT trial_id, seg_idx, verdict FROM (
    SELECT j.trial_id, j.seg_idx, CASE WHEN round(g.gain, 9) > (SELECT threshold FROM swapped_) THEN 'transposition' WHEN b.gain >= -1.35 THEN 'omission' END AS verdict
    FROM {j} j LEFT JOIN {g} g ON g.trial_id = j.trial_id AND g.seg_idx = j.seg_idx LEFT JOIN bridges b ON b.from_state = j.a AND b.to_state = j.b) WHERE verdict IS NOT NULL
  UNION ALL SELECT trial_id, seg_idx, 'repetition' FROM {s} JOIN moments USING (state) WHERE round(duration / mean_duration, 9) > (SELECT threshold FROM repeated_))"""
            for name, j, g, s in (("hverdict", "junctions", "gains", "segments"), ("dverdict", "djunctions", "dgains", "dkeyed"))
        ),
    ),
    "system_prompts": sql("SELECT variant, text FROM systems", PROMPTS),
    "trial_texts": sql("SELECT trial_id, string_agg((seg_idx + 1) || '. ' || text, chr(10) ORDER BY seg_idx) AS text FROM texts GROUP BY trial_id", TEXTS),
    "conversation_turns": sql(
        """SELECT trial_id, seg_idx, coalesce(string_agg('user: ' || text || CASE WHEN seg_idx % 3 = 2 THEN '' ELSE chr(10) || 'assistant: No Anomaly' END, chr(10)) OVER (PARTITION BY trial_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) || chr(10), '') || 'user: ' || text AS messages FROM texts""",
        TEXTS,
    ),
    "prefix_requests": sql(
        """SELECT variant, count(*) AS requests, sum(length(s.text) + length(prompt))::BIGINT AS chars FROM systems s, (SELECT string_agg((seg_idx + 1) || '. ' || text, chr(10)) OVER (PARTITION BY trial_id ORDER BY seg_idx ROWS UNBOUNDED PRECEDING) AS prompt FROM texts) GROUP BY variant""",
        PROMPTS,
    ),
    "segment_parse": sql("SELECT trial_id, tick, verb || '_item_' || noun_id AS label, CAST(tick * 10 + 1 AS INTEGER) AS start_frame, CAST(tick * 10 + 10 AS INTEGER) AS end_frame FROM ticks WHERE tick % 7 <> 3"),
    "verb_noun_split": sql(f"SELECT trial_id, tick, CASE WHEN label = 'SIL' THEN 'stall' ELSE split_part(label, '_', 1) END AS verb, CASE WHEN label = 'SIL' THEN 'kitchen' ELSE substr(label, instr(label, '_') + 1) END AS noun FROM (SELECT *, {LABEL} AS label FROM ticks)"),
    "tick_expand_plurality": sql(expanded("verb_id", "verb_id"), FRAMES),
    "tick_expand_pairs": sql(expanded("verb_id * 100 + noun_id", "pair"), FRAMES),
    "terminal_trim": sql("SELECT trial_id, tick, verb_id, CAST(top - last AS INTEGER) AS n_trimmed FROM (SELECT *, max(tick) OVER (PARTITION BY trial_id) AS top, max(CASE WHEN verb_id <> 0 THEN tick END) OVER (PARTITION BY trial_id) AS last FROM ticks) WHERE tick <= last"),
    "split_semi": sql("SELECT trial_id, tick, verb_id FROM ticks WHERE trial_id % 5 = 0"),
    "split_anti": sql("SELECT trial_id, tick, verb_id FROM ticks WHERE trial_id % 5 <> 0"),
    "rle_steps": sql("SELECT * FROM segments"),
    "rle_pairs": sql("SELECT trial_id, seg_idx, verb_id, noun_id, tick_start, tick_end, duration FROM psteps", TEXTS),
    "steps_text": sql("SELECT trial_id, seg_idx, text, CASE WHEN verb = 'view' AND noun_id = 0 THEN 'idle' WHEN verb = 'view' THEN 'item' || noun_id ELSE verb || ' item' || noun_id END AS phrase FROM texts", TEXTS),
    "run_expansion": sql("SELECT trial_id, tick, verb_id AS state FROM ticks"),
    "segment_absorb": sql(
        "SELECT *, seg_idx = max(seg_idx) OVER (PARTITION BY trial_id) AS is_last FROM (SELECT trial_id, seg_idx, state, min(tick) AS tick_start, CAST(max(tick) + 1 AS INTEGER) AS tick_end, CAST(count(*) AS INTEGER) AS duration FROM am GROUP BY ALL)",
        """,
ak AS (SELECT trial_id, tick, CASE WHEN verb_id IN (1, 2) THEN verb_id END AS k FROM ticks),
af AS (SELECT trial_id, tick, coalesce(last_value(k IGNORE NULLS) OVER (PARTITION BY trial_id ORDER BY tick ROWS UNBOUNDED PRECEDING), first_value(k IGNORE NULLS) OVER (PARTITION BY trial_id ORDER BY tick ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS state FROM ak),
an AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY trial_id ORDER BY tick) = state THEN 0 ELSE 1 END AS new FROM af),
am AS (SELECT *, CAST(sum(new) OVER (PARTITION BY trial_id ORDER BY tick ROWS UNBOUNDED PRECEDING) - 1 AS INTEGER) AS seg_idx FROM an)""",
    ),
    "observed_pairs": sql("SELECT verb_id, noun_id, count(*) AS n FROM ticks GROUP BY ALL HAVING count(*) >= 200"),
    "bag_of_pairs": sql("SELECT trial_id, verb_id, noun_id, round(share / sqrt(sum(share * share) OVER (PARTITION BY trial_id)), 6) AS weight FROM (SELECT trial_id, verb_id, noun_id, n / sum(n) OVER (PARTITION BY trial_id) AS share FROM (SELECT trial_id, verb_id, noun_id, count(*) AS n FROM ticks GROUP BY ALL))"),
    "init_counts": sql("SELECT recipe, state, count(*) AS n FROM segments WHERE seg_idx = 0 GROUP BY ALL"),
    "trans_counts": sql("SELECT * FROM rc"),
    "dur_hist": sql("SELECT * FROM hist"),
    "dur_hist_censored": sql("SELECT is_last, state, least(duration, 6) AS d, count(*) AS n FROM segments GROUP BY ALL"),
    "map_normalise": sql("SELECT from_state, to_state, round(logp, 6) AS logp FROM logp"),
    "backoff": sql("SELECT recipe, from_state, to_state, round(n, 6) AS n FROM smooth", tau=2.0),
    "mode_shift": sql("SELECT recipe, from_state, to_state, round(n + CASE WHEN from_state <> to_state THEN 0.5 ELSE 0 END, 6)::DOUBLE AS n FROM rc"),
    "collapse_marginal": sql("SELECT from_state, to_state, round(sum(share * n), 6) AS n FROM rc JOIN shares USING (recipe) GROUP BY ALL"),
    "marginal_trans": sql("SELECT from_state, to_state, round(logp, 6) AS logp FROM marginal"),
    "nb_moments": sql("SELECT state, n, s, round(r, 6) AS r, round(p, 6) AS p, round(mean_duration, 6) AS mean_duration FROM moments"),
    "empirical_survival": sql("SELECT state, d, round(p_ge, 6) AS p_ge, round(p_le, 6) AS p_le, round(p_lt, 6) AS p_lt, round(p_eq, 6) AS p_eq FROM tails"),
    "two_sided_duration": sql("SELECT trial_id, seg_idx, s.state, duration, CASE WHEN is_last THEN 0 ELSE round(-ln(p_ge), 6) + 0.0 END AS s_long, CASE WHEN is_last THEN 0 ELSE round(-ln(p_le), 6) + 0.0 END AS s_short, CASE WHEN is_last THEN 0 ELSE round(greatest(0, -(ln(2.0) + least(ln(p_ge), ln(p_le)))), 6) END AS s_dur_two, CASE WHEN is_last THEN 'none' WHEN p_ge < p_le THEN 'stuck' ELSE 'left_early' END AS cause, round(p_lt + 0.5 * p_eq, 6) AS pit FROM segments s JOIN tails t ON t.state = s.state AND t.d = least(duration, 6)"),
    "live_stall": sql(
        "SELECT trial_id, tick, e.state, elapsed, round(-ln(p), 6) + 0.0 AS s_temporal FROM (SELECT trial_id, seg_idx, verb_id AS state, tick, CAST(row_number() OVER (PARTITION BY trial_id, seg_idx ORDER BY tick) AS INTEGER) AS elapsed FROM numbered) e JOIN surv ON surv.state = e.state AND surv.e = least(elapsed, 6, top)",
        """,
spine AS (SELECT state, max(d) AS top, unnest(range(1, max(d) + 1)) AS e FROM tails GROUP BY state),
surv AS (SELECT s.state, top, e, first_value(p_ge IGNORE NULLS) OVER (PARTITION BY s.state ORDER BY e ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p FROM spine s LEFT JOIN tails t ON t.state = s.state AND t.d = e)""",
    ),
    "transition_surprise": sql("SELECT trial_id, tick_start, from_state, state, round(s_transition, 6) AS s_transition FROM scored"),
    "expected_next": sql("SELECT from_state, to_state AS expected_state, round(logp, 6) AS logp FROM (SELECT *, row_number() OVER (PARTITION BY from_state ORDER BY round(logp, 9) DESC, to_state) AS rank FROM logp) WHERE rank = 1"),
    "tail_threshold_transition": sql("SELECT from_state, round(threshold, 6) AS threshold FROM thr", tail("thr", TRANSITION, "from_state", "0.3")),
    "tail_threshold_categorical": sql("SELECT state, round(threshold, 6) AS threshold FROM thr", emission("en", "noun_id") + tail("thr", "SELECT state, -logp AS score, exp(logp) AS mass FROM en", "state", "0.3")),
    "tail_threshold_joint": sql("SELECT state, round(threshold, 6) AS threshold FROM thr", emission("en", "noun_id") + emission("ev", "verb_id") + tail("thr", "SELECT state, -ev.logp - en.logp AS score, exp(ev.logp + en.logp) AS mass FROM ev JOIN en USING (state)", "state", "0.3")),
    "tail_threshold_excess": sql("SELECT recipe, from_state, round(threshold, 6) + 0.0 AS threshold FROM thr", tail("thr", "SELECT recipe, from_state, m.logp - r.logp AS score, exp(r.logp) AS mass FROM rlogp r JOIN marginal m USING (from_state, to_state)", "recipe, from_state", "0.3")),
    "tail_threshold_empirical": sql("SELECT state, threshold FROM thr", tail("thr", "SELECT state, duration::DOUBLE AS score, 1 / count(*) OVER (PARTITION BY state) AS mass FROM segments", "state", "0.1")),
    "emission_attribution": sql(
        "SELECT trial_id, tick, round(-ev.logp, 6) AS s_verb, round(-en.logp, 6) AS s_noun, round(-ev.logp - en.logp, 6) AS s_emit, CASE WHEN ev.logp - en.logp > 0.2 THEN 'item' WHEN en.logp - ev.logp > 0.2 THEN 'action' ELSE 'none' END AS attribution FROM after a JOIN ev ON ev.state = a.prev AND ev.verb_id = a.verb_id JOIN en ON en.state = a.prev AND en.noun_id = a.noun_id",
        ",\nafter AS (SELECT *, lag(verb_id) OVER (PARTITION BY trial_id ORDER BY tick) AS prev FROM ticks)" + emission("en", "noun_id", "prev", "after") + emission("ev", "verb_id", "prev", "after"),
    ),
    "missing_step": sql("SELECT from_state, to_state, bridge, round(gain, 6) AS gain FROM bridges", BRIDGES),
    "swap_gain": sql("SELECT j.trial_id, j.seg_idx, j.a, j.b, round(gain, 6) + 0.0 AS gain FROM junctions j LEFT JOIN gains g ON g.trial_id = j.trial_id AND g.seg_idx = j.seg_idx", GAINS),
    "repetition_ratio": sql("SELECT trial_id, seg_idx, state, round(duration / mean_duration, 6) AS ratio FROM segments JOIN moments USING (state)"),
    "sequence_verdicts": sql(
        """SELECT trial_id, seg_idx, error_type, round(CASE WHEN error_type = 'omission' THEN bridge_gain ELSE gain END, 6) + 0.0 AS value, CASE WHEN error_type = 'omission' THEN bridge END AS bridge FROM (
  SELECT j.trial_id, j.seg_idx, g.gain, b.gain AS bridge_gain, bridge, CASE WHEN g.gain > 0.05 THEN 'transposition' WHEN b.gain >= -1.35 THEN 'omission' END AS error_type
  FROM junctions j LEFT JOIN gains g ON g.trial_id = j.trial_id AND g.seg_idx = j.seg_idx LEFT JOIN bridges b ON b.from_state = j.a AND b.to_state = j.b) WHERE error_type IS NOT NULL
UNION ALL SELECT trial_id, seg_idx, 'repetition', round(duration / mean_duration, 6), NULL FROM segments JOIN moments USING (state) WHERE duration / mean_duration > 2.5""",
        BRIDGES + GAINS,
    ),
    **{f"inject_{k}": sql(f"SELECT * FROM d_{k}", chosen(k) + DEGRADED[k]) for k in TYPES},
    "inject_stall": sql(
        """SELECT trial_id, 'stall' AS error_type, CAST(row_number() OVER (PARTITION BY trial_id ORDER BY tick, place) - 1 AS INTEGER) AS tick, verb_id, noun_id, tick AS src_tick, false AS edited FROM (
  SELECT t.*, 0 AS place FROM ticks t JOIN c_stall USING (trial_id) UNION ALL SELECT t.*, unnest(range(1, CAST(greatest(d * 3, 20) AS BIGINT) + 1)) AS place FROM ticks t JOIN c_stall USING (trial_id) WHERE tick = z - 1)""",
        chosen("stall"),
    ),
    "inject_windows": sql("SELECT * FROM windows", ALL_DEGRADED),
    "verdict_steps": sql(
        "SELECT trial_id, step, error_type FROM (SELECT s.trial_id, p.seg_idx AS step, error_type, row_number() OVER (PARTITION BY s.trial_id, p.seg_idx ORDER BY s.seg_idx, error_type) AS rank FROM spans s JOIN psteps p ON p.trial_id = s.trial_id AND p.tick_start < s.z AND p.tick_end > s.a) WHERE rank = 1",
        BRIDGES + GAINS + TEXTS + """,
found AS (SELECT j.trial_id, j.seg_idx, CASE WHEN g.gain > 0.05 THEN 'transposition' WHEN b.gain >= -1.35 THEN 'omission' END AS error_type
  FROM junctions j LEFT JOIN gains g ON g.trial_id = j.trial_id AND g.seg_idx = j.seg_idx LEFT JOIN bridges b ON b.from_state = j.a AND b.to_state = j.b
  UNION ALL SELECT trial_id, seg_idx, 'repetition' FROM segments JOIN moments USING (state) WHERE duration / mean_duration > 2.5),
spans AS (SELECT f.trial_id, f.seg_idx, error_type, tick_start AS a, CASE WHEN error_type = 'repetition' THEN tick_end ELSE coalesce(next_end, tick_end) END AS z
  FROM found f JOIN (SELECT *, lead(tick_end) OVER (PARTITION BY trial_id ORDER BY seg_idx) AS next_end FROM segments) s ON s.trial_id = f.trial_id AND s.seg_idx = f.seg_idx WHERE error_type IS NOT NULL)""",
    ),
    "correction_accuracy": sql(
        """SELECT error_type, count(*) AS n, count(move) AS proposed, round(avg(CASE WHEN move IS NOT NULL THEN CAST(move = true_move AS INTEGER) END), 6) AS move_ok,
  round(avg(CASE WHEN move IS NOT NULL THEN CAST(abs(seconds - true_seconds) <= greatest(2.0, 0.5 * true_seconds) AS INTEGER) END), 6) AS duration_ok FROM judged GROUP BY error_type""",
        ALL_DEGRADED + """,
nexts AS (SELECT from_state, to_state AS move, floor(round(mean_duration, 6) + 0.5) AS seconds FROM (SELECT *, row_number() OVER (PARTITION BY from_state ORDER BY round(logp, 9) DESC, to_state) AS rank FROM logp) l JOIN moments m ON m.state = l.to_state WHERE rank = 1),
befores AS (SELECT *, lag(state) OVER (PARTITION BY trial_id, error_type ORDER BY seg_idx) AS from_state FROM dsteps),
judged AS (SELECT w.error_type, h.state AS true_move, h.duration AS true_seconds, move, seconds FROM windows w JOIN dnumbered d ON d.trial_id = w.trial_id AND d.error_type = w.error_type AND d.tick = w.t0
  JOIN segments h ON h.trial_id = w.trial_id AND d.src_tick >= h.tick_start AND d.src_tick < h.tick_end
  JOIN befores b ON b.trial_id = w.trial_id AND b.error_type = w.error_type AND b.seg_idx = d.seg_idx LEFT JOIN nexts x ON x.from_state = b.from_state)""",
    ),
    "duration_power": sql(
        """SELECT alpha, CAST(sum(CASE WHEN kind = 'as_is' THEN 1 ELSE 0 END) AS BIGINT) AS segments, count(*) FILTER (kind = 'as_is' AND low < alpha) AS as_is, count(*) FILTER (kind = 'doubled' AND low < alpha) AS doubled, count(*) FILTER (kind = 'cut' AND low < alpha) AS cut FROM judged GROUP BY alpha""",
        """,
lows AS (SELECT s.state, k.d, round(2 * least(sum(CASE WHEN h.d >= k.d THEN n ELSE 0 END), sum(CASE WHEN h.d <= k.d THEN n ELSE 0 END)) / sum(n), 9) AS low FROM states s CROSS JOIN (SELECT unnest(range(1, 7)) AS d) k JOIN hist h ON h.state = s.state GROUP BY ALL),
kinds AS (SELECT state, 'as_is' AS kind, duration AS d FROM segments WHERE NOT is_last UNION ALL SELECT state, 'doubled', 2 * duration FROM segments WHERE NOT is_last UNION ALL SELECT state, 'cut', 1 FROM segments WHERE NOT is_last),
judged AS (SELECT kind, low, alpha FROM kinds x JOIN lows l ON l.state = x.state AND l.d = least(x.d, 6) CROSS JOIN (SELECT unnest([0.02, 0.05, 0.1, 0.3, 0.5])::DOUBLE AS alpha))""",
    ),
    "pit_deciles": sql("SELECT decile, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT CAST(least(floor(round(p_lt + 0.5 * p_eq, 9) * 10), 9) AS INTEGER) AS decile, count(*) AS n FROM segments s JOIN tails t ON t.state = s.state AND t.d = least(duration, 6) WHERE NOT is_last GROUP BY ALL)"),
    "representative_trials": sql(
        "SELECT recipe, median, trial_id, total, n_segments FROM (SELECT *, row_number() OVER (PARTITION BY recipe ORDER BY abs(total - median), n_segments, trial_id) AS best FROM lengths JOIN medians USING (recipe)) WHERE best = 1",
        """,
lengths AS (SELECT recipe, trial_id, CAST(sum(duration) AS BIGINT) AS total, count(*) AS n_segments FROM segments GROUP BY ALL),
medians AS (SELECT recipe, list_sort(list(total))[count(*) // 2 + 1] AS median FROM lengths GROUP BY recipe)""",
    ),
    "lexical_start": sql(
        """SELECT 'recipe' AS family, recipe, NULL::INTEGER AS i, NULL::INTEGER AS j, round(ln((n + 1) / sum(n + 1) OVER ()), 6) AS value FROM lt
UNION ALL SELECT 'init', t.recipe, p.state, NULL, round(ln((coalesce(f.n, 0) + 5 * p.n / sum(p.n) OVER (PARTITION BY t.recipe)) / (t.n + 5)), 6) FROM lt t CROSS JOIN (SELECT state, sum(n) AS n FROM lf GROUP BY state) p LEFT JOIN lf f ON f.recipe = t.recipe AND f.state = p.state
UNION ALL SELECT 'trans', recipe, a, b, round(ln(n / sum(n) OVER (PARTITION BY recipe, a)), 6) FROM (SELECT t.recipe, p.a, p.b, coalesce(c.n, 0) + 5 * p.n / sum(p.n) OVER (PARTITION BY t.recipe, p.a) AS n
  FROM lt t CROSS JOIN (SELECT a, b, sum(n) AS n FROM lc GROUP BY ALL) p LEFT JOIN lc c ON c.recipe = t.recipe AND c.a = p.a AND c.b = p.b)
UNION ALL SELECT 'verb', NULL, state, token, round(ln((1 / count(*) OVER (PARTITION BY state) + CASE WHEN verb_id = token THEN 50 ELSE 0 END) / 51), 6) FROM lp CROSS JOIN (SELECT DISTINCT verb_id AS token FROM ticks)
UNION ALL SELECT 'noun', NULL, state, token, round(ln((1 / count(*) OVER (PARTITION BY state) + CASE WHEN noun_id = token THEN 50 ELSE 0 END) / 51), 6) FROM lp CROSS JOIN (SELECT DISTINCT noun_id AS token FROM ticks)
UNION ALL SELECT 'dur_r', NULL, state, NULL, round(r, 6) FROM lr
UNION ALL SELECT 'dur_p', NULL, state, NULL, round(greatest(least(r * n / (r * n + s + 1e-8), 1 - 1e-8), 1e-8), 6) FROM lr""",
        """,
lp AS (SELECT *, CAST(row_number() OVER (ORDER BY n DESC, verb_id, noun_id) - 1 AS INTEGER) AS state FROM (SELECT verb_id, noun_id, count(*) AS n FROM ticks GROUP BY ALL HAVING count(*) >= 5)),
lk AS (SELECT t.trial_id, t.recipe, t.tick, state AS k FROM ticks t LEFT JOIN lp ON lp.verb_id = t.verb_id AND lp.noun_id = t.noun_id),
la AS (SELECT *, coalesce(last_value(k IGNORE NULLS) OVER (PARTITION BY trial_id ORDER BY tick ROWS UNBOUNDED PRECEDING), first_value(k IGNORE NULLS) OVER (PARTITION BY trial_id ORDER BY tick ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS state FROM lk),
ln_ AS (SELECT *, sum(new) OVER (PARTITION BY trial_id ORDER BY tick ROWS UNBOUNDED PRECEDING) AS seg FROM (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY trial_id ORDER BY tick) = state THEN 0 ELSE 1 END AS new FROM la)),
ls AS (SELECT trial_id, recipe, seg, state, count(*) AS duration, lead(state) OVER (PARTITION BY trial_id ORDER BY seg) AS following FROM ln_ GROUP BY trial_id, recipe, seg, state),
lf AS (SELECT recipe, state, count(*) AS n FROM ls WHERE seg = 1 GROUP BY ALL),
lt AS (SELECT recipe, sum(n) AS n FROM lf GROUP BY recipe),
lc AS (SELECT recipe, state AS a, following AS b, count(*) AS n FROM ls WHERE following IS NOT NULL GROUP BY ALL),
lm AS (SELECT state, sum(n) AS n, sum(n * (d - 1)) AS s, sum(n * (d - 1) * (d - 1)) AS q FROM (SELECT state, least(duration, 50) AS d, count(*) AS n FROM ls GROUP BY ALL) GROUP BY state),
lr AS (SELECT *, CASE WHEN var > mean AND mean > 0 THEN least(mean * mean / (var - mean), 1e4) ELSE 5.0 END AS r FROM (SELECT *, s / n AS mean, q / n - (s / n) * (s / n) AS var FROM lm))""",
    ),
    "gt_steps": sql("SELECT trial_id, error_type, seg_idx, state, duration FROM truth", ALL_DEGRADED),
    "debris_steps": sql("SELECT * FROM debris", ALL_DEGRADED),
    "step_cover_tick": sql("SELECT p.trial_id, p.point AS \"at\", seg_idx FROM (SELECT trial_id, CAST(max(tick) - 5 AS INTEGER) AS point FROM ticks GROUP BY ALL) p LEFT JOIN segments s ON s.trial_id = p.trial_id AND p.point >= tick_start AND p.point < tick_end"),
    "project_flags": sql("SELECT trial_id, error_type, d.tick, src_tick FROM degraded d JOIN hflag h USING (trial_id) WHERE h.tick = src_tick", ALL_DEGRADED + flagged(0.3)),
    "attributable": sql("SELECT d.trial_id, d.error_type, d.tick FROM degraded d JOIN dflag f ON f.trial_id = d.trial_id AND f.error_type = d.error_type AND f.tick_start = d.tick WHERE NOT EXISTS (SELECT 1 FROM hflag h WHERE h.trial_id = d.trial_id AND h.tick = src_tick)", ALL_DEGRADED + flagged(0.3)),
    "tick_outcomes": sql("SELECT * FROM outcome", ALL_DEGRADED + flagged(0.3)),
    "tick_metrics": sql(
        """SELECT error_type, n, tp, fp_out, round(tp / n, 6) AS recall, round(coalesce(tp / nullif(tp + fp_out + healthy, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fp_out, 0), 0), 6) AS precision_excl_healthy, round(mean_latency, 6) AS mean_latency FROM (
  SELECT error_type, count(*) AS n, CAST(sum(detected) AS BIGINT) AS tp, CAST(sum(CASE WHEN detected = 0 AND stray = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp_out, avg(latency) AS mean_latency FROM outcome GROUP BY ALL), (SELECT count(DISTINCT trial_id) AS healthy FROM hflag)""",
        ALL_DEGRADED + flagged(0.3),
    ),
    "threshold_bundle": sql("SELECT channel, place, recipe, alpha, round(threshold, 6) + 0.0 AS threshold FROM bundle", CHANNEL_BASE + bundle([0.1, 0.2])),
    "flags_channels": sql(f"SELECT trial_id, tick, channel, round(value, 6) AS value, round(threshold, 6) AS threshold, {severity('value', 'threshold')} AS severity FROM hf", HEALTHY_FLAGS),
    "flags_wide": sql("SELECT trial_id, tick, " + ", ".join(f"bool_or(channel = '{c}') AS {c}" for c in ("s_dur_two", "s_emit", "s_noun", "s_recipe_transition", "s_temporal", "s_transition", "s_verb")) + " FROM hf GROUP BY ALL", HEALTHY_FLAGS),
    "narrated_flags": sql(NARRATED, HEALTHY_FLAGS + tail("thr", TRANSITION, "from_state", "0.3") + BRIDGES),
    "attribution_matrix": sql("SELECT f.error_type, channel, count(DISTINCT f.trial_id) AS trials FROM df f JOIN windows w ON w.trial_id = f.trial_id AND w.error_type = f.error_type WHERE tick BETWEEN t0 AND t1 + 5 GROUP BY ALL", both_flags([0.2])),
    "type_confusion": sql(
        """SELECT error_type, CASE WHEN rank = 2 AND stuck THEN 'repetition' ELSE ['omission', 'abandonment', 'repetition', 'substitution', 'substitution', 'omission'][rank] END AS predicted, count(*) AS steps FROM (
  SELECT f.trial_id, f.error_type, d.seg_idx, min(CASE channel WHEN 's_transition' THEN 1 WHEN 's_dur_two' THEN 2 WHEN 's_temporal' THEN 3 WHEN 's_noun' THEN 4 WHEN 's_verb' THEN 5 WHEN 's_recipe_transition' THEN 6 END) AS rank
  FROM df f JOIN dnumbered d ON d.trial_id = f.trial_id AND d.error_type = f.error_type AND d.tick = f.tick JOIN truth t ON t.trial_id = f.trial_id AND t.error_type = f.error_type AND t.seg_idx = d.seg_idx GROUP BY ALL) x
  LEFT JOIN (SELECT trial_id, error_type, seg_idx, p_ge < p_le AND NOT is_last AS stuck FROM dst s JOIN tails t ON t.state = s.state AND t.d = least(duration, 6)) USING (trial_id, error_type, seg_idx) GROUP BY ALL""",
        both_flags([0.2]),
    ),
    "level_counts": sql(
        f"""SELECT level, tp, fp, fn, tn, {RATES} FROM (
  SELECT 'tick' AS level, {CELLS} FROM judged
  UNION ALL SELECT 'step', {CELLS} FROM (SELECT key, seg_idx, bool_or(p) AS p, bool_or(f) AS f FROM judged GROUP BY ALL)
  UNION ALL SELECT 'trial', {CELLS} FROM (SELECT key, e AS p, bool_or(f) AS f FROM judged GROUP BY ALL)
  UNION ALL SELECT 'trial_loc', count(*) FILTER (e AND hit), count(*) FILTER (CASE WHEN e THEN stray ELSE any_ END), count(*) FILTER (e AND NOT hit), count(*) FILTER (NOT e AND NOT any_) FROM (SELECT key, e, bool_or(f) AS any_, bool_or(f AND p) AS hit, bool_or(f AND NOT p) AS stray FROM judged GROUP BY ALL))""",
        both_flags([0.2]) + JUDGED + ",\njudged AS (SELECT w.*, m.key IS NOT NULL AS f FROM world w LEFT JOIN (SELECT DISTINCT key, tick FROM marks) m ON m.key = w.key AND m.tick = w.tick)",
    ),
    "channel_sweep": sql(
        f"""SELECT channel, alpha, tp, fp, fn, tn, {RATES} FROM (SELECT channel, alpha, count(*) FILTER (e AND hit) AS tp, count(*) FILTER (CASE WHEN e THEN stray ELSE hit OR stray END) AS fp, count(*) FILTER (e AND NOT hit) AS fn, count(*) FILTER (NOT e AND NOT (hit OR stray)) AS tn FROM (
  SELECT g.key, g.e, g.channel, g.alpha, coalesce(bool_or(p), false) AS hit, coalesce(bool_or(NOT p), false) AS stray FROM (SELECT * FROM (SELECT DISTINCT key, e FROM world), (SELECT DISTINCT channel, alpha FROM bundle)) g
  LEFT JOIN (SELECT m.*, p FROM marks m JOIN world w ON w.key = m.key AND w.tick = m.tick) x ON x.key = g.key AND x.channel = g.channel AND x.alpha = g.alpha GROUP BY ALL) GROUP BY ALL)""",
        both_flags([0.05, 0.1, 0.2]) + JUDGED,
    ),
    "transition_ceiling": sql(
        """SELECT error_type, count(*) AS junctions, count(*) FILTER (r.recipe IS NOT NULL) AS seen_in_recipe, count(*) FILTER (r.recipe IS NULL AND g.from_state IS NOT NULL) AS seen_elsewhere, count(*) FILTER (g.from_state IS NULL) AS novel
FROM made m LEFT JOIN rc r ON r.recipe = m.recipe AND r.from_state = m.from_state AND r.to_state = m.state LEFT JOIN tc g ON g.from_state = m.from_state AND g.to_state = m.state GROUP BY error_type""",
        ALL_DEGRADED + """,
source AS (SELECT d.trial_id, d.error_type, d.tick, n.verb_id AS state, lag(n.verb_id) OVER (PARTITION BY d.trial_id, d.error_type ORDER BY d.tick) AS from_state FROM degraded d JOIN numbered n ON n.trial_id = d.trial_id AND n.tick = d.src_tick WHERE d.error_type IN ('omission', 'transposition')),
made AS (SELECT s.*, CAST(trial_id % 5 AS INTEGER) AS recipe FROM source s WHERE from_state <> state AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.trial_id = s.trial_id AND p.from_state = s.from_state AND p.to_state = s.state))""",
    ),
    "positive_ticks": sql("SELECT d.trial_id, d.error_type, count(*) AS positive_ticks, count(DISTINCT d.seg_idx) AS positive_steps FROM dnumbered d JOIN positive p ON p.trial_id = d.trial_id AND p.error_type = d.error_type AND p.seg_idx = d.seg_idx GROUP BY ALL", ALL_DEGRADED + POSITIVE),
    "trial_location": sql(
        """SELECT * FROM (SELECT CAST(count(*) FILTER (detected = 1) AS BIGINT) AS tp, count(*) FILTER (detected = 0 AND stray = 1) AS fp_out, count(*) FILTER (detected = 0) AS fn FROM outcome),
  (SELECT (SELECT count(DISTINCT trial_id) FROM hflag) AS fp_healthy, count(DISTINCT trial_id) - (SELECT count(DISTINCT trial_id) FROM hflag) AS tn FROM ticks)""",
        ALL_DEGRADED + flagged(0.3),
    ),
    "counterfactual": sql(
        """SELECT error_type, count(*) AS n, round(avg(CASE WHEN first IS NULL THEN 0 ELSE 1 END), 6) AS detection_rate, round(avg(CASE WHEN first BETWEEN t0 AND t1 + 5 THEN 1 ELSE 0 END), 6) AS localisation_rate, round(avg(CASE WHEN first BETWEEN t0 AND t1 + 5 THEN first - t0 END), 6) AS mean_latency
FROM windows w LEFT JOIN (SELECT d.trial_id, d.error_type, min(d.tick) AS first FROM degraded d JOIN dflag f ON f.trial_id = d.trial_id AND f.error_type = d.error_type AND f.tick_start = d.tick WHERE NOT EXISTS (SELECT 1 FROM hflag h WHERE h.trial_id = d.trial_id AND h.tick = src_tick) GROUP BY ALL) USING (trial_id, error_type) GROUP BY ALL""",
        ALL_DEGRADED + flagged(0.3),
    ),
    "mcnemar": sql(
        """SELECT error_type, gained, lost, round(coalesce((abs(gained - lost) - 1) * (abs(gained - lost) - 1) / nullif(gained + lost, 0), 0), 6) AS chi2, coalesce((abs(gained - lost) - 1) * (abs(gained - lost) - 1) / nullif(gained + lost, 0), 0) > 3.84 AS significant FROM (
  SELECT error_type, count(*) FILTER (b.detected = 1 AND a.detected = 0) AS gained, count(*) FILTER (b.detected = 0 AND a.detected = 1) AS lost FROM outcome_a a JOIN outcome_b b USING (trial_id, error_type) GROUP BY ALL)""",
        ALL_DEGRADED + flagged(0.2, "_a") + flagged(0.4, "_b"),
    ),
    "step_metrics": sql(
        """SELECT error_type, count(*) AS n, CAST(sum(detected) AS BIGINT) AS tp, CAST(sum(false_steps) AS BIGINT) AS false_steps, round(avg(detected), 6) AS recall FROM (
  SELECT g.trial_id, g.error_type, coalesce(max(CASE WHEN f.seg_idx BETWEEN g0 AND g1 + 1 THEN 1 ELSE 0 END), 0) AS detected,
    coalesce(sum(CASE WHEN f.seg_idx IS NOT NULL AND f.seg_idx NOT BETWEEN g0 AND g1 + 1 AND x.seg_idx IS NULL THEN 1 ELSE 0 END), 0) AS false_steps
  FROM (SELECT trial_id, error_type, min(seg_idx) AS g0, max(seg_idx) AS g1 FROM truth GROUP BY ALL) g LEFT JOIN dflag f ON f.trial_id = g.trial_id AND f.error_type = g.error_type
  LEFT JOIN debris x ON x.trial_id = f.trial_id AND x.error_type = f.error_type AND x.seg_idx = f.seg_idx GROUP BY ALL) GROUP BY ALL""",
        ALL_DEGRADED + flagged(0.3),
    ),
    "alpha_sweep": sql(f"SELECT {CURVE} FROM curve", SWEEP),
    "pr_auc": sql("SELECT round(sum((recall - r0) * (precision + p0) / 2), 6) AS pr_auc FROM (SELECT recall, precision, lag(recall) OVER (ORDER BY recall, precision) AS r0, lag(precision) OVER (ORDER BY recall, precision) AS p0 FROM curve)", SWEEP),
    "best_alpha": sql(f"SELECT {CURVE} FROM curve ORDER BY round(curve.f1, 9) DESC, alpha LIMIT 1", SWEEP),
    "alarm_runs": sql(
        "SELECT trial_id, CAST(sum(CASE WHEN f AND NOT coalesce(b, false) THEN 1 ELSE 0 END) AS BIGINT) AS alarms, CAST(sum(CASE WHEN f THEN 1 ELSE 0 END) AS BIGINT) AS flagged_ticks FROM (SELECT *, lag(f) OVER (PARTITION BY trial_id ORDER BY tick) AS b FROM hf) GROUP BY trial_id",
        tail("thr", TRANSITION, "from_state", "0.3") + """,
hflag AS (SELECT trial_id, tick_start AS tick FROM scored JOIN thr USING (from_state) WHERE round(s_transition, 9) > threshold),
hf AS (SELECT t.trial_id, t.tick, h.tick IS NOT NULL AS f FROM ticks t LEFT JOIN hflag h ON h.trial_id = t.trial_id AND h.tick = t.tick)""",
    ),
    "boundary_f1": sql(
        "SELECT CAST(count(*) FILTER (f AND t) AS BIGINT) AS hit, round(count(*) FILTER (f AND t) / count(*) FILTER (f), 6) AS precision, round(count(*) FILTER (f AND t) / count(*) FILTER (t), 6) AS recall, round(2 * count(*) FILTER (f AND t) / (count(*) FILTER (f) + count(*) FILTER (t)), 6) AS f1 FROM b",
        ",\nb AS (SELECT lag(verb_id) OVER w IS DISTINCT FROM verb_id AS f, lag(noun_id) OVER w IS DISTINCT FROM noun_id AS t FROM ticks WINDOW w AS (PARTITION BY trial_id ORDER BY tick))",
    ),
    "state_purity": sql("SELECT state, CAST(sum(n) AS BIGINT) AS ticks, round(max(n) / sum(n), 6) AS purity FROM (SELECT verb_id AS state, noun_id, count(*) AS n FROM ticks GROUP BY ALL) GROUP BY state"),
    "kl_families": sql(
        "SELECT from_state, round(sum(CASE WHEN a.l > -700 THEN exp(a.l) * (a.l - b.l) ELSE 0 END), 6) AS kl FROM h0 a JOIN h1 b USING (from_state, to_state) GROUP BY from_state",
        "".join(
            f""",
s{k} AS (SELECT DISTINCT state FROM segments WHERE trial_id % 2 = {k}), t{k} AS (SELECT from_state, to_state, count(*) AS n FROM pairs WHERE trial_id % 2 = {k} GROUP BY ALL),
m{k} AS (SELECT a.state AS from_state, b.state AS to_state, greatest(coalesce(n, 0) - 1.0::DOUBLE, 1e-12) AS mass FROM s{k} a CROSS JOIN s{k} b LEFT JOIN t{k} ON from_state = a.state AND to_state = b.state WHERE a.state <> b.state),
h{k} AS (SELECT from_state, to_state, ln(mass) - ln(greatest(sum(mass) OVER (PARTITION BY from_state), 1e-12)) AS l FROM m{k})"""
            for k in (0, 1)
        ),
    ),
    "bounded_bump": sql("SELECT * FROM dual", DUAL),
    "consolidate_all": sql("SELECT state, token, live AS frozen, live FROM dual", DUAL),
    "consolidate_selected": sql("SELECT state, token, CASE WHEN token < 3 THEN live ELSE frozen END AS frozen, CASE WHEN token < 3 THEN live ELSE frozen END AS live FROM dual", DUAL),
    "majority_vote": sql("SELECT trial_id, verb_id, n FROM modal", MODAL),
    "contingency": sql("SELECT verb_id AS a, recipe AS b, count(*) AS n FROM modal GROUP BY ALL", MODAL),
    "ari": sql(
        "SELECT round(coalesce((both_ - ia * ib / nullif(al, 0)) / nullif((ia + ib) / 2 - ia * ib / nullif(al, 0), 0), 1), 6) AS ari FROM (SELECT sum(n * (n - 1) / 2) AS both_, sum(n) * (sum(n) - 1) / 2 AS al FROM c), (SELECT sum(m * (m - 1) / 2) AS ia FROM (SELECT sum(n) AS m FROM c GROUP BY a)), (SELECT sum(m * (m - 1) / 2) AS ib FROM (SELECT sum(n) AS m FROM c GROUP BY b))",
        MODAL + ",\nc AS (SELECT verb_id AS a, recipe AS b, count(*) AS n FROM modal GROUP BY ALL)",
    ),
    "effective_k": sql("SELECT count(*) AS effective_k FROM (SELECT verb_id, count(*) AS n FROM modal GROUP BY ALL) WHERE n >= 0.02 * (SELECT count(*) FROM modal)", MODAL),
    "batch_reply_split": sql("SELECT trial_id, seg_idx, CASE WHEN seg_idx = 2 THEN NULL WHEN state % 2 = 0 THEN 'No Anomaly' ELSE 'Omission Anomaly' END AS reply FROM segments"),
    "prefix_prompt": sql("SELECT trial_id, seg_idx, string_agg((seg_idx + 1) || '. ' || text, chr(10)) OVER (PARTITION BY trial_id ORDER BY seg_idx ROWS UNBOUNDED PRECEDING) AS prompt FROM texts", TEXTS),
    "reply_grammar": sql(
        """SELECT doc_id, k IN (1, 2, 3, 4, 8, 9, 10, 11) AS is_anomaly,
  CASE WHEN k IN (1, 10, 11) THEN 'substitution' WHEN k IN (2, 8) THEN 'omission' WHEN k = 3 THEN 'repetition' WHEN k = 4 THEN 'abandonment' WHEN k = 9 THEN 'transposition' END AS error_type,
  CASE WHEN k IN (1, 10) THEN v.token WHEN k = 3 THEN c.token END AS verb,
  CASE WHEN k IN (1, 10) AND v.token IS NOT NULL THEN 'item3' WHEN k = 3 AND c.token IS NOT NULL THEN 'item2' END AS noun,
  CASE WHEN v.token IS NOT NULL AND k = 1 THEN 12 WHEN v.token IS NOT NULL AND k = 10 THEN 1 WHEN k = 3 AND c.token IS NOT NULL THEN 4 END AS seconds, k IN (0, 1, 2, 4, 8, 10) AS parse_ok
FROM (SELECT doc_id, doc_id % 12 AS k FROM documents) LEFT JOIN vocab v ON v.token = 'view' LEFT JOIN vocab c ON c.token = 'click'"""
    ),
    "canonical_recipe": sql(
        """SELECT recipe, states, n_trials, n_orders, durations FROM best JOIN (
  SELECT recipe, string_agg(d, '-' ORDER BY step) AS durations FROM (SELECT recipe, unnest(string_split(states, '-')) AS state, unnest(range(len(string_split(states, '-')))) AS step FROM best)
  JOIN (SELECT recipe, state::VARCHAR AS state, trunc(median(duration))::INTEGER::VARCHAR AS d FROM segments GROUP BY ALL) USING (recipe, state) GROUP BY recipe) USING (recipe)""",
        """,
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recipe ORDER BY n_trials DESC, states) AS rank, count(*) OVER (PARTITION BY recipe) AS n_orders FROM (
  SELECT recipe, states, count(*) AS n_trials FROM (SELECT trial_id, recipe, string_agg(state::VARCHAR, '-' ORDER BY seg_idx) AS states FROM segments GROUP BY ALL) GROUP BY ALL)) WHERE rank = 1)""",
    ),
    "edit_distance_pairs": sql("SELECT a.recipe, a.trial_id AS a, b.trial_id AS b, CAST(levenshtein(a.w, b.w) AS INTEGER) AS distance FROM w a JOIN w b ON a.recipe = b.recipe AND a.trial_id < b.trial_id", ",\nw AS (SELECT trial_id, recipe, string_agg(chr(CAST(state + 65 AS INTEGER)), '' ORDER BY seg_idx) AS w FROM segments GROUP BY ALL)"),
    "participant_features": sql("SELECT trial_id, recipe, total, round(idle, 6) AS idle_share, n_items, round(total / median(total) OVER (PARTITION BY recipe), 6) AS relative FROM (SELECT trial_id, recipe, count(*) AS total, avg(CASE WHEN verb_id = 0 THEN 1.0 ELSE 0 END) AS idle, count(DISTINCT noun_id) AS n_items FROM ticks GROUP BY ALL)"),
    "speed_consistency": sql(
        "SELECT round(corr(odd, even), 6) AS r, count(*) AS n FROM (SELECT trial_id, avg(CASE WHEN nth % 2 = 1 THEN value END) AS odd, avg(CASE WHEN nth % 2 = 0 THEN value END) AS even FROM (SELECT *, row_number() OVER (PARTITION BY trial_id ORDER BY block) AS nth FROM (SELECT trial_id, tick // 10 AS block, avg(noun_id) AS value FROM ticks GROUP BY ALL)) GROUP BY trial_id) WHERE even IS NOT NULL"
    ),
    "gaussian_ll": sql("SELECT state, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(-n * (ln(sd) + 0.5 * ln(2 * pi())) - n * v / (2 * sd * sd), 6) AS log_likelihood FROM (SELECT state, count(*) AS n, avg(duration::DOUBLE) AS mean, stddev_pop(duration::DOUBLE) + 1e-6 AS sd, var_pop(duration::DOUBLE) AS v FROM segments GROUP BY state)"),
    "bh_fdr": """SELECT id, round(p, 6) AS p, CAST(rank AS INTEGER) AS rank, rank <= coalesce(max(CASE WHEN p <= rank / m * 0.1 THEN rank END) OVER (), 0) AS rejected FROM (
  SELECT *, row_number() OVER (ORDER BY p, id) AS rank, count(*) OVER () AS m FROM (SELECT c_custkey AS id, (c_custkey * 7919) % 1009 / 1009.0::DOUBLE * CASE WHEN c_custkey % 5 = 0 THEN 0.01::DOUBLE ELSE 1.0 END AS p FROM customer))""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
