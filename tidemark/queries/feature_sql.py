"""SQL of the 42 features over the star schema's lines, orders and customers."""

from __future__ import annotations

from tidemark.plans.features import FEATURES
from tidemark.queries.timelines import GAMES_SQL, _asof, _last

#: Of each supplier in an order: lines as counters. The defects (by part number) are what the checks must find.
LINES = """
    lines AS (SELECT l_orderkey AS gamecode, l_suppkey, min(l_linenumber) AS ln, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, min(l_partkey) AS part, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS away_flag FROM lineitem GROUP BY l_orderkey, l_suppkey),
    hist AS (SELECT s.season, l.gamecode, 'S' || l.l_suppkey AS player_id, l.ln, s.team, s.opp, s.home, s.ts, s.game_date, l.away_flag = 1 AS dnp, CAST(CASE WHEN l.away_flag = 1 THEN 0 ELSE l.q END AS DOUBLE) AS minutes, CASE WHEN l.away_flag = 1 THEN 0 ELSE (l.q * 7 + l.l_suppkey) % 31 - 5 END AS pir, s.own_score > s.opp_score AS won
        FROM lines l JOIN sides s ON l.gamecode = s.gamecode AND s.home = (l.ln % 2 = 1))"""

#: Means are exact here but for the last bits of their sums; the shift keeps ties from falling both ways.
ROUNDED = "round({} + 1e-9, 6)"

_P, _T = ("player_id", "gamecode"), ("team", "gamecode")
_W = {n: _last(n, *_P) for n in (3, 5, 10, 20)}
_SO_FAR = "(PARTITION BY player_id, season ORDER BY ts, gamecode ROWS UNBOUNDED PRECEDING)"
_BEFORE = "RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING"


def _ewm(c: str) -> str:
    lag = lambda j: f"lag({c}, {j}) OVER (PARTITION BY player_id ORDER BY ts, gamecode)"
    top = " + ".join(f"coalesce({lag(j)} * {0.5 ** (j / 3)!r}::DOUBLE, 0.0::DOUBLE)" for j in range(12))
    return f"({top}) / ({' + '.join(f'CASE WHEN {lag(j)} IS NOT NULL THEN {0.5 ** (j / 3)!r}::DOUBLE ELSE 0.0::DOUBLE END' for j in range(12))})"


_POST = {
    **{f"{k}_mean_{n}": f"avg({c}) OVER {_W[n]}" for k, c in (("fantasy", "fantasy"), ("pir", "pir")) for n in (3, 5, 10, 20)},
    "fantasy_season_mean": f"avg(fantasy) OVER {_SO_FAR}", "pir_season_mean": f"avg(pir) OVER {_SO_FAR}", "min_season_mean": f"avg(minutes) OVER {_SO_FAR}",
    "fantasy_ewm": _ewm("fantasy"), "pir_ewm": _ewm("pir"), "pir_std_5": f"CASE WHEN count(*) OVER {_W[5]} > 1 THEN stddev_samp(pir) OVER {_W[5]} END",
    "pir_per_min_5": f"CASE WHEN sum(minutes) OVER {_W[5]} >= 10 THEN CAST(sum(pir) OVER {_W[5]} AS DOUBLE) / sum(minutes) OVER {_W[5]} END",
    "min_mean_3": f"avg(minutes) OVER {_W[3]}", "min_mean_5": f"avg(minutes) OVER {_W[5]}", "min_last": "minutes", "min_trend_5": f"CASE WHEN count(*) OVER {_W[5]} >= 3 THEN regr_slope(minutes, event_no) OVER {_W[5]} END",
    "starter_rate_5": f"avg(CAST(ln <= 2 AS INT)) OVER {_W[5]}", "n_season": f"count(*) OVER {_SO_FAR}", "n_total": "event_no", "misses_then": "misses", "season_then": "season", "day_then": "game_date",
}
_SEASON = ("fantasy_season_mean", "pir_season_mean", "min_season_mean")
_PLAIN = [c for c in _POST if c not in (*_SEASON, "n_season", "n_total", "misses_then", "season_then", "day_then")]

_PLAYERS = f"""h AS (SELECT *, NOT dnp AND minutes > 0 AS is_event, CASE WHEN won THEN CAST(pir * 10 + abs(pir) AS DOUBLE) / 10 ELSE CAST(pir AS DOUBLE) END AS fantasy FROM hist),
    m AS (SELECT *, sum(CAST(NOT is_event AS INT)) OVER (PARTITION BY player_id ORDER BY ts, gamecode ROWS UNBOUNDED PRECEDING) AS misses, coalesce(sum(CAST(NOT is_event AS INT)) OVER (PARTITION BY player_id ORDER BY ts {_BEFORE}), 0) AS missed_before, row_number() OVER (PARTITION BY player_id, is_event ORDER BY ts, gamecode) AS event_no FROM h),
    pf AS (WITH {_asof('m', *_P, ', '.join(f'{v} AS p_{k}' for k, v in _POST.items()), 'b.*, COLUMNS(' + "'p_.*'" + ')')}),
    players AS (SELECT season, gamecode, player_id, team, opp, game_date, is_event, fantasy, pir, CAST(home AS DOUBLE) AS home, {', '.join(f'p_{c} AS {c}' for c in _PLAIN)}, {', '.join(f'CASE WHEN p_season_then = season THEN p_{c} END AS {c}' for c in _SEASON)},
        coalesce(CASE WHEN p_season_then = season THEN p_n_season END, 0) AS games_played_season, coalesce(p_n_total, 0) AS games_played_total, missed_before - coalesce(p_misses_then, 0) AS dnp_streak, CASE WHEN p_day_then IS NOT NULL THEN least(date_diff('day', p_day_then, game_date), 365) END AS days_since_last_appearance FROM pf)"""

_W5 = "(PARTITION BY team ORDER BY ts, gamecode ROWS 4 PRECEDING)"
_TEAM_SEASON = "(PARTITION BY team, season ORDER BY ts, gamecode ROWS UNBOUNDED PRECEDING)"
_STRENGTH = ", ".join(f"avg({v}) OVER {w} AS {c}_{n}" for c, v in (("win_pct", "CAST(own_score > opp_score AS INT)"), ("pd", "own_score - opp_score")) for n, w in (("5", _W5), ("season", _TEAM_SEASON)))
_TEAMS = f"""box AS (SELECT gamecode, team, sum(pir) AS rating, abs(sum(minutes) - (200 + 25 * greatest(round_even((sum(minutes) - 200) / 25, 0), 0))) <= 1.5 AS whole FROM hist GROUP BY 1, 2),
    sd AS (SELECT s.*, date_diff('day', DATE '1970-01-01', s.game_date) AS day, CASE WHEN o.whole THEN o.rating END AS allowed, CAST(b.team IS NULL AS INT) AS boxless FROM sides s LEFT JOIN box o ON o.gamecode = s.gamecode AND o.team = s.opp LEFT JOIN box b ON b.gamecode = s.gamecode AND b.team = s.team),
    sl AS (SELECT *, lag(day) OVER w AS day_before, {' + '.join(f'CASE WHEN day - lag(day, {j}) OVER w < 7 THEN 1 ELSE 0 END' for j in range(1, 8))} AS games_last7, row_number() OVER (PARTITION BY team, season ORDER BY ts, gamecode) - 1 AS games_season, row_number() OVER w AS game_no, sum(boxless) OVER w - boxless AS unknown_before,
        sum(allowed) OVER s AS ps, count(allowed) OVER s AS pn FROM sd WINDOW w AS (PARTITION BY team ORDER BY ts, gamecode), s AS (PARTITION BY season ORDER BY ts {_BEFORE})),
    full_ AS (SELECT season, CAST(sum(allowed) AS DOUBLE) / count(allowed) AS mean FROM sd GROUP BY season HAVING count(allowed) > 0),
    upto AS (SELECT x.season, (SELECT max_by(f.mean, f.season) FROM full_ f WHERE f.season < x.season) AS earlier FROM (SELECT DISTINCT season FROM sd) x),
    lm AS (SELECT sl.*, CASE WHEN pn >= 20 THEN CAST(ps AS DOUBLE) / pn ELSE coalesce(earlier, CASE WHEN pn > 0 THEN CAST(ps AS DOUBLE) / pn END) END AS league_mean FROM sl JOIN upto USING (season)),
    st AS (WITH {_asof('lm', *_T, f'{_STRENGTH}, season AS season_then', 'b.*, p.win_pct_5, p.pd_5, CASE WHEN p.season_then = b.season THEN p.win_pct_season END AS win_pct_season, CASE WHEN p.season_then = b.season THEN p.pd_season END AS pd_season', where='true')}),
    tf AS (WITH {_asof('st', *_T, f"avg(allowed) OVER {_W5} AS a5, avg(allowed) OVER {_W5.replace('4 P', '9 P')} AS a10", 'b.*, CASE WHEN b.league_mean > 0 THEN p.a5 / b.league_mean END AS def_pir_5, CASE WHEN b.league_mean > 0 THEN p.a10 / b.league_mean END AS def_pir_10', where='allowed IS NOT NULL')}),
    teams AS (SELECT *, CASE WHEN day_before IS NOT NULL THEN least(day - day_before, 14) END AS rest_days, CASE WHEN day_before IS NOT NULL THEN CAST(day - day_before <= 2 AS INT) END AS short_rest FROM tf)"""

_MISSED = """spans AS (SELECT p.gamecode, p.player_id, p.team, t.game_no, t.unknown_before, greatest(t.game_no - 10, min(t.game_no) OVER (PARTITION BY p.player_id, p.team)) AS start,
        coalesce(sum(CAST(is_event AS INT)) OVER (PARTITION BY p.player_id, p.team ORDER BY t.game_no RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS played FROM players p JOIN teams t ON t.gamecode = p.gamecode AND t.team = p.team),
    missed AS (SELECT s.gamecode, s.player_id, s.game_no - start - (s.unknown_before - t.unknown_before) - played AS missed_last10 FROM spans s JOIN teams t ON t.team = s.team AND t.game_no = s.start)"""

_OWN = {f"team_{c}": f"a.{c}" for c in ("rest_days", "short_rest", "games_last7", "games_season", "win_pct_5", "pd_5", "win_pct_season", "pd_season")}
_OPP = {f"opp_{c}": f"o.{c}" for c in ("rest_days", "games_last7", "win_pct_5", "pd_5", "win_pct_season", "pd_season", "def_pir_5", "def_pir_10")}


def _column(name: str) -> str:
    source = (_OWN | _OPP).get(name, "missed_last10" if name == "missed_last10" else f"p.{name}")
    return f"{ROUNDED.format(f'CAST({source} AS DOUBLE)')} AS {name}"


FEATURES_SQL = f"""WITH {GAMES_SQL}, {LINES}, {_PLAYERS}, {_TEAMS}, {_MISSED}
    SELECT p.player_id, CAST(p.season AS BIGINT) AS season, p.gamecode, CAST(p.team AS VARCHAR) AS team_code, CAST(p.opp AS VARCHAR) AS opp_code, CAST(p.game_date AS VARCHAR) AS game_date, is_event AS is_appearance, CASE WHEN is_event THEN fantasy END AS fantasy_score, CASE WHEN is_event THEN CAST(p.pir AS BIGINT) END AS pir,
    {', '.join(map(_column, FEATURES))}
    FROM players p JOIN teams a ON a.gamecode = p.gamecode AND a.team = p.team JOIN teams o ON o.gamecode = p.gamecode AND o.team = p.opp JOIN missed x ON x.gamecode = p.gamecode AND x.player_id = p.player_id"""
