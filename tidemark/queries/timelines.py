"""Timeline queries: orders by customer (TA), events by user (TB), orders as two-sided games (TG)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import league
from tidemark.operators import timeline as tm

TA = tm.Timeline(("o_custkey",), "t_us", ("o_orderkey",), "is_event")
TB = tm.Timeline(("user_id",), "t_us", ("event_id",), "is_event")
TG = tm.Timeline(("team",), "t_us", ("gamecode",), "is_event")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def orders_timeline(spark, sf_dir) -> DataFrame:
    """value: the price in cents, so that sums are exact."""
    o = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("ts"), (F.col("o_orderstatus") != "F").alias("is_event"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents")
    )
    return TA.spread(o.withColumn("t_us", tm.micros("ts")).withColumn("season", F.year("ts")))


def events_timeline(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("is_event"), "event_type", F.round(F.col("value") * 100).cast("long").alias("v"))
    return TB.spread(e.withColumn("t_us", tm.micros("ts")))


def games(spark, sf_dir) -> DataFrame:
    """Orders as games between nations: the customer's at home."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    key = F.col("o_orderkey")
    o = o.join(c.select("c_custkey", "c_nationkey"), o.o_custkey == c.c_custkey)
    return o.select(
        key.alias("gamecode"),
        F.year("o_orderdate").alias("season"),
        F.col("o_orderdate").cast("date").alias("game_date"),
        F.when(key % 10 != 0, F.col("o_orderdate").cast("timestamp")).alias("tipoff"),
        F.col("c_nationkey").cast("int").alias("home_code"),
        ((F.col("c_nationkey") + 1 + key % 24) % 25).cast("int").alias("away_code"),
        (60 + key * 7 % 41).cast("int").alias("home_score"),
        (60 + key * 11 % 43).cast("int").alias("away_score"),
    )


GAMES_SQL = """
    games AS (SELECT o_orderkey AS gamecode, CAST(year(o_orderdate) AS INT) AS season, CAST(o_orderdate AS DATE) AS game_date,
        CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END AS tipoff, CAST(c_nationkey AS INT) AS home_code,
        CAST((c_nationkey + 1 + o_orderkey % 24) % 25 AS INT) AS away_code, CAST(60 + o_orderkey * 7 % 41 AS INT) AS home_score, CAST(60 + o_orderkey * 11 % 43 AS INT) AS away_score
        FROM orders JOIN customer ON o_custkey = c_custkey),
    sides AS (SELECT gamecode, season, game_date, coalesce(tipoff, CAST(game_date AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 SECOND) AS ts, home_code AS team, away_code AS opp, true AS home, home_score AS own_score, away_score AS opp_score FROM games
        UNION ALL SELECT gamecode, season, game_date, coalesce(tipoff, CAST(game_date AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 SECOND), away_code, home_code, false, away_score, home_score FROM games)"""


def sides(spark, sf_dir, spread: bool = True) -> DataFrame:
    g = games(spark, sf_dir).withColumn("ts", tm.effective_time("tipoff", "game_date"))
    rows = league.two_sided(g.withColumn("t_us", tm.micros("ts")), ("gamecode", "season", "game_date", "ts", "t_us"))
    rows = rows.withColumn("is_event", F.col("own_score") + F.col("opp_score") > 150)
    return TG.spread(rows) if spread else rows


_TA = """WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate AS ts, o_orderstatus <> 'F' AS is_event, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CAST(year(o_orderdate) AS INT) AS season FROM orders),
"""
_TB = """WITH e AS (SELECT event_id, user_id, ts, event_type <> 'error' AS is_event, event_type, CAST(round(value * 100) AS BIGINT) AS v FROM events),
"""


def _asof(base: str, key: str, tie: str, stats: str, out: str, where: str = "is_event", windows: str = "", more: str = "") -> str:
    """base rows with the stats of the last event of strictly earlier time."""
    return f"""{more}post AS (SELECT *, {stats} FROM {base} WHERE {where} {windows}),
        final AS (SELECT * FROM post QUALIFY row_number() OVER (PARTITION BY {key}, ts ORDER BY {tie} DESC) = 1)
        SELECT {out} FROM {base} b ASOF LEFT JOIN final p ON b.{key} = p.{key} AND b.ts > p.ts"""


def _last(k: int, key: str, tie: str) -> str:
    return f"(PARTITION BY {key} ORDER BY ts, {tie} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def asof_strict_prior(spark, sf_dir):
    df = tm.gather_prior(orders_timeline(spark, sf_dir), TA, F.struct("cents", "o_orderkey"))
    return df.select("o_orderkey", "o_custkey", F.col("prior.cents").alias("prior_cents"), F.col("prior.o_orderkey").alias("prior_order"))


def rolling_means(spark, sf_dir):
    df = orders_timeline(spark, sf_dir)
    post = F.struct(*[(F.sum("cents").over(TA.last(n)) / F.count("cents").over(TA.last(n))).alias(f"mean_{n}") for n in (3, 5, 10, 20)], F.col("cents").alias("last_cents"))
    df = tm.gather_prior(df.withColumn("post", post), TA, F.col("post"))
    return df.select("o_orderkey", "o_custkey", *[F.col(f"prior.{c}").alias(c) for c in ("mean_3", "mean_5", "mean_10", "mean_20", "last_cents")])


def rolling_std(spark, sf_dir):
    df = events_timeline(spark, sf_dir).withColumn("post", F.stddev_samp("v").over(TB.last(5)))
    df = tm.gather_prior(df, TB, F.struct("post"))
    return df.select("event_id", F.round("prior.post", 4).alias("std_5"))


def rolling_slope(spark, sf_dir):
    df = events_timeline(spark, sf_dir).withColumn("number", F.row_number().over(TB.events()))
    df = df.withColumn("post", tm.rolling_slope("v", "number", TB, 5))
    df = tm.gather_prior(df, TB, F.struct("post"))
    return df.select("event_id", F.round("prior.post", 4).alias("slope_5"))


def ewm_12(spark, sf_dir):
    df = events_timeline(spark, sf_dir)
    df = df.withColumn("post", tm.weighted_mean("v", TB))
    df = tm.gather_prior(df, TB, F.struct("post"))
    return df.select("event_id", F.round("prior.post", 4).alias("ewm"))


def ratio_with_floor(spark, sf_dir):
    df = orders_timeline(spark, sf_dir).withColumn("weight", F.col("o_orderkey") % 7)
    df = df.withColumn("post", tm.ratio_of_sums("cents", "weight", TA, 5, 10))
    df = tm.gather_prior(df, TA, F.struct("post"))
    return df.select("o_orderkey", F.col("prior.post").alias("ratio_5"))


def season_to_date(spark, sf_dir):
    df = tm.run_ids(orders_timeline(spark, sf_dir), TA, "season")
    w = TA.to_date("run")
    post = F.struct("season", (F.sum("cents").over(w) / F.count("cents").over(w)).alias("mean"), F.count("cents").over(w).alias("n"), F.row_number().over(TA.events()).alias("total"))
    df = tm.gather_prior(df.withColumn("post", post), TA, F.col("post"))
    same = F.col("prior.season") == F.col("season")
    return df.select(
        "o_orderkey",
        F.when(same, F.col("prior.mean")).alias("season_mean"),
        F.coalesce(F.when(same, F.col("prior.n")), F.lit(0)).cast("long").alias("n_season"),
        F.coalesce(F.col("prior.total"), F.lit(0)).cast("long").alias("n_total"),
        F.col("run").cast("long").alias("run"),
    )


def days_since_capped(spark, sf_dir):
    df = tm.gather_prior(orders_timeline(spark, sf_dir), TA, F.struct(F.unix_date(F.col("ts").cast("date")).alias("day")))
    return df.select("o_orderkey", tm.capped_days_since("ts", F.col("prior.day"), 365).cast("long").alias("days_since"))


def miss_streak(spark, sf_dir):
    return tm.miss_streak(events_timeline(spark, sf_dir), TB).select("event_id", F.col("streak").cast("long").alias("streak"))


def event_rate_5(spark, sf_dir):
    df = events_timeline(spark, sf_dir)
    w = TB.last(5)
    df = df.withColumn("post", F.sum((F.col("event_type") == "click").cast("int")).over(w) / F.count("*").over(w))
    return tm.gather_prior(df, TB, F.struct("post")).select("event_id", F.col("prior.post").alias("rate_5"))


def effective_time(spark, sf_dir):
    return games(spark, sf_dir).select("gamecode", tm.micros(tm.effective_time("tipoff", "game_date")).alias("t_us"))


def two_sided_unpivot(spark, sf_dir):
    return league.two_sided(games(spark, sf_dir), ("gamecode",))


def rest_and_load(spark, sf_dir):
    df = league.rest_and_load(sides(spark, sf_dir), ("team",), ("t_us", "gamecode"), "game_date", "season")
    return df.select("team", "gamecode", *[F.col(c).cast("long").alias(c) for c in ("rest_days", "short_rest", "games_last7", "games_season")])


def team_strength(spark, sf_dir):
    """Win share and point margin of scored games: the last five, across seasons, and the season's so far."""
    df = sides(spark, sf_dir).withColumn("win", (F.col("own_score") > F.col("opp_score")).cast("long")).withColumn("margin", (F.col("own_score") - F.col("opp_score")).cast("long"))
    last, season = TG.last(5), TG.to_date("season")
    mean = lambda c, w: F.sum(c).over(w) / F.count(c).over(w)
    post = F.struct("season", mean("win", last).alias("win_pct_5"), mean("margin", last).alias("pd_5"), mean("win", season).alias("win_pct_season"), mean("margin", season).alias("pd_season"))
    df = tm.gather_prior(df.withColumn("post", post), TG, F.col("post"))
    same = F.col("prior.season") == F.col("season")
    return df.select("team", "gamecode", F.col("prior.win_pct_5").alias("win_pct_5"), F.col("prior.pd_5").alias("pd_5"), *[F.when(same, F.col(f"prior.{c}")).alias(c) for c in ("win_pct_season", "pd_season")])


def opponent_allowed_vs_league(spark, sf_dir):
    df = league.league_mean_before(sides(spark, sf_dir, spread=False), "season", "t_us", "opp_score", "is_event")
    df = TG.spread(df).withColumn("allowed", F.sum("opp_score").over(TG.last(5)) / F.count("opp_score").over(TG.last(5)))
    df = tm.gather_prior(df, TG, F.struct("allowed"))
    return df.select("team", "gamecode", "league_mean", F.when(F.col("league_mean") > 0, F.try_divide(F.col("prior.allowed"), F.col("league_mean"))).alias("allowed_vs_league"))


def missed_last_10(spark, sf_dir):
    """Of the customer's ten orders before this one, how many were no events, from the first on; unknown ones do not count."""
    df = orders_timeline(spark, sf_dir)
    df = df.withColumn("no", F.row_number().over(TA.rows())).withColumn("unknown", (F.col("o_orderkey") % 5 == 0).cast("int"))
    w = Window.partitionBy("o_custkey").orderBy("no").rangeBetween(-10, -1)
    first = F.min("no").over(Window.partitionBy("o_custkey"))
    so_far = TA.rows().rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("start", F.greatest(F.col("no") - 10, first)).withColumn("unknown_before", F.coalesce(F.sum("unknown").over(so_far), F.lit(0)))
    missed = F.coalesce(F.sum(((~F.col("is_event")) & (F.col("unknown") == 0)).cast("int")).over(w), F.lit(0))
    return df.select("o_orderkey", missed.cast("long").alias("missed_10"), F.col("start").cast("long").alias("start_no"), F.col("unknown_before").cast("long").alias("unknown_before"))


QUERIES = {f.__name__: f for f in (asof_strict_prior, rolling_means, rolling_std, rolling_slope, ewm_12, ratio_with_floor, season_to_date, days_since_capped, miss_streak, event_rate_5, effective_time, two_sided_unpivot, rest_and_load, team_strength, opponent_allowed_vs_league, missed_last_10)}

_mean = lambda c, k, key, tie: f"CAST(sum({c}) OVER {_last(k, key, tie)} AS DOUBLE) / count({c}) OVER {_last(k, key, tie)}"
_ewm_top = " + ".join(f"coalesce(lag(v, {j}) OVER w * {0.5 ** (j / 3)!r}::DOUBLE, 0.0::DOUBLE)" if j else "v * 1.0::DOUBLE" for j in range(12))
_ewm_low = " + ".join(f"CASE WHEN lag(v, {j}) OVER w IS NOT NULL THEN {0.5 ** (j / 3)!r}::DOUBLE ELSE 0.0::DOUBLE END" if j else "1.0::DOUBLE" for j in range(12))

SQL = {
    "asof_strict_prior": _TA + _asof("o", "o_custkey", "o_orderkey", "1 AS one", "b.o_orderkey, b.o_custkey, p.cents AS prior_cents, p.o_orderkey AS prior_order"),
    "rolling_means": _TA + _asof("o", "o_custkey", "o_orderkey", ", ".join(f"{_mean('cents', n, 'o_custkey', 'o_orderkey')} AS mean_{n}" for n in (3, 5, 10, 20)), "b.o_orderkey, b.o_custkey, mean_3, mean_5, mean_10, mean_20, p.cents AS last_cents"),
    "rolling_std": _TB + _asof("e", "user_id", "event_id", f"stddev_samp(v) OVER {_last(5, 'user_id', 'event_id')} AS s", "b.event_id, round(s, 4) AS std_5"),
    "rolling_slope": _TB.replace("AS v FROM events)", "AS v FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, is_event ORDER BY ts, event_id) AS number FROM e)")
    + _asof("n", "user_id", "event_id", f"CASE WHEN count(v) OVER {_last(5, 'user_id', 'event_id')} >= 3 THEN regr_slope(v, number) OVER {_last(5, 'user_id', 'event_id')} END AS s", "b.event_id, round(s, 4) AS slope_5"),
    "ewm_12": _TB + _asof("e", "user_id", "event_id", f"({_ewm_top}) / ({_ewm_low}) AS s", "b.event_id, round(s, 4) AS ewm", windows="WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"),
    "ratio_with_floor": _TA + _asof("o", "o_custkey", "o_orderkey", f"CASE WHEN sum(o_orderkey % 7) OVER {_last(5, 'o_custkey', 'o_orderkey')} >= 10 THEN CAST(sum(cents) OVER {_last(5, 'o_custkey', 'o_orderkey')} AS DOUBLE) / CAST(sum(o_orderkey % 7) OVER {_last(5, 'o_custkey', 'o_orderkey')} AS DOUBLE) END AS r", "b.o_orderkey, r AS ratio_5"),
    "season_to_date": _TA.replace("FROM orders)", "FROM orders), r AS (SELECT *, CAST(sum(moved) OVER (PARTITION BY o_custkey ORDER BY ts, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM (SELECT *, CASE WHEN season IS DISTINCT FROM lag(season) OVER (PARTITION BY o_custkey ORDER BY ts, o_orderkey) THEN 1 ELSE 0 END AS moved FROM o))")
    + _asof("r", "o_custkey", "o_orderkey", "CAST(sum(cents) OVER w AS DOUBLE) / count(cents) OVER w AS mean, count(cents) OVER w AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY ts, o_orderkey) AS total", "b.o_orderkey, CASE WHEN p.season = b.season THEN mean END AS season_mean, coalesce(CASE WHEN p.season = b.season THEN n END, 0) AS n_season, coalesce(total, 0) AS n_total, b.run", windows="WINDOW w AS (PARTITION BY o_custkey, run ORDER BY ts, o_orderkey ROWS UNBOUNDED PRECEDING)"),
    "days_since_capped": _TA + _asof("o", "o_custkey", "o_orderkey", "1 AS one", "b.o_orderkey, CASE WHEN p.ts IS NOT NULL THEN CAST(least(date_diff('day', CAST(p.ts AS DATE), CAST(b.ts AS DATE)), 365) AS BIGINT) END AS days_since"),
    "miss_streak": _TB.rstrip().rstrip(",") + """, i AS (SELECT *, sum(CAST(is_event AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM e),
        m AS (SELECT *, sum(CASE WHEN is_event THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS misses FROM i),
        """ + _asof("m", "user_id", "event_id", "1 AS one", "b.event_id, CAST(coalesce(p.misses, 0) AS BIGINT) AS streak", where="true"),
    "event_rate_5": _TB + _asof("e", "user_id", "event_id", f"CAST(sum(CAST(event_type = 'click' AS INT)) OVER {_last(5, 'user_id', 'event_id')} AS DOUBLE) / count(*) OVER {_last(5, 'user_id', 'event_id')} AS r", "b.event_id, r AS rate_5"),
    "effective_time": f"WITH {GAMES_SQL} SELECT gamecode, epoch_us(coalesce(tipoff, CAST(game_date AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 SECOND)) AS t_us FROM games",
    "two_sided_unpivot": f"WITH {GAMES_SQL} SELECT gamecode, team, opp, home, own_score, opp_score FROM sides",
    "rest_and_load": f"""WITH {GAMES_SQL}, d AS (SELECT team, gamecode, season, ts, date_diff('day', DATE '1970-01-01', game_date) AS day FROM sides)
        SELECT team, gamecode, CASE WHEN lag(day) OVER w IS NOT NULL THEN CAST(least(day - lag(day) OVER w, 14) AS BIGINT) END AS rest_days, CASE WHEN lag(day) OVER w IS NOT NULL THEN CAST(day - lag(day) OVER w <= 2 AS BIGINT) END AS short_rest,
        CAST({' + '.join(f'CASE WHEN day - lag(day, {j}) OVER w < 7 THEN 1 ELSE 0 END' for j in range(1, 8))} AS BIGINT) AS games_last7, row_number() OVER (PARTITION BY team, season ORDER BY ts, gamecode) - 1 AS games_season
        FROM d WINDOW w AS (PARTITION BY team ORDER BY ts, gamecode)""",
    "team_strength": f"WITH {GAMES_SQL}, s AS (SELECT *, own_score + opp_score > 150 AS is_event, CAST(own_score > opp_score AS BIGINT) AS win, CAST(own_score - opp_score AS BIGINT) AS margin FROM sides), "
    + _asof("s", "team", "gamecode", ", ".join(f"CAST(sum({c}) OVER {w} AS DOUBLE) / count({c}) OVER {w} AS {c}_{w}" for c in ("win", "margin") for w in ("last5", "season_w")), "b.team, b.gamecode, win_last5 AS win_pct_5, margin_last5 AS pd_5, CASE WHEN p.season = b.season THEN win_season_w END AS win_pct_season, CASE WHEN p.season = b.season THEN margin_season_w END AS pd_season", windows="WINDOW last5 AS (PARTITION BY team ORDER BY ts, gamecode ROWS 4 PRECEDING), season_w AS (PARTITION BY team, season ORDER BY ts, gamecode ROWS UNBOUNDED PRECEDING)"),
    "opponent_allowed_vs_league": f"""WITH {GAMES_SQL}, s AS (SELECT *, own_score + opp_score > 150 AS is_event FROM sides),
        full_ AS (SELECT season, CAST(sum(opp_score) AS DOUBLE) / count(*) AS m FROM s WHERE is_event GROUP BY season),
        l AS (SELECT team, gamecode, season, sum(CASE WHEN is_event THEN opp_score END) OVER w AS ps, count(CASE WHEN is_event THEN opp_score END) OVER w AS pn FROM s WINDOW w AS (PARTITION BY season ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)),
        lm AS (SELECT team, gamecode, CASE WHEN pn >= 20 THEN CAST(ps AS DOUBLE) / pn ELSE coalesce((SELECT max_by(f.m, f.season) FROM full_ f WHERE f.season < l.season), CASE WHEN pn > 0 THEN CAST(ps AS DOUBLE) / pn END) END AS league_mean FROM l),
        a AS ({{asof}}) SELECT a.team, a.gamecode, league_mean, CASE WHEN league_mean > 0 THEN allowed / league_mean END AS allowed_vs_league FROM a JOIN lm USING (team, gamecode)""".replace(
        "{asof}", "WITH " + _asof("s", "team", "gamecode", f"{_mean('opp_score', 5, 'team', 'gamecode')} AS allowed", "b.team, b.gamecode, allowed")
    ),
    "missed_last_10": _TA.rstrip().rstrip(",") + """, n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY ts, o_orderkey) AS no, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS unknown FROM o)
        SELECT o_orderkey, CAST(coalesce(sum(CASE WHEN NOT is_event AND unknown = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY no RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS missed_10,
        greatest(no - 10, min(no) OVER (PARTITION BY o_custkey)) AS start_no, CAST(coalesce(sum(unknown) OVER (PARTITION BY o_custkey ORDER BY ts, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS unknown_before FROM n""",
}
