"""Ingest, quality, store, model, evaluation, serving and streaming, on small hand-made and synthetic data."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import synthetic
from tidemark import schemas
from tidemark.functions import parsing, scoring
from tidemark.operators import quality
from tidemark.operators import relational as rel
from tidemark.plans import clean, evaluate, model, serve
from tidemark.plans import features as ft
from tidemark.sources import raw_cache, store
from tidemark.streaming import ingest

BOX = "Season int, Gamecode int, Home int, Player_ID string, IsStarter double, Team string, Player string, Minutes string, " + ", ".join(f"{c} int" for c in clean.RAW_COUNTERS) + ", Valuation int, Plusminus double"


def box_line(player, team, home, minutes="20:00", code=1, two=3, three=1, free=2, name=None, bad=0):
    points = 2 * two + 3 * three + free + bad
    pir = points + 5 + 2 + 1 + 0 + 3 - 2 - 1 - 1 - 1 - 0 - 2
    return (2023, code, home, f"{player}  ", 1.0, team, name or f"NAME {player}", minutes, points, two, two + 2, three, three + 1, free, free + 1, 2, 3, 5, 2, 1, 1, 0, 0, 2, 3, pir, 1.0)


@pytest.fixture(scope="module")
def raw(spark):
    lines = []
    for team, home in (("AAA", 1), ("BBB", 0)):
        lines += [box_line(f"P{team}{k}", team, home, "20:00", two=3 + home) for k in range(10)]
        total = [sum(x[i] for x in lines if x[5] == team) for i in range(8, 26)]
        lines.append((2023, 1, home, "Total", 0.0, team, "Total", "200:00", *total, None))
    box = spark.createDataFrame(lines, BOX)
    results = spark.createDataFrame([(2023, "RS", 1, "Oct 05, 2023", "20:45", 1, "AAA", "Alpha", "BBB", "Beta", 130, 110), (2023, "RS", 1, "Oct 06, 2023", "20:00", 2, "BBB", "Beta", "AAA", "Alpha", 0, 0)], "season int, Phase string, Round int, date string, time string, gameCode int, homecode string, hometeam string, awaycode string, awayteam string, homescore int, awayscore int")
    schedule = spark.createDataFrame([("2023", 1, "RS", "1", "October 5, 2023", "20:45", "AAA", "Alpha BC", "BBB", "Beta", " True "), ("2023", 2, "RS", "3", "Dec 20, 2023", "bad", "BBB", "Beta", "AAA", "Alpha BC", "false")], "season string, gameday int, round string, game string, date string, startime string, homecode string, hometeam string, awaycode string, awayteam string, played string")
    return box, results, schedule


def test_clean_tables(raw):
    c = clean.clean(*raw)
    games = {r.gamecode: r for r in c.games.collect()}
    assert games.keys() == {1, 2, 3} and games[1].played and not games[2].played and not games[3].played
    assert games[1].tipoff_utc == dt.datetime(2023, 10, 5, 18, 45) and games[3].tipoff_utc is None and games[1].winner_code == "AAA"
    assert games[2].home_score is None
    assert {r.team_code: r.name for r in c.teams.collect()} == {"AAA": "Alpha BC", "BBB": "Beta"}
    rows = c.player_games.collect()
    assert len(rows) == 20 and all(r.pir == r.valuation and r.won == (r.team_code == "AAA") and r.opp_code != r.team_code for r in rows)
    assert {r.fantasy_score for r in rows if r.won} == {(r.pir * 11) / 10 for r in rows if r.won}
    assert quality.gate(c.issues) == {}
    assert {r.rule: r.broken for r in clean.load_checks(c.player_games, c.games).collect() if r.broken} == {}


@pytest.mark.parametrize(
    "column,value,check",
    [
        ("Points", lambda: F.col("Points") + 1, "points_formula"), ("TotalRebounds", lambda: F.col("TotalRebounds") + 1, "rebounds_sum"), ("FieldGoalsAttempted2", lambda: F.lit(0), "made_exceeds_attempted"), ("Assistances", lambda: F.lit(-1), "negative_stat"),
        ("Minutes", lambda: F.lit("DNP"), "dnp_with_stats"), ("Minutes", lambda: F.lit(" "), "zero_minutes_not_dnp"), ("Gamecode", lambda: F.lit(77), "missing_game"), ("Team", lambda: F.lit("CCC"), "team_not_in_game"), ("Home", lambda: F.lit(0), "home_flag_mismatch"), ("Steals", lambda: F.lit(None).cast("int"), "missing_values"), ("Player_ID", lambda: F.lit("PAAA1"), "duplicate_key"),
    ],
)
def test_each_check_is_triggered_once(raw, column, value, check):
    box, results, schedule = raw
    one = F.trim("Player_ID") == "PAAA0"
    changed = box.withColumn(column, F.when(one, value()).otherwise(F.col(column)))
    found = {r.check for r in clean.clean(changed, results, schedule).issues.select("check").collect()}
    assert check in found


def test_total_score_and_schedule_checks(raw):
    box, results, schedule = raw
    total = F.trim("Player_ID") == "Total"
    c = clean.clean(box.withColumn("Minutes", F.when(total & (F.col("Team") == "AAA"), "190:00").otherwise(F.col("Minutes"))).withColumn("Assistances", F.when(total, F.col("Assistances") + 2).otherwise(F.col("Assistances"))), results.withColumn("homescore", F.lit(131)), schedule.withColumn("date", F.lit("Oct 09, 2023")))
    found = {(r.check, r.key): r.detail for r in c.issues.collect()}
    assert found["team_minutes_mismatch", "AAA"] == "minutes=190.0" and found["team_total_mismatch", "AAA"] == "assists:-2" and ("score_mismatch", "AAA") in found and ("results_schedule_conflict", "1") in found
    with pytest.raises(quality.QualityError, match="points_formula: 1"):
        quality.gate(clean.clean(box.withColumn("Points", F.when(F.trim("Player_ID") == "PAAA0", 99).otherwise(F.col("Points"))), results, schedule).issues)


def test_bonus_for_every_rating(spark):
    rows = spark.range(-100, 151).select(F.col("id").alias("p")).crossJoin(spark.createDataFrame([(True,), (False,)], "won boolean"))
    for r in rows.withColumn("s", scoring.bonus_score("p", "won")).collect():
        assert r.s == ((r.p * 10 + abs(r.p)) / 10 if r.won else r.p)
    with pytest.raises(Exception, match="won is null"):
        rows.limit(1).select(scoring.bonus_score("p", F.lit(None).cast("boolean"))).collect()


def test_parsers(spark):
    one = spark.range(1)
    dates = ["Jan 05, 2024", "February 29, 2024", "sep 1, 2020", "31 Dec 2020", "Feb 30, 2023", None]
    got = [one.select(parsing.month_day_year(F.lit(d).cast("string")).alias("d")).first().d for d in dates]
    assert got == [dt.date(2024, 1, 5), dt.date(2024, 2, 29), dt.date(2020, 9, 1), None, None, None]
    utc = lambda d, c: one.select(parsing.local_to_utc(F.lit(d).cast("date"), F.lit(c)).alias("t")).first().t
    assert utc("2023-09-05", "20:45") == dt.datetime(2023, 9, 5, 18, 45) and utc("2023-12-05", "20:45") == dt.datetime(2023, 12, 5, 19, 45) and utc("2023-12-05", "later") is None
    m = lambda x: tuple(one.select(parsing.minutes_played(F.lit(x).cast("string")).alias("m")).first().m)
    assert m("12:30") == (12.5, False) and m(" dnp ") == (0.0, True) and m("") == (0.0, False) and m(None) == (0.0, False)
    with pytest.raises(Exception, match="minutes: 12:75"):
        m("12:75")
    names = spark.createDataFrame([("Dončić,  Luka",), ("O'Neal-Šarić Ł. Ærø",), (None,)], "n string").select(parsing.name_key("n").alias("a"), parsing.search_key("n").alias("b"), parsing.display_name("n").alias("c")).collect()
    assert names[0][:2] == ("DONCIC, LUKA", "doncic luka") and names[1].b == "oneal saric l aero" and names[2].b is None and names[0].c == "Luka Dončić"
    r = one.select(parsing.round2(F.lit(-0.001)).alias("z"), parsing.nearly_equal(F.lit(1.0), F.lit(1.0 + 1e-12)).alias("e"), parsing.nearly_equal(F.lit(None).cast("double"), F.lit(None).cast("double")).alias("n"), parsing.nearly_equal(F.lit(1.0), F.lit(1.1)).alias("d")).first()
    assert str(r.z) == "0.0" and r.e and r.n and not r.d


def test_store(spark, tmp_path):
    t = schemas.PLAYERS
    path = f"{tmp_path}/players"
    make = lambda *r: spark.createDataFrame(list(r), t.schema)
    store.upsert(spark, path, t, make(("P1", "Old", 2010, 2015), ("P2", "Two", 2012, 2012)), store.PLAYER_RESOLVER)
    newer = make(("P1", "New", 2016, 2017), ("P3", "Three", 2020, 2020))
    for _ in range(2):  # idempotent
        store.upsert(spark, path, t, newer, store.PLAYER_RESOLVER)
    store.upsert(spark, path, t, make(("P1", "Older", 2008, 2009)), store.PLAYER_RESOLVER)
    got = {r.player_id: (r.name, r.first_season, r.last_season) for r in store.load(spark, path, t).collect()}
    assert got == {"P1": ("New", 2008, 2017), "P2": ("Two", 2012, 2012), "P3": ("Three", 2020, 2020)}
    store.copy_tables(spark, str(tmp_path), f"{tmp_path}/copy", schemas.TABLES)
    assert store.verify(store.load(spark, path, t), store.load(spark, f"{tmp_path}/copy/players", t), t).count() == 0
    store.delete_keys(spark, path, t, make(("P2", "", 0, 0)).select("player_id"))
    assert store.load(spark, path, t).count() == 2 and store.verify(store.load(spark, path, t), store.load(spark, f"{tmp_path}/copy/players", t), t).count() > 0
    with pytest.raises(ValueError, match="repeats"):
        store.merge(make(), make(("P1", "a", 1, 1), ("P1", "b", 1, 1)), ["player_id"])
    with pytest.raises(FileNotFoundError):
        store.load(spark, f"{tmp_path}/none", t, must_exist=True)
    bad = spark.createDataFrame([("PX", "maybe", None, None, None, dt.datetime(2024, 1, 1))], schemas.AVAILABILITY.schema)
    assert {r.check for r in quality.table_issues(schemas.AVAILABILITY, bad, {"players": store.load(spark, path, t)}).collect()} == {"player_availability check status", "player_availability -> players"}


def test_stream_merges_once(spark, tmp_path):
    t = schemas.PLAYERS
    for k in range(2):
        spark.createDataFrame([("P1", f"n{k}", 2010, 2015 + k), (f"P{k + 5}", "x", 2012, 2012)], t.schema).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.merge_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", t, store.PLAYER_RESOLVER, "last_season").awaitTermination()
    got = {r.player_id: (r.name, r.last_season) for r in ingest.current(spark, f"{tmp_path}/out", t).collect()}
    assert got == {"P1": ("n1", 2016), "P5": ("x", 2012), "P6": ("x", 2012)}


class Failing(Exception):
    def __init__(self, status, retry_after=None):
        self.status, self.retry_after = status, retry_after


def test_fetch_with_gaps_and_retries(spark, tmp_path):
    slept, now = [], [0.0]
    limiter = raw_cache.RateLimiter(10, clock=lambda: now[0], sleep=lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    tries = {}

    class Source:
        def results(self, season):
            return [{"gameCode": c, "homescore": 80, "awayscore": 70 if c != 4 else 0} for c in range(1, 5)]

        def schedule(self, season):
            return [{"game": str(c), "played": "true" if c == 5 else "false"} for c in range(1, 7)]

        def boxscore(self, season, code):
            tries[code] = tries.get(code, 0) + 1
            if code == 2 and tries[code] == 1:
                raise Failing(429, "7")
            if code == 5:
                raise Failing(503)
            return [{"Gamecode": code, "Points": tries[code]}]

    cache = raw_cache.RawCache(spark, str(tmp_path))
    assert raw_cache.fetch_season(cache, Source(), limiter, 2023, every=2, attempts=2) == [5] and cache.gaps() == {2023: [5]}
    assert cache.codes(2023) == {1, 2, 3} and max(slept) >= 7 and limiter.gap >= 0.2 and tries[5] == 4
    assert raw_cache.fetch_season(cache, Source(), limiter, 2023, attempts=1) == [5] and tries[1] == 1
    assert cache.load_all([2022, 2023])["boxscores"].count() == 3
    assert raw_cache.retry_after("Wed, 21 Oct 2015 07:28:10 GMT", 1445412480.0) == 10.0 and raw_cache.retry_after("soon", 0) is None
    with pytest.raises(FileNotFoundError):
        cache.load_all([2022])


def test_greedy_line_up_equals_the_window(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("abc"), rnd.randint(0, 20)) for i in range(60)]
    picked, per = [], {}
    for i, g, v in sorted(rows, key=lambda x: (-x[2], x[0])):
        if per.get(g, 0) < 4 and len(picked) < 10:
            per[g] = per.get(g, 0) + 1
            picked.append(i)
    got = rel.capped_top(spark.createDataFrame(rows, "i int, g string, v int"), "g", [F.desc("v"), F.asc("i")], 4, 10)
    assert {r.i for r in got.collect()} == set(picked)


@pytest.fixture(scope="module")
def league(spark):
    return [f.cache() for f in synthetic.league(spark, seed=11, seasons=4, teams=6, rounds=10, pool=9)]


@pytest.fixture(scope="module")
def parts(league):
    history, games, _ = league
    return {k: v.cache() for k, v in model.splits(ft.build_features(history, None, games).cache(), (2020, 2021), 2022, 2023).items()}


def test_ridge_equals_the_closed_form(parts):
    m = model.fit_ridge(parts["fit"], 25.0)
    p = m.preparation
    rows = parts["fit"].select("fantasy_score", *ft.FEATURES).toPandas()
    x = rows[list(ft.FEATURES)].to_numpy(float)
    flags = np.isnan(x)[:, [ft.FEATURES.index(c) for c in p.flagged]].astype(float)
    x = np.concatenate([np.where(np.isnan(x), np.nanmedian(x, axis=0), x), flags], axis=1)
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    y = rows["fantasy_score"].to_numpy()
    w = np.linalg.solve(z.T @ z + 25.0 * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    assert np.allclose(m.regressor.coefficients.toArray(), w, atol=1e-6) and m.regressor.intercept == pytest.approx(y.mean())


def test_models_beat_the_baselines_and_survive_saving(spark, parts, tmp_path):
    mean, median = model.fit_values(parts["fit"])
    test = model.baselines(parts["test"], mean, median)
    ridge = model.fit_ridge(parts["fit"], 100.0)
    trees = model.fit_trees(parts["train"], parts["validation"], rounds=8, depth=3)
    judged = trees.predict(ridge.predict(test, "ridge"), "trees").cache()
    errors = {r.predictor: r.mae for r in evaluate.comparison({"test": judged}, ["ridge", "trees", *[c for c in judged.columns if c.startswith("baseline_")]], "fantasy_score").collect()}
    assert errors["ridge"] < errors["baseline_global_mean"] and errors["trees"] < errors["baseline_global_mean"]
    ridge.save(spark, f"{tmp_path}/m")
    again = model.load_model(spark, f"{tmp_path}/m").predict(parts["test"], "p").agg(F.sum("p")).first()[0]
    assert again == pytest.approx(judged.agg(F.sum("ridge")).first()[0]) and len(ridge.importances()) == 15
    with pytest.raises(model.GateError):
        model.gate(errors["ridge"], errors["ridge"])
    model.gate(errors["ridge"], errors["ridge"] + 1e-9)
    e = evaluate.metrics(judged, "ridge", "fantasy_score").first()
    assert e.mae == pytest.approx(errors["ridge"]) and e.rmse >= e.mae and e.r2 < 1
    b = evaluate.mae_difference(judged, "ridge", "baseline_global_mean", "fantasy_score", ["season", "gamecode"], rounds=200).first()
    assert b["mean"] == pytest.approx(errors["ridge"] - errors["baseline_global_mean"]) and b.low < b["mean"] < b.high and b.share_below > 0.9
    s = evaluate.segments(judged.withColumn("minutes", F.lit(15.0)), ["ridge"], "fantasy_score").collect()
    assert sum(r.n for r in s) == 3 * e.n and {r.segment for r in s} == {"minutes", "prior", "phase"}
    assert len(model.data_version(judged.select("season", "gamecode"))) == 12 and model.hold_out(parts["test"], mean, median).count() == e.n
    with pytest.raises(ValueError, match="empty"):
        model.splits(judged, (1990, 1991), 2022, 2023)


def test_predict_rank_search_and_record(spark, league):
    history, games, upcoming = league
    as_of = str(history.agg(F.max("game_date")).first()[0] + dt.timedelta(days=2))
    table = games.withColumn("played", F.col("home_score").isNotNull()).withColumn("phase", F.lit("RS"))
    mean_model = lambda df: df.withColumn("predicted", F.coalesce("fantasy_mean_5", F.lit(0.0)))
    got = serve.predict(history, table, as_of, mean_model, active_only=False).cache()
    assert got.count() == history.select("player_id").distinct().count()
    assert 0 < got.where("active").count() <= got.count()
    out = got.orderBy(F.desc("predicted")).first().player_id
    ill = spark.createDataFrame([(out, "out", None, None, dt.date(2020, 1, 1), dt.datetime(2024, 1, 1))], schemas.AVAILABILITY.schema)
    judged = serve.with_availability(got, ill, today="2024-06-01").cache()
    first = serve.rankings(judged, limit=500, include_unavailable=True).collect()
    assert first[-1].player_id == out and first[-1].effective == 0 and "expected return has passed" in first[-1].notes and {r.total for r in first} == {len(first)}
    page = serve.rankings(judged, limit=5, offset=3).collect()
    assert [r.rank for r in page] == [4, 5, 6, 7, 8] and page[0].total == len(first) - 1
    team = serve.known_team(history.select("team_code").distinct(), " t00 ")
    assert {r.team_code for r in serve.rankings(judged, team=team).collect()} == {"T00"}
    with pytest.raises(ValueError, match="unknown team"):
        serve.known_team(history.select("team_code").distinct(), "XX")
    players = got.select("player_id", F.concat(F.lit("ŠARIĆ, "), "player_id").alias("name"), "team_code", "active")
    assert all("P00" in r.player_id for r in serve.search_players(players, "saric p00").collect())
    rows = serve.to_record(got, "v1", as_of, "2024-01-01 00:00:00")
    assert rows.where("gamecode < 0").count() == 0 and rows.count() > 0
    status = evaluate.recorded(rows, table, history.withColumn("dnp", F.col("dnp")))
    assert {r.status for r in status.collect()} == {"pending"} and evaluate.summary(status).first().pending == rows.count()
    h = serve.health(table, history, as_of).first()
    assert h.age_days == 2 and h.played < h.games
    with pytest.raises(Exception, match="status"):
        serve.valid_availability(ill.withColumn("status", F.lit("gone"))).collect()
    assert math.isfinite(h.players)


def test_cleaning_reads_the_box_once(spark, tmp_path, monkeypatch):
    from tidemark.queries import plans as queries

    scans, real = {}, clean.written
    monkeypatch.setattr(clean, "written", lambda df, name: (scans.update({name: df._jdf.queryExecution().executedPlan().toString().count("FileScan")}), real(df, name))[1])
    made = clean.clean(*queries.raw_box(spark, "/root/testdata/sf0.001"))
    assert scans["box"] == 2  # the players' rows and the sums by side, each once
    clean.load_checks(made.player_games, made.games).count()
    assert "sides" in scans  # the rows are summed by side once, for all rules


def test_load_checks_broadcast_no_games(spark, monkeypatch):
    from tidemark.queries import plans as queries

    plans, real = {}, clean.written
    monkeypatch.setattr(clean, "written", lambda df, name: (plans.update({name: df._jdf.queryExecution().executedPlan().toString()}), real(df, name))[1])
    found = queries.load_checks(spark, "/root/testdata/sf0.001")
    plans["checks"] = found._jdf.queryExecution().executedPlan().toString()
    assert [name for name in ("games", "sides", "checks") if "BroadcastExchange" in plans[name]] == []


def test_load_checks_of_games_with_and_without_rows(spark):
    box = "points total_reb assists steals blocks_for fouls_received fg2_att fg2_made fg3_att fg3_made ft_att ft_made turnovers blocks_against fouls_committed".split()
    row = lambda season, code, team, won: (season, code, team, won, 0, 0, 0.0, *[0] * len(box))
    rows = [row(1, 1, "A", True), row(1, 1, "B", False), row(1, 2, "A", True), row(1, 3, "A", True), row(1, 3, "B", True), row(1, 3, "C", False), row(None, 4, "A", True), row(None, 4, "B", False)]
    lines = spark.createDataFrame(rows, "season int, gamecode int, team_code string, won boolean, pir int, valuation int, fantasy_score double, " + ", ".join(f"{c} int" for c in box))
    games = spark.createDataFrame([(1, 1, True), (1, 2, True), (1, 5, True), (1, 6, False), (1, 7, True), (1, 7, True), (None, 4, True), (1, 8, None)], "season int, gamecode int, played boolean")
    got = lambda accepted: {r.rule: r.broken for r in clean.load_checks(lines, games, accepted).collect()}
    rules = {"rating equals the source's": 0, "rating as recomputed": 0, "score rule": 0, "one winner": 1, "two teams": 2}
    assert got([]) == rules | {"games without rows": 4} and got([(1, 7)]) == rules | {"games without rows": 2}
    none = {r.rule: r.broken for r in clean.load_checks(lines.limit(0), games.limit(0)).collect()}
    assert none == dict.fromkeys([*rules, "games without rows"], 0)
