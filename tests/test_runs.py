"""Whole runs over stored tables: ingest, training, hold-out files, line-ups, the command line."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tests.test_plans import league, parts, raw  # noqa: F401 - fixtures
from tidemark import __main__ as command
from tidemark import schemas
from tidemark.operators import lineups, ordering, quality
from tidemark.plans import features as ft
from tidemark.plans import ingest, model, train
from tidemark.sources import raw_cache, store, tables


@pytest.fixture(scope="module")
def cache(spark, raw, tmp_path_factory):  # noqa: F811
    made = raw_cache.RawCache(spark, str(tmp_path_factory.mktemp("cache")))
    for kind, rows in zip(("boxscores", "results", "schedule"), raw):
        made.write(kind, 2023, rows)
    made.set_gaps(2023, [9])
    return made


def test_ingest_writes_all_tables_or_none(spark, cache, tmp_path, monkeypatch):
    root = f"{tmp_path}/db"
    assert ingest.run(spark, cache, root, [2023], f"{tmp_path}/reports") == {}
    assert {t: store.load(spark, f"{root}/{t}").count() for t in ("teams", "players", "games", "player_games")} == {"teams": 2, "players": 20, "games": 3, "player_games": 20}
    assert spark.read.option("header", True).csv(f"{tmp_path}/reports/gaps").collect()[0].gamecode == "9" and spark.read.option("header", True).csv(f"{tmp_path}/reports/season_summary").count() == 1
    history = tables.history(spark, root)
    assert len(history.columns) == 17 and history.count() == 20 and {(r.team_score, r.opp_score) for r in history.where("won").collect()} == {(130.0, 110.0)}
    assert tables.schedule(spark, root).count() == 2 and tables.players(spark, root).count() == 20
    told = lambda t: sorted(map(tuple, store.load(spark, f"{root}/{t.name}", t).collect()), key=str)
    before = [told(t) for t in (schemas.PLAYERS, schemas.PLAYER_GAMES)]
    assert ingest.run(spark, cache, root, [2023]) == {}  # again: nothing changes
    assert [told(t) for t in (schemas.PLAYERS, schemas.PLAYER_GAMES)] == before
    # a failure while the tables are written leaves the old ones
    monkeypatch.setattr(store, "publish", lambda *a: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError):
        store.replace_all(spark, root, {"teams": store.load(spark, f"{root}/teams").limit(0)})
    monkeypatch.undo()
    assert store.load(spark, f"{root}/teams").count() == 2
    # an error among the issues blocks the load
    bad = raw_cache.RawCache(spark, f"{tmp_path}/bad")
    for kind in ("boxscores", "results", "schedule"):
        rows = cache.read(kind, 2023)
        bad.write(kind, 2023, rows.withColumn("Points", F.lit(1)) if kind == "boxscores" else rows)
    with pytest.raises(quality.QualityError, match="points_formula"):
        ingest.run(spark, bad, f"{tmp_path}/other", [2023])
    assert not store.exists(spark, f"{tmp_path}/other/games")


def test_command_line(spark, cache, tmp_path, capsys):
    root = f"{tmp_path}/db"
    run = lambda *a: command.main(list(a), spark)
    assert run("ingest", "--cache", cache.path, "--root", root, "--seasons", "2023") == 0
    assert run("verify", "--root", root, "--seasons", "2023") == 0
    assert run("verify", "--root", f"{tmp_path}/none", "--seasons", "2023") == 2
    assert run("verify", "--root", root, "--seasons", "2023-2020") == 2
    assert run("features", "--root", root, "--out", f"{tmp_path}/features") == 0 and spark.read.parquet(f"{tmp_path}/features").count() == 20
    assert run("train", "--root", root, "--model", f"{tmp_path}/m", "--train", "2021-2022", "--validation", "2023", "--test", "2023") == 2  # no rows of those seasons
    assert "split is empty" in capsys.readouterr().err
    # copies, availability, hold-outs
    assert run("copy", "--source", root, "--target", f"{tmp_path}/copy", "--dry-run") == 0 and not store.exists(spark, f"{tmp_path}/copy/teams")
    assert run("copy", "--source", root, "--target", f"{tmp_path}/copy") == 0 and "player_games: 20" in capsys.readouterr().out
    assert run("availability", "--root", root, "--player", " paaa1", "--status", "Out ", "--until", "2023-12-01", "--note", "knee") == 0
    assert run("availability", "--root", root, "--player", "nobody", "--status", "out") == 2 and run("availability", "--root", root, "--status", "out") == 0
    assert "PAAA1\tNAME PAAA1\tout\t2023-12-01\tknee" in capsys.readouterr().out
    assert run("availability", "--root", root, "--player", "PAAA1", "--remove") == 0 and store.load(spark, f"{root}/player_availability").count() == 0
    assert run("holdout", "--root", root, "--out", f"{tmp_path}/h", "--train", "2021-2022", "--validation", "2022", "--test", "2023") == 2


def test_season_lists_and_game_keys():
    assert ingest.season_list("2019, 2021-2023,2022") == [2019, 2021, 2022, 2023] and ingest.game_keys(" 2022/15,2023/7") == [(2022, 15), (2023, 7)]
    for bad in ("", "x", "2023-2020", "-2020"):
        with pytest.raises(ValueError):
            ingest.season_list(bad)
    with pytest.raises(ValueError, match="SEASON/CODE"):
        ingest.game_keys("2022-15")


def test_training_run(spark, parts, tmp_path):  # noqa: F811
    tried = [{"kind": "ridge", "alpha": 100.0}, {"kind": "trees", "loss": "absolute", "depth": 3, "step": 0.1, "rounds": 6}]
    with pytest.raises(model.GateError):
        train.train(spark, parts, f"{tmp_path}/m", 0.1, tried[:1])
    assert not store.exists(spark, f"{tmp_path}/m/report")  # nothing is written behind a failed gate
    report = train.train(spark, parts, f"{tmp_path}/m", 50.0, tried)
    stored = train.load_report(spark, f"{tmp_path}/m")
    assert stored["chosen"]["kind"] == report["chosen"]["kind"] and stored["out_of_sample"] and stored["seasons"] == [2020, 2021, 2022] and set(stored["targets"]) == {"fantasy_score", "pir"}
    train.check_out_of_sample(stored, 2023)
    with pytest.raises(ValueError, match="trained on"):
        train.check_out_of_sample(stored, 2022)
    both = train.predict_both(spark, f"{tmp_path}/m", parts["test"])
    assert dict(both.dtypes)["predicted_pir"] == "float" and both.where("predicted_fantasy_score is null or predicted_pir is null").count() == 0
    mean, median = model.fit_values(parts["fit"])
    train.export_hold_out(spark, parts["test"], mean, median, f"{tmp_path}/h", {"season": 2023})
    rows, told = train.import_hold_out(spark, f"{tmp_path}/h")
    from tidemark import __main__ as tool

    assert tool.main(["judge", "--model", f"{tmp_path}/m", "--holdout", f"{tmp_path}/h"], spark) == 0
    assert told["season"] == 2023 and rows.count() == parts["test"].count() and dict(rows.dtypes)[ft.FEATURES[0]] == "float"


def test_candidates_are_seeded():
    every = train.candidates()
    assert len(every) == 36 and every == train.candidates() and every != train.candidates(seed=1) and len({json.dumps(c) for c in every}) == len(every)


def test_finite(spark):
    values = [1.23456789, float("nan"), float("inf"), float("-inf"), None]
    got = [r.v for r in spark.createDataFrame([(v,) for v in values], "v double").select(train.finite(F.col("v")).alias("v")).collect()]
    assert got == [1.234568, None, None, None, None] == train.finite_values(values)
    assert train.finite_values({"a": [float("nan"), {"b": 2.00000049}]}) == {"a": [None, {"b": 2.0}]}


def test_buckets_are_merged_alone(spark, tmp_path):
    t, path = schemas.PLAYERS, f"{tmp_path}/db/players"
    make = lambda ids, name: spark.createDataFrame([(f"P{i}", name, 2020, 2020) for i in ids], t.schema)
    store.upsert(spark, path, t, make(range(100), "a"), buckets=8)
    first = store.pointers(spark, f"{tmp_path}/db")["tables"]["players"]
    store.upsert(spark, path, t, make([7], "b"))
    second = store.pointers(spark, f"{tmp_path}/db")["tables"]["players"]
    assert len(first) == 8 and sum(first[k] != second[k] for k in first) == 1
    got = {r.player_id: r.name for r in store.load(spark, path, t).collect()}
    assert len(got) == 100 and got["P7"] == "b" and got["P8"] == "a"
    for i in range(3):  # old pieces go, but for those of the state before
        store.upsert(spark, path, t, make([7], f"c{i}"))
    assert store.load(spark, path, t).count() == 100


def test_numbered_is_a_total_order(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"), (F.col("id") % 3 == 0).alias("g"))
    got = ordering.numbered(rows, [F.asc("g"), F.desc("v")], "no", 5).collect()
    assert [r.no for r in sorted(got, key=lambda r: (r.g, -r.v))] == list(range(1, 1001))


def test_line_up_changes(spark):
    ddl = "lineup string, slot int, player_id string, team_code string"
    picks = spark.createDataFrame([("a", 0, "p0", "T"), ("a", 1, "p1", "T"), *[("b", k, f"q{k}", f"T{k % 3}") for k in range(10)]], ddl)
    wanted = lambda *r: spark.createDataFrame(list(r), ddl)
    why = lambda rows, **k: {(r.lineup, r.player_id): r.blocker for r in lineups.blockers(picks, rows, **k).collect()}
    assert why(wanted(("a", 2, "p1", "T"), ("b", 3, "x", "T"), ("c", 0, "x", "T"))) == {("a", "p1"): "duplicate", ("b", "x"): "full", ("c", "x"): None}
    assert why(wanted(("a", 1, "z", "U"))) == {("a", "z"): "occupied"} and why(wanted(("a", 2, "z", "T")), team_limit=2) == {("a", "z"): "team-limit"}
    assert lineups.add(picks, wanted(("a", 2, "z", "T"), ("b", 11, "x", "T"))).count() == 13
    assert lineups.remove(picks, wanted(("b", 0, "q3", ""))).count() == 11
    captain = {(r.lineup, r.player_id): r.slot for r in lineups.set_captain(picks, wanted(("b", 0, "q4", ""), ("a", 0, "nobody", ""))).collect()}
    assert captain["b", "q4"] == 0 and captain["b", "q0"] == 4 and captain["a", "p0"] == 0
    messy = picks.union(wanted(("a", 3, "p0", "T"), ("a", 1, "p2", "T"), ("a", 5, "gone", "T"), ("a", 6, "p6", "T")))
    known = messy.where("player_id <> 'gone'").select("player_id")
    assert {(r.slot, r.player_id) for r in lineups.sanitised(messy, known, team_limit=2).where("lineup = 'a'").collect()} == {(0, "p0"), (1, "p1")}


def test_refresh_tells_the_dates(spark, cache, tmp_path):
    from tidemark.plans import serve

    root = f"{tmp_path}/db"
    ingest.run(spark, cache, root, [2023])
    state = serve.Loaded(spark, root)
    assert state.latest == dt.date(2023, 10, 5)
    one = serve.predict_player(state.history, state.games, "PAAA0", "2023-10-10", lambda df: df.withColumn("predicted", F.lit(1.5))).collect()
    assert len(one) == 1 and one[0].predicted == 1.5
    assert serve.predict_player(state.history, state.games, "NOBODY", "2023-10-10", lambda df: df.withColumn("predicted", F.lit(1.5))).count() == 0
    assert state.refresh() == (dt.date(2023, 10, 5), dt.date(2023, 10, 5))
