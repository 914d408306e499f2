"""The remote source, played games, kept predictions and one prediction as served."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_plans import raw  # noqa: F401 - fixture
from tests.test_runs import cache  # noqa: F401 - fixture
from tidemark import schemas
from tidemark.plans import ingest, serve
from tidemark.plans import features as ft
from tidemark.sources import raw_cache, remote, store, tables

DDL = {"results": "gameCode int, homescore int, awayscore int", "schedule": "game string, played string", "boxscores": "Gamecode int, Points int"}


class Flaky(remote.FolderClient):
    """The first call for a game fails by a full queue, game 5 always."""

    def boxscore(self, season, gamecode):
        error = RuntimeError("busy")
        error.status = 503
        if gamecode == 5:
            raise error
        mark = f"{self.path}/seen_{season}_{gamecode}"
        try:
            open(mark).close()
        except FileNotFoundError:
            open(mark, "w").close()
            raise error from None
        return super().boxscore(season, gamecode)


@pytest.fixture
def service(tmp_path):
    for season in (2022, 2023):
        for kind, rows in {"results": [{"gameCode": c, "homescore": 80, "awayscore": 70 if c != 4 else 0} for c in range(1, 5)], "schedule": [{"game": str(c), "played": "true" if c == 5 else "false"} for c in range(1, 7)], "boxscores": [{"Gamecode": c, "Points": season + c} for c in range(1, 6) for _ in "ab"]}.items():
            (tmp_path / f"{kind}_{season}.json").write_text(json.dumps(rows))
    return str(tmp_path)


def test_format_league_reads_a_season_in_a_partition(spark, service):
    df = remote.read(spark, "results", [2022, 2023, 2024], "tidemark.sources.remote:FolderClient", arguments={"path": service}, attempts=1, per_second=1000, backoff=0)
    assert df.rdd.getNumPartitions() == 3
    rows = df.collect()
    assert sorted({r.season for r in rows if r.payload}) == [2022, 2023] and [(r.season, r.error) for r in rows if r.error] == [(2024, "EmptyResponse: no rows")]


def test_fetch_retries_and_keeps_the_ledger(spark, service, tmp_path):
    made = raw_cache.RawCache(spark, f"{tmp_path}/cache")
    options = dict(arguments={"path": service}, per_second=1000, attempts=2, backoff=0)
    assert remote.fetch(made, [2022, 2023], "tests.test_serving:Flaky", DDL, **options) == {2022: [5], 2023: [5]} == made.gaps()
    assert made.codes(2022) == {1, 2, 3} == made.codes(2023) and made.read("boxscores", 2023).agg(F.sum("Points")).first()[0] == 2 * (3 * 2023 + 6)
    # the rest is cached; the gap closes once the game can be had
    assert remote.fetch(made, [2022, 2023], "tidemark.sources.remote:FolderClient", DDL, **options) == {2022: [], 2023: []} and made.gaps() == {}
    assert made.codes(2022) == {1, 2, 3, 5} and made.read("boxscores", 2022).count() == 8


@pytest.fixture
def root(spark, cache, tmp_path):  # noqa: F811
    ingest.run(spark, cache, f"{tmp_path}/db", [2023])
    return f"{tmp_path}/db"


def test_played_games(spark, root):
    assert [r.gamecode for r in tables.played_games(spark, root).collect()] == [1] and tables.games(spark, root).count() == 3


def test_predictions_are_kept_until_the_tables_move(spark, root):
    made = []

    def model(df):
        made.append(1)
        return df.withColumn("predicted", F.lit(2.345) + F.length("player_id"))

    state = serve.Loaded(spark, root)
    first = state.predictions("2023-10-10", model)
    assert first.count() == 20 and len(made) == 1
    assert sorted(map(str, state.predictions("2023-10-10", model).collect())) == sorted(map(str, first.collect())) and len(made) == 1
    assert serve.Loaded(spark, root).predictions("2023-10-10", model).count() == 20 and len(made) == 1  # another process reads them too
    assert state.predictions("2023-10-11", model).count() == 20 and len(made) == 2
    one = store.load(spark, f"{root}/player_games", schemas.PLAYER_GAMES)
    store.upsert(spark, f"{root}/player_games", schemas.PLAYER_GAMES, one.limit(1))  # the pointer moves
    assert state.predictions("2023-10-10", model).count() == 20 and len(made) == 3
    state.refresh()
    state.predictions("2023-10-10", model)
    assert len(made) == 4


def test_one_prediction_as_served(spark, root):
    model = lambda df: df.withColumn("predicted", F.lit(2.345) + F.length("player_id"))
    out = spark.createDataFrame([("PAAA0", "out", "doctor", None, None, None)], "player_id string, status string, source string, note string, expected_return date, updated_at timestamp").withColumn("updated_at", F.lit("2023-10-06").cast("timestamp")).withColumn("expected_return", F.lit("2023-10-08").cast("date"))
    store.upsert(spark, f"{root}/player_availability", schemas.AVAILABILITY, out)
    state = serve.Loaded(spark, root)
    r = state.served(" paaa0 ", "2023-10-10", model, with_features=True).first()
    assert (r.player_id, r.name, r.team_code, r.team_name, r.active) == ("PAAA0", "NAME PAAA0", "AAA", "Alpha BC", True)
    assert (r.predicted_fantasy, r.model_predicted_fantasy, r.n_prior_appearances, str(r.last_appearance)) == (0.0, 7.35, 1, "2023-10-05") and r.availability.status == "out"
    assert r.next_game.gamecode == 3 and r.next_game.opponent_code == "BBB" and r.next_game.opponent_name == "Beta" and r.next_game.home is False
    assert r.notes == ["out", "expected return has passed", "1 appearance"] and set(r.features) == set(ft.FEATURES) and r.features["min_last"] == 20.0
    other = state.served("PBBB1", "2023-10-10", model).first()
    assert other.predicted_fantasy == other.model_predicted_fantasy == 7.35 and other.availability is None and "features" not in other.asDict()
    assert state.served("NOBODY", "2023-10-10", model).count() == 0
