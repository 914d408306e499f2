"""Constraints before the pointer moves, copies that go on after a failure, verification whatever the layout."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators.quality import QualityError
from tidemark.sources import store


@pytest.fixture
def db(spark, tmp_path):
    root = f"{tmp_path}/db"
    make = lambda t, *rows: spark.createDataFrame(list(rows), t.schema)
    store.upsert(spark, f"{root}/teams", schemas.TEAMS, make(schemas.TEAMS, ("AAA", "Alpha"), ("BBB", "Beta")))
    store.upsert(spark, f"{root}/players", schemas.PLAYERS, make(schemas.PLAYERS, *[(f"P{i}", f"Name {i}", 2020, 2021) for i in range(40)]), buckets=8)
    game = lambda code, home="AAA": (2023, code, "RS", 1, dt.date(2023, 10, 5), None, home, "BBB", 80, 70, True, "AAA")
    store.upsert(spark, f"{root}/games", schemas.GAMES, make(schemas.GAMES, game(1), game(2)))
    return root, make, game


def told(spark, root, table):
    return sorted(map(tuple, store.load(spark, f"{root}/{table.name}", table).collect()), key=str)


def test_a_broken_rule_leaves_the_old_state(spark, db):
    root, make, game = db
    before, state = told(spark, root, schemas.GAMES), store.pointers(spark, root)
    with pytest.raises(QualityError, match="games -> teams: 1"):
        store.upsert(spark, f"{root}/games", schemas.GAMES, make(schemas.GAMES, game(3), game(4, home="XXX")))
    with pytest.raises(QualityError, match="players null: 1"):
        store.upsert(spark, f"{root}/players", schemas.PLAYERS, spark.createDataFrame([("P1", None, 2020, 2021)], "player_id string, name string, first_season int, last_season int"))
    out = lambda who, status: spark.createDataFrame([(who, status, None, None, None, dt.datetime(2024, 1, 1))], schemas.AVAILABILITY.schema)
    path = f"{root}/player_availability"
    with pytest.raises(QualityError, match="check status: 1"):
        store.upsert(spark, path, schemas.AVAILABILITY, out("P1", "maybe"))
    with pytest.raises(QualityError, match="-> players: 1"):
        store.upsert(spark, path, schemas.AVAILABILITY, out("nobody", "out"))
    assert told(spark, root, schemas.GAMES) == before and store.pointers(spark, root) == state and not store.exists(spark, path)
    assert not [p for p in spark._jvm.java.io.File(root).list() if p.startswith("player_availability.")]  # what was written is gone
    store.upsert(spark, path, schemas.AVAILABILITY, out("P1", "out"))
    # what others refer to can't go
    with pytest.raises(QualityError, match="player_availability -> players: 1"):
        store.delete_keys(spark, f"{root}/players", schemas.PLAYERS, spark.createDataFrame([("P1",)], "player_id string"))
    with pytest.raises(QualityError, match="games -> teams: 2"):
        store.replace_all(spark, root, {"teams": make(schemas.TEAMS, ("BBB", "Beta"))}, {"teams": schemas.TEAMS})
    store.delete_keys(spark, f"{root}/players", schemas.PLAYERS, spark.createDataFrame([("P2",)], "player_id string"))
    assert store.load(spark, f"{root}/players", schemas.PLAYERS).count() == 39
    # tables replaced together may refer to each other's new rows
    store.replace_all(spark, root, {"teams": make(schemas.TEAMS, ("CCC", "C"), ("BBB", "B")), "games": make(schemas.GAMES, game(9, home="CCC"))}, {"teams": schemas.TEAMS, "games": schemas.GAMES})
    assert [r[1] for r in told(spark, root, schemas.GAMES)] == [9]
    with pytest.raises(QualityError, match="games key: 1"):
        store.replace(make(schemas.GAMES, game(9, home="CCC"), game(9, home="CCC")), f"{root}/games", schemas.GAMES)


def test_a_copy_goes_on_where_it_broke_off(spark, db, tmp_path, monkeypatch):
    root, target = db[0], f"{tmp_path}/copy"
    assert store.copy_tables(spark, root, target, schemas.TABLES, dry_run=True) == {"teams": 2, "players": 40, "games": 2, "player_games": None, "predictions": None, "player_availability": None}
    assert not store.exists(spark, f"{target}/teams")
    upsert, copied = store.upsert, []

    def failing(spark, path, table, rows, **more):
        if table is schemas.PLAYERS and len(copied) == 4:
            raise OSError("the line went dead")
        copied.append((table.name, rows.inputFiles()[0].split("/db/")[1].rpartition("/")[0]))
        upsert(spark, path, table, rows, **more)

    monkeypatch.setattr(store, "upsert", failing)
    with pytest.raises(OSError):
        store.copy_tables(spark, root, target, schemas.TABLES)
    assert [c[0] for c in copied] == ["teams", "players", "players", "players"] and 0 < store.load(spark, f"{target}/players").count() < 40
    again = []
    monkeypatch.setattr(store, "upsert", lambda spark, path, table, rows, **more: (again.append((table.name, rows.inputFiles()[0].split("/db/")[1].rpartition("/")[0])), upsert(spark, path, table, rows, **more)))
    done = store.copy_tables(spark, root, target, schemas.TABLES)
    assert done["players"] == 40 and not set(again) & set(copied) and len(set(again) | set(copied)) == 1 + 8 + 1
    for t in (schemas.TEAMS, schemas.PLAYERS, schemas.GAMES):
        assert told(spark, target, t) == told(spark, root, t)
        assert store.verify(store.load(spark, f"{root}/{t.name}", t), store.load(spark, f"{target}/{t.name}", t), t).count() == 0
    monkeypatch.undo()
    assert store.copy_tables(spark, root, target, schemas.TABLES)["players"] == 40  # whole again, and nothing changes
    assert told(spark, target, schemas.PLAYERS) == told(spark, root, schemas.PLAYERS)


def test_equal_tables_of_other_layouts_verify(spark):
    rows = spark.range(200_000)
    noise = (F.col("id") * 7919 % 100_003) / 977 - 50
    columns = [F.lit(1 if f.dataType.typeName() == "integer" else 0).cast(f.dataType).alias(f.name) for f in schemas.PLAYER_GAMES.schema.fields if f.name not in ("player_id", "minutes", "fantasy_score")]
    table = rows.select(*columns, F.col("id").cast("string").alias("player_id"), noise.alias("minutes"), (noise * 1.1).alias("fantasy_score")).select(*schemas.PLAYER_GAMES.schema.names).cache()
    for other in (table.repartition(7), table.orderBy(F.desc("fantasy_score")).coalesce(3)):
        assert store.verify(table, other, schemas.PLAYER_GAMES).collect() == []
    last_bit = table.withColumn("minutes", F.when(F.col("player_id") == "77", F.col("minutes") * (1 + 3e-16)).otherwise(F.col("minutes")))
    assert store.verify(table, last_bit, schemas.PLAYER_GAMES).collect() == []
    for column, change in (("minutes", 1e-6), ("pir", 1)):
        one = table.withColumn(column, F.when(F.col("player_id") == "77", F.col(column) + change).otherwise(F.col(column)).cast(table.schema[column].dataType))
        assert "digest" in {r.metric for r in store.verify(table, one, schemas.PLAYER_GAMES).collect()}
    gone = {r.metric: (r.source, r.target) for r in store.verify(table, table.where("player_id <> '77'"), schemas.PLAYER_GAMES).collect()}
    assert gone["rows"] == ("200000", "199999")


def test_values_take_the_tables_types(spark):
    ddl = "season string, gamecode long, phase string, round string, game_date string, tipoff_utc string, home_code string, away_code string, home_score double, away_score float, played string, winner_code string"
    row = spark.createDataFrame([("2023", 7, "RS", " ", "2023-10-05", "", "AAA", "BBB", float("nan"), 70.0, "true", " ")], ddl)
    got = store.coerced(row, schemas.GAMES)
    assert got.schema.simpleString() == spark.createDataFrame([], schemas.GAMES.schema).schema.simpleString()
    assert tuple(got.first()) == (2023, 7, "RS", None, dt.date(2023, 10, 5), None, "AAA", "BBB", None, 70, True, " ")
