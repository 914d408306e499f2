"""Checks that return issues (check, severity, season, gamecode, key, detail); errors block a load."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.league import complete_minutes
from tidemark.operators.relational import outer_difference
from tidemark.schemas import COUNTERS, Table

ISSUE = ("check", "severity", "season", "gamecode", "key", "detail")


class QualityError(ValueError):
    pass


def issues(df: DataFrame, check: str, severity: str, where: Column, key: Column, detail: Column) -> DataFrame:
    return df.where(where).select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.col("season").cast("int").alias("season"), F.col("gamecode").cast("int").alias("gamecode"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def _pairs(*names: str) -> Column:
    return F.concat_ws(" ", *[F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in names])


def null_columns(columns: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))


def issues_of_rows(df: DataFrame, checks: list[tuple[str, str, Column, Column, Column]]) -> DataFrame:
    """Issues of several checks (check, severity, where, key, detail) in one pass over df."""
    made = [F.when(where, F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))) for check, severity, where, key, detail in checks]
    listed = df.select(F.col("season").cast("int").alias("season"), F.col("gamecode").cast("int").alias("gamecode"), F.explode(F.array_compact(F.array(*made))).alias("i"))
    return listed.select("i.check", "i.severity", "season", "gamecode", "i.key", "i.detail")


def duplicate_key_issues(rows: DataFrame) -> DataFrame:
    """An issue for each row whose key repeats, of the keys' counts alone."""
    counts = rows.groupBy("season", "gamecode", "player_id").agg(F.count("*").alias("n")).where("n > 1")
    each = counts.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("_i"))
    return issues(each, "duplicate_key", "error", F.lit(True), F.col("player_id"), F.concat(F.col("n").cast("string"), F.lit(" rows")))


def box_score_issues(rows: DataFrame) -> DataFrame:
    """All checks of single rows: player rows with COUNTERS, minutes and dnp. Rows with nulls fail only missing_values."""
    key = F.col("player_id")
    needed = ["season", "gamecode", "player_id", "team_code", "minutes", "dnp", *COUNTERS]
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in needed])
    points = 2 * F.col("fg2_made") + 3 * F.col("fg3_made") + F.col("ft_made")
    made = [("fg2_made", "fg2_att"), ("fg3_made", "fg3_att"), ("ft_made", "ft_att")]
    any_of = lambda conditions: reduce(lambda a, b: a | b, conditions)
    some = any_of([F.col(c) != 0 for c in COUNTERS])
    checks = [
        ("missing_values", "error", ~whole, F.coalesce(key, F.lit("")), F.concat(F.lit("NULL in "), F.concat_ws(", ", null_columns(needed)))),
        ("points_formula", "error", whole & (F.col("points") != points), key, _pairs("points", "fg2_made", "fg3_made", "ft_made")),
        ("rebounds_sum", "error", whole & (F.col("total_reb") != F.col("off_reb") + F.col("def_reb")), key, _pairs("total_reb", "off_reb", "def_reb")),
        ("made_exceeds_attempted", "warning", whole & any_of([F.col(m) > F.col(a) for m, a in made]), key, F.concat_ws(" ", *[F.when(F.col(m) > F.col(a), _pairs(m, a)) for m, a in made])),
        ("negative_stat", "warning", whole & (F.least(*COUNTERS) < 0), key, F.concat_ws(" ", *[F.when(F.col(c) < 0, _pairs(c)) for c in COUNTERS])),
        ("dnp_with_stats", "warning", whole & F.col("dnp") & (some | (F.col("minutes") > 0)), key, _pairs("minutes")),
        ("zero_minutes_not_dnp", "warning", whole & ~F.col("dnp") & (F.col("minutes") == 0), key, F.lit("0 minutes")),
    ]
    return duplicate_key_issues(rows).unionByName(issues_of_rows(rows, checks))


def team_total_issues(players: DataFrame, totals: DataFrame, columns: list[str] = list(COUNTERS)) -> DataFrame:
    """Sums of the players' and team rows against the total row: signed differences by column."""
    on = ["season", "gamecode", "team_code"]
    summed = players.groupBy(*on).agg(*[F.sum(c).alias(c) for c in columns])
    apart = outer_difference(summed, totals, on, columns)
    return issues(apart, "team_total_mismatch", "warning", reduce(lambda a, b: a | b, [F.col(c) != 0 for c in columns]), F.col("team_code"), F.concat_ws(" ", *[F.when(F.col(c) != 0, F.format_string(f"{c}:%+d", F.col(c).cast("long"))) for c in columns]))


def team_minutes_issues(totals: DataFrame) -> DataFrame:
    return issues(totals, "team_minutes_mismatch", "warning", ~complete_minutes("minutes"), F.col("team_code"), _pairs("minutes"))


def context_issues(rows: DataFrame, games: DataFrame) -> DataFrame:
    """Rows without a game, of a team that does not play in it, or with the wrong home flag."""
    joined = rows.join(games.select("season", "gamecode", "home_code", "away_code"), ["season", "gamecode"], "left")
    key, team = F.col("player_id"), F.col("team_code")
    known = F.col("home_code").isNotNull()
    checks = [
        ("missing_game", "error", ~known, key, F.lit("no such game")),
        ("team_not_in_game", "error", known & (team != F.col("home_code")) & (team != F.col("away_code")), key, _pairs("team_code", "home_code", "away_code")),
        ("home_flag_mismatch", "warning", known & ((team == F.col("home_code")) != F.col("home")) & team.isin(F.col("home_code"), F.col("away_code")), key, _pairs("team_code", "home_code")),
    ]
    return issues_of_rows(joined, checks)


def score_issues(games: DataFrame, totals: DataFrame) -> DataFrame:
    """A team's points in its total row against the game's score; a team of neither side has none (see context_issues)."""
    joined = totals.join(games, ["season", "gamecode"])
    score = F.when(F.col("team_code") == F.col("home_code"), F.col("home_score")).when(F.col("team_code") == F.col("away_code"), F.col("away_score"))
    joined = joined.withColumn("score", score)
    return issues(joined, "score_mismatch", "warning", F.col("points") != F.col("score"), F.col("team_code"), _pairs("points", "score"))


def conflict_issues(results: DataFrame, schedule: DataFrame, columns: list[str]) -> DataFrame:
    """Games that both sources have with different values (null equals null); the tip-off counts where both have it."""
    a, b = results.alias("a"), schedule.alias("b")
    joined = a.join(b, ["season", "gamecode"])
    apart = [~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns]
    both = F.col("a.tipoff_utc").isNotNull() & F.col("b.tipoff_utc").isNotNull() & (F.col("a.tipoff_utc") != F.col("b.tipoff_utc"))
    detail = F.concat_ws(" ", *[F.when(x, F.concat(F.lit(f"{c}:"), F.coalesce(F.col(f"a.{c}").cast("string"), F.lit("null")), F.lit("/"), F.coalesce(F.col(f"b.{c}").cast("string"), F.lit("null")))) for c, x in zip(columns, apart)], F.when(both, F.lit("tipoff_utc")))
    return issues(joined, "results_schedule_conflict", "warning", reduce(lambda x, y: x | y, apart) | both, F.col("gamecode"), detail)


def name_anomalies(df: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """(kind, subject, other, n): ids with several names, names with several ids; ids never merge.

    One row for each distinct pair, n: how many others the subject has. Distinct pairs are counted before they are
    joined, so a name of very many ids is never gathered in one row.
    """
    pairs = df.select(F.col(id_col).cast("string").alias("id"), F.col(name_col).cast("string").alias("name")).distinct()
    two = []
    for kind, by, other in (("one_id_many_names", "id", "name"), ("one_name_many_ids", "name", "id")):
        many = pairs.groupBy(F.col(by).alias("subject")).agg(F.count(other).alias("n")).where("n > 1")
        two.append(pairs.join(many, F.col(by) == F.col("subject")).where(F.col(other).isNotNull()).select(F.lit(kind).alias("kind"), "subject", F.col(other).alias("other"), "n"))
    return two[0].unionByName(two[1])


def table_issues(table: Table, df: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """(check, n): repeated keys, null in a required column, dangling references, failed checks."""
    required = [f.name for f in table.schema.fields if not f.nullable]
    out = [df.groupBy(*table.key).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit(f"{table.name} key").alias("check"), "n")]
    out.append(df.where(F.size(null_columns(required)) > 0).agg(F.count("*").alias("n")).select(F.lit(f"{table.name} null").alias("check"), "n"))
    if table.references:
        out.append(dangling(table, df, others))
    for name, rule in table.checks.items():
        out.append(df.where(~F.expr(rule)).agg(F.count("*").alias("n")).select(F.lit(f"{table.name} check {name}").alias("check"), "n"))
    return reduce(DataFrame.unionByName, out).where("n > 0")


def dangling(table: Table, df: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """(check, n): rows that refer to a key which is not there."""
    out = []
    for own, name, theirs in table.references:
        target = others[name].select(*[F.col(t).alias(f"_{t}") for t in theirs])
        loose = df.join(target, [df[a] == target[f"_{t}"] for a, t in zip(own, theirs)], "left_anti")
        out.append(loose.agg(F.count("*").alias("n")).select(F.lit(f"{table.name} -> {name}").alias("check"), "n"))
    return reduce(DataFrame.unionByName, out).where("n > 0")


def gate(found: DataFrame) -> dict[str, int]:
    """Counts by check; raises where any issue is an error."""
    counts = {(r["check"], r["severity"]): r["n"] for r in found.groupBy("check", "severity").agg(F.count("*").alias("n")).collect()}
    errors = {c: n for (c, s), n in counts.items() if s == "error"}
    if errors:
        raise QualityError(", ".join(f"{c}: {n}" for c, n in sorted(errors.items())))
    return {c: n for (c, _), n in counts.items()}
