"""A seeded synthetic league: history, games and upcoming rows with the odd cases that features must survive."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import DataFrame, SparkSession

HISTORY_DDL = "season long, gamecode long, player_id string, team_code string, opp_code string, home boolean, game_date date, tipoff_utc timestamp_ntz, is_starter boolean, minutes double, dnp boolean, pir long, fantasy_score double, team_score double, opp_score double, phase string, won boolean"
GAMES_DDL = "season long, gamecode long, game_date date, tipoff_utc timestamp_ntz, home_code string, away_code string, home_score double, away_score double"
UPCOMING_DDL = "player_id string, season long, gamecode long, team_code string, opp_code string, home boolean, game_date date, tipoff_utc timestamp_ntz, phase string"


def rows(seed: int = 7, seasons: int = 4, teams: int = 8, rounds: int = 16, pool: int = 11) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """(history, games, upcoming): postponed games, transfers, newcomers, injuries, equal times, unknown tip-offs, short boxes, games without boxes."""
    rnd = random.Random(seed)
    codes = [f"T{i:02d}" for i in range(teams)]
    skill = {}
    rosters = {t: [f"P{t[1:]}{k:02d}" for k in range(pool)] for t in codes}
    history, games, upcoming = [], [], []
    for s in range(seasons):
        season, start = 2020 + s, dt.date(2020 + s, 10, 1)
        if s:
            for t in codes:  # a departure, a newcomer
                rosters[t] = [p for p in rosters[t] if p != rosters[t][s % pool]] + [f"N{season}{t[1:]}"]
            a, b = rnd.sample(codes, 2)  # a transfer
            rosters[b] = [*rosters[b], rosters[a].pop()]
        code, injured = 0, {}
        for r in range(rounds + (3 if s == seasons - 1 else 0)):
            future = r >= rounds
            order = codes[:]
            rnd.shuffle(order)
            for home, away in zip(order[::2], order[1::2]):
                code += 1
                day = start + dt.timedelta(days=7 * r + rnd.randint(0, 2) + (25 if not future and rnd.random() < 0.08 else 0))
                tip = None if rnd.random() < 0.1 else dt.datetime.combine(day, dt.time(rnd.choice([17, 18, 19]), 0))
                scores = (None, None) if future else (float(rnd.randint(60, 100)), float(rnd.randint(60, 100)))
                if scores[0] is not None and scores[0] == scores[1]:
                    scores = (scores[0] + 1, scores[1])
                games.append((season, code, day, tip, home, away, *scores))
                boxless = not future and rnd.random() < 0.03
                for team, opp, at_home, own, other in ((home, away, True, *scores), (away, home, False, *scores[::-1])):
                    if boxless:
                        continue
                    players = rosters[team]
                    total = 225 if rnd.random() < 0.1 else 200
                    active = []
                    for p in players:
                        injured[p] = injured.get(p, 0) - 1 if injured.get(p, 0) > 0 else (rnd.randint(1, 4) if rnd.random() < 0.05 else 0)
                        if not injured[p] and not p.endswith("00"):  # the first of each pool never plays
                            active.append(p)
                    if future:
                        upcoming += [(p, season, code, team, opp, at_home, day, tip, "RS") for p in players]
                        continue
                    share = [rnd.random() + 0.2 for _ in active]
                    if rnd.random() < 0.04:
                        total -= 20  # an incomplete box
                    for p in players:
                        if p not in active and rnd.random() < 0.3:
                            continue  # not on the sheet at all
                        m = round(total * share[active.index(p)] / sum(share), 2) if p in active else 0.0
                        pir = int(rnd.gauss(skill.setdefault(p, rnd.uniform(-2, 18)) * m / 25, 5)) if p in active else 0
                        won = own > other
                        history.append((season, code, p, team, opp, at_home, day, tip, rnd.random() < 0.4 and p in active, m, p not in active, pir, (pir * 10 + abs(pir)) / 10 if won else float(pir), own, other, "RS" if r < rounds - 4 else "PO", won))
    return history, games, upcoming


def league(spark: SparkSession, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    history, games, upcoming = rows(**options)
    return spark.createDataFrame(history, HISTORY_DDL), spark.createDataFrame(games, GAMES_DDL), spark.createDataFrame(upcoming, UPCOMING_DDL)
