"""Joins, sets, aggregates, scalars, checks, ranks and writes on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import parsing, scoring
from tidemark.operators import league, quality, quantiles
from tidemark.operators import relational as rel
from tidemark.operators import timeline as tm
from tidemark.operators.ordering import numbered
from tidemark.queries.timelines import GAMES_SQL, games, orders_timeline, read, sides
from tidemark.schemas import Table
from tidemark.sources import store


def _orders(spark, sf_dir):
    return read(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date")).withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))


_O = "o AS (SELECT *, CAST(o_orderdate AS DATE) AS day, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)"
_LATEST = "(SELECT max(CAST(o_orderdate AS DATE)) FROM orders)"


def history_scan(spark, sf_dir):
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    joined = li.join(o, li.l_orderkey == o.o_orderkey)
    return joined.groupBy("o_orderkey", "o_custkey").agg(F.count("*").alias("lines"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("long")).otherwise(0)).alias("returned"))


def full_outer_flags(spark, sf_dir):
    o = _orders(spark, sf_dir)
    a = o.where("day < '1997-07-01'").select("o_orderkey", F.col("cents").alias("cents_a"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("status_a"))
    b = o.where("day >= '1994-01-01'").select("o_orderkey", F.col("cents").alias("cents_b"), F.col("o_orderstatus").alias("status_b"))
    joined = rel.flagged_outer_join(a, b, ["o_orderkey"])
    return joined.select("o_orderkey", "side", F.coalesce("cents_a", "cents_b").alias("cents"), F.coalesce("status_a", "status_b").alias("status"))


def validated_left_join(spark, sf_dir):
    o, c = _orders(spark, sf_dir), read(spark, sf_dir, "customer")
    rows = c.select("c_custkey", "c_nationkey", "c_mktsegment").withColumnRenamed("c_custkey", "o_custkey")
    joined = rel.validated_left_join(o.withColumn("o_custkey", F.when(F.col("o_orderkey") % 11 == 0, -1).otherwise(F.col("o_custkey"))), rows, ["o_custkey"], "customer")
    return joined.select("o_orderkey", "o_custkey", F.col("c_nationkey").cast("long").alias("nation"), "c_mktsegment")


def rows_per_customer(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey")
    n = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return c.join(n, c.c_custkey == n.o_custkey, "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def two_side_feature_join(spark, sf_dir):
    """Each side's mean score so far, for the team and for its opponent in the same game."""
    rows = sides(spark, sf_dir)
    table = rows.select("gamecode", "team", "opp", F.row_number().over(Window.partitionBy("team").orderBy("t_us", "gamecode")).alias("no"), F.col("own_score").alias("scored"))
    own = rel.unique(table, ["gamecode", "team"], "team table")
    opp = own.select("gamecode", F.col("team").alias("opp"), F.col("no").alias("opp_no"), F.col("scored").alias("opp_scored"))
    return own.join(opp, ["gamecode", "opp"], "left").select("gamecode", "team", "opp", F.col("no").cast("long").alias("no"), F.col("opp_no").cast("long").alias("opp_no"), "scored", "opp_scored", F.col("opp_no").isNotNull().alias("known"))


def anti_semi(spark, sf_dir):
    c, o, li = (read(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    without = c.join(o, c.c_custkey == o.o_custkey, "left_anti").select(F.lit("customer without order").alias("kind"), F.col("c_custkey").alias("id"))
    big = o.join(li.where("l_quantity > 49"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").where("o_orderstatus = 'O'").select(F.lit("open with large line").alias("kind"), F.col("o_orderkey").alias("id"))
    return without.unionByName(big)


def outer_arith(spark, sf_dir):
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    a = li.where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.col("l_quantity").cast("long")).alias("q"), F.count("*").alias("n"))
    b = o.select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 97).alias("q"), F.lit(4).cast("long").alias("n"))
    return rel.outer_difference(a, b, ["k"], ["q", "n"])


def three_way_eval(spark, sf_dir):
    """Predictions (events) with the played games (orders) and rows (lineitem) they speak of, by version."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string")).alias("version"), F.round("value").cast("long").alias("predicted"))
    g = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    box = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("actual"))
    joined = e.join(g, e.event_id == g.o_orderkey).join(box, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("actual").isNull(), "not_in_boxscore").when(F.col("actual") < 20, "dnp").otherwise("appeared")
    rows = joined.withColumn("status", status).withColumn("error", F.when(F.col("status") == "appeared", F.abs(F.col("predicted") - F.col("actual"))))
    return rows.groupBy("version").agg(F.count("*").alias("n"), *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "not_in_boxscore", "dnp", "appeared")], (F.sum("error") / F.count("error")).alias("mae"), (F.sum(F.when(F.col("status") == "appeared", F.col("predicted") - F.col("actual"))) / F.count("error")).alias("bias"))


def group_complete_flag(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    m = li.groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("minutes"), F.count("*").alias("n"))
    return m.select("l_orderkey", "minutes", "n", F.rint((F.col("minutes") - 200) / 25).cast("long").alias("overtimes"), league.complete_minutes(F.col("minutes").cast("double")).alias("complete"))


def latest_name(spark, sf_dir):
    o = _orders(spark, sf_dir).withColumn("name", F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("n"), (F.col("o_orderkey") % 3).cast("string"))))
    last = rel.latest(o, ["o_custkey"], [F.when(F.col("o_orderkey") % 6 != 0, F.col("day")), "o_orderkey"], ["name"])
    span = o.groupBy("o_custkey").agg(F.min(F.year("day")).alias("first_season"), F.max(F.year("day")).alias("last_season"))
    return span.join(last, "o_custkey").select("o_custkey", "name", F.col("first_season").cast("long").alias("first_season"), F.col("last_season").cast("long").alias("last_season"))


def distinct_gt_one(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return quality.name_anomalies(o.select(F.col("o_custkey").cast("string").alias("id"), F.col("o_orderpriority").alias("name")), "id", "name")


def season_summary(spark, sf_dir):
    o = _orders(spark, sf_dir).withColumn("season", F.year("day"))
    g = o.groupBy("season").agg(F.count("*").alias("games"), F.count_if(F.col("o_orderstatus") == "F").alias("played"), F.count_distinct("o_custkey").alias("customers"), F.max("cents").alias("largest"))
    li = read(spark, sf_dir, "lineitem").withColumn("season", F.year("l_shipdate"))
    rows = li.groupBy("season").agg(F.count("*").alias("rows"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    joined = g.join(rows, "season", "full_outer")
    return joined.select(F.col("season").cast("long").alias("season"), "games", "played", "customers", "largest", "rows", "returned", F.round(F.try_divide(F.col("rows"), F.col("games")), 2).alias("rows_per_game"))


def two_level_winner(spark, sf_dir):
    s = sides(spark, sf_dir).withColumn("won", F.col("own_score") > F.col("opp_score"))
    team = s.groupBy("gamecode", "team").agg(F.max("won").alias("won"))
    return team.groupBy("gamecode").agg(F.sum(F.col("won").cast("long")).alias("winners"), F.count("*").alias("teams")).where("winners <> 1 or teams <> 2")


def table_aggregates(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return o.agg(F.count("*").alias("n"), F.sum("cents").alias("cents"), F.min("day").cast("string").alias("first"), F.max("day").cast("string").alias("last"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("day"))).cast("string").alias("last_done"), F.min(F.when(F.col("o_orderstatus") == "O", F.col("day"))).cast("string").alias("next_open"))


def content_digest(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return rel.content_digest(c, ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])


def reg_metrics(spark, sf_dir):
    """n, MAE, RMSE, R2 and bias by event type; R2 null where the truth does not vary."""
    e = read(spark, sf_dir, "events").select("event_type", F.round(F.col("value")).cast("long").alias("y"), (F.col("user_id") % 100).alias("p"))
    d, one = F.col("p") - F.col("y"), F.count("*")
    total = one * F.sum(F.col("y") * F.col("y")) - F.sum("y") * F.sum("y")
    r2 = 1 - F.try_divide((one * F.sum(d * d)).cast("double"), F.when(total != 0, total).cast("double"))
    return e.groupBy("event_type").agg(one.alias("n"), (F.sum(F.abs(d)) / one).alias("mae"), F.round(F.sqrt(F.sum(d * d) / one), 6).alias("rmse"), F.round(r2, 6).alias("r2"), (F.sum(d) / one).alias("bias"))


def segments(spark, sf_dir):
    """MAE of three predictors by segment, the segmentations stacked."""
    e = read(spark, sf_dir, "events").select("event_type", F.round(F.col("value")).cast("long").alias("y"), (F.col("user_id") % 40).alias("minutes"), (F.col("event_id") % 8).alias("prior"))
    e = e.withColumn("minutes", F.when(F.col("minutes") > 0, F.col("minutes")))
    minutes = parsing.bucket("minutes", [(10, "<10"), (20.001, "10-20")], ">20", "none")
    labels = F.array(*[F.struct(F.lit(k).alias("segment"), v.alias("label")) for k, v in (("minutes", minutes), ("prior", parsing.bucket("prior", [(5, "<5")], ">=5", "none")), ("phase", F.when(F.col("event_type") == "click", "RS").when(F.col("event_type").isNull(), "unknown").otherwise("other")))])
    rows = e.select("y", "minutes", "prior", F.explode(labels).alias("s")).select("y", "minutes", "prior", "s.*")
    return rows.groupBy("segment", "label").agg(F.count("*").alias("n"), *[(F.sum(F.abs(F.col("y") - p)) / F.count("*")).alias(f"mae_{k}") for k, p in (("zero", F.lit(0)), ("prior", F.col("prior")), ("fifty", F.lit(50)))])


def baseline_chain(spark, sf_dir):
    """Rolling mean, else the season's, else the global mean and median of the fit rows."""
    df = orders_timeline(spark, sf_dir)
    from tidemark.queries.timelines import TA

    post = F.struct((F.sum("cents").over(TA.last(5)) / F.count("cents").over(TA.last(5))).alias("m5"), "season")
    df = tm.gather_prior(df.withColumn("post", post), TA, F.col("post"))
    fit = orders_timeline(spark, sf_dir).where("season < 1996 and is_event").agg((F.sum("cents") / F.count("*")).alias("mean"), F.median("cents").alias("median"))
    df = df.crossJoin(F.broadcast(fit))  # one row
    return df.where("season >= 1997").select("o_orderkey", F.coalesce(F.when(F.col("prior.season") >= F.col("season") - 1, F.col("prior.m5")), F.col("mean")).alias("rolling_or_mean"), F.coalesce(F.col("prior.m5"), F.col("median")).alias("rolling_or_median"))


def bootstrap_stat(spark, sf_dir, rounds: int = 1000):
    """Paired cluster bootstrap of a mean difference by user: draws by a fixed rule, sums per cluster first."""
    e = read(spark, sf_dir, "events").select("user_id", F.round("value").cast("long").alias("y"), (F.col("event_id") % 100).alias("p"))
    clusters = e.groupBy("user_id").agg(F.sum(F.abs(F.col("y") - F.col("p")) - F.abs(F.col("y") - 50)).alias("d"), F.count("*").alias("n"))
    clusters = numbered(clusters, ["user_id"]).withColumn("g", F.col("no") - 1)  # long: g * g passes 32 bits from 46,341 clusters on
    many = clusters.agg(F.count("*").alias("many"))
    spread = clusters.select("g").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "g")  # few clusters make many draws
    draws = spread.crossJoin(F.broadcast(many)).select(F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("i"), "g", "many")
    draws = draws.withColumn("pick", F.pmod(F.col("i") * 7919 + F.col("g") * (2 * F.col("i") + 3) + F.col("g") * F.col("g"), F.col("many")))
    own = clusters.select(F.col("g").alias("pick"), "d", "n").hint("shuffle_hash")  # a task holds its share of the clusters; the draws are not sorted
    stats = draws.select("i", "pick").join(own, "pick").groupBy("i").agg((F.sum("d") / F.sum("n")).alias("s"))
    return stats.agg(F.round(F.percentile("s", 0.025), 6).alias("low"), F.round(F.percentile("s", 0.975), 6).alias("high"), (F.count_if(F.col("s") < 0) / F.count("*")).alias("share_below"))


def capped_top_k(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("team"), F.round(F.col("c_acctbal") * 100).cast("long").alias("value"))
    return rel.capped_top(c, "team", [F.desc("value"), F.asc("c_custkey")], 6, 100)


def lineup_total(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("team"), F.round(F.col("c_acctbal") * 100).cast("long").alias("value"))
    order = [F.desc("value"), F.asc("c_custkey")]
    return rel.lineup_total(rel.capped_top(c, "team", order, 6, 10), order, "value")


def page_with_total(spark, sf_dir):
    o = _orders(spark, sf_dir).where("o_orderstatus = 'P'").select("o_orderkey", "cents")
    return rel.page(o, [F.desc("cents"), F.asc("o_orderkey")], 20, 50)


def ranked_slice(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.round(F.col("c_acctbal") * 100).cast("long").alias("model"), (F.col("c_custkey") % 7 == 0).alias("is_out"))
    c = c.withColumn("effective", F.when(F.col("is_out"), F.lit(0).cast("long")).otherwise(F.col("model")))
    rows = rel.ranked(c, [F.asc("is_out"), F.desc("effective"), F.desc("model"), F.asc("c_custkey")])
    return rows.where("rank > 100 and rank <= 300")


def union_precedence(spark, sf_dir):
    o = _orders(spark, sf_dir)
    a = o.where("o_orderstatus = 'P'").select("o_custkey", "day", "o_orderkey", F.lit("games").alias("origin"))
    b = o.where("o_orderstatus = 'F'").select("o_custkey", "day", "o_orderkey", F.lit("history").alias("origin"))
    c = o.select("o_custkey", "day", F.lit("upcoming").alias("origin"), "o_orderkey")
    return rel.first_by_precedence([a, b, c], ["o_custkey"], ["day", "o_orderkey"]).withColumn("day", F.col("day").cast("string"))


def set_diff(spark, sf_dir):
    a = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"))
    b = read(spark, sf_dir, "lineitem").where("l_quantity > 20").select(F.col("l_orderkey").alias("k"))
    return a.subtract(b).withColumn("kind", F.lit("minus")).unionByName(a.intersect(b).withColumn("kind", F.lit("both"))).unionByName(a.union(b).distinct().withColumn("kind", F.lit("either")))


_TERMS = {t: f"(l_quantity::BIGINT * {3 + i} + l_linenumber * {i}) % 23" for i, t in enumerate((*scoring.PLUS, *[x for pair in scoring.MISSES for x in pair], *scoring.MINUS))}


def score_formula(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    terms = [((F.col("l_quantity").cast("long") * (3 + i) + F.col("l_linenumber") * i) % 23).alias(t) for i, t in enumerate(_TERMS)]
    rows = li.select("l_orderkey", "l_partkey", "l_linenumber", (F.col("l_partkey") % 2 == 0).alias("won"), *terms).withColumn("pir", scoring.rating())
    rows = rows.withColumn("score", scoring.bonus_score("pir", "won"))
    return rows.groupBy("l_orderkey").agg(F.sum("pir").alias("pir"), F.sum((F.col("score") * 10).cast("long")).alias("score_tenths"), F.min("score").alias("least"), F.max("score").alias("most"))


def date_time_parse(spark, sf_dir):
    o = _orders(spark, sf_dir)
    rows = o.select("o_orderkey", "day", F.date_format("day", "MMM dd, yyyy").alias("text"), F.concat((F.col("o_orderkey") % 24).cast("string"), F.lit(":"), F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0")).alias("clock"), F.when(F.col("o_orderkey") % 9 == 0, "DNP").when(F.col("o_orderkey") % 9 == 1, " ").otherwise(F.concat((F.col("o_orderkey") % 45).cast("string"), F.lit(":"), F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0"))).alias("played"))
    m = parsing.minutes_played("played")
    utc = F.unix_micros(parsing.local_to_utc("day", "clock").cast("timestamp"))  # of a repeated hour the first counts
    return rows.select("o_orderkey", parsing.month_day_year("text").cast("string").alias("day"), utc.alias("utc_us"), F.round(m["minutes"], 6).alias("minutes"), m["dnp"].alias("dnp"), parsing.season_of("day").cast("long").alias("season"))


def search_tokens(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", parsing.ascii_search_key(F.concat_ws("-", "p_name", "p_brand")).alias("key"))
    return p.where(parsing.contains_words("key", F.lit("brand 1"))).select("p_partkey", "key")


def override_status(spark, sf_dir):
    """Availability by customer: out counts 0; notes; severity order as a rank."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.round(F.col("c_acctbal") * 100).cast("long").alias("model"), F.element_at(F.array(F.lit("out"), F.lit("doubtful"), F.lit("available"), F.lit(None).cast("string")), (F.col("c_custkey") % 4 + 1).cast("int")).alias("status"))
    notes = F.array_compact(F.array(F.when(F.col("status") == "out", "out"), F.when(F.col("status") == "doubtful", "doubtful"), F.when(F.col("model") < 0, "negative")))
    severity = F.when(F.col("status") == "out", 0).when(F.col("status") == "doubtful", 1).when(F.col("status") == "available", 2).otherwise(3)
    return c.select("c_custkey", F.when(F.col("status") == "out", F.lit(0).cast("long")).otherwise(F.col("model")).alias("effective"), F.concat_ws("; ", notes).alias("notes"), severity.cast("long").alias("severity"))


def quality_issues(spark, sf_dir):
    """Orders as box-score rows with defects by modulus."""
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders")
    fg2, fg3, ft = k % 9, k % 5, k % 7
    rows = o.select(
        F.year("o_orderdate").alias("season"), (k % 50).cast("int").alias("gamecode"), F.concat(F.lit("P"), (F.col("o_custkey")).cast("string")).alias("player_id"), F.when(k % 101 != 0, "T").alias("team_code"),
        F.when(k % 13 == 0, 0.0).otherwise(20.0).alias("minutes"), (k % 26 == 0).alias("dnp"),
        (2 * fg2 + 3 * fg3 + ft + F.when(k % 37 == 0, 1).otherwise(0)).alias("points"), fg2.alias("fg2_made"), (fg2 + F.when(k % 41 == 0, -1).otherwise(2)).alias("fg2_att"), fg3.alias("fg3_made"), (fg3 + 1).alias("fg3_att"), ft.alias("ft_made"), (ft + 1).alias("ft_att"),
        (k % 4).alias("off_reb"), (k % 6).alias("def_reb"), (k % 4 + k % 6 + F.when(k % 43 == 0, 1).otherwise(0)).alias("total_reb"), F.when(k % 47 == 0, -1).otherwise(k % 3).alias("assists"),
        *[(k % (3 + i)).alias(c) for i, c in enumerate(("steals", "turnovers", "blocks_for", "blocks_against", "fouls_committed", "fouls_received"))],
    )
    found = quality.box_score_issues(rows)
    return found.groupBy("check", "severity").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


def keyed_merge(spark, sf_dir):
    """Customers' first and last order year and name, merged from two loads with the player's rules."""
    o = _orders(spark, sf_dir).withColumn("y", F.year("day"))
    make = lambda rows, name: rows.groupBy(F.col("o_custkey").cast("string").alias("player_id")).agg(F.lit(name).alias("name"), F.min("y").cast("int").alias("first_season"), F.max("y").cast("int").alias("last_season"))
    old, new = make(o.where("o_orderstatus <> 'O'"), "old"), make(o.where("o_orderstatus = 'O'"), "new")
    return store.merge(old, new, ["player_id"], store.PLAYER_RESOLVER)


def post_load_verify(spark, sf_dir):
    """Rules after a load, each with the number of rows that break it."""
    g, s = games(spark, sf_dir), sides(spark, sf_dir)
    pair = s.withColumn("won", (F.col("own_score") > F.col("opp_score")).cast("int")).groupBy("gamecode").agg(F.count("*").alias("teams"), F.sum("won").alias("winners"))
    rules = [("games without winner", pair.where("winners = 0")), ("two teams", pair.where("teams <> 2")), ("same team", g.where("home_code = away_code")), ("played", g.where("home_score <= 0 or away_score <= 0")), ("large margin", g.where("abs(home_score - away_score) > 35"))]
    parts = [df.agg(F.count("*").alias("broken")).select(F.lit(name).alias("rule"), "broken") for name, df in rules]
    return store.union_all(parts)


def latest_next_row(spark, sf_dir):
    """Each customer's last order up to the middle of 1996 and the first after it."""
    o = _orders(spark, sf_dir)
    last = rel.latest_row(o.where("day <= '1996-06-30'"), ["o_custkey"], [F.desc("day"), F.desc("o_orderkey")]).select("o_custkey", F.col("o_orderkey").alias("last_order"))
    after = rel.latest_row(o.where("day > '1996-06-30'"), ["o_custkey"], [F.asc("day"), F.asc("o_orderkey")]).select("o_custkey", F.col("o_orderkey").alias("next_order"))
    return last.join(after, "o_custkey", "full_outer").select("o_custkey", "last_order", "next_order")


def active_set(spark, sf_dir):
    """Customers with an order in the reference season or in the 45 days up to as_of (the last order day)."""
    o = _orders(spark, sf_dir).withColumn("season", F.year("day"))
    at = o.agg(F.max("day").alias("as_of"))
    first = o.groupBy("season").agg(F.min("day").alias("starts")).crossJoin(F.broadcast(at))  # one row
    reference = first.agg(F.coalesce(F.max(F.when(F.col("starts") <= F.col("as_of"), F.col("season"))), F.max("season")).alias("reference"), F.first("as_of").alias("as_of"))
    rows = o.crossJoin(F.broadcast(reference))  # one row
    active = rows.where((F.col("season") == F.col("reference")) | F.col("day").between(F.date_sub("as_of", 45), F.col("as_of")))
    return active.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("day").cast("string").alias("last_day"))


def neutral_rows(spark, sf_dir):
    """The next order after 1998-06-30 of every customer, or a neutral row."""
    o, c = _orders(spark, sf_dir), read(spark, sf_dir, "customer").select("c_custkey")
    nxt = rel.latest_row(o.where("day > '1998-06-30'"), ["o_custkey"], [F.asc("day"), F.asc("o_orderkey")])
    joined = c.join(nxt, c.c_custkey == nxt.o_custkey, "left")
    known = F.col("o_orderkey").isNotNull()
    return joined.select("c_custkey", F.coalesce("o_orderkey", F.lit(-1)).alias("gamecode"), F.coalesce("day", F.lit("1998-07-01").cast("date")).cast("string").alias("day"), F.when(known, F.col("cents")).alias("cents"))


def search_keys(spark, sf_dir):
    """The normalised key of every whole text, by its digest."""
    d = read(spark, sf_dir, "documents").select("doc_id", parsing.search_key("text").alias("key"))
    return d.select("doc_id", F.length("key").cast("long").alias("key_chars"), F.md5("key").alias("key_md5"))


_PRICED = Table("priced", T.StructType([T.StructField("o_orderkey", T.LongType(), False), T.StructField("cents", T.LongType()), T.StructField("price", T.DoubleType()), T.StructField("day", T.DateType())]), ("o_orderkey",))


def copy_differences(spark, sf_dir):
    """What tells orders from a copy in another layout in which a thousand was put on one order in 97; the sum of their prices as doubles is no difference."""
    own = _orders(spark, sf_dir).select("o_orderkey", "cents", F.col("o_totalprice").cast("double").alias("price"), "day")
    other = own.repartition(5, "day").withColumn("cents", F.col("cents") + F.when(F.col("o_orderkey") % 97 == 5, 100_000).otherwise(0))
    found = store.verify(own, other, _PRICED).where("metric <> 'digest'")
    return found.select("metric", F.col("source").cast("double").alias("source"), F.col("target").cast("double").alias("target"))


def exact_quantiles(spark, sf_dir):
    """Median and 97.5 % point of the lines' numbers, by counting."""
    li, columns = read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = [(c, share, v) for share in (0.5, 0.975) for c, v in quantiles.exact_quantiles(li, columns, share).items()]
    return spark.createDataFrame(rows, "name string, share double, value double").withColumn("value", F.round("value", 6))


QUERIES = {f.__name__: f for f in (search_keys, copy_differences, exact_quantiles, history_scan, full_outer_flags, validated_left_join, rows_per_customer, two_side_feature_join, anti_semi, outer_arith, three_way_eval, group_complete_flag, latest_name, distinct_gt_one, season_summary, two_level_winner, table_aggregates, content_digest, reg_metrics, segments, baseline_chain, bootstrap_stat, capped_top_k, lineup_total, page_with_total, ranked_slice, union_precedence, set_diff, score_formula, date_time_parse, search_tokens, override_status, quality_issues, keyed_merge, post_load_verify, latest_next_row, active_set, neutral_rows)}

_pir = " + ".join(_TERMS[t] for t in scoring.PLUS) + "".join(f" - ({_TERMS[a]} - {_TERMS[m]})" for a, m in scoring.MISSES) + "".join(f" - {_TERMS[t]}" for t in scoring.MINUS)
_names = "SELECT CAST(o_custkey AS VARCHAR) AS id, o_orderpriority AS name FROM orders"
_issue = lambda check, severity, where: f"SELECT '{check}' AS check_, '{severity}' AS severity, player_id AS key FROM w WHERE {where}"

SQL = {
    "search_keys": r"""WITH k AS (SELECT doc_id, trim(regexp_replace(translate(replace(replace(replace(replace(strip_accents(lower(replace(text, 'ß', 'ss'))), chr(39), ''), '’', ''), '.', ''), 'æ', 'ae'), 'đłøı-/,', 'dloi   '), '\s+', ' ', 'g')) AS key FROM documents)
        SELECT doc_id, length(key) AS key_chars, md5(key) AS key_md5 FROM k""",
    "copy_differences": f"""WITH {_O}, a AS (SELECT o_orderkey, cents, cents + CASE WHEN o_orderkey % 97 = 5 THEN 100000 ELSE 0 END AS other FROM o),
        m AS (SELECT unnest(['sum cents', 'min cents', 'max cents']) AS metric, unnest([sum(cents)::DOUBLE, min(cents)::DOUBLE, max(cents)::DOUBLE]) AS source, unnest([sum(other)::DOUBLE, min(other)::DOUBLE, max(other)::DOUBLE]) AS target FROM a)
        SELECT * FROM m WHERE abs(source - target) > greatest(1e-9 * greatest(abs(source), abs(target)), 1e-6)""",
    "exact_quantiles": " UNION ALL ".join(f"SELECT '{c}' AS name, {s}::DOUBLE AS share, round(quantile_cont({c}::DOUBLE, {s}), 6) AS value FROM lineitem" for s in (0.5, 0.975) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
    "history_scan": "SELECT o_orderkey, o_custkey, count(*) AS lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS returned FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY ALL",
    "full_outer_flags": f"""WITH {_O}, a AS (SELECT o_orderkey, cents, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS s FROM o WHERE day < '1997-07-01'), b AS (SELECT o_orderkey, cents, o_orderstatus AS s FROM o WHERE day >= '1994-01-01')
        SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'right_only' WHEN b.o_orderkey IS NULL THEN 'left_only' ELSE 'both' END AS side, coalesce(a.cents, b.cents) AS cents, coalesce(a.s, b.s) AS status FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""",
    "validated_left_join": "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE o_custkey END AS o_custkey FROM orders) SELECT o_orderkey, o_custkey, CAST(c_nationkey AS BIGINT) AS nation, c_mktsegment FROM o LEFT JOIN customer ON o_custkey = c_custkey",
    "rows_per_customer": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "two_side_feature_join": f"WITH {GAMES_SQL}, t AS (SELECT gamecode, team, opp, row_number() OVER (PARTITION BY team ORDER BY ts, gamecode) AS no, own_score AS scored FROM sides) SELECT a.gamecode, a.team, a.opp, a.no, b.no AS opp_no, a.scored, b.scored AS opp_scored, b.no IS NOT NULL AS known FROM t a LEFT JOIN t b ON a.gamecode = b.gamecode AND a.opp = b.team",
    "anti_semi": "SELECT 'customer without order' AS kind, c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT 'open with large line', o_orderkey FROM orders WHERE o_orderstatus = 'O' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)",
    "outer_arith": "WITH a AS (SELECT l_orderkey AS k, sum(CAST(l_quantity AS BIGINT)) AS q, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1), b AS (SELECT o_orderkey AS k, o_orderkey % 97 AS q, 4 AS n FROM orders) SELECT coalesce(a.k, b.k) AS k, CAST(coalesce(a.q, 0) - coalesce(b.q, 0) AS BIGINT) AS q, CAST(coalesce(a.n, 0) - coalesce(b.n, 0) AS BIGINT) AS n FROM a FULL JOIN b ON a.k = b.k",
    "three_way_eval": """WITH box AS (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS actual FROM lineitem GROUP BY 1),
        j AS (SELECT 'v' || (event_id % 3) AS version, CAST(round(value) AS BIGINT) AS predicted, actual, CASE WHEN o_orderstatus = 'O' THEN 'pending' WHEN actual IS NULL THEN 'not_in_boxscore' WHEN actual < 20 THEN 'dnp' ELSE 'appeared' END AS status FROM events JOIN orders ON event_id = o_orderkey LEFT JOIN box ON o_orderkey = l_orderkey)
        SELECT version, count(*) AS n, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'not_in_boxscore') AS not_in_boxscore, count(*) FILTER (status = 'dnp') AS dnp, count(*) FILTER (status = 'appeared') AS appeared,
        CAST(sum(abs(predicted - actual)) FILTER (status = 'appeared') AS DOUBLE) / count(*) FILTER (status = 'appeared') AS mae, CAST(sum(predicted - actual) FILTER (status = 'appeared') AS DOUBLE) / count(*) FILTER (status = 'appeared') AS bias FROM j GROUP BY version""",
    "group_complete_flag": """WITH m AS (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS minutes, count(*) AS n FROM lineitem GROUP BY 1)
        SELECT l_orderkey, minutes, n, CAST(round_even((minutes - 200) / 25.0, 0) AS BIGINT) AS overtimes, abs(minutes - (200 + 25 * greatest(round_even((minutes - 200) / 25.0, 0), 0))) <= 1.5 AS complete FROM m""",
    "latest_name": f"""WITH {_O}, n AS (SELECT *, CASE WHEN o_orderkey % 4 <> 0 THEN 'n' || (o_orderkey % 3) END AS name, CASE WHEN o_orderkey % 6 <> 0 THEN day END AS d FROM o),
        l AS (SELECT o_custkey, name FROM n WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY d DESC NULLS FIRST, o_orderkey DESC) = 1)
        SELECT s.o_custkey, name, first_season, last_season FROM (SELECT o_custkey, min(year(day)) AS first_season, max(year(day)) AS last_season FROM o GROUP BY 1) s LEFT JOIN l USING (o_custkey)""",
    "distinct_gt_one": f"WITH x AS (SELECT DISTINCT * FROM ({_names})) SELECT 'one_id_many_names' AS kind, id AS subject, name AS other, count(*) OVER (PARTITION BY id) AS n FROM x QUALIFY n > 1 UNION ALL SELECT 'one_name_many_ids', name, id, count(*) OVER (PARTITION BY name) AS n FROM x QUALIFY n > 1",
    "season_summary": f"""WITH {_O}, g AS (SELECT year(day) AS season, count(*) AS games, count(*) FILTER (o_orderstatus = 'F') AS played, count(DISTINCT o_custkey) AS customers, max(cents) AS largest FROM o GROUP BY 1), r AS (SELECT year(l_shipdate) AS season, count(*) AS rows, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1)
        SELECT coalesce(g.season, r.season) AS season, games, played, customers, largest, rows, returned, round(CAST(rows AS DOUBLE) / nullif(games, 0), 2) AS rows_per_game FROM g FULL JOIN r ON g.season = r.season""",
    "two_level_winner": f"WITH {GAMES_SQL}, t AS (SELECT gamecode, team, max(CAST(own_score > opp_score AS BIGINT)) AS won FROM sides GROUP BY 1, 2) SELECT gamecode, CAST(sum(won) AS BIGINT) AS winners, count(*) AS teams FROM t GROUP BY 1 HAVING sum(won) <> 1 OR count(*) <> 2",
    "table_aggregates": f"WITH {_O} SELECT count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, CAST(min(day) AS VARCHAR) AS first, CAST(max(day) AS VARCHAR) AS last, count(*) FILTER (o_orderstatus = 'F') AS done, CAST(max(day) FILTER (o_orderstatus = 'F') AS VARCHAR) AS last_done, CAST(min(day) FILTER (o_orderstatus = 'O') AS VARCHAR) AS next_open FROM o",
    "content_digest": "SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(md5("
    + " || ".join(f"coalesce(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '~')" for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))
    + "), 1, 15) AS BIGINT)) % 18446744073709551616 AS VARCHAR) AS digest FROM customer",
    "reg_metrics": """WITH e AS (SELECT event_type, CAST(round(value) AS BIGINT) AS y, user_id % 100 AS p FROM events)
        SELECT event_type, count(*) AS n, CAST(sum(abs(p - y)) AS DOUBLE) / count(*) AS mae, round(sqrt(CAST(sum((p - y) * (p - y)) AS DOUBLE) / count(*)), 6) AS rmse,
        round(1 - CAST(count(*) * sum((p - y) * (p - y)) AS DOUBLE) / CAST(nullif(count(*) * sum(y * y) - sum(y) * sum(y), 0) AS DOUBLE), 6) AS r2, CAST(sum(p - y) AS DOUBLE) / count(*) AS bias FROM e GROUP BY 1""",
    "segments": """WITH e AS (SELECT event_type, CAST(round(value) AS BIGINT) AS y, CASE WHEN user_id % 40 > 0 THEN user_id % 40 END AS minutes, event_id % 8 AS prior FROM events),
        s AS (SELECT 'minutes' AS segment, CASE WHEN minutes IS NULL THEN 'none' WHEN minutes < 10 THEN '<10' WHEN minutes <= 20 THEN '10-20' ELSE '>20' END AS label, y, prior FROM e UNION ALL SELECT 'prior', CASE WHEN prior < 5 THEN '<5' ELSE '>=5' END, y, prior FROM e UNION ALL SELECT 'phase', CASE WHEN event_type = 'click' THEN 'RS' WHEN event_type IS NULL THEN 'unknown' ELSE 'other' END, y, prior FROM e)
        SELECT segment, label, count(*) AS n, CAST(sum(abs(y)) AS DOUBLE) / count(*) AS mae_zero, CAST(sum(abs(y - prior)) AS DOUBLE) / count(*) AS mae_prior, CAST(sum(abs(y - 50)) AS DOUBLE) / count(*) AS mae_fifty FROM s GROUP BY 1, 2""",
    "baseline_chain": """WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate AS ts, o_orderstatus <> 'F' AS is_event, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CAST(year(o_orderdate) AS INT) AS season FROM orders),
        post AS (SELECT *, CAST(sum(cents) OVER w AS DOUBLE) / count(*) OVER w AS m5 FROM o WHERE is_event WINDOW w AS (PARTITION BY o_custkey ORDER BY ts, o_orderkey ROWS 4 PRECEDING)), final AS (SELECT * FROM post QUALIFY row_number() OVER (PARTITION BY o_custkey, ts ORDER BY o_orderkey DESC) = 1),
        fit AS (SELECT CAST(sum(cents) AS DOUBLE) / count(*) AS mean, median(cents) AS median FROM o WHERE season < 1996 AND is_event)
        SELECT b.o_orderkey, coalesce(CASE WHEN p.season >= b.season - 1 THEN m5 END, mean) AS rolling_or_mean, coalesce(m5, median) AS rolling_or_median FROM (SELECT * FROM o WHERE season >= 1997) b ASOF LEFT JOIN final p ON b.o_custkey = p.o_custkey AND b.ts > p.ts CROSS JOIN fit""",
    "bootstrap_stat": """WITH c AS (SELECT user_id, CAST(sum(abs(CAST(round(value) AS BIGINT) - event_id % 100) - abs(CAST(round(value) AS BIGINT) - 50)) AS BIGINT) AS d, count(*) AS n FROM events GROUP BY 1), g AS (SELECT *, row_number() OVER (ORDER BY user_id) - 1 AS g, count(*) OVER () AS big FROM c),
        draws AS (SELECT i, (i * 7919 + g * (2 * i + 3) + g * g) % big AS pick FROM g, range(1000) r(i)), s AS (SELECT i, CAST(sum(d) AS DOUBLE) / sum(n) AS s FROM draws JOIN g ON pick = g.g GROUP BY i)
        SELECT round(quantile_cont(s, 0.025), 6) AS low, round(quantile_cont(s, 0.975), 6) AS high, CAST(count(*) FILTER (s < 0) AS DOUBLE) / count(*) AS share_below FROM s""",
    "capped_top_k": "WITH c AS (SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS team, CAST(round(c_acctbal * 100) AS BIGINT) AS value FROM customer) SELECT * FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY team ORDER BY value DESC, c_custkey) <= 6) ORDER BY value DESC, c_custkey LIMIT 100",
    "lineup_total": "WITH c AS (SELECT c_custkey, c_nationkey AS team, CAST(round(c_acctbal * 100) AS BIGINT) AS value FROM customer), t AS (SELECT * FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY team ORDER BY value DESC, c_custkey) <= 6) ORDER BY value DESC, c_custkey LIMIT 10), p AS (SELECT *, row_number() OVER (ORDER BY value DESC, c_custkey) AS p FROM t) SELECT sum(value * CASE WHEN p = 1 THEN 2.0::DOUBLE WHEN p <= 6 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS total, count(*) AS picks FROM p",
    "page_with_total": f"WITH {_O} SELECT o_orderkey, cents, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS total FROM o WHERE o_orderstatus = 'P' ORDER BY cents DESC, o_orderkey LIMIT 50 OFFSET 20",
    "ranked_slice": "WITH c AS (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS model, c_custkey % 7 = 0 AS is_out FROM customer), e AS (SELECT *, CASE WHEN is_out THEN 0 ELSE model END AS effective FROM c) SELECT *, row_number() OVER (ORDER BY is_out, effective DESC, model DESC, c_custkey) AS rank FROM e QUALIFY rank > 100 AND rank <= 300",
    "union_precedence": f"WITH {_O}, u AS (SELECT o_custkey, day, o_orderkey, 'games' AS origin, 0 AS part FROM o WHERE o_orderstatus = 'P' UNION ALL SELECT o_custkey, day, o_orderkey, 'history', 1 FROM o WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, day, o_orderkey, 'upcoming', 2 FROM o) SELECT o_custkey, CAST(day AS VARCHAR) AS day, o_orderkey, origin FROM u QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY part, day, o_orderkey) = 1",
    "set_diff": "WITH a AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT l_orderkey AS k FROM lineitem WHERE l_quantity > 20) SELECT k, 'minus' AS kind FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'both' FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT k, 'either' FROM (SELECT k FROM a UNION SELECT k FROM b)",
    "score_formula": f"WITH r AS (SELECT l_orderkey, l_partkey % 2 = 0 AS won, {_pir} AS pir FROM lineitem), s AS (SELECT *, CASE WHEN won THEN CAST(pir * 10 + abs(pir) AS DOUBLE) / 10 ELSE CAST(pir AS DOUBLE) END AS score FROM r) SELECT l_orderkey, CAST(sum(pir) AS BIGINT) AS pir, CAST(sum(CAST(trunc(score * 10) AS BIGINT)) AS BIGINT) AS score_tenths, min(score) AS least, max(score) AS most FROM s GROUP BY 1",
    "date_time_parse": """WITH o AS (SELECT o_orderkey, CAST(strptime(strftime(o_orderdate, '%b %d, %Y'), '%b %d, %Y') AS DATE) AS day FROM orders)
        , w AS (SELECT *, CAST(day AS TIMESTAMP) + to_hours(o_orderkey % 24) + to_minutes(o_orderkey % 60) AS wall FROM o), u AS (SELECT *, wall AT TIME ZONE 'Europe/Madrid' AS utc FROM w)
        SELECT o_orderkey, CAST(day AS VARCHAR) AS day, epoch_us(CASE WHEN (utc - INTERVAL 1 HOUR) AT TIME ZONE 'Europe/Madrid' = wall THEN utc - INTERVAL 1 HOUR ELSE utc END) AS utc_us,
        CASE WHEN o_orderkey % 9 IN (0, 1) THEN 0.0 ELSE round(CAST(o_orderkey % 45 AS DOUBLE) + CAST(o_orderkey % 60 AS DOUBLE) / 60, 6) END AS minutes, o_orderkey % 9 = 0 AS dnp, year(day) - CAST(month(day) < 8 AS BIGINT) AS season FROM u""",
    "search_tokens": "WITH p AS (SELECT p_partkey, trim(regexp_replace(translate(translate(lower(p_name || '-' || p_brand), '''.', ''), '-/,', '   '), ' +', ' ', 'g')) AS key FROM part) SELECT * FROM p WHERE contains(key, 'brand') AND contains(key, '1')",
    "override_status": "WITH c AS (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS model, CASE c_custkey % 4 WHEN 0 THEN 'out' WHEN 1 THEN 'doubtful' WHEN 2 THEN 'available' END AS status FROM customer) SELECT c_custkey, CASE WHEN status = 'out' THEN 0 ELSE model END AS effective, concat_ws('; ', CASE WHEN status = 'out' THEN 'out' END, CASE WHEN status = 'doubtful' THEN 'doubtful' END, CASE WHEN model < 0 THEN 'negative' END) AS notes, CAST(CASE WHEN status = 'out' THEN 0 WHEN status = 'doubtful' THEN 1 WHEN status = 'available' THEN 2 ELSE 3 END AS BIGINT) AS severity FROM c",
    "quality_issues": """WITH k AS (SELECT o_orderkey AS k, o_custkey, year(o_orderdate) AS season FROM orders), r AS (SELECT season, k % 50 AS gamecode, 'P' || o_custkey AS player_id, k % 101 = 0 AS missing, k, count(*) OVER (PARTITION BY season, k % 50, o_custkey) AS n FROM k), w AS (SELECT *, NOT missing AS whole FROM r)
        SELECT check_ AS "check", severity, count(*) AS n, count(DISTINCT key) AS keys FROM ("""
    + " UNION ALL ".join(
        _issue(*x)
        for x in (
            ("duplicate_key", "error", "n > 1"),
            ("missing_values", "error", "missing"),
            ("points_formula", "error", "whole AND k % 37 = 0"),
            ("rebounds_sum", "error", "whole AND k % 43 = 0"),
            ("made_exceeds_attempted", "warning", "whole AND k % 41 = 0"),
            ("negative_stat", "warning", "whole AND (k % 47 = 0 OR (k % 41 = 0 AND k % 9 = 0))"),
            ("dnp_with_stats", "warning", "whole AND k % 26 = 0"),
            ("zero_minutes_not_dnp", "warning", "whole AND k % 13 = 0 AND k % 26 <> 0"),
        )
    )
    + ") GROUP BY 1, 2",
    "keyed_merge": """WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS player_id, o_orderstatus, CAST(year(o_orderdate) AS INT) AS y FROM orders), a AS (SELECT player_id, 'old' AS name, min(y) AS f, max(y) AS l FROM o WHERE o_orderstatus <> 'O' GROUP BY 1), b AS (SELECT player_id, 'new' AS name, min(y) AS f, max(y) AS l FROM o WHERE o_orderstatus = 'O' GROUP BY 1)
        SELECT coalesce(a.player_id, b.player_id) AS player_id, CASE WHEN a.name IS NULL OR b.l >= a.l THEN b.name ELSE a.name END AS name, least(a.f, b.f) AS first_season, greatest(a.l, b.l) AS last_season FROM a FULL JOIN b ON a.player_id = b.player_id""",
    "post_load_verify": f"""WITH {GAMES_SQL}, p AS (SELECT gamecode, count(*) AS teams, sum(CAST(own_score > opp_score AS INT)) AS winners FROM sides GROUP BY 1)
        SELECT 'games without winner' AS rule, count(*) AS broken FROM p WHERE winners = 0 UNION ALL SELECT 'two teams', count(*) FROM p WHERE teams <> 2 UNION ALL SELECT 'same team', count(*) FROM games WHERE home_code = away_code UNION ALL SELECT 'played', count(*) FROM games WHERE home_score <= 0 OR away_score <= 0 UNION ALL SELECT 'large margin', count(*) FROM games WHERE abs(home_score - away_score) > 35""",
    "latest_next_row": f"WITH {_O}, a AS (SELECT o_custkey, o_orderkey FROM o WHERE day <= '1996-06-30' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY day DESC, o_orderkey DESC) = 1), b AS (SELECT o_custkey, o_orderkey FROM o WHERE day > '1996-06-30' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY day, o_orderkey) = 1) SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.o_orderkey AS last_order, b.o_orderkey AS next_order FROM a FULL JOIN b ON a.o_custkey = b.o_custkey",
    "active_set": f"WITH {_O}, s AS (SELECT year(day) AS season, min(day) AS starts FROM o GROUP BY 1), r AS (SELECT coalesce(max(season) FILTER (starts <= {_LATEST}), max(season)) AS reference FROM s) SELECT o_custkey, count(*) AS n, CAST(max(day) AS VARCHAR) AS last_day FROM o, r WHERE year(day) = reference OR day BETWEEN {_LATEST} - 45 AND {_LATEST} GROUP BY 1",
    "neutral_rows": f"WITH {_O}, n AS (SELECT * FROM o WHERE day > '1998-06-30' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY day, o_orderkey) = 1) SELECT c_custkey, coalesce(o_orderkey, -1) AS gamecode, CAST(coalesce(day, DATE '1998-07-01') AS VARCHAR) AS day, cents FROM customer LEFT JOIN n ON c_custkey = o_custkey",
}
