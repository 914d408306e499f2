"""Scores in exact integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The rating's terms.
PLUS = ("points", "total_reb", "assists", "steals", "blocks_for", "fouls_received")
MISSES = (("fg2_att", "fg2_made"), ("fg3_att", "fg3_made"), ("ft_att", "ft_made"))
MINUS = ("turnovers", "blocks_against", "fouls_committed")


def rating(columns: dict[str, str] | None = None) -> Column:
    """Performance index: PLUS, less attempts missed, less MINUS. columns: other names for the terms. A part of a point is an error."""
    name = (columns or {}).get
    terms = {c: F.col(name(c, c)) for c in (*PLUS, *[x for pair in MISSES for x in pair], *MINUS)}
    broken = F.coalesce(*[F.when(c != F.floor(c), F.lit(name(k, k))) for k, c in terms.items()])
    whole = {k: c.cast("bigint") for k, c in terms.items()}
    total = whole[PLUS[0]]
    for c in PLUS[1:]:
        total = total + whole[c]
    for tried, made in MISSES:
        total = total - (whole[tried] - whole[made])
    for c in MINUS:
        total = total - whole[c]
    return F.when(broken.isNotNull(), F.raise_error(F.concat(broken, F.lit(" is not an integer"))).cast("bigint")).otherwise(total)


def bonus_score(rating_: Column | str, won: Column | str) -> Column:
    """The rating, a tenth of its magnitude more where the team won: one exact division. A null won is an error."""
    p = (F.col(rating_) if isinstance(rating_, str) else rating_).cast("bigint")
    w = F.col(won) if isinstance(won, str) else won
    score = F.when(w, (p * 10 + F.abs(p)) / F.lit(10)).otherwise(p.cast("double"))
    return F.when(w.isNull(), F.raise_error(F.lit("won is null")).cast("double")).otherwise(score)
