"""Parsers and normalisers as column expressions."""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def month_day_year(text: Column | str) -> Column:
    """'Mon DD, YYYY' or a full English month name, whatever the locale; null where it is no date."""
    parts = F.regexp_extract(F.trim(_c(text)), r"^([A-Za-z]{3})[A-Za-z]* +(\d{1,2}), *(\d{4})$", 0)
    month = F.initcap(F.regexp_extract(F.trim(_c(text)), r"^([A-Za-z]{3})", 1))
    rest = F.regexp_extract(F.trim(_c(text)), r"(\d{1,2}, *\d{4})$", 1)
    plain = F.concat_ws(" ", month, F.regexp_replace(rest, ", *", ", "))
    return F.when(parts != "", F.try_to_timestamp(plain, F.lit("MMM d, yyyy")).cast("date"))


def local_to_utc(date: Column | str, clock: Column | str, zone: str = "Europe/Madrid") -> Column:
    """A date and 'HH:MM' of the zone as naive UTC; null where either does not parse."""
    local = F.try_to_timestamp(F.concat_ws(" ", _c(date).cast("date").cast("string"), F.trim(_c(clock))), F.lit("yyyy-MM-dd H:mm"))
    return F.when(F.trim(_c(clock)).rlike(r"^\d{1,2}:\d{2}$"), F.to_utc_timestamp(local, zone).cast("timestamp_ntz"))


def minutes_played(text: Column | str) -> Column:
    """Struct (minutes, dnp): 'MM:SS' in decimal minutes, 'DNP' as (0, true), blank as (0, false); else an error."""
    t = F.upper(F.trim(F.coalesce(_c(text), F.lit(""))))
    clock = r"^(\d{1,3}):([0-5]\d)$"
    played = F.substring_index(t, ":", 1).try_cast("double") + F.substring_index(t, ":", -1).try_cast("double") / 60
    minutes = F.when(t.isin("", "DNP"), F.lit(0.0)).when(t.rlike(clock), played).otherwise(F.raise_error(F.concat(F.lit("minutes: "), t)).cast("double"))
    return F.struct(minutes.alias("minutes"), (t == "DNP").alias("dnp"))


def text_true(text: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(_c(text))) == "true", F.lit(False))


def season_of(date: Column | str, first_month: int = 8) -> Column:
    d = _c(date)
    return F.year(d) - (F.month(d) < first_month).cast("int")


def canonical_id(text: Column | str) -> Column:
    return F.upper(F.trim(_c(text)))


def valid_player_id(text: Column | str) -> Column:
    return canonical_id(text).rlike(r"^P[A-Z0-9]{3,6}$")


@F.pandas_udf(StringType())
def name_key(names: pd.Series) -> pd.Series:
    """Decomposed, without combining marks, upper case, single spaces (Unicode decomposition has no built-in)."""
    bare = lambda x: " ".join("".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).upper().split())
    return names.map(bare, na_action="ignore")


#: Letters that do not decompose.
LETTERS = {"đ": "d", "ł": "l", "ø": "o", "ı": "i", "æ": "ae", "œ": "oe"}


def search_text(x: str) -> str:
    """Case-folded, without marks, LETTERS replaced, apostrophes and full stops dropped, '-', '/' and ',' as spaces."""
    folded = unicodedata.normalize("NFKD", x.casefold())
    kept = "".join(LETTERS.get(c, c) for c in folded if not unicodedata.combining(c))
    for c in "'’.":
        kept = kept.replace(c, "")
    for c in "-/,":
        kept = kept.replace(c, " ")
    return " ".join(kept.split())


@F.pandas_udf(StringType())
def search_key(names: pd.Series) -> pd.Series:
    """search_text of a column (Unicode decomposition has no built-in)."""
    return names.map(search_text, na_action="ignore")


def ascii_search_key(text: Column | str) -> Column:
    """search_key for ASCII names, in built-in functions only."""
    spaced = F.translate(F.translate(F.lower(_c(text)), "'.", ""), "-/,", "   ")
    return F.trim(F.regexp_replace(spaced, " +", " "))


def client_key(text: Column | str) -> Column:
    """The client's normaliser: it removes . , ' - and leaves no space in their place."""
    return F.trim(F.regexp_replace(F.translate(F.lower(_c(text)), ".,'’-", ""), " +", " "))


def contains_words(key: Column | str, query: Column | str) -> Column:
    """Every word of the query is a substring of the key."""
    k = _c(key)
    return F.forall(F.filter(F.split(_c(query), " "), lambda w: w != ""), lambda w: F.contains(k, w))


def display_name(name: Column | str) -> Column:
    """'LAST, FIRST' as 'First Last'."""
    n = _c(name)
    turned = F.concat_ws(" ", F.trim(F.element_at(F.split(n, ","), 2)), F.trim(F.element_at(F.split(n, ","), 1)))
    return F.initcap(F.when(F.size(F.split(n, ",")) == 2, turned).otherwise(F.trim(n)))


def round2(x: Column | str) -> Column:
    """Two decimals, never a negative zero."""
    return F.round(_c(x), 2) + F.lit(0.0)


def nearly_equal(a: Column | str, b: Column | str, relative: float = 1e-9, absolute: float = 1e-6) -> Column:
    """Null equals null."""
    a, b = _c(a), _c(b)
    near = F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
    return F.coalesce(near, a.isNull() & b.isNull())


def bucket(x: Column | str, bounds: list[tuple[float, str]], last: str, missing: str) -> Column:
    """The first name whose bound x is below; last where none is."""
    c = _c(x)
    out = F.when(c.isNull(), missing)
    for bound, name in bounds:
        out = out.when(c < bound, name)
    return out.otherwise(last)


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package
