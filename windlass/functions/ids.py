"""Column functions for race ids, keys, seasons and eligibility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "Unknown"


def race_number(race_id: Column) -> Column:
    return F.regexp_extract(race_id, r"/(\d+)[A-Z]?$", 1).try_cast("int")


def race_division(race_id: Column) -> Column:
    return F.substring(race_id, -1, 1)


def adjusted_race_id(race_id: Column, scoring: Column) -> Column:
    """Combined scoring sails all divisions as one race: drop the letter."""
    return F.when(scoring == "Combined", F.regexp_replace(race_id, r".$", "")).otherwise(race_id)


def known(col: Column) -> Column:
    """The literal 'Unknown' and NULL both mean missing; inside it is NULL."""
    return F.nullif(col, F.lit(UNKNOWN))


def surrogate_key(link: Column, name: Column, team: Column, sep: str = "-") -> Column:
    return F.coalesce(known(link), F.concat_ws(sep, name, team))


def partner_key(link: Column, name: Column, team: Column, sep: str = "/") -> Column:
    """Link, else name and team, else 'Unknown'."""
    named = F.when(known(name).isNotNull(), F.concat_ws(sep, name, team))
    return F.coalesce(known(link), named, F.lit(UNKNOWN))


def season_of(race_id: Column) -> Column:
    return F.split_part(race_id, F.lit("/"), F.lit(1))


def season_code(date: Column) -> Column:
    half = F.when(F.month(date) <= 6, "s").otherwise("f")
    return F.concat(half, F.lpad((F.year(date) % 100).cast("string"), 2, "0"))


def season_list(first: int | Column, last: int | Column) -> Column:
    """['f16','s16','f17',...] for the years first..last, in two digits."""
    years = F.sequence(F.lit(first), F.lit(last))
    return F.flatten(
        F.transform(
            years,
            lambda y: F.transform(
                F.array(F.lit("f"), F.lit("s")),
                lambda h: F.concat(h, F.lpad((y % 100).cast("string"), 2, "0")),
            ),
        )
    )


def grad_year(year: Column) -> Column:
    """'2026' -> 2026 and '25 Jr' -> 2025; anything else NULL."""
    head = F.split_part(year, F.lit(" "), F.lit(1)).try_cast("int")
    return F.when(year.contains(" "), head + 2000).otherwise(head)


def slug(name: Column) -> Column:
    return F.lower(F.translate(name, " /", "--"))


def parse_date(value: Column) -> Column:
    """ISO date or timestamp, MM/DD/YYYY, epoch milliseconds, or y,m,d tuple."""
    tuple_text = F.regexp_replace(F.regexp_replace(value, r"[()\s]", ""), ",", "-")
    epoch_ms = F.when(value.rlike(r"^-?\d{9,}$"), value.try_cast("bigint"))
    return F.coalesce(
        F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(value, 1, 10))),
        F.when(value.contains("/"), F.try_to_date(value, "M/d/yyyy")),
        F.to_date(F.timestamp_millis(epoch_ms)),
        F.when(value.contains(","), F.try_to_date(tuple_text, "y-M-d")),
    )


def race_range(text: Column, race_count: Column) -> Column:
    """'' -> 1..n; '1-3,5' -> [1,2,3,5]."""
    parts = F.transform(
        F.split(F.regexp_replace(text, r"\s", ""), ","),
        lambda p: F.sequence(
            F.split_part(p, F.lit("-"), F.lit(1)).cast("int"),
            F.element_at(F.split(p, "-"), -1).cast("int"),
        ),
    )
    return F.when(F.trim(text) == "", F.sequence(F.lit(1), race_count)).otherwise(F.flatten(parts))


def score_cell(text: Column, title: Column) -> Column:
    """Digits, else the first number in a title such as '(12, DNF)'."""
    plain = F.when(text.rlike(r"^\d+$"), text.try_cast("int"))
    return F.coalesce(plain, F.regexp_extract(title, r"^\((\d+)", 1).try_cast("int"))


def needs_fetch(
    seen: Column, status: Column, date: Column, today: Column, max_age: int = 14
) -> Column:
    """Unseen, or unofficial and at most `max_age` days old."""
    return (~seen) | ((status != "Official") & (F.datediff(today, date) <= max_age))


def quoted_list(text: Column) -> Column:
    """"['A', \"O'Brien\"]" -> array('A', "O'Brien"): items in either kind of
    quotes, with backslash escapes."""
    item = r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")"""
    return F.transform(
        F.regexp_extract_all(text, F.lit(item), F.lit(1)),
        lambda q: F.regexp_replace(F.substring(q, F.lit(2), F.length(q) - 2), r"\\(.)", "$1"),
    )
