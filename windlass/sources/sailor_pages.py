"""Sailor pages: JSON held in a meta attribute, with patches for broken pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windlass import schemas
from windlass.functions import markup as m


def sailor_meta(pages: DataFrame) -> DataFrame:
    """pages: link, html -> the sailor dimension; a page without data is left out."""
    content = F.coalesce(
        m.first_match(F.col("html"), r"""(?is)<meta\b[^>]*name="ts:data"[^>]*content='([^']*)'"""),
        m.first_match(F.col("html"), r'(?is)<meta\b[^>]*name="ts:data"[^>]*content="([^"]*)"'),
    )
    menu = m.first_match(F.col("html"), r'(?is)<ul\b[^>]*id="menu".*?</ul>', 0)
    team = m.text(F.get(m.all_matches(menu, r"(?is)<li\b.*?</li>"), F.lit(1)))
    parsed = pages.select(
        "link", F.from_json(m.unescape(content), schemas.SAILOR_META).alias("d"), team.alias("team")
    ).filter("d.name is not null")
    return parsed.select(
        F.col("link").alias("key"), "link", "d.name", "d.first_name", "d.last_name", "d.gender",
        "d.year", F.get(F.split("d.school", "/"), F.lit(2)).alias("teamLink"), "team", "d.id",
        "d.external_id",
    )


def patch(sailors: DataFrame, patches: DataFrame) -> DataFrame:
    """Rows given by hand for pages without usable data; a parsed row wins."""
    missing = patches.join(sailors.select("key"), "key", "left_anti")
    return sailors.unionByName(missing, allowMissingColumns=True)


def unlinked_sailors(entries: DataFrame, members: DataFrame) -> DataFrame:
    """People without a page, keyed by name and team (name, year, team)."""
    cols = ["name", "year", "team"]
    both = entries.filter("link is null").select(*cols).unionByName(
        members.filter("link is null").select(*cols)
    ).distinct()
    return both.withColumn("key", F.concat_ws("-", "name", "team"))
