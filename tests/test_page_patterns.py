"""Patterns of rows, cells and tables on odd markup, and what page queries store."""

from pyspark.sql import functions as F

from windlass.functions import markup as m
from windlass.plans.catalog import pages as catalog_pages
from windlass.sources import match_pages

ODD = [
    None, "", "<tr>", "<tr></tr>", "<TR a='1'>x</Tr><tr>y</tr>", "<tr><td>1 < 2</td></tr><tr>open",
    "<tr>\n<th>a</TH><td class='team1 x'>b</td></tr></tr>", "<tr><<</tr>><tr></tr x></tr>",
    "<table class=results><tr><td>1</td></tr></table><table class='results'>2</table>",
    "<td class=team1>no end <td class=team1>end</td>",
]


def test_a_pattern_takes_what_a_lazy_one_takes(spark):
    assert "*?" not in m.up_to("tr")
    html = F.col("html")
    lazy = {
        "rows": r"(?is)<tr\b.*?</tr>", "cells": r"(?is)<t[dh]\b.*?</t[dh]>",
        "of_class": rf"(?is)<t[dh]\b[^>]*{m.class_of('team1')}.*?</t[dh]>",
    }
    table = rf"(?is)<table\b[^>]*{m.class_of('results')}.*?</table>"
    got = spark.createDataFrame([(h,) for h in ODD], "html string").select(
        "html", m.rows(html).alias("rows"), m.cells(html).alias("cells"),
        m.cells_of_class(html, "team1").alias("of_class"),
        m.table_of_class(html, "results").alias("table"),
        *[m.all_matches(html, p).alias(f"lazy_{c}") for c, p in lazy.items()],
        m.first_match(html, table, 0).alias("lazy_table")).collect()
    for r in got:
        for c in (*lazy, "table"):
            assert r[c] == r[f"lazy_{c}"], (r["html"], c)


def test_a_long_row_needs_no_stack(spark):
    page = "<table class='results'><tr>" + "<b>x</b>< " * 200_000 + "</tr></table>"
    df = spark.createDataFrame([(page,)], "html string")
    row = df.select(F.length(m.rows(F.col("html"))[0]), F.length(m.table_of_class(F.col("html"), "results")))
    assert tuple(row.first()) == (len(page) - len("<table class='results'></table>"), len(page))


def test_only_the_asked_page_is_stored(spark, monkeypatch):
    pages = spark.createDataFrame([("r1", "<a>", "<b>")], "regatta string, scores string, sailors string")
    monkeypatch.setattr(catalog_pages.rendered, "fleet_pages", lambda spark, sf: pages)
    kept = catalog_pages._fleet_pages(spark, "", "scores")
    assert [tuple(r) for r in spark.read.parquet(*kept.inputFiles()).collect()] == [("r1", "<a>")]


def test_rounds_ports_and_team_rows_are_what_lazy_patterns_take(spark):
    assert "*?" not in match_pages._ROUND + match_pages._TEAM_ROW + m.before(match_pages._PORT)
    odd = [
        None, "", "<div class=port>a<div class='x'>b</div><div class='port big'>c < d<DIV CLASS=port>",
        "<tr class='x roundrow'>1<tr><td>2</td><tr class=roundrow>3</table><tr class=roundrow>4",
        "<tr class='row team-1'><<th>a</th>< tr <tr class=\"team-2 x\">b<tr class='other'>c",
    ]
    row, team, port = match_pages._ROUND_ROW, rf"tr\b[^>]*{match_pages._OF_TEAM}", match_pages._PORT
    pairs = {
        match_pages._ROUND: rf"(?is)<{row}.*?(?=<{row}|</table>)",
        match_pages._TEAM_ROW: rf"(?is)<{team}.*?(?=<{team}|$)",
        rf"(?is)<{port}{m.before(port)}": rf"(?is)<{port}.*?(?=<{port}|$)",
    }
    df, html = spark.createDataFrame([(h,) for h in odd], "html string"), F.col("html")
    for quick, lazy in pairs.items():
        got = df.select(m.all_matches(html, quick), m.all_matches(html, lazy)).collect()
        assert all(a == b for a, b in got) and any(a for a, _ in got)


def test_references_are_looked_for_where_there_is_one(spark):
    held = [None, "", "a b", "R&amp;D", "&#65;&nbsp;&amp;lt;", "1 &lt; 2 & 3", "&#0;"]
    got = spark.createDataFrame([(h,) for h in held], "t string").select(m.unescape(F.col("t"))).collect()
    assert [r[0] for r in got] == [None, "", "a b", "R&D", "A &lt;", "1 < 2 & 3", "&#0;"]


def test_a_rotation_page_is_parsed_once(spark, monkeypatch):
    calls = []
    parse = match_pages.rotation_rows
    monkeypatch.setattr(match_pages, "rotation_rows", lambda pages: calls.append(1) or parse(pages))
    pages = spark.createDataFrame(
        [("m1", "<a>", "<b>", "<c>")],
        "regatta string, races string, rotation string, report string")
    monkeypatch.setattr(catalog_pages.rendered, "match_pages", lambda spark, sf: pages)
    assert catalog_pages.matches_from_pages(spark, "").count() == 0
    assert calls == [1]


def test_settings_of_the_queries_do_not_stay_for_the_corpus_operators(spark):
    from windlass.llm.common import prepare
    from windlass.session import QUERY_SETTINGS, apply_settings

    defaults = [spark.conf.get(k) for k in QUERY_SETTINGS if not spark.conf.unset(k)]
    apply_settings(spark, query=True)
    assert [spark.conf.get(k) for k in QUERY_SETTINGS] == list(QUERY_SETTINGS.values())
    prepare(spark)
    assert [spark.conf.get(k) for k in QUERY_SETTINGS] == defaults
