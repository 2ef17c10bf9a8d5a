"""Some queries against their SQL at the smallest scale, where it is at hand."""

import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = [
    "race_id_parts", "date_forms", "last_duplicate_kept", "region_exposure", "as_of_snapshots",
    "rating_update_one_race", "match_update_one_race", "processing_order", "pool_ranks",
    "team_top_ratings", "fleet_head_to_head", "regatta_averages", "fleet_scores", "match_rotation",
    "rating_state", "fleet_history", "match_history", "incremental_rating", "pair_rating",
    "elo_pairwise", "elo_field_average", "glicko2", "full_rating_run", "linked_sailors",
    "published_sailors", "regatta_documents", "search_index_documents", "season_calendar",
    "wide_to_long", "rank_matrix", "loss_graph_page_rank", "fleet_head_to_head_seasons",
    "match_head_to_head_seasons", "identity_chains", "page_fetch", "document_store",
    "document_tree_delete", "rating_histogram_fit",
]


def _norm(rows):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "~"
        if isinstance(v, float):
            return f"{v:.4f}"
        return str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"create view {file.split('.')[0]} as select * from '{DATA}/{file}'")
    got = entry.queries()[name](spark, DATA)
    cols = sorted(got.columns)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == cols
    listed = ", ".join(f'"{c}"' for c in cols)
    expected = con.sql(f"select {listed} from ({entry.oracle_sql()[name]})").fetchall()
    assert _norm(map(tuple, got.select(*cols).collect())) == _norm(expected)


def test_every_query_of_the_catalog_has_an_oracle():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(entry.catalog.QUERIES) == set(entry.catalog.ORACLES)
    assert len(entry.queries()) > 100
