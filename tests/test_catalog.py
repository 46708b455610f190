import pytest

from quillforge.plans import catalog
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, connection, name):
    assert_same(catalog.QUERIES[name](spark, SF), connection, catalog.ORACLES[name])


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_scripted_loop_covers_every_paper_once_a_round(spark):
    rows = catalog.inner_loop_scripted(spark, SF).collect()
    first = sum(r.n for r in rows if r.iteration == 0)
    assert first == 200
    for it in range(1, 4):
        before = sum(r.n for r in rows if r.iteration == it - 1 and r.outcome not in ("accepted", "infra_error", "error", "paper_too_long"))
        assert sum(r.n for r in rows if r.iteration == it) == before


def test_html_to_markdown_keeps_a_title(spark):
    got = catalog.html_to_markdown(spark, SF).collect()
    assert len(got) == 50 and all(r.markdown.startswith("# ") for r in got)
