import pytest

from fiscus.operators import filters as P
from fiscus.operators import paging as L


@pytest.fixture(scope="module")
def payers(make_payers):
    # Every name occurs many times, so the order needs the id to be settled.
    return make_payers(
        range(250),
        full_name=lambda i: f"Name {i % 3}",
        registration_district=lambda i: "north" if i % 2 else "south",
        employees_count=lambda i: None if i % 5 else i % 4,
    )


def ids(df):
    return [r["taxpayer_id"] for r in df.collect()]


def test_pages_cover_everything_once_in_spite_of_ties(payers):
    seen = []
    for page in range(1, 4):
        seen += ids(L.payer_page(payers, page, 100, sort_by="full_name", sort_order="desc"))
    assert sorted(seen) == list(range(250))
    assert seen[:2] == [2, 5]


def test_counts(payers):
    row = L.payer_page(payers, 2, 7, district="north").first()
    assert (row["total_count"], row["total_pages"]) == (125, 18)


def test_past_the_end_the_total_is_still_known(payers):
    assert L.payer_page(payers, 99, 10).count() == 0
    assert tuple(L.page_summary(payers, 10).first()) == (250, 25)
    assert tuple(L.page_summary(payers, 10, inn="nobody").first()) == (0, 0)


def test_a_page_has_the_size_asked_for(payers):
    assert L.payer_page(payers, 1, 250).count() == 250
    assert L.page_of(payers, 1, 250).count() == L.page_after(payers, None, 250).count() == 250
    assert L.page_summary(payers, 100).first()["total_pages"] == 3


@pytest.mark.parametrize("column", L.SORTABLE)
@pytest.mark.parametrize("order", ["asc", "desc"])
def test_pages_by_the_last_row_are_the_sorted_list(payers, column, order):
    want = ids(L.order_by(payers, column, order))
    got, last = [], (None, None)
    while rows := L.page_after(payers, last[0], 70, column, order, last[1]).collect():
        got += [r["taxpayer_id"] for r in rows]
        last = rows[-1]["taxpayer_id"], rows[-1][column]
    assert got == want


def test_empty_filters_mean_no_filter(payers):
    assert L.page_summary(payers, 10, inn="", district="").first()["total"] == 250


def test_search_text_is_literal(payers):
    assert P.where_all(payers, P.contains("inn", "%")).count() == 0
    assert P.where_all(payers, P.contains("inn", "10024")).count() == 10


def test_nulls_sort_like_the_source_database(payers):
    up = [r["employees_count"] for r in L.order_by(payers, "employees_count").collect()]
    assert up[0] is None and up[-1] == 3
    down = [r["employees_count"] for r in L.order_by(payers, "employees_count", "desc").collect()]
    assert down[0] == 3 and down[-1] is None


def test_keyset_pages(payers):
    first = ids(L.page_after(payers, None, 40))
    assert first + ids(L.page_after(payers, first[-1], 40)) == list(range(80))


@pytest.mark.parametrize("bad", [
    {"sort_by": "1; drop table x"}, {"sort_order": "sideways"}, {"page": 0}, {"page_size": 0},
])
def test_bad_requests(payers, bad):
    with pytest.raises(ValueError):
        L.payer_page(payers, **bad)


def test_user_card(make_payers):
    payers = make_payers([1, 2], employees_count=lambda i: 0 if i == 1 else 3)
    cards = {r["id"]: r for r in P.user_records(payers).collect()}
    assert cards[1]["employees_count"] is None and cards[2]["employees_count"] == 3
    assert cards[1]["avatar"]["src"].endswith("seed=Payer 1")


def test_json_keeps_nulls(make_payers):
    text = P.json_records(make_payers([1]).select("inn", "employees_count")).first()["record"]
    assert text == '{"inn":"100001","employees_count":null}'


def test_align_schema(make_payers):
    from fiscus.schemas import PREDICT

    rows = P.align_schema(make_payers([1]), PREDICT)
    assert rows.schema.names == PREDICT.names
    assert rows.first()["income"] is None
