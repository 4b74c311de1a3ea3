"""Arrays whose parts are known give what their JSON text gives."""

import pytest

from rillflow.engine import Engine

TABLE = "datatable(n:long, r:real)[1, 0.25, -3, 2.0, 7, 1e300, 0, -0.5, 2, real(null)]"
SAME = [
    "series_abs({x})", "series_exp({x})", "series_log({x})[0]", "todouble(series_acos({x})[1])", "todouble(series_exp({x})[2])", "series_multiply({x}, {x})", "todouble(series_multiply({x}, {x})[1])", "series_divide({x}, series_floor({x}))", "series_add({x}, dynamic([1, 2, 3]))", "series_add({x}, dynamic([1]))",
    "series_equals({x}, {x})", "series_fill_forward({x})", "series_fill_linear({x})", "series_stats_dynamic({x})", "series_sum({x})", "series_dot_product({x}, {x})", "series_cosine_similarity({x}, {x})", "tolong({x}[0]) + tolong({x}[-1])", "todouble({x}[9])", "todouble(series_sign({x})[9])", "array_reverse({x})", "array_slice({x}, -2, -1)", "array_shift_left({x}, 1)", "array_shift_right({x}, 1, 0)", "array_concat({x}, dynamic([1, null]))", "array_length({x})", "zip({x}, dynamic(['p']))", "array_sort_desc({x})", "series_sin(series_log({x}))",
]


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark)


@pytest.mark.parametrize("array", ["pack_array(n, r, 4)", "pack_array(n, 5, n + 1)"])
def test_parts_are_what_the_text_says(engine, array):
    items = ", ".join(f"c{i}={e.format(x='x')}" for i, e in enumerate(SAME))
    got = [engine.query(f"{TABLE} | extend x={array} | {between} project n, {items}").collect() for between in ("", "where n < 100 |", "extend x=tostring(x) | extend x=parse_json(x) |")]
    assert str(got[0]) == str(got[1]) == str(got[2]) and len(got[0]) == 5


def plan(engine, text):
    return engine.query(text)._jdf.queryExecution().optimizedPlan().toString()


def test_series_of_known_parts_are_not_parsed(engine):  # F2, F6
    text = "range n from 1 to 3 step 1 | extend x=pack_array(n, 4) | project a=round(todouble(series_sin(x)[0]), 3), b=series_add(x, x), c=series_sum(x)"
    assert [tuple(r) for r in engine.query(text).take(1)] == [(0.841, "[2,8]", 5.0)]
    found = engine.query("range n from 1 to 3 step 1 | extend x=pack_array(n, 4) | project b=series_add(x, x), c=series_sum(x), d=series_dot_product(x, x)")
    assert "parse" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_a_text_is_parsed_once_for_an_expression(engine):  # F3, F6, F7
    head = "range n from 1 to 3 step 1 | extend x=tostring(n) | extend x=strcat('[', x, ',null]') | extend x=parse_json(x) | project a="
    for call in ("series_fill_linear(x)", "series_stats_dynamic(x)", "array_slice(x, 0, -1)", "array_shift_left(x, 1)", "array_sort_asc(x)", "zip(x)"):
        assert plan(engine, head + call).lower().count("parsejson(") == 1, call
    assert plan(engine, head + "series_cosine_similarity(x, x)").lower().count("parsejson(") == 2


def test_an_object_is_made_once(engine):  # F4
    text = plan(engine, "range n from 1 to 3 step 1 | extend u=strcat('http://h/p?k=', n, '&k=2&a') | project a=parse_url(u), b=parse_urlquery(u)")
    assert text.count("regexp_extract(") == 6 and text.count("split(") == 1
    assert engine.query("print parse_urlquery('?k=1&k=2&a'), bag_pack('b', 1, 'a', 2, 'b', 3), bag_pack('q\\\"', 1)").collect()[0][:2] == ('{"a":"","k":"2"}', '{"a":2,"b":3}')
