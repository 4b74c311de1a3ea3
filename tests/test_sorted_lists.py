"""Lists in the order of a sort."""

from rillflow.engine import Engine


def test_lists_follow_a_sort_without_a_window_over_all_rows(spark):
    engine = Engine(spark)
    text = "range x from 1 to 2000 step 1 | extend g=x % 3, k=iff(x % 7 == 0, long(null), x * 911 % 2003) | sort by k {0}, x asc | summarize l=make_list(x), s=strcat_delim('-', x) by g"
    for way, key in (("asc", lambda x: (x % 7 != 0, x * 911 % 2003 if x % 7 else 0, x)), ("desc", lambda x: (x % 7 == 0, -(x * 911 % 2003) if x % 7 else 0, x))):
        df = engine.query(text.format(way))
        want = sorted(range(1, 2001), key=key)
        of = {g: [str(x) for x in want if x % 3 == g] for g in range(3)}
        assert {r.g: (r.l, r.s) for r in df.collect()} == {g: ("[" + ",".join(xs) + "]", "-".join(xs)) for g, xs in of.items()}
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
