"""Queries over the test tables, one or more for each family of operators, with SQL that gives the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import family_queries
from .engine import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels", "conversations")

#: Name: (query, SQL or None where SQL cannot say it).
QUERIES: dict[str, tuple[str, str | None]] = {
    "flagship": (
        "lineitem | where l_shipdate <= datetime(1998-09-02) | summarize sum_qty=sum(l_quantity), n=count() by l_returnflag, l_linestatus",
        "SELECT CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, count(*) AS n, l_returnflag, l_linestatus FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus",
    ),
    "where_project": (
        "orders | where o_totalprice > 100000 and o_orderpriority startswith '1' | project o_orderkey, half=round(o_totalprice / 2, 1), y=getyear(o_orderdate)",
        "SELECT o_orderkey, round(o_totalprice / 2, 1) AS half, CAST(year(o_orderdate) AS BIGINT) AS y FROM orders WHERE o_totalprice > 100000 AND o_orderpriority LIKE '1%'",
    ),
    "extend_case": (
        "customer | extend tier=case(c_acctbal > 5000, 'high', c_acctbal > 0, 'mid', 'low') | summarize n=count() by tier, c_mktsegment",
        "SELECT count(*) AS n, CASE WHEN c_acctbal > 5000 THEN 'high' WHEN c_acctbal > 0 THEN 'mid' ELSE 'low' END AS tier, c_mktsegment FROM customer GROUP BY ALL",
    ),
    "projections": (
        "part | project-away p_retailprice, p_type | project-rename brand=p_brand | project-reorder p_size | project-keep p_*, brand",
        "SELECT p_size, p_partkey, p_name, p_brand AS brand FROM part",
    ),
    "string_predicates": (
        "part | where p_name contains 'a' or p_type has 'steel' or p_brand =~ 'BRAND#11' | where p_name !endswith 'zz' | project p_partkey, u=toupper(p_name), n=strlen(p_type)",
        r"SELECT p_partkey, upper(p_name) AS u, CAST(octet_length(encode(p_type)) AS BIGINT) AS n FROM part WHERE (contains(lower(p_name), 'a') OR regexp_matches(lower(p_type), '(^|[^0-9a-z])steel($|[^0-9a-z])') OR lower(p_brand) = 'brand#11') AND NOT p_name LIKE '%zz'",
    ),
    "join_inner": (
        "orders | join kind=inner (customer | where c_acctbal > 0) on $left.o_custkey == $right.c_custkey | summarize n=count(), hi=max(o_totalprice) by c_mktsegment",
        "SELECT count(*) AS n, max(o_totalprice) AS hi, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY c_mktsegment",
    ),
    "join_leftouter": (
        "customer | join kind=leftouter (orders | summarize n=count() by o_custkey) on $left.c_custkey == $right.o_custkey | project c_custkey, n",
        "SELECT c_custkey, n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey",
    ),
    "join_fullouter": (
        "customer | project k=c_custkey * 2, a=c_name | join kind=fullouter (part | project k=p_partkey * 3, b=p_brand) on k",
        "SELECT l.k, a, b FROM (SELECT c_custkey * 2 AS k, c_name AS a FROM customer) l FULL JOIN (SELECT p_partkey * 3 AS k, p_brand AS b FROM part) r ON l.k = r.k",
    ),
    "join_anti": (
        "customer | join kind=leftanti orders on $left.c_custkey == $right.o_custkey | project c_custkey",
        "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    ),
    "join_rightsemi": (
        "orders | where o_totalprice > 300000 | join kind=rightsemi customer on $left.o_custkey == $right.c_custkey | project c_custkey, c_name",
        "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    ),
    "lookup": (
        "supplier | lookup nation on $left.s_nationkey == $right.n_nationkey | summarize n=count(), total=max(s_acctbal) by n_name",
        "SELECT count(*) AS n, max(s_acctbal) AS total, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
    ),
    "in_subquery": (
        "orders | where o_custkey in (customer | where c_mktsegment == 'BUILDING' | project c_custkey) and o_orderstatus !in ('F') | count",
        "SELECT count(*) AS \"Count\" FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderstatus NOT IN ('F')",
    ),
    "aggregates": (
        "lineitem | summarize n=count(), c=countif(l_discount > 0.05), lo=min(l_shipdate), hi=max(l_extendedprice), d=dcount(l_partkey), p=percentile(l_quantity, 90), sd=dcountif(l_suppkey, l_tax > 0.04), q=sumif(l_quantity, l_returnflag == 'R') by l_linestatus",
        "SELECT count(*) AS n, count(*) FILTER (l_discount > 0.05) AS c, min(l_shipdate) AS lo, max(l_extendedprice) AS hi, count(DISTINCT l_partkey) AS d, quantile_cont(l_quantity, 0.9) AS p, count(DISTINCT l_suppkey) FILTER (l_tax > 0.04) AS sd, CAST(sum(l_quantity) FILTER (l_returnflag = 'R') AS DOUBLE) AS q, l_linestatus FROM lineitem GROUP BY l_linestatus",
    ),
    "statistics": (
        "lineitem | summarize a=avg(l_quantity), s=stdev(l_quantity), v=variancep(l_quantity), c=covariance(l_quantity, l_discount) by l_returnflag | project l_returnflag, a=round(a, 6), s=round(s, 6), v=round(v, 6), c=round(c, 6)",
        "SELECT l_returnflag, round(avg(l_quantity), 6) AS a, round(stddev_samp(l_quantity), 6) AS s, round(var_pop(l_quantity), 6) AS v, round(covar_samp(l_quantity, l_discount), 6) AS c FROM lineitem GROUP BY l_returnflag",
    ),
    "arg_max_star": (
        "orders | summarize arg_max(o_totalprice, *) by o_custkey | project o_custkey, o_orderkey, o_totalprice",
        "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1",
    ),
    "make_set": (
        "orders | summarize s=make_set(o_orderstatus) by o_orderpriority | project o_orderpriority, s=array_sort_asc(s)",
        "SELECT o_orderpriority, '[' || array_to_string(list_transform(list_sort(list_distinct(list(o_orderstatus))), lambda x: '\"' || x || '\"'), ',') || ']' AS s FROM orders GROUP BY o_orderpriority",
    ),
    "bits": (
        "nation | summarize o=binary_all_or(n_nationkey), a=binary_all_and(n_nationkey), x=binary_all_xor(n_nationkey) by n_regionkey",
        "SELECT CAST(bit_or(n_nationkey) AS BIGINT) AS o, CAST(bit_and(n_nationkey) AS BIGINT) AS a, CAST(bit_xor(n_nationkey) AS BIGINT) AS x, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation GROUP BY n_regionkey",
    ),
    "bin_time": (
        "events | summarize n=count(), users=dcount(user_id) by event_type, day=bin(ts, 1d)",
        "SELECT count(*) AS n, count(DISTINCT user_id) AS users, event_type, date_trunc('day', ts) AS day FROM events GROUP BY ALL",
    ),
    "dynamic_path": (
        "events | extend k=tolong(parse_json(props).k) | where isnotnull(k) | summarize n=count(), hi=max(k) by event_type",
        "SELECT count(*) AS n, max(CAST(props->>'$.k' AS BIGINT)) AS hi, event_type FROM events WHERE props->>'$.k' IS NOT NULL GROUP BY event_type",
    ),
    "top": ("orders | top 20 by o_totalprice desc | project o_orderkey, o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 20"),
    "distinct_count": ("lineitem | distinct l_returnflag, l_linestatus | count", "SELECT count(*) AS \"Count\" FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)"),
    "union_all": (
        "customer | project k=c_custkey, n=c_name | union (supplier | project k=s_suppkey, b=s_acctbal)",
        "SELECT c_custkey AS k, c_name AS n, CAST(NULL AS DOUBLE) AS b FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier",
    ),
    "partition_by": (
        "orders | partition by o_orderpriority (top 3 by o_totalprice desc | project o_orderpriority, o_orderkey)",
        "SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS r FROM orders) WHERE r <= 3",
    ),
    "serialize": (
        "nation | sort by n_nationkey asc | serialize rn=row_number(), before=prev(n_name), after=next(n_nationkey, 2, -1) | project n_nationkey, rn, before, after",
        "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, row_number() OVER w AS rn, lag(n_name) OVER w AS before, CAST(lead(n_nationkey, 2, -1) OVER w AS BIGINT) AS after FROM nation WINDOW w AS (ORDER BY n_nationkey)",
    ),
    "scan_sum": (
        "nation | sort by n_nationkey asc | scan declare (total:long=0) with (step s: true => total = s.total + n_nationkey;) | project n_nationkey, total",
        "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(sum(n_nationkey) OVER (ORDER BY n_nationkey) AS BIGINT) AS total FROM nation",
    ),
    "mv_expand": (
        "part | extend w=split(p_type, ' ') | mv-expand w to typeof(string) | summarize n=count() by w",
        "SELECT count(*) AS n, w FROM (SELECT unnest(string_split(p_type, ' ')) AS w FROM part) GROUP BY w",
    ),
    "mv_apply": (
        "part | extend w=split(p_type, ' ') | mv-apply w to typeof(string) on (summarize n=count(), m=max(w)) | project n, m",
        "SELECT CAST(len(string_split(p_type, ' ')) AS BIGINT) AS n, list_max(string_split(p_type, ' ')) AS m FROM part",
    ),
    "parse_text": (
        "customer | parse c_name with * '#' num:long | project c_custkey, num",
        "SELECT c_custkey, TRY_CAST(nullif(regexp_extract(c_name, '#\\s*([+-]?\\d+)\\s*$', 1), '') AS BIGINT) AS num FROM customer",
    ),
    "regex_functions": (
        "part | project p_partkey, a=extract('([0-9]+)', 1, p_brand), b=replace_regex(p_type, '([A-Z])[A-Z]+', '\\\\1.')",
        "SELECT p_partkey, nullif(regexp_extract(p_brand, '([0-9]+)', 1), '') AS a, regexp_replace(p_type, '([A-Z])[A-Z]+', '\\1.', 'g') AS b FROM part",
    ),
    "hashes": (
        "customer | project c_custkey, m=hash_md5(c_name), s=hash_sha256(c_mktsegment), b=base64_encode_tostring(c_name)",
        "SELECT c_custkey, md5(c_name) AS m, sha256(c_mktsegment) AS s, to_base64(encode(c_name)) AS b FROM customer",
    ),
    "datetimes": (
        "orders | project o_orderkey, w=startofweek(o_orderdate), d=datetime_diff('day', datetime(1999-01-01), o_orderdate), f=format_datetime(o_orderdate, 'yyyy/MM/dd'), n=datetime_add('hour', 5, o_orderdate)",
        "SELECT o_orderkey, date_trunc('day', o_orderdate) - to_days(CAST(dayofweek(o_orderdate) AS INTEGER)) AS w, CAST(trunc((epoch_us(TIMESTAMP '1999-01-01') - epoch_us(o_orderdate)) / 86400000000.0) AS BIGINT) AS d, strftime(o_orderdate, '%Y/%m/%d') AS f, o_orderdate + INTERVAL 5 HOUR AS n FROM orders",
    ),
    "make_series": (
        "events | make-series n=count() default=0 on ts from datetime(2024-01-01) to datetime(2024-01-11) step 1d by event_type | project event_type, n",
        "SELECT event_type, '[' || string_agg(CAST(n AS VARCHAR), ',' ORDER BY d) || ']' AS n FROM (SELECT t.event_type, d, count(e.ts) AS n FROM (SELECT DISTINCT event_type FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-11') t CROSS JOIN range(0, 10) r(d) LEFT JOIN events e ON e.event_type = t.event_type AND e.ts >= TIMESTAMP '2024-01-01' + to_days(CAST(d AS INTEGER)) AND e.ts < TIMESTAMP '2024-01-01' + to_days(CAST(d AS INTEGER) + 1) GROUP BY 1, 2) GROUP BY event_type",
    ),
    "vectors": (
        "embeddings | project vec_id, d=round(series_dot_product(embedding, embedding), 4)",
        "SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS d FROM embeddings",
    ),
    "graph_match": (
        "nation | project a=tostring(n_nationkey), b=tostring(n_regionkey) | union (region | project a=tostring(r_regionkey), b='root') | make-graph a --> b | graph-match (x)-[e]->(y)-[f]->(z) project x.NodeId, y.NodeId, z.NodeId | count",
        "WITH e AS (SELECT row_number() OVER () AS i, * FROM (SELECT n_nationkey::VARCHAR AS a, n_regionkey::VARCHAR AS b FROM nation UNION ALL SELECT r_regionkey::VARCHAR, 'root' FROM region)) SELECT count(*) AS \"Count\" FROM e JOIN e f ON e.b = f.a AND e.i <> f.i",
    ),
    "find_text": (
        "find in (nation, region) where n_nationkey == 3 project n_name",
        "SELECT 'nation' AS source_, n_name FROM nation WHERE n_nationkey = 3",
    ),
    "lets": (
        "let f = (x:real) { x * 1.1 }; let big = orders | where o_totalprice > 200000; big | summarize n=count() | extend y=round(f(10.0), 3)",
        "SELECT count(*) AS n, 11.0::DOUBLE AS y FROM orders WHERE o_totalprice > 200000",
    ),
}


QUERIES |= family_queries.QUERIES


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    out = Engine(spark)
    for name in TABLES:
        out.register_parquet(name, f"{sf_dir}/{name}.parquet")
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    texts = {name: (lambda spark, sf_dir, text=text: engine(spark, sf_dir).query(text)) for name, (text, _) in QUERIES.items()}
    return texts | {name: run for name, (run, _) in family_queries.RUNS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in (QUERIES | family_queries.RUNS).items() if sql}
