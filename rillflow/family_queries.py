"""More registered queries, family by family: every operator and function over whole test tables, with SQL.

Text is a query of the language.  Floating results that two libraries may round
apart in the last bit are rounded to six places, away from zero's two signs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine
from .sources.tables import folder

#: Name: (query, SQL).
JOINS = {
    "join_rightouter": (
        "orders | where o_totalprice > 300000 | project o_orderkey, k=o_custkey | join kind=rightouter (customer | project k=c_custkey, c_name) on k",
        "SELECT o_orderkey, o_custkey AS k, c_name FROM (SELECT * FROM orders WHERE o_totalprice > 300000) RIGHT JOIN customer ON o_custkey = c_custkey",
    ),
    "join_rightanti": (
        "orders | where o_totalprice > 400000 | join kind=rightanti customer on $left.o_custkey == $right.c_custkey | project c_custkey, c_name",
        "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    ),
    "join_leftsemi": (
        "customer | join kind=leftsemi (orders | where o_orderpriority startswith '1') on $left.c_custkey == $right.o_custkey | project c_custkey, c_acctbal",
        "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')",
    ),
    "join_leftanti_rows": (
        "customer | join kind=anti (orders | where o_totalprice > 400000) on $left.c_custkey == $right.o_custkey | project c_custkey",
        "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    ),
    "join_innerunique": (
        "orders | project k=o_custkey | join (customer | project k=c_custkey, c_name) on k",
        "SELECT DISTINCT o_custkey AS k, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    ),
    "union_leading": (
        "union (customer | project k=c_custkey, n=c_name), (supplier | project k=s_suppkey, n=s_name) | summarize rows_=count(), hi=max(n) by k",
        "SELECT count(*) AS rows_, max(n) AS hi, k FROM (SELECT c_custkey AS k, c_name AS n FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier) GROUP BY k",
    ),
    "let_table_function": (
        "let rich = (T:(c_acctbal:real), least:real) { T | where c_acctbal > least }; customer | invoke rich(5000.0) | summarize n=count() by c_mktsegment",
        "SELECT count(*) AS n, c_mktsegment FROM customer WHERE c_acctbal > 5000 GROUP BY c_mktsegment",
    ),
    "toscalar": (
        "let most = toscalar(orders | summarize max(o_totalprice)); orders | where o_totalprice > most / 2 | project o_orderkey, share=round(o_totalprice / most, 6)",
        "SELECT o_orderkey, round(o_totalprice / (SELECT max(o_totalprice) FROM orders), 6) AS share FROM orders WHERE o_totalprice > (SELECT max(o_totalprice) FROM orders) / 2",
    ),
}

PREDICATES = {
    "terms": (
        "part | project p_partkey, a=p_name hasprefix 'sma', b=p_name hassuffix 'get', c=p_type has_any ('economy', 'large'), d=p_name has_all ('cold', 'widget'), e=p_name !has 'cold', f=p_name has_cs 'Cold', g=p_name !has_cs 'cold', h=p_name !hasprefix 'wid', i=p_name !hassuffix 'get', j=p_type hasprefix_cs 'ECO', k=p_type hassuffix_cs 'omy'",
        r"""SELECT p_partkey, regexp_matches(p_name, '(^|[^0-9a-z])sma') AS a, regexp_matches(p_name, 'get($|[^0-9a-z])') AS b, regexp_matches(lower(p_type), '(^|[^0-9a-z])(economy|large)($|[^0-9a-z])') AS c,
 regexp_matches(p_name, '(^|[^0-9a-z])cold($|[^0-9a-z])') AND regexp_matches(p_name, '(^|[^0-9a-z])widget($|[^0-9a-z])') AS d, NOT regexp_matches(p_name, '(^|[^0-9a-z])cold($|[^0-9a-z])') AS e, false AS f, NOT regexp_matches(p_name, '(^|[^0-9a-z])cold($|[^0-9a-z])') AS g,
 NOT regexp_matches(p_name, '(^|[^0-9a-z])wid') AS h, NOT regexp_matches(p_name, 'get($|[^0-9a-z])') AS i, regexp_matches(p_type, '(^|[^0-9A-Za-z])ECO') AS j, false AS k FROM part""",
    ),
    "text_predicates": (
        "part | project p_partkey, a=p_name contains 'OLD', b=p_name !contains 'OLD', c=p_name contains_cs 'OLD', d=p_name !contains_cs 'old', e=p_name startswith 'COLD', f=p_name !startswith_cs 'COLD', g=p_name endswith 'GET', h=p_name !endswith_cs 'get', i=p_name like '*wid*', j=p_name !like 'cold*', k=p_brand matches regex '#1[0-9]$', l=p_type !~ 'economy', m=p_name startswith_cs 'cold', n=p_name endswith_cs 'get'",
        "SELECT p_partkey, contains(lower(p_name), 'old') AS a, NOT contains(lower(p_name), 'old') AS b, contains(p_name, 'OLD') AS c, NOT contains(p_name, 'old') AS d, starts_with(lower(p_name), 'cold') AS e, NOT starts_with(p_name, 'COLD') AS f, ends_with(lower(p_name), 'get') AS g, NOT ends_with(p_name, 'get') AS h, p_name ILIKE '%wid%' AS i, NOT p_name ILIKE 'cold%' AS j, regexp_matches(p_brand, '#1[0-9]$') AS k, lower(p_type) <> 'economy' AS l, starts_with(p_name, 'cold') AS m, ends_with(p_name, 'get') AS n FROM part",
    ),
    "ranges_and_lists": (
        "part | project p_partkey, a=p_size between (10 .. 20), b=p_size !between (10 .. 20), c=p_brand in~ ('brand#13', 'BRAND#5'), d=p_brand !in~ ('brand#13'), e=p_size in (1, 2, 3), f=p_size >= 10 and p_size <= 20 or p_retailprice < 901, g=not(p_size != 24), h=p_partkey < 10, i=p_partkey > 10",
        "SELECT p_partkey, p_size BETWEEN 10 AND 20 AS a, NOT p_size BETWEEN 10 AND 20 AS b, lower(p_brand) IN ('brand#13', 'brand#5') AS c, lower(p_brand) <> 'brand#13' AS d, p_size IN (1, 2, 3) AS e, p_size >= 10 AND p_size <= 20 OR p_retailprice < 901 AS f, p_size = 24 AS g, p_partkey < 10 AS h, p_partkey > 10 AS i FROM part",
    ),
    "like_of_a_column": (
        "part | extend p=strcat(substring(p_name, 0, 2), '*', substring(p_name, strlen(p_name) - 1, 1)) | project p_partkey, a=p_name like p, b=p_type like p",
        "SELECT p_partkey, p_name ILIKE left(p_name, 2) || '%' || right(p_name, 1) AS a, p_type ILIKE left(p_name, 2) || '%' || right(p_name, 1) AS b FROM part",
    ),
}

MATH = {
    "arithmetic": (
        "lineitem | project l_orderkey, l_linenumber, a=abs(0 - l_tax), b=round(pow(l_discount, 2), 6), c=round(sqrt(l_quantity), 6), d=ceiling(l_extendedprice / 7), e=sign(l_discount - 0.05), f=l_linenumber * 3 - 1, g=l_orderkey / 7, h=l_orderkey % 7, i=bin(l_quantity, 10.0), j=floor(l_orderkey, 100), k=round(l_extendedprice, 0), l=min_of(l_linenumber, 3), m=max_of(l_quantity, 20.0)",
        "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_tax AS a, round(pow(l_discount, 2), 6) AS b, round(sqrt(l_quantity), 6) AS c, ceil(l_extendedprice / 7) AS d, CAST(sign(l_discount - 0.05::DOUBLE) AS BIGINT) AS e, CAST(l_linenumber * 3 - 1 AS BIGINT) AS f, l_orderkey // 7 AS g, l_orderkey % 7 AS h, floor(l_quantity / 10) * 10 AS i, l_orderkey // 100 * 100 AS j, round(l_extendedprice, 0) AS k, CAST(least(l_linenumber, 3) AS BIGINT) AS l, greatest(l_quantity, 20.0::DOUBLE) AS m FROM lineitem",
    ),
    "logarithms": (
        "lineitem | project l_orderkey, l_linenumber, a=round(log(l_quantity) + 10, 6), b=round(log2(l_quantity) + 10, 6), c=round(log10(l_quantity) + 10, 6), d=round(exp(l_tax), 6), e=round(exp2(l_tax), 6), f=round(exp10(l_tax), 6), g=round(pi(), 6), h=isinf(log(l_quantity - l_quantity)), i=isnan(log(0 - l_quantity)), j=isfinite(l_tax)",
        "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(ln(l_quantity) + 10, 6) AS a, round(log2(l_quantity) + 10, 6) AS b, round(log10(l_quantity) + 10, 6) AS c, round(exp(l_tax), 6) AS d, round(pow(2, l_tax), 6) AS e, round(pow(10, l_tax), 6) AS f, round(pi(), 6) AS g, true AS h, true AS i, true AS j FROM lineitem",
    ),
    "trigonometry": (
        "lineitem | project l_orderkey, l_linenumber, a=round(sin(l_quantity) + 2, 6), b=round(cos(l_quantity) + 2, 6), c=round(tan(l_discount) + 2, 6), d=round(asin(l_discount) + 2, 6), e=round(acos(l_discount) + 2, 6), f=round(atan(l_quantity) + 2, 6), g=round(atan2(l_quantity, l_tax + 1) + 2, 6), h=round(degrees(l_discount) + 1, 6), i=round(radians(l_quantity) + 1, 6)",
        "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(sin(l_quantity) + 2, 6) AS a, round(cos(l_quantity) + 2, 6) AS b, round(tan(l_discount) + 2, 6) AS c, round(asin(l_discount) + 2, 6) AS d, round(acos(l_discount) + 2, 6) AS e, round(atan(l_quantity) + 2, 6) AS f, round(atan2(l_quantity, l_tax + 1) + 2, 6) AS g, round(degrees(l_discount) + 1, 6) AS h, round(radians(l_quantity) + 1, 6) AS i FROM lineitem",
    ),
    "conversions": (
        "orders | extend s=tostring(o_orderkey) | project o_orderkey, a=toint(s), b=tolong(strcat(s, 'x')), c=todouble(strcat(s, '.5')), d=toreal(s), e=tobool(iff(o_orderkey % 2 == 0, 'true', 'false')), f=tostring(o_totalprice > 100000), g=isnull(tobool(o_orderstatus)), h=isnotnull(o_custkey), i=iff(o_totalprice > 100000, 'big', 'small'), j=coalesce(extract('([1-2])-', 1, o_orderpriority), 'none'), k=int(o_totalprice), l=long(s), m=double(s), n=bool(1), o=tostring(o_custkey)",
        "SELECT o_orderkey, o_orderkey AS a, 0::BIGINT AS b, o_orderkey + 0.5::DOUBLE AS c, o_orderkey::DOUBLE AS d, o_orderkey % 2 = 0 AS e, CASE WHEN o_totalprice > 100000 THEN 'true' ELSE 'false' END AS f, true AS g, true AS h, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS i, coalesce(nullif(regexp_extract(o_orderpriority, '([1-2])-', 1), ''), 'none') AS j, CAST(trunc(o_totalprice) AS BIGINT) AS k, o_orderkey AS l, o_orderkey::DOUBLE AS m, true AS n, o_custkey::VARCHAR AS o FROM orders",
    ),
}

STRINGS = {
    "strings": (
        "part | project p_partkey, a=tolower(p_type), b=substring(p_name, 2, 4), c=replace_string(p_name, 'i', 'II'), d=trim_start('[a-d]', p_name), e=trim_end('[a-z]', p_brand), f=has_any_index(p_name, dynamic(['cold', 'widget'])), g=reverse(p_name), h=isnotempty(p_name), i=strcmp(p_name, p_brand), j=strrep(p_brand, 2, '|'), k=translate('abc', 'xyz', p_name), l=strcat_delim('-', p_name, p_brand, p_size), m=string_size(p_name), n=indexof(p_name, 'd'), o=countof(p_name, 'd'), p=strcat(p_name, 1, '!'), q=trim('[cdt]', p_name), r=isempty(p_type), s=substring(p_name, 3)",
        "SELECT p_partkey, lower(p_type) AS a, substr(p_name, 3, 4) AS b, replace(p_name, 'i', 'II') AS c, regexp_replace(p_name, '^[a-d]+', '') AS d, regexp_replace(p_brand, '[a-z]+$', '') AS e, CASE WHEN regexp_matches(p_name, '(^|[^0-9a-z])cold($|[^0-9a-z])') THEN 0 WHEN regexp_matches(p_name, '(^|[^0-9a-z])widget($|[^0-9a-z])') THEN 1 ELSE -1 END::BIGINT AS f, reverse(p_name) AS g, p_name <> '' AS h, CASE WHEN p_name < p_brand THEN -1 WHEN p_name > p_brand THEN 1 ELSE 0 END::BIGINT AS i, p_brand || '|' || p_brand AS j, translate(p_name, 'abc', 'xyz') AS k, p_name || '-' || p_brand || '-' || p_size AS l, strlen(p_name) AS m, instr(p_name, 'd')::BIGINT - 1 AS n, (length(p_name) - length(replace(p_name, 'd', '')))::BIGINT AS o, p_name || '1!' AS p, regexp_replace(regexp_replace(p_name, '^[cdt]+', ''), '[cdt]+$', '') AS q, p_type = '' AS r, substr(p_name, 4) AS s FROM part",
    ),
    "regexes": (
        "customer | project c_custkey, a=extract('([0-9])([0-9])$', 2, c_name), b=extract_all('([0-9]{3})', c_name), c=replace_regex(c_name, '0+', 'o'), d=split(c_name, '#'), e=tostring(split(c_name, '#')[1]), f=extract('(?P<d>[0-9]+)', 1, c_name, typeof(long))",
        r"""SELECT c_custkey, regexp_extract(c_name, '([0-9])([0-9])$', 2) AS a, '["' || array_to_string(regexp_extract_all(c_name, '([0-9]{3})', 1), '","') || '"]' AS b, regexp_replace(c_name, '0+', 'o', 'g') AS c, '["' || replace(c_name, '#', '","') || '"]' AS d, string_split(c_name, '#')[2] AS e, regexp_extract(c_name, '([0-9]+)', 1)::BIGINT AS f FROM customer""",
    ),
    "urls": (
        "customer | extend u=strcat('https://host', c_custkey, '.example:80', c_custkey % 10, '/p/', c_mktsegment, '?k=', c_custkey, '&n=a b&k=z#f') | extend p=parse_url(u) | project c_custkey, a=tostring(p.Host), b=tostring(p.Port), c=tostring(p.Path), d=tostring(p.Scheme), e=tostring(p.Fragment), f=parse_urlquery(tostring(p.Query)), g=url_encode(c_name), h=url_decode(url_encode_component(u)) == u, i=url_encode_component('a b&c'), j=tostring(parse_path(strcat('C:\\\\d', c_custkey, '\\\\f.tar.gz')).FileName), k=parse_command_line(strcat('run \"', c_custkey, ' b\" c'), 'windows'), l=parse_csv(strcat(c_custkey, ',\"x,y\"'))",
        r"""SELECT c_custkey, 'host' || c_custkey || '.example' AS a, '80' || (c_custkey % 10) AS b, '/p/' || c_mktsegment AS c, 'https' AS d, 'f' AS e, '{"k":"z","n":"a b"}' AS f, c_name AS g, true AS h, 'a%20b%26c' AS i, 'f.tar.gz' AS j, '["run","' || c_custkey || ' b","c"]' AS k, '["' || c_custkey || '","x,y"]' AS l FROM customer""",
    ),
    "user_agents": (
        "customer | extend ua=iff(c_custkey % 2 == 0, 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.6099.71 Safari/537.36', 'Mozilla/5.0 (X11; Linux x86_64; rv:109.0) Gecko/20100101 Firefox/115.0') | extend b=parse_user_agent(ua, 'browser') | summarize n=count() by family=tostring(b.Browser.Family), major=tostring(b.Browser.MajorVersion)",
        "SELECT count(*) AS n, CASE WHEN c_custkey % 2 = 0 THEN 'Chrome' ELSE 'Firefox' END AS family, CASE WHEN c_custkey % 2 = 0 THEN '120' ELSE '115' END AS major FROM customer GROUP BY ALL",
    ),
    "codes": (
        "customer | project c_custkey, a=hash_sha1(c_name), b=base64_decode_tostring(base64_encode_tostring(c_name)), c=strlen(tostring(new_guid())), d=rand() < 1.0, e=rand(10) < 10, f=hash_md5(tostring(c_custkey))",
        "SELECT c_custkey, sha1(c_name) AS a, c_name AS b, 36::BIGINT AS c, true AS d, true AS e, md5(c_custkey::VARCHAR) AS f FROM customer",
    ),
    "parsing": (
        "customer | extend s=strcat('id=', c_custkey, '; seg=', c_mktsegment) | parse-where s with 'id=' id:long '; seg=' seg | parse-kv s as (id:long, seg:string) with (pair_delimiter='; ', kv_delimiter='=') | parse kind=regex c_name with '[A-Z]' rest:string '#' num:long | project c_custkey, id, seg, rest, num",
        "SELECT c_custkey, c_custkey AS id, c_mktsegment AS seg, 'ustomer' AS rest, c_custkey AS num FROM customer",
    ),
}

DATETIMES = {
    "starts_and_ends": (
        "events | project event_id, a=startofday(ts), b=startofmonth(ts), c=startofyear(ts), d=startofweek(ts), e=endofday(ts), f=endofweek(ts), g=endofmonth(ts), h=endofyear(ts)",
        "SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS a, date_trunc('month', ts)::TIMESTAMP AS b, date_trunc('year', ts)::TIMESTAMP AS c, date_trunc('day', ts)::TIMESTAMP - to_days(dayofweek(ts)::INTEGER) AS d, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS e, date_trunc('day', ts)::TIMESTAMP - to_days(dayofweek(ts)::INTEGER) + INTERVAL 7 DAY - INTERVAL 1 MICROSECOND AS f, date_trunc('month', ts)::TIMESTAMP + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND AS g, date_trunc('year', ts)::TIMESTAMP + INTERVAL 1 YEAR - INTERVAL 1 MICROSECOND AS h FROM events",
    ),
    "date_parts": (
        "events | project event_id, a=dayofmonth(ts), b=getmonth(ts), c=getyear(ts), d=hourofday(ts), e=monthofyear(ts), f=dayofyear(ts), g=weekofyear(ts), h=week_of_year(ts), i=dayofweek(ts) / 1d, j=datetime_diff('hour', ts, datetime(2024-01-01)), k=datetime_diff('month', ts, datetime(2023-05-01))",
        "SELECT event_id, day(ts) AS a, month(ts) AS b, year(ts) AS c, hour(ts) AS d, month(ts) AS e, dayofyear(ts) AS f, weekofyear(ts) AS g, weekofyear(ts) AS h, dayofweek(ts)::DOUBLE AS i, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 3600000000 AS j, (year(ts) - 2023) * 12 + month(ts) - 5 AS k FROM events",
    ),
    "times": (
        "events | project event_id, a=unixtime_seconds_todatetime(user_id * 1000), b=unixtime_milliseconds_todatetime(user_id * 1000), c=todatetime(format_datetime(ts, 'yyyy-MM-dd HH:mm:ss')), d=make_timespan(1, 2, 3) / 1s, e=totimespan('01:00:00') / 1m, f=format_timespan(user_id * 1h, 'd.hh:mm'), g=datetime_add('month', 1, startofmonth(ts)), h=bin(ts, 1h), i=(ts - startofday(ts)) / 1h < 24.0, j=ts + 1d, k=ts - 90m",
        "SELECT event_id, make_timestamp(user_id * 1000 * 1000000) AS a, make_timestamp(user_id * 1000 * 1000) AS b, date_trunc('second', ts) AS c, 3723.0::DOUBLE AS d, 60.0::DOUBLE AS e, (user_id // 24)::VARCHAR || '.' || lpad((user_id % 24)::VARCHAR, 2, '0') || ':00' AS f, date_trunc('month', ts)::TIMESTAMP + INTERVAL 1 MONTH AS g, date_trunc('hour', ts) AS h, true AS i, ts + INTERVAL 1 DAY AS j, ts - INTERVAL 90 MINUTE AS k FROM events",
    ),
    "past": (
        "events | where ts < now() and ts < ago(1d) | summarize n=count() by event_type, y=make_datetime(format_datetime(ts, 'yyyy-MM-01'))",
        "SELECT count(*) AS n, event_type, date_trunc('month', ts)::TIMESTAMP AS y FROM events GROUP BY ALL",
    ),
}

AGGREGATES = {
    "conditional_aggregates": (
        "lineitem | summarize a=minif(l_quantity, l_tax > 0.04), b=maxif(l_shipdate, l_tax > 0.04), c=avgif(l_quantity, l_tax > 0.04), d=stdevif(l_quantity, l_tax > 0.04), e=varianceif(l_quantity, l_tax > 0.04), f=variancepif(l_quantity, l_tax > 0.04), g=count_distinctif(l_partkey, l_tax > 0.04), h=covarianceif(l_quantity, l_discount, l_tax > 0.04), i=covariancepif(l_quantity, l_discount, l_tax > 0.04) by l_returnflag | extend c=round(c, 6), d=round(d, 6), e=round(e, 6), f=round(f, 6), h=round(h + 1, 6), i=round(i + 1, 6)",
        "SELECT min(l_quantity) AS a, max(l_shipdate) AS b, round(avg(l_quantity), 6) AS c, round(stddev_samp(l_quantity), 6) AS d, round(var_samp(l_quantity), 6) AS e, round(var_pop(l_quantity), 6) AS f, count(DISTINCT l_partkey) AS g, round(covar_samp(l_quantity, l_discount) + 1, 6) AS h, round(covar_pop(l_quantity, l_discount) + 1, 6) AS i, l_returnflag FROM lineitem WHERE l_tax > 0.04 GROUP BY l_returnflag",
    ),
    "spreads": (
        "lineitem | summarize a=variance(l_quantity), b=stdevp(l_quantity), c=covariancep(l_quantity, l_discount), d=count_distinct(l_suppkey), percentiles(l_quantity, 25, 75), p=percentiles_array(l_linenumber, 25, 50) by l_returnflag | extend a=round(a, 6), b=round(b, 6), c=round(c + 1, 6) | project l_returnflag, a, b, c, d, percentile_l_quantity_25, percentile_l_quantity_75, p50=todouble(p[1])",
        "SELECT l_returnflag, round(var_samp(l_quantity), 6) AS a, round(stddev_pop(l_quantity), 6) AS b, round(covar_pop(l_quantity, l_discount) + 1, 6) AS c, count(DISTINCT l_suppkey) AS d, quantile_cont(l_quantity, 0.25) AS percentile_l_quantity_25, quantile_cont(l_quantity, 0.75) AS percentile_l_quantity_75, quantile_cont(l_linenumber, 0.5)::DOUBLE AS p50 FROM lineitem GROUP BY l_returnflag",
    ),
    "lists": (
        "orders | sort by o_orderkey asc | extend c=iff(o_orderkey % 3 == 0, long(null), o_orderkey) | summarize a=make_list(o_orderkey), b=make_list_with_nulls(c), d=make_list_if(o_orderkey, o_totalprice > 150000), e=strcat_delim('-', o_orderkey), f=make_list(c) by o_custkey | extend f=array_length(f)",
        "SELECT '[' || string_agg(o_orderkey, ',' ORDER BY o_orderkey) || ']' AS a, '[' || string_agg(CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE o_orderkey::VARCHAR END, ',' ORDER BY o_orderkey) || ']' AS b, '[' || coalesce(string_agg(o_orderkey, ',' ORDER BY o_orderkey) FILTER (o_totalprice > 150000), '') || ']' AS d, string_agg(o_orderkey, '-' ORDER BY o_orderkey) AS e, count(*) FILTER (o_orderkey % 3 <> 0) AS f, o_custkey FROM orders GROUP BY o_custkey",
    ),
    "sets_and_bags": (
        "orders | summarize a=make_set_if(o_orderstatus, o_totalprice > 100000), b=make_bag(bag_pack(o_orderstatus, 1)), c=make_bag_if(bag_pack(o_orderstatus, 2), o_orderstatus != 'P'), d=take_any(o_custkey), e=anyif(o_custkey, o_custkey >= 0), f=any(o_custkey) by o_custkey | extend a=array_sort_asc(a)",
        """SELECT '[' || coalesce(string_agg(DISTINCT '"' || o_orderstatus || '"', ',' ORDER BY '"' || o_orderstatus || '"') FILTER (o_totalprice > 100000), '') || ']' AS a, '{' || string_agg(DISTINCT '"' || o_orderstatus || '":1', ',' ORDER BY '"' || o_orderstatus || '":1') || '}' AS b, '{' || coalesce(string_agg(DISTINCT '"' || o_orderstatus || '":2', ',' ORDER BY '"' || o_orderstatus || '":2') FILTER (o_orderstatus <> 'P'), '') || '}' AS c, o_custkey AS d, o_custkey AS e, o_custkey AS f, o_custkey FROM orders GROUP BY o_custkey""",
    ),
    "arg_min": (
        "orders | summarize p=arg_min(o_orderkey, o_totalprice), s=arg_max(o_orderkey, o_orderstatus) by o_custkey",
        "SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS p, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY o_custkey",
    ),
}

NETWORK = {
    "ipv4": (
        "customer | extend b=tostring(c_custkey % 256), c=tostring(c_custkey / 256 % 256) | extend ip=strcat('10.', c, '.', b, '.7'), net=strcat('10.', c, '.', b, '.0/24') | project c_custkey, a=parse_ipv4(ip), d=ipv4_is_private(ip), e=ipv4_is_in_range(ip, net), f=ipv4_is_in_any_range(ip, '10.0.0.0/20', '192.168.0.0/16'), g=ipv4_is_match(ip, '10.0.0.0', 12), h=ipv4_compare(ip, '10.0.8.7'), i=ipv4_netmask_suffix(net), j=format_ipv4(ip, 16), k=format_ipv4_mask(ip, 24), l=parse_ipv4_mask(ip, 16), m=has_ipv4(strcat('at ', ip, ', now'), ip), n=has_any_ipv4(strcat('at ', ip), '1.2.3.4', '10.0.1.7'), o=has_ipv4_prefix(ip, '10.0.'), p=has_any_ipv4_prefix(ip, '11.', strcat('10.', c, '.'))",
        "SELECT c_custkey, 167772160 + (c_custkey // 256 % 256) * 65536 + c_custkey % 256 * 256 + 7 AS a, true AS d, true AS e, c_custkey // 256 % 256 = 0 AND c_custkey % 256 < 16 AS f, c_custkey // 256 % 256 < 16 AS g, CAST(sign((c_custkey // 256 % 256) * 256 + c_custkey % 256 - 8) AS BIGINT) AS h, 24::BIGINT AS i, '10.' || c_custkey // 256 % 256 || '.0.0' AS j, '10.' || c_custkey // 256 % 256 || '.' || c_custkey % 256 || '.0/24' AS k, 167772160 + (c_custkey // 256 % 256) * 65536 AS l, true AS m, c_custkey % 65536 = 1 AS n, c_custkey // 256 % 256 = 0 AS o, true AS p FROM customer",
    ),
    "ipv6": (
        "customer | extend k=tostring(c_custkey % 9000 + 1000) | extend ip=strcat('fe80::', k) | project c_custkey, a=parse_ipv6(ip), b=parse_ipv6_mask(ip, 112), c=ipv6_compare(ip, 'fe80::1000'), d=ipv6_is_match(ip, 'fe80::1010', 120), e=ipv6_is_in_range(ip, 'fe80::/64'), f=ipv6_is_in_any_range(ip, 'fc00::/7', 'fe80::1000/120'), g=ipv4_range_to_cidr_list(strcat('10.9.', c_custkey % 256, '.0'), strcat('10.9.', c_custkey % 256, '.127'))",
        """SELECT c_custkey, 'fe80:0000:0000:0000:0000:0000:0000:' || (c_custkey % 9000 + 1000) AS a, 'fe80:0000:0000:0000:0000:0000:0000:0000' AS b, CASE WHEN c_custkey % 9000 = 0 THEN 0 ELSE 1 END::BIGINT AS c, c_custkey % 9000 < 100 AS d, true AS e, c_custkey % 9000 < 100 AS f, '["10.9.' || c_custkey % 256 || '.0/25"]' AS g FROM customer""",
    ),
}

DYNAMICS = {
    "arrays": (
        "part | extend x=pack_array(p_size, p_partkey, 7) | project p_partkey, a=x, b=array_concat(x, dynamic([1])), c=array_index_of(x, 7) >= 0, d=array_reverse(x), e=array_slice(x, 1, 2), f=array_shift_left(x, 1), g=array_shift_right(x, 1, 0), h=strcat_array(x, '+'), i=array_length(x), j=zip(x, dynamic(['p', 'q'])), k=tolong(x[0]) + tolong(x[-1]), l=todynamic('[1,2]'), m=array_sort_desc(dynamic([3, 10, 2]))",
        """SELECT p_partkey, '[' || p_size || ',' || p_partkey || ',7]' AS a, '[' || p_size || ',' || p_partkey || ',7,1]' AS b, true AS c, '[7,' || p_partkey || ',' || p_size || ']' AS d, '[' || p_partkey || ',7]' AS e, '[' || p_partkey || ',7,null]' AS f, '[0,' || p_size || ',' || p_partkey || ']' AS g, p_size || '+' || p_partkey || '+7' AS h, 3::BIGINT AS i, '[[' || p_size || ',"p"],[' || p_partkey || ',"q"],[7,null]]' AS j, CAST(p_size + 7 AS BIGINT) AS k, '[1,2]' AS l, '[10,3,2]' AS m FROM part""",
    ),
    "sets": (
        "part | extend x=pack_array(strcat('a', p_size % 3), strcat('a', p_size % 2)), y=dynamic(['a0', 'a1']) | project p_partkey, a=set_union(x, y), b=set_intersect(x, y), c=set_difference(y, x)",
        """WITH s AS (SELECT p_partkey, list_distinct(['a' || p_size % 3, 'a' || p_size % 2]) AS x, ['a0', 'a1'] AS y FROM part),
 t AS (SELECT p_partkey, list_sort(list_distinct(list_concat(x, y))) AS a, list_sort(list_intersect(x, y)) AS b, list_sort(list_filter(y, lambda v: NOT list_contains(x, v))) AS c FROM s)
 SELECT p_partkey, '[' || array_to_string(list_transform(a, lambda v: '"' || v || '"'), ',') || ']' AS a, '[' || array_to_string(list_transform(b, lambda v: '"' || v || '"'), ',') || ']' AS b, '[' || array_to_string(list_transform(c, lambda v: '"' || v || '"'), ',') || ']' AS c FROM t""",
    ),
    "bags": (
        "part | extend x=bag_pack('k', p_size, 'b', p_brand) | project p_partkey, a=x, b=bag_keys(x), c=bag_has_key(x, 'k'), d=bag_merge(x, dynamic({'k': 0, 'z': 1})), e=bag_remove_keys(x, dynamic(['b'])), f=treepath(x), g=tostring(x.b), h=tolong(x['k']), i=pack('q', 1), j=pack_dictionary('q', 'w')",
        """SELECT p_partkey, '{"b":"' || p_brand || '","k":' || p_size || '}' AS a, '["b","k"]' AS b, true AS c, '{"b":"' || p_brand || '","k":' || p_size || ',"z":1}' AS d, '{"k":' || p_size || '}' AS e, '["$","$[''b'']","$[''k'']"]' AS f, p_brand AS g, p_size::BIGINT AS h, '{"q":1}' AS i, '{"q":"w"}' AS j FROM part""",
    ),
    "bag_unpack": (
        "events | project event_id, d=parse_json(props) | evaluate bag_unpack(d) | project event_id, k",
        "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events",
    ),
    "mv_expand_pairs": (
        "part | extend x=pack_array(p_size, 1), y=pack_array('a') | mv-expand x to typeof(long), y to typeof(string) | project p_partkey, x, y",
        "SELECT p_partkey, p_size::BIGINT AS x, 'a' AS y FROM part UNION ALL SELECT p_partkey, 1, NULL FROM part",
    ),
}

SERIES = {
    "series_arithmetic": (
        "part | extend x=pack_array(p_size, 4, p_partkey), y=pack_array(2, 4, 3) | project p_partkey, a=series_add(x, y), b=series_subtract(x, y), c=series_multiply(x, y), d=series_divide(pack_array(p_size * 2, 8), dynamic([2, 4])), e=series_pow(y, dynamic([2, 2, 2])), f=series_sum(x), g=series_product(dynamic([2, 3, 4])), h=round(series_magnitude(x), 6), i=round(series_pearson_correlation(pack_array(p_size, 1, 99), dynamic([1, 2, 9])), 6), j=series_dot_product(x, y), k=round(series_cosine_similarity(x, y), 6)",
        "SELECT p_partkey, '[' || p_size + 2 || ',8,' || p_partkey + 3 || ']' AS a, '[' || p_size - 2 || ',0,' || p_partkey - 3 || ']' AS b, '[' || p_size * 2 || ',16,' || p_partkey * 3 || ']' AS c, '[' || p_size || ',2]' AS d, '[4,16,9]' AS e, (p_size + 4 + p_partkey)::DOUBLE AS f, 24.0::DOUBLE AS g, round(sqrt(p_size * p_size + 16 + p_partkey * p_partkey), 6) AS h, round((SELECT corr(u, v) FROM (VALUES (p_size::DOUBLE, 1.0::DOUBLE), (1.0, 2.0), (99.0, 9.0)) t(u, v)), 6) AS i, (p_size * 2 + 16 + p_partkey * 3)::DOUBLE AS j, round((p_size * 2 + 16 + p_partkey * 3) / (sqrt(p_size * p_size + 16 + p_partkey * p_partkey) * sqrt(29)), 6) AS k FROM part",
    ),
    "series_comparisons": (
        "part | extend x=pack_array(p_size, 10), y=dynamic([20, 10]) | project p_partkey, a=series_equals(x, y), b=series_not_equals(x, y), c=series_less(x, y), d=series_less_equals(x, y), e=series_greater(x, y), f=series_greater_equals(x, y)",
        "SELECT p_partkey, '[' || (p_size = 20) || ',true]' AS a, '[' || (p_size <> 20) || ',false]' AS b, '[' || (p_size < 20) || ',false]' AS c, '[' || (p_size <= 20) || ',true]' AS d, '[' || (p_size > 20) || ',false]' AS e, '[' || (p_size >= 20) || ',true]' AS f FROM part",
    ),
    "series_functions": (
        "lineitem | extend x=pack_array(l_discount) | project l_orderkey, l_linenumber, a=round(todouble(series_sin(x)[0]) + 2, 6), b=round(todouble(series_cos(x)[0]) + 2, 6), c=round(todouble(series_tan(x)[0]) + 2, 6), d=round(todouble(series_asin(x)[0]) + 2, 6), e=round(todouble(series_acos(x)[0]) + 2, 6), f=round(todouble(series_atan(x)[0]) + 2, 6), g=round(todouble(series_exp(x)[0]), 6), h=series_abs(pack_array(0 - l_linenumber, 2)), i=series_sign(pack_array(0 - l_linenumber, 2)), j=series_ceiling(dynamic([1.5])), k=series_floor(dynamic([1.5])), l=round(todouble(series_log(pack_array(l_quantity))[0]) + 2, 6)",
        "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(sin(l_discount) + 2, 6) AS a, round(cos(l_discount) + 2, 6) AS b, round(tan(l_discount) + 2, 6) AS c, round(asin(l_discount) + 2, 6) AS d, round(acos(l_discount) + 2, 6) AS e, round(atan(l_discount) + 2, 6) AS f, round(exp(l_discount), 6) AS g, '[' || l_linenumber || ',2]' AS h, '[' || CASE WHEN l_linenumber = 0 THEN '0' ELSE '-1' END || ',1]' AS i, '[2]' AS j, '[1]' AS k, round(ln(l_quantity) + 2, 6) AS l FROM lineitem",
    ),
    "series_fills": (
        "part | extend x=array_concat(dynamic([null]), pack_array(p_size), dynamic([null]), pack_array(p_size + 2), dynamic([null])) | project p_partkey, a=series_fill_forward(x), b=series_fill_backward(x), c=series_fill_const(x, 0), d=series_fill_linear(x), e=tolong(series_stats_dynamic(pack_array(p_size, 5)).sum)",
        "SELECT p_partkey, '[null,' || p_size || ',' || p_size || ',' || p_size + 2 || ',' || p_size + 2 || ']' AS a, '[' || p_size || ',' || p_size || ',' || p_size + 2 || ',' || p_size + 2 || ',null]' AS b, '[0,' || p_size || ',0,' || p_size + 2 || ',0]' AS c, '[' || p_size || ',' || p_size || ',' || p_size + 1 || ',' || p_size + 2 || ',' || p_size + 2 || ']' AS d, (p_size + 5)::BIGINT AS e FROM part",
    ),
}

SHAPES = {
    "range_rows": ("range x from 1 to 1000 step 7 | extend y=x * x | where y % 2 == 0", "SELECT x::BIGINT AS x, x * x AS y FROM range(1, 1001, 7) r(x) WHERE x * x % 2 = 0"),
    "datatable_join": (
        "customer | join kind=inner (datatable(c_nationkey:int, area:string)[0, 'x', 1, 'y', 2, 'z']) on c_nationkey | summarize n=count() by area",
        "SELECT count(*) AS n, area FROM customer JOIN (VALUES (0, 'x'), (1, 'y'), (2, 'z')) t(k, area) ON c_nationkey = k GROUP BY area",
    ),
    "print_values": ("print a=1 + 2, b='x', c=2.5 * 2, d=datetime(2024-02-03), e=1h / 1m, f=true", "SELECT 3::BIGINT AS a, 'x' AS b, 5.0::DOUBLE AS c, TIMESTAMP '2024-02-03' AS d, 60.0::DOUBLE AS e, true AS f"),
    "by_names": ("part | project-by-names dynamic(['p_size', 'p_partkey']) | as P | union (P | where p_size > 40) | project-away p_size | sort by p_partkey asc", "SELECT p_partkey FROM part UNION ALL SELECT p_partkey FROM part WHERE p_size > 40"),
    "schemas": ("orders | project o_orderkey, o_totalprice, o_orderdate | getschema | project ColumnName, ColumnType", "SELECT * FROM (VALUES ('o_orderkey', 'long'), ('o_totalprice', 'real'), ('o_orderdate', 'datetime')) t(ColumnName, ColumnType)"),
    "render": ("orders | summarize n=count() by o_orderstatus | render barchart with (title='n')", "SELECT count(*) AS n, o_orderstatus FROM orders GROUP BY o_orderstatus"),
    "takes": ("orders | take 17 | count | union (orders | limit 5 | count), (orders | sample 11 | count), (orders | sample-distinct 3 of o_orderstatus | count)", "SELECT * FROM (VALUES (17::BIGINT), (5), (11), ((SELECT least(3, count(DISTINCT o_orderstatus)) FROM orders))) t(Count)"),
    "search": ("search in (customer, nation) 'FURNITURE' | summarize n=count() by Column", "SELECT count(*) AS n, 'c_mktsegment' AS \"Column\" FROM customer WHERE c_mktsegment = 'FURNITURE' HAVING count(*) > 0"),
    "graph_paths": (
        "customer | project a=strcat('c', c_custkey), b=strcat('n', c_nationkey) | union (nation | project a=strcat('n', n_nationkey), b=strcat('r', n_regionkey)) | make-graph a --> b | graph-match (x)-[e]->(y)-[f]->(z) where z.NodeId != 'r0' project x.NodeId, y.NodeId, z.NodeId",
        "SELECT 'c' || c_custkey AS \"x.NodeId\", 'n' || c_nationkey AS \"y.NodeId\", 'r' || n_regionkey AS \"z.NodeId\" FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 0",
    ),
    "graph_walks": (
        "customer | project a=strcat('c', c_custkey), b=strcat('n', c_nationkey) | union (nation | project a=strcat('n', n_nationkey), b=strcat('r', n_regionkey)) | make-graph a --> b | graph-match (x)-[e*1..3]->(y) where y.NodeId startswith 'r' project x=x.NodeId, y=y.NodeId, hops=array_length(e.a)",
        "SELECT 'c' || c_custkey AS x, 'r' || n_regionkey AS y, 2::BIGINT AS hops FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1 FROM nation",
    ),
    "graph_tables": (
        "customer | project a=strcat('c', c_custkey), b=strcat('n', c_nationkey) | make-graph a --> b | graph-to-table nodes | count",
        "SELECT count(*) AS \"Count\" FROM (SELECT 'c' || c_custkey AS v FROM customer UNION SELECT 'n' || c_nationkey FROM customer)",
    ),
    "make_series_nonempty": (
        "events | make-series total=sum(value) default=0, n=count() on ts from datetime(2024-01-01) to datetime(2024-01-06) step 1d | project n",
        "SELECT '[' || string_agg(n, ',' ORDER BY d) || ']' AS n FROM (SELECT d, count(e.ts) AS n FROM range(0, 5) r(d) LEFT JOIN events e ON e.ts >= TIMESTAMP '2024-01-01' + to_days(CAST(d AS INTEGER)) AND e.ts < TIMESTAMP '2024-01-01' + to_days(CAST(d AS INTEGER) + 1) GROUP BY d)",
    ),
}

QUERIES: dict[str, tuple[str, str | None]] = JOINS | PREDICATES | MATH | STRINGS | DATETIMES | AGGREGATES | NETWORK | DYNAMICS | SERIES | SHAPES


def _engine(spark: SparkSession, sf_dir: str) -> tuple[Engine, str]:
    """An engine whose stored tables lie in a new folder, and that folder."""
    root = folder(spark)
    out = Engine(spark, root)
    for name in ("customer", "nation", "orders", "part"):
        out.register_parquet(name, f"{sf_dir}/{name}.parquet")
    return out, root


def file_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """csv(), json(), ndjson() and parquet() of files that Spark wrote."""
    engine, root = _engine(spark, sf_dir)
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    customer.write.option("header", True).csv(f"{root}/c.csv")
    customer.write.json(f"{root}/c.jsonl")
    return engine.query(f"""csv('{root}/c.csv') | project kind='csv', c_custkey, c_acctbal, c_mktsegment
 | union (ndjson('{root}/c.jsonl') | project kind='ndjson', c_custkey, c_acctbal, c_mktsegment), (parquet('{sf_dir}/customer.parquet') | project kind='parquet', c_custkey, c_acctbal, c_mktsegment)""")


def stored_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands that create, fill, change, merge and drop stored tables."""
    engine, _ = _engine(spark, sf_dir)
    for command in (
        ".create table T (k:long, seg:string)",
        ".set-or-append T <| customer | project k=c_custkey, seg=c_mktsegment",
        ".ingest inline into table T <|\n-1,EXTRA\n-2,EXTRA",
        ".create-merge table T (note:string)",
        ".set Copy <| T | where k >= 0 | project k, seg",
        ".compact table T",
        ".merge table Copy extents",
        ".gc table T",
        ".create-or-alter function Above(least:long=0) { T | where k >= least }",
        ".set Gone <| T | take 1",
        ".drop table Gone",
    ):
        engine.query(command)
    return engine.query("Above(-1) | summarize n=count(), noted=countif(isnotempty(note)) by seg | union (Copy | summarize n=count() by seg=strcat('copy ', seg))")


def followed_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view that is filled when made and merges each append."""
    engine, _ = _engine(spark, sf_dir)
    for command in (
        ".set T <| orders | where o_totalprice <= 100000 | project o_custkey, o_totalprice, o_orderstatus",
        ".create materialized-view V on table T { T | summarize n=count(), hi=max(o_totalprice), kinds=dcount(o_orderstatus) by o_custkey }",
        ".set-or-append T <| orders | where o_totalprice > 100000 and o_totalprice <= 200000 | project o_custkey, o_totalprice, o_orderstatus",
        ".set-or-append T <| orders | where o_totalprice > 200000 | project o_custkey, o_totalprice, o_orderstatus",
    ):
        engine.query(command)
    return engine.query("V")


#: Name: (function, SQL).
RUNS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "file_sources": (file_sources, "SELECT kind, c_custkey, c_acctbal, c_mktsegment FROM customer CROSS JOIN (VALUES ('csv'), ('ndjson'), ('parquet')) t(kind)"),
    "stored_tables": (
        stored_tables,
        "SELECT n, noted, seg FROM (SELECT count(*) AS n, 0::BIGINT AS noted, c_mktsegment AS seg FROM customer GROUP BY 3 UNION ALL SELECT 1, 0, 'EXTRA' UNION ALL SELECT count(*), NULL, 'copy ' || c_mktsegment FROM customer GROUP BY 3)",
    ),
    "followed_view": (followed_view, "SELECT count(*) AS n, max(o_totalprice) AS hi, count(DISTINCT o_orderstatus) AS kinds, o_custkey FROM orders GROUP BY o_custkey"),
}
