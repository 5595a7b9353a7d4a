"""Registered queries: the ad-hoc SQL surface, as text through sqlapi."""

from __future__ import annotations

from lodestone.plans.registry import query, same_sql

same_sql("Z01_full_join", "select coalesce(a.id, b.id) as id, a.n as calls_in, b.n as calls_out from (select target as id, count(*) as n from edges where kind = 'calls' group by target) a full outer join (select source as id, count(*) as n from edges where kind = 'calls' group by source) b on a.id = b.id")
same_sql("Z01_using", "select c_custkey, o_orderkey from customer join (select o_custkey as c_custkey, o_orderkey, o_totalprice from orders) o using (c_custkey) where o_totalprice > 200000")
same_sql("Z01_left_right", "select n_name, r_name from nation left join region on n_regionkey = r_regionkey and r_name like 'A%' union all select n_name, r_name from nation right join region on n_regionkey = r_regionkey and n_nationkey < 5")
same_sql("Z02_range_join", "select a.event_id as a, b.event_id as b from events a join events b on a.user_id = b.user_id and b.ts > a.ts and b.ts <= a.ts + interval 1 hour")
same_sql("Z03_exists", "select c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o_totalprice > 300000) and not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o_orderstatus = 'P')")
same_sql("Z03_in", "select p_partkey from part where p_partkey in (select l_partkey from lineitem where l_quantity >= 50)")
same_sql("Z04_scalar_subquery", "select o_orderkey, o_totalprice from orders o where o_totalprice > (select avg(o_totalprice) * 1.8 from orders i where i.o_custkey = o.o_custkey)")
same_sql("Z05_having", "select l_suppkey, count(*) as n, count(distinct l_partkey) as parts, count(*) filter (where l_returnflag = 'R') as returned from lineitem group by l_suppkey having count(*) > 600")
same_sql("Z06_aggregates", "select l_returnflag, count(*) as n, round(avg(l_quantity), 6) as mean, min(l_tax) as low, max(l_tax) as high, coalesce(sum(case when l_quantity > 1000 then l_quantity end), 0.0) as total from lineitem group by l_returnflag")
same_sql("Z07_group_concat", "select r_name, listagg(distinct n_name, ',') within group (order by n_name) as names from nation join region on n_regionkey = r_regionkey group by r_name", "select r_name, string_agg(distinct n_name, ',' order by n_name) as names from nation join region on n_regionkey = r_regionkey group by r_name")
same_sql("Z08_ranking", "select c_custkey, row_number() over w as rn, rank() over w as rk, dense_rank() over w as dr, ntile(4) over w as nt, round(percent_rank() over w, 6) as pr, round(cume_dist() over w, 6) as cd from customer window w as (partition by c_nationkey order by c_acctbal, c_custkey)")
same_sql("Z09_analytic", "select o_orderkey, lag(o_orderkey) over w as before, lead(o_orderkey, 2) over w as after, first_value(o_orderkey) over w as first, nth_value(o_orderkey, 2) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following) as second from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)")
same_sql("Z10_rows_frame", "select event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 2 preceding and current row), 4) as mean from events")
same_sql("Z11_range_frame", "select p_partkey, count(*) over (partition by p_brand order by p_size range between 2 preceding and 1 following) as n from part")
same_sql("Z12_groups_frame", "select p_partkey, count(*) over (partition by p_brand order by g range between 1 preceding and 1 following) as n from (select *, dense_rank() over (partition by p_brand order by p_size) as g from part) x", "select p_partkey, count(*) over (partition by p_brand order by p_size groups between 1 preceding and 1 following) as n from part")
same_sql("Z13_union", "select n_name as name from nation union select r_name from region union all select 'x'")
same_sql("Z14_intersect", "select o_custkey as id from orders where o_totalprice > 200000 intersect select c_custkey from customer where c_acctbal > 0")
same_sql("Z14_except", "select c_custkey as id from customer except select o_custkey from orders where o_totalprice > 400000")
same_sql("Z15_offset", "select c_custkey, c_name from customer order by c_acctbal desc nulls last, c_custkey limit 10 offset 20")
same_sql("Z16_with", "with a as (select o_custkey, sum(o_totalprice) as spent from orders group by o_custkey), b as (select avg(spent) as mean from a) select o_custkey, round(spent, 2) as spent from a where spent > (select mean * 2 from b)")
same_sql("Z16_recursive", "with recursive up(id, d) as (select 'part:1', 0 union all select e.source, d + 1 from up join edges e on e.target = up.id and e.kind = 'calls' where d < 3) select id, min(d) as depth from up group by id")
same_sql("Z17_strings", "select p_partkey, lower(p_name) as lo, upper(p_name) as up, length(p_name) as n, substr(p_name, 2, 3) as sub, substr(p_name, -3) as tail, instr(p_name, ' ') as at, replace(p_name, ' ', '-') as dashed, trim('  ' || p_name || ' ') as trimmed, 'p' || p_brand as joined from part")
same_sql("Z17_printf", "select p_partkey, format_string('%05d:%s', p_partkey, p_brand) as f, chr(65 + cast(p_partkey % 26 as int)) as c, ascii(p_name) as a, hex(p_brand) as h from part", "select p_partkey, printf('%05d:%s', p_partkey, p_brand) as f, chr(65 + cast(p_partkey % 26 as int)) as c, ascii(p_name) as a, hex(p_brand) as h from part")
same_sql("Z18_patterns", "select p_partkey from part where p_name ilike '%RED%' or p_name rlike '^b.*s$'", "select p_partkey from part where p_name ilike '%RED%' or p_name glob 'b*s'")
same_sql("Z19_math", "select p_partkey, abs(p_size - 25) as a, round(p_retailprice, 1) as r, p_partkey div 7 as d, p_partkey % 7 as m from part", "select p_partkey, abs(p_size - 25) as a, round(p_retailprice, 1) as r, p_partkey // 7 as d, p_partkey % 7 as m from part")
same_sql("Z20_dates", "select date_format(o_orderdate, 'yyyy-MM') as month, count(*) as n, max(datediff(o_orderdate, date'1992-01-01')) as days from orders group by 1", "select strftime(o_orderdate, '%Y-%m') as month, count(*) as n, max(date_diff('day', date '1992-01-01', cast(o_orderdate as date))) as days from orders group by 1")
same_sql("Z21_json", "select event_id, get_json_object(props, '$.page') as page, json_array_length('[1,2,3]') as n from events", "select event_id, json_extract_string(props, '$.page') as page, json_array_length('[1,2,3]') as n from events")
same_sql("Z21_json_each", "select k, count(*) as n from (select explode(json_object_keys(props)) as k from events) x group by k", "select k, count(*) as n from (select unnest(json_keys(props)) as k from events) x group by k")
same_sql("Z22_case", "select l_orderkey, l_linenumber, case when l_tax > 0.05 then 'high' else 'low' end as tax, if(l_discount > 0, 1, 0) as off, coalesce(nullif(l_returnflag, 'N'), '-') as flag, try_cast(l_linestatus as int) as bad from lineitem", "select l_orderkey, l_linenumber, case when l_tax > 0.05 then 'high' else 'low' end as tax, if(l_discount > 0, 1, 0) as off, coalesce(nullif(l_returnflag, 'N'), '-') as flag, try_cast(l_linestatus as int) as bad from lineitem")
same_sql("Z26_grouping_sets", "select l_returnflag, l_linestatus, grouping(l_returnflag) as g, count(*) as n from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())")
same_sql("Z26_cube", "select p_brand, p_size, count(*) as n from part where p_size < 5 group by cube (p_brand, p_size)")
same_sql("S15_query", "select kind, provenance, count(*) as n from edges group by kind, provenance")


@query("Z22_typeof", "select p_partkey, lower(typeof(p_partkey)) as a, replace(typeof(p_name), 'VARCHAR', 'string') as b, lower(typeof(p_retailprice)) as c, lower(typeof(p_size > 5)) as d from part")
def typeof(g):
    return g.sql("select p_partkey, typeof(p_partkey) as a, typeof(p_name) as b, typeof(p_retailprice) as c, typeof(p_size > 5) as d from part")
