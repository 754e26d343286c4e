"""Data-quality checks of the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from activity_engine.operators import quality as q
from activity_engine.plans.registry import Tables, query

_REQUIRED = {
    "events": (["event_id", "ts", "user_id"], 100),
    "orders": (["o_orderkey", "o_custkey", "o_orderdate"], 1000),
    "lineitem": (["l_orderkey", "l_partkey"], 1000),
    "documents": (["doc_id", "text", "lang"], 100),
    "pages": (["page_id", "html"], 10),
    "conversations": (["conv_id", "turn", "text"], 10),
    "labels": (["doc_id", "quality"], 10_000_000),
}


@query(" union all ".join(
    f"select '{n}' as table_name, case when count(*) >= {rows} then 'OK' else 'FAIL' end as status, count(*) || ' rows' as detail from {n}"
    for n, (_, rows) in _REQUIRED.items()))
def dq_required(t: Tables) -> DataFrame:
    checks = [q.check_required(getattr(t, name), name, columns, rows) for name, (columns, rows) in _REQUIRED.items()]
    return reduce(DataFrame.unionByName, checks)


def _rule_sql(table: str, column: str, rule: str, violated: str) -> str:
    count = f"count(*) filter (where {violated})"
    return f"select '{table}' as table_name, '{column}' as \"column\", '{rule}' as rule, {count} as violations, {count} = 0 as passed from {table}"


@query(" union all ".join([
    _rule_sql("orders", "o_custkey", "not_null", "o_custkey is null"),
    _rule_sql("orders", "o_totalprice", "positive", "o_totalprice <= 0"),
    _rule_sql("orders", "o_orderstatus", "one_of", "o_orderstatus not in ('F', 'O')"),
    _rule_sql("lineitem", "l_quantity", "at_least", "l_quantity < 5"),
    _rule_sql("lineitem", "l_discount", "positive", "l_discount <= 0"),
    _rule_sql("events", "props", "castable", "props is not null and try_cast(props as int) is null"),
    _rule_sql("events", "value", "at_least", "value < 1"),
]))
def dq_rules(t: Tables) -> DataFrame:
    checks = [
        q.check_rules(t.orders, "orders", [
            q.not_null("o_custkey"), q.positive("o_totalprice"), q.one_of("o_orderstatus", ["F", "O"])]),
        q.check_rules(t.lineitem, "lineitem", [q.at_least("l_quantity", 5), q.positive("l_discount")]),
        q.check_rules(t.events, "events", [q.castable("props", "int"), q.at_least("value", 1)]),
    ]
    return reduce(DataFrame.unionByName, checks)


def _unique_sql(table: str, keys: str, tolerance: int) -> str:
    surplus = f"(count(*) - (select count(*) from (select distinct {keys} from {table})))"
    return f"select '{table}' as table_name, '{keys}' as key, {surplus} as duplicates, {surplus} <= {tolerance} as passed from {table}"


@query(" union all ".join([
    _unique_sql("orders", "o_orderkey", 0), _unique_sql("lineitem", "l_orderkey,l_linenumber", 10),
    _unique_sql("documents", "lang,source", 10), _unique_sql("conversations", "conv_id,turn", 0)]))
def dq_unique(t: Tables) -> DataFrame:
    checks = [
        q.check_unique(t.orders, "orders", ["o_orderkey"]),
        q.check_unique(t.lineitem, "lineitem", ["l_orderkey", "l_linenumber"], 10),
        q.check_unique(t.documents, "documents", ["lang", "source"], 10),
        q.check_unique(t.conversations, "conversations", ["conv_id", "turn"]),
    ]
    return reduce(DataFrame.unionByName, checks)


@query("""with d as (select lang, text, count(*) as n from documents group by all)
 select lang, sum(n)::bigint as rows, count(*) as texts, sum(n - 1)::bigint as copies from d group by lang""")
def dup_keys(t: Tables) -> DataFrame:
    copies = t.documents.groupBy("lang", F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"))
    return copies.groupBy("lang").agg(
        F.sum("n").alias("rows"), F.count("*").alias("texts"), F.sum(F.col("n") - 1).alias("copies")
    )


def _time_sql(table: str, ts: str, bound: str) -> str:
    days = f"datediff('day', min({ts}), max({ts}))::int"
    return f"""select '{table}' as table_name, min({ts}) as first_ts, max({ts}) as last_ts, {days} as days,
 max({ts}) <= timestamp '{bound}' as in_past, {days} >= 365 as long_enough from {table}"""


@query(_time_sql("orders", "o_orderdate", "2024-01-15") + " union all " + _time_sql("events", "ts", "2024-01-15"))
def dq_time(t: Tables) -> DataFrame:
    bound = F.lit("2024-01-15").cast("timestamp_ntz")
    return q.check_time(t.orders, "orders", "o_orderdate", bound, 365).unionByName(q.check_time(t.events, "events", "ts", bound, 365))


@query("""select 'lineitem' as table_name, 'l_orderkey' as key, count(*) as orphans from lineitem
 where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P')
 union all select 'labels', 'doc_id', count(*) from labels where doc_id not in (select doc_id from documents where lang = 'en')""")
def dq_orphans(t: Tables) -> DataFrame:
    done = t.orders.filter("o_orderstatus <> 'P'")
    english = t.documents.filter("lang = 'en'")
    return q.check_orphans(t.lineitem, done, "l_orderkey", "o_orderkey", "lineitem").unionByName(
        q.check_orphans(t.labels, english, "doc_id", "doc_id", "labels")
    )
