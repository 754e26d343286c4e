"""Blocks, context windows, scores, corpus and conversation statistics."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from activity_engine.functions import text as tx
from activity_engine.operators import corpus, graph, ordered, select
from activity_engine.plans.params import MARKERS, STYLE_REASONING, STYLE_SIGNATURES, STYLE_SLANG, WINDOW_SIZES
from activity_engine.plans.registry import Tables, query
from activity_engine.plans.text_queries import escaped, hits, word_hits
from activity_engine.session import durable

OWNER = "assistant"
_SYSTEM = ("que la", "nicht ")


@cache
def _style() -> corpus.Style:
    return corpus.Style(tx.word_pattern(STYLE_SIGNATURES), tx.word_pattern(STYLE_SLANG), tx.word_pattern(STYLE_REASONING))


def points_sql(text: str) -> str:
    lines = f"(length({text}) - length(replace({text}, chr(10), '')) + 1)"
    words = hits(text, chr(92) + "S+")
    return f"""({word_hits(text, STYLE_SIGNATURES)} * 3 + {word_hits(text, STYLE_SLANG)} * 1.5::double + {word_hits(text, STYLE_REASONING)} * 2
 + case when {lines} >= 3 then 3 else 0 end + case when {lines} >= 6 then 4 else 0 end
 + case when {words} > 30 then 2 else 0 end + case when {words} > 100 then 3 else 0 end)"""


_BLOCKS = f"""m as (select conv_id, turn, case when role = 'assistant' then role else 'user' end as sender, text from conversations
  where text <> '' and not regexp_matches(text, '(?i){'|'.join(_SYSTEM)}')),
 l as (select *, lag(sender) over (partition by conv_id order by turn) as before from m),
 r as (select *, sum(case when before <> sender then 1 else 0 end) over (partition by conv_id order by turn) as block_no from l),
 b as (select conv_id, block_no::bigint as block_no, min(sender) as sender, string_agg(text, chr(10) order by turn) as text, count(*) as n_msgs
  from r group by conv_id, block_no),
 p as (select *, {word_hits('text', STYLE_SLANG)} + {word_hits('text', STYLE_REASONING)} as points, {points_sql('text')} as style from b),
 w as (select t.conv_id, t.block_no, s.size, t.text, t.style, t.sender, string_agg(h.sender || ': ' || h.text, chr(10) order by h.block_no) as history,
  floor(t.style) + sum(h.points)::double / s.size as score, sum(case when h.sender = 'assistant' then h.style else 0 end) + t.style as example
  from p t, (select unnest([{', '.join(map(str, WINDOW_SIZES))}]) as size) s, p h
  where t.sender = 'assistant' and t.block_no >= s.size and h.conv_id = t.conv_id and h.block_no between t.block_no - s.size and t.block_no - 1
  group by t.conv_id, t.block_no, s.size, t.text, t.style, t.sender)"""


def _blocks(t: Tables) -> DataFrame:
    """Turns with 'system' counted as 'user', system-like texts left out."""
    sender = F.when(F.col("role") == OWNER, F.lit(OWNER)).otherwise("user")
    messages = t.conversations.filter(~tx.is_chat_noise(F.col("text"), _SYSTEM)).withColumn("sender", sender)
    return corpus.turn_blocks(messages, "conv_id", "turn", "sender", "text")


def _scores(blocks: DataFrame) -> DataFrame:
    return corpus.window_scores(blocks, "conv_id", OWNER, _style(), WINDOW_SIZES)


@query(f"with {_BLOCKS} select conv_id, block_no, sender, text, n_msgs from b")
def turn_blocks(t: Tables) -> DataFrame:
    return _blocks(t)


@query(f"with {_BLOCKS} select conv_id, block_no, size::int as size, history from w")
def context_windows(t: Tables) -> DataFrame:
    lines = F.transform("history", lambda b: F.concat(b["sender"], F.lit(": "), b["text"]))
    made = corpus.context_windows(_blocks(t), "conv_id", OWNER, WINDOW_SIZES)
    return made.select("conv_id", "block_no", "size", F.array_join(lines, "\n").alias("history"))


@query(f"with {_BLOCKS} select conv_id, block_no, size::int as size, round(score, 6) as score from w where score >= 7")
def window_score(t: Tables) -> DataFrame:
    kept = _scores(_blocks(t)).filter(F.col("score") >= corpus.MIN_SCORE)
    return kept.select("conv_id", "block_no", "size", F.round("score", 6).alias("score"))


@query(f"select conv_id, turn, floor({points_sql('text')})::int as score from conversations")
def style_score(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", corpus.block_score(F.col("text"), _style()).alias("score"))


def _examples(t: Tables) -> DataFrame:
    """Best windows per conversation as training examples with the score of their assistant turns."""
    blocks = durable(_blocks(t))  # read for the scores and again for the winners' texts
    best = corpus.best_per_person(_scores(blocks), "conv_id")
    made = corpus.messages_of(corpus.with_history(best, blocks, "conv_id"), OWNER)
    return made.withColumn("example", corpus.example_score(F.col("messages"), _style()))


@query(f"with {_BLOCKS} select conv_id, block_no, size::int as size, example as score from w where score >= 7")
def example_score(t: Tables) -> DataFrame:
    return _examples(t).select("conv_id", "block_no", "size", F.col("example").alias("score"))


_TOP = f"""with {_BLOCKS}, x as (select *, row_number() over (order by example desc, conv_id, block_no, size) as rank from w where score >= 7)"""


@query(_TOP + " select conv_id, block_no, size::int as size, example as score from x where rank <= 300")
def top_examples(t: Tables) -> DataFrame:
    found = _examples(t).select("conv_id", "block_no", "size", F.col("example").alias("score"))
    return found.orderBy(F.desc("score"), "conv_id", "block_no", "size").limit(corpus.TOP_EXAMPLES)


_SPOKEN = """array_to_string(list_transform(list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(x)), lambda x: x <> ''), lambda x: {who} || ': ' || x), chr(10))"""


@query(f"""with {_BLOCKS}, x as (select *, row_number() over (order by example desc, conv_id, block_no, size) as rank from w where score >= 7),
 h as (select x.rank, h.block_no, {_SPOKEN.format(text='h.text', who="case when h.sender = 'assistant' then 'Me' else 'Other' end")} as said
  from x join b h on h.conv_id = x.conv_id and h.block_no between x.block_no - x.size and x.block_no where x.rank <= 300)
 select rank, '--- Exemple ' || rank || ' ---' || chr(10) || string_agg(said, chr(10) order by block_no) || chr(10) as value from h group by rank""")
def corpus_lines(t: Tables) -> DataFrame:
    """Text of the best examples, one row per example."""
    best = _examples(t).orderBy(F.desc("example"), "conv_id", "block_no", "size").limit(corpus.TOP_EXAMPLES)
    keyed = best.withColumn("_order", -F.col("example"))
    numbered = ordered.dense_position(keyed, [], ["_order", "conv_id", "block_no", "size"], "rank")
    rank = F.col("rank") + 1
    return numbered.select(rank.alias("rank"), corpus.corpus_text(F.col("messages"), rank, "Me", "Other").alias("value"))


@query(f"""with {_BLOCKS} select w.conv_id, w.block_no, size::int as size, '{{"messages":['
 || string_agg(to_json({{'role': h.sender, 'content': h.text}})::varchar, ',' order by h.block_no) || ']}}' as json
 from w join b h on h.conv_id = w.conv_id and h.block_no between w.block_no - size and w.block_no where score >= 7 group by w.conv_id, w.block_no, size""")
def chat_json(t: Tables) -> DataFrame:
    return _examples(t).select("conv_id", "block_no", "size", corpus.chat_json(F.col("messages")).alias("json"))


@query(f"""select conv_id, role, {escaped('substr(text, 1, 120)')} as preview, rank::int as rank from (select *, row_number() over (partition by conv_id
 order by turn desc) as rank from conversations where text <> '' and length(text) <= 300 and not regexp_matches(text, '(?i){'|'.join(_SYSTEM)}')) where rank <= 4""")
def recent_messages(t: Tables) -> DataFrame:
    shown = t.conversations.filter((F.length("text") <= 300) & ~tx.is_chat_noise(F.col("text"), _SYSTEM))
    last = select.top_per_group(shown, ["conv_id"], [F.desc("turn")], 4)
    return last.select("conv_id", "role", tx.html_escape(F.substring("text", 1, 120)).alias("preview"), "rank")


_MARKED = " or ".join(f"contains(lower(text), '{m}')" for m in MARKERS)


@query(f"""select role, count(*) as n, round(100.0 * count(*) filter (where {_MARKED}) / count(*), 6) as pct from conversations group by role""")
def marker_share(t: Tables) -> DataFrame:
    marked = tx.contains_any(F.lower("text"), MARKERS)
    share = F.try_divide(100.0 * F.count_if(marked), F.count("*"))
    return t.conversations.groupBy("role").agg(F.count("*").alias("n"), F.round(share, 6).alias("pct"))


@query(f"""select role, conv_id, turn, rank::int as rank, case when length(text) > 200 then substr(text, 1, 200) || '...' else text end as sample from (
 select *, row_number() over (partition by role order by conv_id, turn) as rank from conversations where {_MARKED}) where rank <= 3""")
def marker_samples(t: Tables) -> DataFrame:
    marked = t.conversations.filter(tx.contains_any(F.lower("text"), MARKERS))
    first = select.top_per_group(marked, ["role"], [F.col("conv_id"), F.col("turn")], 3)
    return first.select("role", "conv_id", "turn", "rank", tx.preview(F.col("text"), 200).alias("sample"))


@query("""with c as (select o_custkey, strftime(o_orderdate, '%Y-%m') as m, count(*) as n from orders group by all),
 k as (select o_custkey, m as peak_month, n as peak_count from (select *, row_number() over (partition by o_custkey order by n desc, m) as rn from c) where rn = 1)
 select o_custkey, min(o_orderdate) as first_ts, max(o_orderdate) as last_ts, count(*) filter (where o_orderstatus = 'F') as sent,
 count(*) filter (where o_orderstatus <> 'F') as received, any_value(peak_month) as peak_month, any_value(peak_count) as peak_count
 from orders join k using (o_custkey) group by o_custkey""")
def conv_stats(t: Tables) -> DataFrame:
    return graph.conversation_stats(t.orders, ["o_custkey"], "o_orderdate", F.col("o_orderstatus") == "F")


_CONTACTS = """c as (select o_custkey, count(*) as message_count from orders group by o_custkey having count(*) >= 5),
 k as (select c.*, coalesce(c_acctbal > 5000, false) as is_close from c left join customer on c_custkey = o_custkey),
 s as (select *, case when is_close then floor(20 + 44 * (message_count::double / (select max(message_count) from k)))
  else floor(1 + 11 * (message_count::double / (select max(message_count) from k))) end::int as size,
  round(0.8::double + floor(2 * (message_count::double / (select max(message_count) from k))), 1) as width from k)"""


def _contacts(t: Tables) -> DataFrame:
    close = t.customer.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return graph.contact_strength(t.orders, "o_custkey", close)


@query(f"with {_CONTACTS} select o_custkey, message_count, is_close, message_count * case when is_close then 2.0::double else 1 end as weight from k")
def contact_weight(t: Tables) -> DataFrame:
    return _contacts(t)


@query(f"with {_CONTACTS} select o_custkey, is_close, size, width from s")
def node_scale(t: Tables) -> DataFrame:
    return graph.scaled_nodes(_contacts(t)).select("o_custkey", "is_close", "size", "width")


@query(f"""with {_CONTACTS} select 'me' as node_id, false as is_close, 0::bigint as message_count, 80::int as size
 union all select o_custkey::varchar, is_close, message_count, size from s""")
def ego_nodes(t: Tables) -> DataFrame:
    return graph.ego_nodes(_contacts(t), "o_custkey", F.lit("me"))


@query(f"with {_CONTACTS} select 'me' as src, o_custkey::varchar as dst, is_close, width from s")
def ego_edges(t: Tables) -> DataFrame:
    return graph.ego_edges(_contacts(t), "o_custkey", F.lit("me"))


@query(f"""with {_CONTACTS}, n as (select 'me' as node_id, false as is_close, 0 as message_count, 80 as size
 union all select o_custkey::varchar, is_close, message_count, size from s)
 select 'nodes' as part, to_json({{'node_id': node_id, 'is_close': is_close, 'message_count': message_count, 'size': size}})::varchar as json from n
 union all select 'links', to_json({{'src': 'me', 'dst': o_custkey::varchar, 'is_close': is_close, 'width': width}})::varchar from s""")
def graph_lines(t: Tables) -> DataFrame:
    contacts = _contacts(t)
    me = F.lit("me")
    return graph.graph_json(graph.ego_nodes(contacts, "o_custkey", me), graph.ego_edges(contacts, "o_custkey", me))
