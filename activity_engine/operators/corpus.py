"""From ordered messages to scored training examples: blocks, context windows, style scores, corpus text."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from activity_engine.functions import text as tx
from activity_engine.operators.ordered import OrderedRows, number_runs
from activity_engine.operators.select import top_per_group

# Style words of the corpus owner, as regular expression alternatives.
SLANG = r"(?iU)\b(dcp|jsp|genre|fin\b|mtn|att\b|bah|nan\b|wsh|wesh|ptn|tqt|oe\b|cv\b|enft|vrais)\b"
SIGNATURES = (
    r"(?iU)\b(gnon|mouais|unhun|\bui\b|réel\b|miskine|aïe)\b"
    r"|(mais wsh|oh la+la+|pas compris|alors là|c quoi|nan mais|en vrais?|bah oui|bah non|bah nan)"
)
REASONING = (
    r"(?iU)\b(en gros|je comprends|du coup|parce que|je pense que|c'est logique|c'est normal|faut\b"
    r"|je sais pas mais|en fait|au final|finalement|sauf que|même si)\b"
)
CONTEXT_SIZES = (2, 5, 12, 25, 40)
MIN_SCORE = 7
PER_PERSON = 800
TOP_EXAMPLES = 300


@dataclass(frozen=True)
class Style:
    """Patterns whose occurrences make a block interesting."""

    signatures: str = SIGNATURES
    slang: str = SLANG
    reasoning: str = REASONING


def style_points(text: Column, style: Style) -> Column:
    """Signatures x3, slang x1.5, reasoning x2, and bonuses for bursts (3, 6 lines) and length (30, 100 words)."""
    lines = F.regexp_count(text, F.lit("\n")) + 1
    words = tx.word_count(text)

    def bonus(condition: Column, points: int) -> Column:
        return F.when(condition, points).otherwise(0)

    return (
        F.regexp_count(text, F.lit(style.signatures)) * 3
        + F.regexp_count(text, F.lit(style.slang)) * F.lit(1.5)
        + F.regexp_count(text, F.lit(style.reasoning)) * 2
        + bonus(lines >= 3, 3)
        + bonus(lines >= 6, 4)
        + bonus(words > 30, 2)
        + bonus(words > 100, 3)
    )


def block_score(text: Column, style: Style) -> Column:
    return F.floor(style_points(text, style)).cast("int")


def history_points(text: Column, style: Style) -> Column:
    return F.regexp_count(text, F.lit(style.slang)) + F.regexp_count(text, F.lit(style.reasoning))


def turn_blocks(messages: DataFrame, conv: str, seq: str, sender: str, text: str) -> DataFrame:
    """Runs of consecutive messages by one sender: block number, sender, joined text, message count.

    (conv, seq) identifies a message and seq is the order, inside and between blocks. Runs are numbered without the
    texts; only the messages of one block, the value to be produced, meet in one place.
    """
    numbered = number_runs(messages.select(conv, seq, sender), [conv], [seq], sender, "block_no")
    placed = messages.select(conv, seq, text).join(numbered, [conv, seq])
    lines = F.transform(F.array_sort(F.collect_list(F.struct(seq, text))), lambda x: x[text])
    return placed.groupBy(conv, "block_no").agg(
        F.min(sender).alias("sender"), F.array_join(lines, "\n").alias("text"), F.count("*").alias("n_msgs")
    )


def context_windows(blocks: DataFrame, conv: str, owner: str, sizes: Sequence[int] = CONTEXT_SIZES) -> DataFrame:
    """One row per (owner's block, size) with at least ``size`` blocks before it, and these blocks as ``history``."""
    rows = OrderedRows(blocks, [conv], ["block_no"]).preceding(F.struct("sender", "text"), max(sizes), "history").result()
    targets = _sized(rows.filter(F.col("sender") == owner), "history", sizes)
    last = F.slice("history", -F.col("size"), F.col("size"))
    return targets.withColumn("history", last).select(conv, "block_no", "size", "history", "sender", "text")


def _sized(targets: DataFrame, before: str, sizes: Sequence[int]) -> DataFrame:
    """A row per size for which there is enough before the target."""
    listed = targets.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    return listed.filter(F.size(before) >= F.col("size"))


def window_scores(
    blocks: DataFrame, conv: str, owner: str, style: Style, sizes: Sequence[int] = CONTEXT_SIZES
) -> DataFrame:
    """(conv, block_no, size, score) of every context window: the style score of its target plus the history's slang
    and reasoning hits per block. Texts are rated first, so only numbers are put in order."""
    rated = blocks.select(
        conv, "block_no", "sender", history_points(F.col("text"), style).alias("points"),
        F.when(F.col("sender") == owner, block_score(F.col("text"), style)).alias("own"),
    )
    rows = OrderedRows(rated, [conv], ["block_no"]).preceding(F.col("points"), max(sizes), "before").result()
    targets = _sized(rows.filter(F.col("sender") == owner), "before", sizes)
    history = F.aggregate(F.slice("before", -F.col("size"), F.col("size")), F.lit(0), lambda total, x: total + x)
    return targets.select(conv, "block_no", "size", (F.col("own") + history / F.col("size")).alias("score"))


def best_per_person(scores: DataFrame, conv: str, minimum: float = MIN_SCORE, k: int = PER_PERSON) -> DataFrame:
    """Windows of at least ``minimum`` points, the best ``k`` of each conversation."""
    good = scores.filter(F.col("score") >= minimum)
    return top_per_group(good, [conv], [F.desc("score"), F.col("block_no"), F.col("size")], k).drop("rank")


def with_history(windows: DataFrame, blocks: DataFrame, conv: str) -> DataFrame:
    """Chosen windows with their texts. The blocks of a window, at most its size and one, are joined by number."""
    numbers = F.sequence(F.col("block_no") - F.col("size"), F.col("block_no"))
    members = windows.select("*", F.explode(numbers).alias("_member"))
    texts = blocks.select(conv, F.col("block_no").alias("_member"), "sender", "text")
    gathered = members.join(texts, [conv, "_member"]).groupBy(*windows.columns).agg(
        F.array_sort(F.collect_list(F.struct("_member", "sender", "text"))).alias("_blocks")
    )
    past = F.transform(F.slice("_blocks", 1, F.col("size")), lambda b: F.struct(b["sender"], b["text"]))
    last = F.element_at("_blocks", -1)
    return gathered.select(
        *windows.columns, past.alias("history"), last["sender"].alias("sender"), last["text"].alias("text")
    )


def messages_of(windows: DataFrame, owner: str) -> DataFrame:
    """Windows as training examples: ``messages`` is an array of (role, content), the owner being the assistant."""

    def role(sender: Column) -> Column:
        return F.when(sender == owner, "assistant").otherwise("user")

    past = F.transform("history", lambda b: F.struct(role(b["sender"]).alias("role"), b["text"].alias("content")))
    last = F.array(F.struct(role(F.col("sender")).alias("role"), F.col("text").alias("content")))
    return windows.withColumn("messages", F.concat(past, last)).drop("history", "sender", "text")


def example_score(messages: Column, style: Style) -> Column:
    """Style points of the assistant's turns, not truncated."""
    own = F.filter(messages, lambda m: m["role"] == "assistant")
    return F.aggregate(own, F.lit(0.0), lambda total, m: total + style_points(m["content"], style))


def corpus_text(messages: Column, index: Column, me: str, other: str) -> Column:
    """Header and one ``Speaker: line`` per non-blank line, followed by a blank line."""

    def spoken(message: Column) -> Column:
        speaker = F.when(message["role"] == "assistant", me).otherwise(other)
        lines = F.filter(F.transform(F.split(message["content"], "\n"), F.trim), lambda line: line != "")
        return F.transform(lines, lambda line: F.concat(speaker, F.lit(": "), line))

    header = F.array(F.concat(F.lit("--- Exemple "), index.cast("string"), F.lit(" ---")))
    return F.array_join(F.concat(header, F.flatten(F.transform(messages, spoken)), F.array(F.lit(""))), "\n")


def chat_json(messages: Column) -> Column:
    return F.to_json(F.struct(messages.alias("messages")))
