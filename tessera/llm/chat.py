"""Chat logs: cumulative snapshots collapse to the maximal conversations, which are rendered as text.

Each turn gets a digest of its role and text; rolling over a conversation's turns gives a digest of each prefix. A
conversation goes if its whole digest is a proper prefix digest of another one, and of equal conversations the one with the
smallest id stays. Only digests are gathered by conversation and compared; the turns of the maximal conversations alone are
then gathered with their texts and rendered.

Defined cases: turns stand by number (null first), then role, then text; repeated rows of a turn count once; null roles and
texts are empty; turns with a null conversation id form one conversation with a null id; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPLATE = "<|{role}|>\n{text}\n<|end|>\n"
BLOCK = 64  # turns whose digests are appended to one array; blocks are joined at the end, so that long conversations stay cheap


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without repeated rows."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).distinct()


def _turn_digest() -> Column:
    return F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.lit(":"), F.col("text")))


def prefix_digests(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and the digests of all prefixes, the last one being that of the whole."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("digest"))))
    roll = lambda acc, s: F.concat(acc, F.array(F.md5(F.concat(F.element_at(acc, -1), s["digest"]))))
    last = lambda blocks: F.element_at(F.element_at(blocks, -1), -1)
    block = lambda acc, at: F.concat(acc, F.array(F.slice(F.aggregate(F.slice("steps", at, BLOCK), F.array(last(acc)), roll), 2, BLOCK)))
    rolled = F.flatten(F.aggregate(F.sequence(F.lit(1), F.size("steps"), F.lit(BLOCK)), F.array(F.array(F.lit(""))), block))
    steps = turns.select("conv_id", "turn", "role", "text").withColumn("digest", _turn_digest()).groupBy("conv_id").agg(ordered.alias("steps"))
    return steps.select("conv_id", F.size("steps").alias("n_turns"), F.slice(rolled, 2, F.size("steps")).alias("prefixes"))


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies (equal conversations) of the conversations that no other one extends."""
    prefixes = prefix_digests(turns_of(conversations))
    whole = prefixes.select("conv_id", "n_turns", F.element_at("prefixes", -1).alias("digest"))
    kept = whole.groupBy("digest").agg(F.min(F.struct("conv_id", "n_turns")).alias("first"), F.count(F.lit(1)).alias("n_copies"))
    inner = prefixes.select(F.explode(F.slice("prefixes", 1, F.col("n_turns") - 1)).alias("digest")).distinct()
    return kept.join(inner, "digest", "left_anti").select("first.conv_id", "first.n_turns", "n_copies")


def render(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """The maximal conversations as text: conv_id, n_turns, n_copies, text."""
    head, _, rest = template.partition("{role}")
    middle, _, tail = rest.partition("{text}")
    turn = F.concat(F.lit(head), F.col("role"), F.lit(middle), F.col("text"), F.lit(tail))
    left = maximal(conversations)
    turns = turns_of(conversations).withColumnRenamed("conv_id", "id").join(left, F.col("id").eqNullSafe(F.col("conv_id")))
    lines = F.array_sort(F.collect_list(F.struct("turn", "role", "text", turn.alias("line"))))
    rendered = turns.groupBy("conv_id", "n_turns", "n_copies").agg(lines.alias("lines"))
    return rendered.select("conv_id", "n_turns", "n_copies", F.array_join(F.col("lines.line"), "").alias("text"))
