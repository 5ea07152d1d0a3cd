"""Preference formatting: a prompt that both conversations share, rendered once, and two masked completions.

The prompt is the longest common prefix of turns (equal role and text) of the chosen and the rejected conversation;
what follows in each is its completion. Turns are rendered as <|im_start|>role, newline, text, <|im_end|>, newline.
The mask of a completion is its spans of code points (start, end exclusive) that are trained on: the text and end
mark of assistant turns. DataFrame operations only; a conversation is one row, as a document is.

Defined cases: a null role is user, a null text is empty; turns of one number are ordered by role and text; equal
conversations give empty completions and identical = true; where one conversation is a prefix of the other its
completion is empty; a key without a partner gives no row; a key given twice on both sides gives each combination; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# The marks of the rendered form.
START, END = "<|im_start|>", "<|im_end|>"


def threads(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, turns: the conversation's (role, text) in order."""
    row = F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.array_sort(F.collect_list(row))
    return turns.groupBy(key).agg(F.transform(ordered, lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"))


def rendered(turns: Column) -> Column:
    one = lambda t: F.concat(F.lit(START), t.role, F.lit("\n"), t.text, F.lit(END + "\n"))
    return F.array_join(F.transform(turns, one), "")


def mask(turns: Column) -> Column:
    """Spans of the rendered turns that are trained on."""
    empty = F.array().cast("array<struct<start:int,end:int>>")
    head = lambda t: F.length(t.role) + F.lit(len(START) + 1)

    def step(state, t):
        start = state["at"] + head(t)
        end = start + F.length(t.text) + F.lit(len(END))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = F.when(t.role == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda s: s["spans"])


def format_pairs(chosen: DataFrame, rejected: DataFrame, key: str = "conv_id") -> DataFrame:
    """chosen, rejected: key and turns. Returns key, prompt_turns, prompt, both completions with masks, identical."""
    both = chosen.select(F.col(key).alias("key"), F.col("turns").alias("a")).join(rejected.select(F.col(key).alias("key"), F.col("turns").alias("b")), "key")
    shorter = F.least(F.size("a"), F.size("b"))
    differs = F.filter(F.sequence(F.lit(0), shorter), lambda i: (i == shorter) | (F.get("a", i) != F.get("b", i)))
    both = both.withColumn("n", F.array_min(differs))
    after = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    both = both.select("key", "n", F.slice("a", F.lit(1), F.col("n")).alias("prompt"), after("a").alias("a"), after("b").alias("b"))
    return both.select(
        F.col("key").alias(key), F.col("n").cast("long").alias("prompt_turns"), rendered(F.col("prompt")).alias("prompt"),
        rendered(F.col("a")).alias("chosen"), mask(F.col("a")).alias("chosen_mask"),
        rendered(F.col("b")).alias("rejected"), mask(F.col("b")).alias("rejected_mask"),
        ((F.size("a") == 0) & (F.size("b") == 0)).alias("identical"),
    )


def against_next(conversations: DataFrame) -> DataFrame:
    """Formats every conversation, up to its last assistant turn, against itself with that of the next id in its place.

    A conversation without an assistant turn, or whose next id (conv_id + 1) has none, has no pair.
    """
    held = threads(conversations).withColumn("last", F.array_max(F.transform("turns", lambda t, i: F.when(t.role == "assistant", i))))
    held = common.stored(held.where("last is not null").select("conv_id", F.slice("turns", F.lit(1), F.col("last") + 1).alias("turns")), "threads")
    answer = held.select((F.col("conv_id") - 1).alias("conv_id"), F.element_at("turns", -1).alias("other"))
    swapped = held.join(answer, "conv_id").select("conv_id", F.concat(F.slice("turns", F.lit(1), F.size("turns") - 1), F.array("other")).alias("turns"))
    return format_pairs(held, swapped)


def digests(pairs: DataFrame) -> DataFrame:
    """The formatted pairs with texts as lower-case SHA-256 and masks as the number of code points trained on."""
    sizes = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x["end"] - x["start"]).cast("long")
    return pairs.select(
        "conv_id", "prompt_turns", F.length("prompt").cast("long").alias("prompt_chars"), *(F.sha2(c, 256).alias(f"{c}_sha256") for c in ("prompt", "chosen", "rejected")),
        sizes("chosen_mask").alias("chosen_trained"), sizes("rejected_mask").alias("rejected_trained"), "identical",
    )


SQL = """
with t as (
  select conv_id, coalesce(role, 'user') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn, coalesce(role, 'user'), coalesce(text, '')) as i
  from conversations
), r as (
  select *, max(case when role = 'assistant' then i end) over (partition by conv_id) as last_i,
         '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as line
  from t
), c as (
  select conv_id, any_value(last_i) as n, coalesce(string_agg(line, '' order by i) filter (i < last_i), '') as head,
         any_value(line) filter (i = last_i) as answer, any_value(length(text)) filter (i = last_i) as size
  from r where last_i is not null group by conv_id
), p as (
  select a.conv_id, a.n, a.head, a.answer, a.size, b.answer as other, b.size as other_size, a.answer = b.answer as same
  from c a join c b on b.conv_id = a.conv_id + 1
)
select conv_id, cast(case when same then n else n - 1 end as bigint) as prompt_turns,
       cast(length(case when same then head || answer else head end) as bigint) as prompt_chars,
       sha256(case when same then head || answer else head end) as prompt_sha256,
       sha256(case when same then '' else answer end) as chosen_sha256,
       sha256(case when same then '' else other end) as rejected_sha256,
       cast(case when same then 0 else size + 10 end as bigint) as chosen_trained,
       cast(case when same then 0 else other_size + 10 end as bigint) as rejected_trained,
       same as identical
from p
"""
