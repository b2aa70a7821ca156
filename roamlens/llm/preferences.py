"""Preference formatting of chat conversations, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from roamlens.llm.common import staged
from roamlens.operators.ordered import blocked_row_number

# How a turn is written, and who speaks in completions that are trained on.
OPEN, CLOSE, TRAINED = "<|{role}|>\n", "<|end|>\n", "assistant"


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns: array of {role, text} in the order of ``turn``).

    Nulls in role and text count as empty, a null turn sorts first, ties by role
    and text; exact repetitions of a turn stay. Rows with a null conv_id belong to
    no conversation and are left out.
    """
    turns = turns.filter(F.col("conv_id").isNotNull())
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("all"))
    return whole.select(
        "conv_id", F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")
    )


def rendered(turns: Column) -> Column:
    """Segments {text, trained} of an array of turns: header, body and end mark."""
    head, tail = OPEN.split("{role}")
    return F.transform(
        turns,
        lambda t: F.struct(
            F.concat(F.lit(head), t["role"], F.lit(tail)).alias("head"),
            F.concat(t["text"], F.lit(CLOSE)).alias("body"),
            (t["role"] == TRAINED).alias("trained"),
        ),
    )


def _text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: F.concat(s["head"], s["body"])), "")


def _mask(segments: Column) -> Column:
    """Trained stretches {start, stop} in characters of the joined segments:
    bodies, with their end mark, of turns of the trained role."""
    start = F.lit(0).cast("long")
    walked = F.aggregate(
        segments,
        F.struct(start.alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans")),
        lambda acc, s: F.struct(
            (acc["at"] + F.char_length(s["head"]) + F.char_length(s["body"])).cast("long").alias("at"),
            F.when(
                s["trained"],
                F.concat(acc["spans"], F.array(F.struct(
                    (acc["at"] + F.char_length(s["head"])).cast("long").alias("start"),
                    (acc["at"] + F.char_length(s["head"]) + F.char_length(s["body"])).cast("long").alias("stop"),
                ))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return walked["spans"]


def shared_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))  # the longer one's rest meets nulls
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def format_preferences(pairs: DataFrame) -> DataFrame:
    """``pairs`` (pair_id, chosen, rejected: arrays of {role, text}) as training rows.

    Columns: pair_id, n_shared, prompt, chosen_text, rejected_text, chosen_mask,
    rejected_mask. The longest common prefix of whole turns is rendered once, as
    the prompt; the rest of either side is its completion, with the stretches to
    train on (turns of the assistant). If one side is a prefix of the other its
    completion is empty; null sides count as empty ones.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    blank = lambda t: F.struct(
        F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")
    )
    sides = pairs.select("pair_id", *[F.transform(F.coalesce(c, none), blank).alias(c) for c in ("chosen", "rejected")])
    cut = sides.withColumn("n_shared", shared_turns(F.col("chosen"), F.col("rejected")))
    rest = lambda c: F.slice(c, F.col("n_shared") + 1, F.size(c))
    parts = cut.select(
        "pair_id", "n_shared",
        rendered(F.slice("chosen", 1, F.col("n_shared"))).alias("shared"),
        rendered(rest("chosen")).alias("c"), rendered(rest("rejected")).alias("r"),
    )
    return parts.select(
        "pair_id", "n_shared", _text(F.col("shared")).alias("prompt"),
        _text(F.col("c")).alias("chosen_text"), _text(F.col("r")).alias("rejected_text"),
        _mask(F.col("c")).alias("chosen_mask"), _mask(F.col("r")).alias("rejected_mask"),
    )


BLOCK_DIGITS = 3  # hex digits of a digest that cut an order into blocks


def _ring(answers: DataFrame, group: str) -> DataFrame:
    """(answer_sha, group, other_sha): the next answer of the same group, in the order
    of ``place``, a keyed digest; the last is followed by the first. Null if a group has one.

    Answers are numbered in blocks of the whole order, so no group is one task's.
    """
    digits = F.conv(F.substring("place", 1, BLOCK_DIGITS), 16, 10).cast("int")
    block = F.concat_ws(":", F.col(group), F.lpad(digits.cast("string"), 5, "0"))
    numbered = staged(blocked_row_number(answers, [group], ["place", "answer_sha"], block, "rn"))
    sizes = numbered.groupBy(group).agg(F.count("*").alias("size"))
    ahead = numbered.join(sizes, group).select(
        group, "answer_sha", F.when(F.col("size") > 1, F.col("rn") % F.col("size") + 1).alias("rn")
    )
    return ahead.join(numbered.select(group, "rn", F.col("answer_sha").alias("other_sha")), [group, "rn"], "left").drop("rn")


def preference_pairs(turns: DataFrame, key: str = "preferences") -> DataFrame:
    """Pairs from plain conversations: (pair_id, chosen, rejected).

    ``chosen`` is a conversation up to its last assistant turn; ``rejected`` has the
    same turns before it, then the answer of another conversation: the next
    different answer, in the order of a digest keyed by ``key``, among those to the
    same opening turn, or else among those of the same length (log2 of characters),
    or else among all. Only if the whole table has one answer are both sides equal.
    A conversation without an assistant turn is both sides as it is, so nothing in
    it is trained on. Every conversation is in one pair. Rows without a conv_id are
    left out, repeated turns stay, texts may be of any length; other columns are
    ignored and an empty table has no pairs.

    Distinct answers are numbered, so copies of an answer, however many, cost one row.
    """
    whole = conversations_of(turns)
    last = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"] == TRAINED)), True) + 1
    # array_position is 0 without an assistant turn
    ended = whole.select("conv_id", "turns", F.when(last <= F.size("turns"), last).otherwise(0).cast("int").alias("last"))
    answer = F.get("turns", F.col("last") - 1)
    text = F.concat(F.lit(TRAINED), F.lit(":"), answer["text"])
    ready = staged(ended.select(
        "conv_id", F.when(F.col("last") > 0, F.slice("turns", 1, F.col("last"))).otherwise(F.col("turns")).alias("turns"), "last",
        F.when(F.col("last") > 0, F.sha2(text, 256)).alias("answer_sha"), F.md5(F.concat(text, F.lit(key))).alias("place"),
        F.concat(F.lit("o"), F.sha2(F.concat(F.get("turns", F.lit(0))["role"], F.lit(":"), F.get("turns", F.lit(0))["text"]), 256)).alias("opening"),
        F.concat(F.lit("l"), F.length(F.bin(F.char_length(answer["text"]))).cast("string")).alias("length"), F.lit("all").alias("any"),
    ))
    answered = ready.filter("last > 0")
    named = answered.select("conv_id", "answer_sha", "opening", "length", "any")
    for i, group in enumerate(("opening", "length", "any")):
        ring = _ring(answered.select(group, "answer_sha", "place").distinct(), group)
        named = named.join(ring.withColumnRenamed("other_sha", f"other{i}"), [group, "answer_sha"])
    chosen = named.select("conv_id", F.coalesce("other0", "other1", "other2", "answer_sha").alias("answer_sha"))
    texts = answered.groupBy("answer_sha").agg(F.min(F.element_at("turns", -1)).alias("other"))
    others = chosen.join(texts, "answer_sha").select("conv_id", "other")
    rejected = F.concat(F.slice("turns", 1, F.greatest(F.size("turns") - 1, F.lit(0))), F.array("other"))
    return ready.join(others, "conv_id", "left").select(
        F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"),
        F.when(F.col("other").isNull(), F.col("turns")).otherwise(rejected).alias("rejected"),
    )


def mask_text(mask: Column) -> Column:
    """Stretches as text: start-stop, comma-joined."""
    return F.array_join(F.transform(mask, lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["stop"].cast("string"))), ",")


PREFERENCES_SQL = """
WITH turned AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM {conversations} WHERE conv_id IS NOT NULL
), ends AS (
  SELECT conv_id, coalesce(max(pos) FILTER (role = 'assistant'), 0) AS last, max(pos) AS n FROM turned GROUP BY conv_id
), cut AS (
  SELECT t.*, last FROM turned t JOIN ends USING (conv_id) WHERE last = 0 OR pos <= last
), facts AS (
  SELECT a.conv_id, a.text AS answer, 'o' || sha256(f.role || ':' || f.text) AS opening, 'l' || length(bin(length(a.text))) AS len,
         md5('assistant:' || a.text || 'preferences') AS place
  FROM cut a JOIN cut f ON f.conv_id = a.conv_id AND f.pos = 1 WHERE a.pos = a.last
), rings AS (
  {rings}
), others AS (
  SELECT conv_id, f.answer, coalesce(o.other, l.other, a.other, f.answer) AS other
  FROM facts f LEFT JOIN rings o ON o.g = f.opening AND o.answer = f.answer
    LEFT JOIN rings l ON l.g = f.len AND l.answer = f.answer LEFT JOIN rings a ON a.g = 'all' AND a.answer = f.answer
), written AS (
  SELECT conv_id, count(*) AS n, any_value(last) AS last,
         coalesce(string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY pos) FILTER (last = 0 OR pos < last), '') AS prompt,
         coalesce(string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY pos), '') AS everything
  FROM cut GROUP BY conv_id
), sides AS (
  SELECT w.conv_id AS pair_id, last > 0 AND answer <> other AS differs, n, prompt, everything,
         '<|assistant|>' || chr(10) AS head, answer || '<|end|>' || chr(10) AS a, other || '<|end|>' || chr(10) AS b
  FROM written w LEFT JOIN others USING (conv_id)
)
SELECT pair_id, CAST(CASE WHEN differs THEN n - 1 ELSE n END AS INTEGER) AS n_shared, CASE WHEN differs THEN prompt ELSE everything END AS prompt,
       CASE WHEN differs THEN head || a ELSE '' END AS chosen_text, CASE WHEN differs THEN head || b ELSE '' END AS rejected_text,
       CASE WHEN differs THEN length(head) || '-' || (length(head) + length(a)) ELSE '' END AS chosen_mask,
       CASE WHEN differs THEN length(head) || '-' || (length(head) + length(b)) ELSE '' END AS rejected_mask
FROM sides
""".replace("{rings}", " UNION ALL ".join(
    f"""SELECT g, answer, CASE WHEN count(*) OVER (PARTITION BY g) > 1 THEN
         coalesce(lead(answer) OVER (PARTITION BY g ORDER BY place), first_value(answer) OVER (PARTITION BY g ORDER BY place)) END AS other
  FROM (SELECT DISTINCT {group} AS g, answer, place FROM facts)""" for group in ("opening", "len", "'all'")
))
