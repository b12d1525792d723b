"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the prompt,
and its reply alone is trainable. Only DataFrame functions are used.

A turn is written as ``<|turn|>role<|text|>text<|end|>``. Control strings inside roles
and texts get one backslash after their first character, which is taken away again when
the format is read; ``<\\|`` in a text becomes ``<\\\\|``, so no text is ambiguous.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# What follows the first character of a control string: ``<|``, ``<s>``, ``</s>``,
# ``<<SYS>>``, ``<</SYS>>`` and ``[INST]``, ``[/INST]``.
_REST = r"\||/?s>|</?SYS>>"
_REST_SQUARE = r"/?INST\]"
_CONTROL = rf"<(\\*)({_REST})|\[(\\*)({_REST_SQUARE})"
_ESCAPED = rf"<\\(\\*)({_REST})|\[\\(\\*)({_REST_SQUARE})"


def escape(text: Column) -> Column:
    """Text that holds no control string; ``unescape`` gives the text back."""
    angled = F.regexp_replace(text, rf"<(\\*)({_REST})", r"<\\$1$2")
    return F.regexp_replace(angled, rf"\[(\\*)({_REST_SQUARE})", r"[\\$1$2")


def unescape(text: Column) -> Column:
    angled = F.regexp_replace(text, rf"<\\(\\*)({_REST})", "<$1$2")
    return F.regexp_replace(angled, rf"\[\\(\\*)({_REST_SQUARE})", "[$1$2")


def prefix_targets(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target_role: str = "assistant") -> DataFrame:
    """One row per assistant turn: conv_id, target_turn, n_turns, prompt, reply, closing.

    ``prompt || reply || closing`` is the formatted example; the loss covers ``reply``.
    ``target_turn`` counts from 1 in the order of turn, role and text (nulls first), so
    repeated rows and ties have a fixed order. Turns after the last reply have no target:
    a conversation that has such turns gives one more row with null ``target_turn`` and
    ``reply``, so that nothing is lost. Null roles and texts are empty; rows with a null
    ``conv_id`` form one conversation. Other columns are dropped; no rows, no examples.

    A conversation is put together in one row, as an example has to be; no state is
    shared between conversations.
    """
    none = F.lit("")
    row = F.struct(
        F.col(turn).alias("t"),
        F.coalesce(F.col(role), none).alias("r"),
        F.coalesce(F.col(text), none).alias("x"),
    )
    told = turns.select(F.col(conv_id).alias("conv_id"), row.alias("_row")).groupBy("conv_id").agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    head = lambda r: F.concat(F.lit(TURN), escape(r), F.lit(TEXT))
    parts = told.select(
        "conv_id",
        F.size("_rows").alias("n_turns"),
        F.transform("_rows", lambda t: F.struct((t["r"] == target_role).alias("target"), head(t["r"]).alias("head"), escape(t["x"]).alias("body"))).alias("_turns"),
    )
    last = F.element_at("_turns", -1)["target"]
    numbers = F.sequence(F.lit(1), F.col("n_turns"))
    at = F.filter(numbers, lambda i: F.element_at("_turns", i)["target"])
    at = F.when(last, at).otherwise(F.concat(at, F.array(F.col("n_turns") + 1)))
    each = parts.withColumn("_at", F.explode(at))
    before = F.transform(F.slice("_turns", F.lit(1), F.col("_at") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(END)))
    target = F.get("_turns", F.col("_at") - 1)
    return each.select(
        "conv_id",
        F.when(target.isNotNull(), F.col("_at")).alias("target_turn"),
        "n_turns",
        F.concat(F.array_join(before, ""), F.coalesce(target["head"], none)).alias("prompt"),
        target["body"].alias("reply"),
        F.when(target.isNotNull(), F.lit(END)).otherwise(none).alias("closing"),
    )


def formatted(prompt: str = "prompt", reply: str = "reply", closing: str = "closing") -> Column:
    return F.concat(F.col(prompt), F.coalesce(F.col(reply), F.lit("")), F.col(closing))


def read_turns(text: Column) -> Column:
    """The turns of a formatted text as an array of (role, text)."""
    pieces = F.filter(F.split(text, r"<\|turn\|>", -1), lambda p: p.contains(TEXT))
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.split_part(p, F.lit(TEXT), F.lit(1))).alias("role"),
            unescape(F.split_part(F.split_part(p, F.lit(TEXT), F.lit(2)), F.lit(END), F.lit(1))).alias("text"),
        ),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from its examples alone: turns, loss text and sizes.

    The example that reaches furthest holds every turn. Replies are joined in order.
    """
    per = examples.select("conv_id", F.coalesce("target_turn", F.lit(2147483647)).alias("_at"), "reply", formatted().alias("_all"))
    told = per.groupBy("conv_id").agg(
        F.max_by("_all", "_at").alias("_all"),
        F.array_sort(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("_at", "reply")))).alias("_replies"),
        F.sum(F.length("_all").cast("long")).alias("formatted_chars"),
    )
    turns = told.select(
        "conv_id",
        read_turns(F.col("_all")).alias("_turns"),
        F.array_join(F.transform("_replies", lambda r: unescape(r["reply"])), "").alias("loss_text"),
        "formatted_chars",
    )
    return turns.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns_text"),
        "loss_text",
        "formatted_chars",
    )


def op4_prefix_targets(spark, sf_dir):
    """All conversations and one whose texts hold control strings, read back from the output."""
    from sourceloom.llm.common import table

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(tricky).alias("text"),
    )
    told = read_back(prefix_targets(turns.unionByName(extra)))
    return told.select(
        "conv_id",
        "n_turns",
        F.sha2("turns_text", 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth,
    count(*) OVER (PARTITION BY conv_id) AS n_turns, role = 'assistant' AS target,
    length(regexp_replace(regexp_replace(role, '<(\\*)(\||/?s>|</?SYS>>)', '<+\1\2', 'g'), '\[(\\*)(/?INST\])', '[+\1\2', 'g'))
    + length(regexp_replace(regexp_replace(text, '<(\\*)(\||/?s>|</?SYS>>)', '<+\1\2', 'g'), '\[(\\*)(/?INST\])', '[+\1\2', 'g'))
    + length('<|turn|><|text|><|end|>') AS chars
  FROM turns
), summed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY nth) AS through FROM sized
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE target), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (WHERE target), '')) AS loss_sha256,
  CAST(sum(CASE WHEN target OR nth = n_turns THEN through ELSE 0 END) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
"""
