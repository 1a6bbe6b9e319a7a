"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is rendered as one text, one block per turn::

    <|turn|>role<newline>text<|end|><newline>

A deterministic parser (split at the end mark, then at the first newline) reads the text back. A
turn that holds one of the marks, or does not come back as it was, is rendered again with its control
strings escaped, and its mark says so (``<|turn:e|>``); this repeats, with every turn escaped, until the
whole conversation reads back identical. No mark in the output stems from a role or a text. Escaping puts one more backslash between ``<`` and ``|``, so it can be undone
exactly whatever the text holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import or_empty

TURN, TURN_ESCAPED, END = "<|turn|>", "<|turn:e|>", "<|end|>\n"
MARKS = (TURN, TURN_ESCAPED, END.strip())
SPLIT = r"\Q" + END + r"\E"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def render_turn(role: Column, text: Column, escaped: Column) -> Column:
    """One block. A role's newlines would end its line, so an escaped role writes them as ``<|n``."""
    safe_role = F.replace(escape(role), F.lit("\n"), F.lit("<|n"))
    return F.when(escaped, F.concat(F.lit(TURN_ESCAPED), safe_role, F.lit("\n"), escape(text), F.lit(END))).otherwise(
        F.concat(F.lit(TURN), role, F.lit("\n"), text, F.lit(END)))


def holds_mark(text: Column) -> Column:
    found = F.lit(False)
    for mark in MARKS:
        found = found | F.contains(text, F.lit(mark))
    return found


def parse(formatted: Column) -> Column:
    """Array of ``(role, text)`` in the order of the turns; a block without a known mark is null."""
    def block(b: Column) -> Column:
        escaped = F.startswith(b, F.lit(TURN_ESCAPED))
        body = F.when(escaped, F.substring(b, len(TURN_ESCAPED) + 1, 2**30)).when(
            F.startswith(b, F.lit(TURN)), F.substring(b, len(TURN) + 1, 2**30))
        at = F.locate("\n", body)
        role, text = F.substr(body, F.lit(1), at - 1), F.substr(body, at + 1)
        plain_role = unescape(F.replace(role, F.lit("<|n"), F.lit("\n")))
        return F.when(at > 0, F.struct(F.when(escaped, plain_role).otherwise(role).alias("role"),
                                       F.when(escaped, unescape(text)).otherwise(text).alias("text")))
    blocks = F.split(formatted, SPLIT, -1)
    # what follows the last end mark is empty in every rendered conversation
    return F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), block)


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """``conv_id, n_turns, formatted, parsed, read_back`` with one row per conversation.

    ``parsed`` is what the parser reads from ``formatted``: ``role, text`` and whether the text is
    under the loss mask. ``read_back`` tells that it equals the source; it is true for every input,
    and the work fails otherwise. Null role or text: empty. Rows are ordered by turn (null first),
    then role and text; repeated rows are repeated turns. Null ids form one conversation. An empty
    table gives no rows. A conversation is one text, so its turns meet in one row.
    """
    role, text = or_empty(role_col), or_empty(text_col)
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), text.alias("text"))
    # first attempt: a turn that holds a mark or does not read back alone is escaped
    plain = render_turn(F.col("role"), F.col("text"), F.lit(False))
    want = F.array(F.struct("role", "text"))
    rows = rows.withColumn("conflict", holds_mark(F.col("role")) | holds_mark(F.col("text")) | ~(parse(plain).eqNullSafe(want)))
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "conflict"))).alias("turns"))

    def rendered(everything: bool) -> Column:
        return F.array_join(F.transform("turns", lambda t: render_turn(
            t["role"], t["text"], F.lit(True) if everything else t["conflict"])), "")
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    first = talks.withColumn("source", source).withColumn("formatted", rendered(False)).withColumn("parsed", parse(F.col("formatted")))
    second = first.withColumn("formatted", F.when(F.col("parsed").eqNullSafe(F.col("source")), F.col("formatted"))
                              .otherwise(rendered(True))).withColumn("parsed", parse(F.col("formatted")))
    same = F.when(F.col("parsed").eqNullSafe(F.col("source")), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("conversation does not read back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    return second.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), "formatted",
        F.transform("parsed", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"),
                                                 (t["role"] == trained).alias("loss"))).alias("parsed"),
        same.alias("read_back"))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, read from the parsed output."""
    loss = F.array_join(F.transform(F.filter("parsed", lambda t: t["loss"]), lambda t: t["text"]), "")
    whole = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.filter("read_back").select(
        "conv_id", F.size("parsed").cast("bigint").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"))


PROBE = "</s>[INST] ok [/INST]"

ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
parts AS (
  SELECT *, contains(role, chr(10)) OR regexp_matches(role, '<\|(turn|turn:e|end)\|>') OR regexp_matches(text, '<\|(turn|turn:e|end)\|>') AS conflict FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(CASE WHEN conflict THEN 19 + length(regexp_replace(replace(role, chr(10), '   '), '<(\\*)\|', '<\\\1|', 'g'))
                          + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))
                     ELSE 17 + length(role) + length(text) END) AS BIGINT) AS formatted_chars
FROM parts GROUP BY conv_id"""
