"""Chat formatting by event-sourced reconstruction, with DataFrame operations only.

A log holds events of messages: ``delta`` adds text, ``edit`` puts the text in
place of what the message held, ``regenerate`` voids the message and all later
ones as logged so far. Events are folded by conversation in order of ``seq``;
the final messages are rendered with a template whose control strings are
escaped inside roles and texts, so that the turns can be read back exactly.

Cases: a null text adds nothing, a null role reads back as empty, other kinds
(null too) count as ``delta``; a null conversation id is a conversation of its
own; events of equal seq are ordered by role and text; repeated table rows are
messages of their own; an empty log gives no conversations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Template:
    """A turn reads: begin, role, head, text, end. ``rest`` matches what follows the ``<`` or ``[`` of a control string."""

    begin: str = "<s>[INST]"
    head: str = "[/INST]"
    end: str = "</s>"
    rest: str = r"/?s>|/?INST\]"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"([<\[])(\\*)({self.rest})", r"$1$2\\$3")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"([<\[])\\(\\*)({self.rest})", r"$1$2$3")


def events(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A table of finished turns as a log: each row a message of one delta, in order of turn."""
    picked = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    return picked.withColumn("seq", F.row_number().over(order).cast("long")).select("conv_id", "seq", F.col("seq").alias("message"), F.lit("delta").alias("kind"), "role", "text")


def reconstruct(log: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the final messages of a log of (conv_id, seq, message, kind, role, text)."""
    later = Window.partitionBy("conv_id").orderBy(F.col("seq").desc(), F.col("role").desc(), F.col("text").desc()).rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("conv_id", "message").orderBy(F.col("seq").desc(), F.col("role").desc(), F.col("text").desc()).rowsBetween(Window.unboundedPreceding, -1)
    voided = F.min(F.when(F.col("kind") == "regenerate", F.col("message"))).over(later) <= F.col("message")
    replaced = F.max(F.when(F.col("kind") == "edit", F.lit(1))).over(same).isNotNull()
    live = log.withColumn("gone", F.coalesce(voided, F.lit(False)) | replaced).filter("NOT gone")
    part = F.struct("seq", "role", F.when(F.coalesce(F.col("kind"), F.lit("delta")) != "regenerate", F.col("text")).alias("text"))
    folded = live.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit(""))), "")
    roles = F.filter(F.transform("parts", lambda p: p["role"]), lambda r: r.isNotNull())
    return folded.select("conv_id", "message", F.when(F.size(roles) > 0, F.element_at(roles, -1)).alias("role"), text.alias("text"))


def render(messages: DataFrame, template: Template = Template(), *, learned: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): one row a conversation; spans are [start, end) in code points around the texts that are learned."""
    t = template
    parts = messages.withColumn("role_", t.escape(F.coalesce("role", F.lit("")))).withColumn("text_", t.escape(F.coalesce("text", F.lit(""))))
    parts = parts.withColumn("part", F.concat(F.lit(t.begin), "role_", F.lit(t.head), "text_", F.lit(t.end)))
    upto = F.sum(F.length("part")).over(Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("stop", upto - len(t.end)).withColumn("start", F.col("stop") - F.length("text_"))
    row = F.struct("message", "part", "start", "stop", (F.coalesce(F.col("role"), F.lit("")) == learned).alias("learned"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    spans = F.transform(F.filter("rows", lambda r: r["learned"]), lambda r: F.struct(r["start"].alias("start"), r["stop"].alias("stop")))
    return whole.select("conv_id", F.array_join(F.transform("rows", lambda r: r["part"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column, template: Template = Template()) -> Column:
    """The turns, as an array of (role, text), read back from a rendered conversation."""
    t = template
    parts = F.split(formatted, t.end.replace("[", r"\["), -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(p: Column) -> Column:
        at = F.instr(p, F.lit(t.head))
        return F.struct(
            t.unescape(p.substr(F.lit(len(t.begin) + 1), at - (len(t.begin) + 1))).alias("role"),
            t.unescape(p.substr(at + len(t.head), F.length(p))).alias("text"),
        )

    return F.transform(parts, turn)


def learned_text(formatted: Column, spans: Column, template: Template = Template()) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: template.unescape(formatted.substr((s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")


def digest(rendered: DataFrame) -> DataFrame:
    """The columns that op10 returns, read back from the rendered text."""
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = rendered.withColumn("turns", parse(F.col("formatted"))).withColumn("learned", learned_text(F.col("formatted"), F.col("loss_spans")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The result as DuckDB states it.
SQL = r"""
WITH all_rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), filled AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM all_rows
), counted AS (
  SELECT *, length(role) + len(regexp_extract_all(role, '[<\[]\\*(/?s>|/?INST\])'))
          + length(text) + len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?INST\])')) + 20 AS chars
  FROM filled
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM counted GROUP BY conv_id
"""
