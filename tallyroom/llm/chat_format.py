"""Chat formatting: conversations as training texts with a loss mask, by DataFrame functions only.

Turns are collected as structs and sorted; neighbours of one role are merged into one block; blocks are joined to a text.  A block is
``open_role role close_role text (next_text text)* end_turn``.  These marks, and further ``reserved`` strings, are broken up
by an escape character where they occur in a role or text, so no text can pass for a mark, and reading the output back gives exactly
the turns that went in, those merged into one block apart again.

The loss mask is a list of runs (number of code points, whether they count) whose sum is the length of the text: each text
of a role in ``learned`` counts, marks and the other roles do not.

A conversation becomes one text, hence one row: that of a conversation must fit one (2 GB in Spark).  Its turns are gathered by a partial
aggregate a task, and all work on it is in proportion to its length: no list or text grows by a step at a time.

Defined results: a null text is an empty one, a null role the empty role, which is like any other; null ids of conversations are one
conversation; turns go by number, nulls first, equal numbers by role and then text, and repeated rows are turns of their own.  Texts may be empty and of any length.  An
empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """The marks of the format.  None may hold, after its first character, the first character of any, or the escape."""

    open_role: str = "[INST]"
    close_role: str = "[/INST]"
    next_text: str = "[NEXT]"
    end_turn: str = "</s>"
    reserved: tuple[str, ...] = ("<s>", "<pad>", "<unk>")
    escape: str = "\\"
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        marks = [self.open_role, self.close_role, self.next_text, self.end_turn]
        leads = {m[:1] for m in self.controls}
        if len(set(marks)) < 4 or len(self.escape) != 1 or any(len(m) < 2 or leads & set(m[1:]) or self.escape in m for m in self.controls):
            raise ValueError("marks must differ, have two characters, and hold no first character of a mark, nor the escape, further in")
        if any(a != b and b.startswith(a) for a in self.controls for b in self.controls):
            raise ValueError("no mark may begin with another")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open_role, self.close_role, self.next_text, self.end_turn, *self.reserved)

    def escaped(self, text: Column) -> Column:
        """The escape is doubled, then put behind the first character of each mark."""
        doubled = F.replace(text, F.lit(self.escape), F.lit(2 * self.escape))
        return reduce(lambda t, m: F.replace(t, F.lit(m), F.lit(m[0] + self.escape + m[1:])), self.controls, doubled)

    def plain(self, text: Column) -> Column:
        """Undoes ``escaped``: an escape goes and what follows it stays."""
        return F.regexp_replace(text, f"(?s){re.escape(self.escape)}(.)", "$1")


def _runs(turns: Column) -> Column:
    """Sorted turns as blocks of neighbours of one role: structs of role and the list of texts."""
    n = F.size(turns)
    begins = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(turns, i - 1)["role"] != F.get(turns, i - 2)["role"]))
    ends = F.concat(F.slice(begins, F.lit(2), F.size(begins)), F.array(n + 1))
    return F.zip_with(begins, ends, lambda a, b: F.struct(F.get(turns, a - 1)["role"].alias("role"), F.transform(F.slice(turns, a, b - a), lambda t: t["text"]).alias("texts")))


def formatted(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, formatted (the text), loss_mask (array of chars, loss): a row for each conversation."""
    empty = F.lit("")
    turn = F.struct("turn", template.escaped(F.coalesce("role", empty)).alias("role"), template.escaped(F.coalesce("text", empty)).alias("text"))
    # ties are told by the texts as they are, not as they are escaped
    turn = F.struct(turn["turn"].alias("turn"), F.coalesce("role", empty).alias("by_role"), F.coalesce("text", empty).alias("by_text"), turn["role"].alias("role"), turn["text"].alias("text"))
    sorted_turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    blocks = sorted_turns.select("conv_id", _runs(F.col("turns")).alias("blocks"))
    opening = lambda b: F.concat(F.lit(template.open_role), b["role"], F.lit(template.close_role))
    text = F.array_join(F.transform("blocks", lambda b: F.concat(opening(b), F.array_join(b["texts"], template.next_text), F.lit(template.end_turn))), "")
    run = lambda chars, loss: F.struct(chars.cast("int").alias("chars"), loss.alias("loss"))

    def masked(b: Column) -> Column:
        """The runs of a block: each mark, and each text, by itself."""
        learned, last = b["role"].isin([*template.learned]), F.size(b["texts"]) - 1
        between = lambda i: F.when(i < last, len(template.next_text)).otherwise(len(template.end_turn))
        texts = F.flatten(F.transform(b["texts"], lambda t, i: F.array(run(F.length(t), learned), run(between(i), F.lit(False)))))
        return F.concat(F.array(run(F.length(opening(b)), F.lit(False))), texts)

    mask = F.filter(F.flatten(F.transform("blocks", masked)), lambda r: r["chars"] > 0)
    return blocks.select("conv_id", text.alias("formatted"), mask.alias("loss_mask"))


def turns(template: Template = Template()) -> Column:
    """The turns of a formatted text, an array of role and text, read back from it."""
    blocks = F.filter(F.split("formatted", re.escape(template.end_turn)), lambda b: b != "")

    def opened(b: Column) -> Column:
        halves = F.split(b, re.escape(template.close_role), 2)
        role = template.plain(F.substr(F.get(halves, F.lit(0)), F.lit(len(template.open_role) + 1)))
        return F.transform(F.split(F.get(halves, F.lit(1)), re.escape(template.next_text)), lambda t: F.struct(role.alias("role"), template.plain(t).alias("text")))

    return F.flatten(F.transform(blocks, opened))


def learned_text(template: Template = Template()) -> Column:
    """The text under the loss mask.  The text is cut before and behind each mark, which gives the runs of the mask one by one; where
    lengths differ, mask and text do not belong together, and that is an error."""
    openings, closings = (re.escape(m) for m in (template.open_role, template.end_turn))
    inner = re.escape(template.next_text)
    cut = f"(?<={re.escape(template.close_role)}|{inner}|{closings})|(?={inner}|{closings}|{openings})"
    pieces = F.filter(F.split("formatted", cut), lambda p: p != "")
    both = F.zip_with(pieces, "loss_mask", lambda p, r: F.struct(p.alias("piece"), r["loss"].alias("loss"), (F.length(p) == r["chars"]).alias("fits")))
    said = F.array_join(F.transform(F.filter(both, lambda x: x["loss"]), lambda x: template.plain(x["piece"])), "")
    return F.when(F.forall(both, lambda x: F.coalesce(x["fits"], F.lit(False))), said).otherwise(F.raise_error(F.lit("a loss mask does not fit its text")))


def digests(texts: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of formatted conversations, read back from them."""
    said = texts.select("conv_id", turns(template).alias("turns"), learned_text(template).alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return said.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars",
    )


#: formatted_chars follows from the rows: marks by role, and escapes by the marks and escapes inside.
ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM rows
), near AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY k) IS DISTINCT FROM role OR k = 1 AS opens FROM placed
), sized AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\]', '', 'g')) + len(regexp_extract_all(text, '\[INST\]|\[/INST\]|\[NEXT\]|</s>|<s>|<pad>|<unk>')) AS chars,
    length(role) + length(regexp_replace(role, '[^\\]', '', 'g')) + len(regexp_extract_all(role, '\[INST\]|\[/INST\]|\[NEXT\]|</s>|<s>|<pad>|<unk>')) AS role_chars
  FROM near
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + CASE WHEN opens THEN role_chars + 13 + 4 ELSE 6 END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
