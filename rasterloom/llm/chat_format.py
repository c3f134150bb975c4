"""Operator 3, chat formatting, in DataFrame functions only.

Method: a declarative template names the marks around a turn, how they are escaped, which roles may follow
which, and for which roles the text counts in the loss. A finite-state machine over the roles of a
conversation, folded over its turns in order, tells whether the order is valid and where it first breaks. A
conversation becomes segments of text, each with a loss flag; the formatted string is their concatenation.

Escaping is reversible: the escape character is doubled, and inside every control string of a text one escape
character is put after the first character, so that no control string is left. unescape() removes an escape
character, and keeps the one that follows it. read_back() parses the formatted string alone.

Turns are ordered by (turn, role, text). Defined results: a null text is empty; a null role is the empty role,
which no state accepts; a null turn comes first; a null conv_id is a conversation of its own; repeated rows
are turns of their own; an invalid order is formatted like any other and flagged in `valid` and `breaks_at`;
an empty table gives no rows (in the query, the probe's alone); further columns are ignored, whatever their names. A conversation is one row: its size is bounded by
its own turns, which are ordered inside that row without a window over others.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import table

#: Fixed values of the template.
TEMPLATE = {
    "open": "<|turn|>",
    "middle": "<|says|>",
    "close": "<|done|>",
    "escape": "\\",
    "control": ["<|turn|>", "<|says|>", "<|done|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]"],
    "loss": ["assistant"],
    "start": "start",
    "next": {
        "start": {"system": "told", "user": "asked"},
        "told": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    },
    "accept": ["answered"],
}


def escape(text: Column, template: dict = TEMPLATE) -> Column:
    esc = template["escape"]
    first = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in template["control"])
    return F.regexp_replace(F.replace(text, F.lit(esc), F.lit(esc * 2)), first, esc.replace("\\", "\\\\"))


def unescape(text: Column, template: dict = TEMPLATE) -> Column:
    e = re.escape(template["escape"])
    return F.regexp_replace(text, f"{e}({e}?)", "$1")


def _state(states: dict, accept: str, state: Column, role: Column) -> Column:
    out = F.lit(accept)
    for s, follow in states.items():
        for r, to in follow.items():
            out = F.when((state == s) & (role == r), F.lit(to)).otherwise(out)
    return out


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id and its turns, an array of (turn, role, text) in order."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def formatted(rows: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """conv_id, valid, breaks_at (index of the first turn out of order, else null), segments (text, loss) and
    formatted."""
    t = template
    convs = conversations(rows)
    walk = F.aggregate(
        "turns",
        F.struct(F.lit(t["start"]).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad")),
        lambda acc, x: F.struct(
            _state(t["next"], "broken", acc["state"], x["role"]).alias("state"),
            (acc["at"] + 1).alias("at"),
            F.coalesce(acc["bad"], F.when(_state(t["next"], "broken", acc["state"], x["role"]) == "broken", acc["at"])).alias("bad"),
        ),
    )
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                piece(F.concat(F.lit(t["open"]), escape(x["role"], t), F.lit(t["middle"])), F.lit(False)),
                piece(escape(x["text"], t), x["role"].isin(t["loss"])),
                piece(F.lit(t["close"]), F.lit(False)),
            ),
        )
    )
    return convs.select("conv_id", walk.alias("walk"), segments.alias("segments")).select(
        "conv_id",
        (F.col("walk.bad").isNull() & F.col("walk.state").isin(t["accept"])).alias("valid"),
        F.col("walk.bad").alias("breaks_at"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_back(text: Column, template: dict = TEMPLATE) -> Column:
    """The turns, an array of (role, text), that a formatted string holds."""
    t = template
    bodies = F.filter(F.split(text, re.escape(t["open"])), lambda x: x != "")
    parts = lambda x: F.split(x, f"{re.escape(t['middle'])}|{re.escape(t['close'])}")
    return F.transform(
        bodies,
        lambda x: F.struct(unescape(parts(x)[0], t).alias("role"), unescape(parts(x)[1], t).alias("text")),
    )


def digests(out: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """What the output says, read back from it: turns from the formatted string, loss from the segments."""
    turns = read_back(F.col("formatted"), template)
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
    spelled = lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))
    read = out.select("conv_id", "valid", "breaks_at", F.length("formatted").cast("long").alias("formatted_chars"), turns.alias("turns"), loss.alias("loss"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", spelled), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
        "valid", F.col("breaks_at").cast("long").alias("breaks_at"),
    )


#: A conversation whose texts are control strings.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return digests(formatted(rows.unionByName(probe)))


_ESC = r"""replace(replace(replace(replace(replace(replace(replace(replace(replace({}, '\', '\\'),
  '<|turn|>', '<\|turn|>'), '<|says|>', '<\|says|>'), '<|done|>', '<\|done|>'), '<|endoftext|>', '<\|endoftext|>'),
  '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')"""
ORACLE_SQL = f"""
WITH RECURSIVE r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS k FROM r),
s AS (
  SELECT *, lag(role) OVER w AS before, lag(role, 2) OVER w AS earlier, count(*) OVER (PARTITION BY conv_id) AS n
  FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
v AS (
  SELECT *, CASE WHEN k = 0 THEN role IN ('system', 'user')
                 WHEN role = 'user' THEN before = 'assistant' OR (before = 'system' AND k = 1)
                 WHEN role = 'assistant' THEN before = 'user' ELSE false END AS fits FROM s)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(24 + length({_ESC.format('role')}) + length({_ESC.format('text')}))::BIGINT AS formatted_chars,
       bool_and(fits) AND max_by(role, k) = 'assistant' AS valid,
       min(k) FILTER (NOT fits)::BIGINT AS breaks_at
FROM v GROUP BY conv_id
"""
