"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

Everything is built-in DataFrame functions; a conversation is gathered once,
by one shuffle on its key, because its formatted text is one value.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read


@dataclass(frozen=True)
class Template:
    """A turn becomes open + role + middle + text + close; control strings inside roles and texts are escaped.

    `moves` lists for each state the roles that may follow; a state is the last
    role, START before the first.  A conversation is complete if it ends in a
    state of `final`.
    """

    open: str = "<|turn|>"
    middle: str = "<|text|>"
    close: str = "<|end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"START": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        heads = {c[:2] for c in self.controls}
        if any(len(c) < 3 or c[0] in c[1:] or "\\" in c for c in self.controls) or len({h[0] for h in heads}) > 1 or len(set(self.controls)) < 3:
            raise ValueError("control strings need a common first character that occurs once in each, no backslash, and 3 characters")

    @property
    def controls(self) -> tuple[str, str, str]:
        return self.open, self.middle, self.close


def quoted(s: str) -> str:
    """s as a Java regex literal."""
    return "".join("\\" + c if not c.isalnum() else c for c in s)


def escape(text: Column, template: Template) -> Column:
    """Double backslashes, and put one after the first character of each control string's first two."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for head in sorted({c[:2] for c in template.controls}):
        out = F.replace(out, F.lit(head), F.lit(head[0] + "\\" + head[1]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chat(turns: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: conv, n_turns, valid, complete, bad_turn, segments (text, loss), formatted.

    Null roles and texts count as empty; an empty or unknown role makes the
    conversation invalid (`bad_turn` is the index of the first such turn), but
    it is formatted like any other.  Turns are ordered by (turn, role, text),
    null turns first, so ties and repeated rows have one order.  Rows with a
    null key form one conversation.  Extra columns are ignored; an empty table
    gives an empty result.
    """
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    gathered = turns.select(F.col(conv).alias("conv"), row.alias("row")).groupBy("conv").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    allowed = F.create_map(*[x for state, roles in template.moves.items() for x in (F.lit(state), F.array(*map(F.lit, roles)))])
    # The machine's state is the last role, so each turn's step reads the role before it.
    before = F.concat(F.array(F.lit("START")), F.transform("rows", lambda r: r["role"]))
    steps = F.zip_with(F.transform("rows", lambda r: r["role"]), F.slice(before, 1, F.size("rows")), lambda now, was: F.coalesce(F.array_contains(F.try_element_at(allowed, was), now), F.lit(False)))
    parts = F.transform(
        "rows",
        lambda r: F.array(
            F.struct(F.concat(F.lit(template.open), escape(r["role"], template), F.lit(template.middle)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(r["text"], template).alias("text"), r["role"].isin(*template.loss_roles).alias("loss")),
            F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss")),
        ),
    )
    return gathered.select(
        F.col("conv").alias(conv),
        F.size("rows").cast("long").alias("n_turns"),
        (F.array_position(steps, False) - 1).alias("first_bad"),
        F.element_at("rows", -1)["role"].isin(*template.final).alias("complete"),
        F.flatten(parts).alias("segments"),
    ).select(
        conv,
        "n_turns",
        (F.col("first_bad") < 0).alias("valid"),
        "complete",
        F.when(F.col("first_bad") >= 0, F.col("first_bad")).alias("bad_turn"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    pieces = F.split(formatted, quoted(template.close))
    turns = F.slice(pieces, 1, F.size(pieces) - 1)
    return F.transform(
        turns,
        lambda p: F.struct(
            unescape(F.substr(F.substring_index(p, template.middle, 1), F.lit(len(template.open) + 1))).alias("role"),
            unescape(F.substring_index(p, template.middle, -1)).alias("text"),
        ),
    )


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


#: The contract's own conversation: other templates' control strings inside both texts, which stand as they are.
PLANTED = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and conversation -1, and digests what is read back from the output."""
    given = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = given.unionByName(spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string"))
    out = format_chat(turns)
    back = out.withColumn("back", read_back(F.col("formatted"))).withColumn("under", loss_text(F.col("segments")))
    text = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "complete",
        "bad_turn",
    )


#: The same rows from the conversations themselves.
OP1_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS t, replace(replace(role, '\', '\\'), '<|', '<\|') AS r,
    lag(role, 1, 'START') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS was,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i
  FROM turns
), stepped AS (
  SELECT *, CASE was WHEN 'START' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user'
    WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE false END AS ok FROM escaped
), made AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS under,
    sum(length('<|turn|>') + length(r) + length('<|text|>') + length(t) + length('<|end|>')) AS formatted_chars,
    bool_and(ok) AS valid, arg_max(role, i) = 'assistant' AS complete, min(i) FILTER (NOT ok) AS bad_turn
  FROM stepped GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, CAST(length(under) AS BIGINT) AS loss_chars, sha256(under) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars, valid, complete, CAST(bad_turn AS BIGINT) AS bad_turn
FROM made
"""
