"""Chat formatting with DataFrame functions only.

A declarative template gives each role's opening and closing mark and whether its text carries loss; a finite-state
machine over roles tells whether the turns stand in an allowed order. A conversation becomes segments
(text, loss), whose concatenation is the formatted string.

Inside texts every control character (< [ ] and the backslash) is followed by a backslash, so no control string can
occur there; removing that backslash gives the text back.

Defined cases: null text is empty; a null role is the empty role, which like any unknown role has the general marks and
fails validation; turns are ordered by turn (null first), then role, then text; repeated rows are turns of their own; rows
with a null conv_id are one conversation; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read


@dataclass(frozen=True)
class Template:
    """role -> (opening mark, closing mark, loss on its text); moves: state -> roles that may follow ('' starts)."""

    roles: dict = field(default_factory=lambda: {"system": ("[SYS] ", "[/SYS]", False), "user": ("[INST] ", "[/INST]", False), "assistant": ("[OUT] ", "</s>", True)})
    other: tuple = ("[ROLE ", "[/ROLE]")
    moves: dict = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    last: tuple = ("assistant",)


TEMPLATE = Template()
_SPECIAL = r"([<\[\]\\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _SPECIAL, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _SPECIAL + r"\\", "$1")


def _by_role(role: Column, of: dict, otherwise: Column) -> Column:
    out = otherwise
    for name, value in of.items():
        out = F.when(role == name, F.lit(value)).otherwise(out)
    return out


def machine(roles: Column, t: Template) -> Column:
    """The index (from 0) of the first turn that may not stand there, the number of turns if the end is not allowed, or -1."""
    def step(state: Column, role: Column) -> Column:
        good = F.lit(False)
        for before, after in t.moves.items():
            good = good | ((state["role"] == before) & role.isin(*after))
        return F.struct(role.alias("role"), (state["at"] + 1).alias("at"), F.when((state["bad"] < 0) & ~good, state["at"]).otherwise(state["bad"]).alias("bad"))

    start = F.struct(F.lit("").alias("role"), F.lit(0).alias("at"), F.lit(-1).alias("bad"))
    return F.aggregate(roles, start, step, lambda s: F.when((s["bad"] < 0) & ~s["role"].isin(*t.last), s["at"]).otherwise(s["bad"]))


def format_chats(rows: DataFrame, t: Template = TEMPLATE) -> DataFrame:
    """conv_id, segments array<struct<text, loss>>, formatted, first_bad_turn, valid. The turns of one conversation become
    one row, as its output does; nothing else is gathered."""
    turn = F.struct(rows["turn"].alias("turn"), F.coalesce(rows["role"], F.lit("")).alias("role"), F.coalesce(rows["text"], F.lit("")).alias("text"))
    chats = rows.groupBy(rows["conv_id"].alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def segments(x: Column) -> Column:
        role = x["role"]
        opening = _by_role(role, {k: v[0] for k, v in t.roles.items()}, F.concat(F.lit(t.other[0]), escaped(role), F.lit("] ")))
        closing = _by_role(role, {k: v[1] for k, v in t.roles.items()}, F.lit(t.other[1]))
        loss = _by_role(role, {k: v[2] for k, v in t.roles.items()}, F.lit(False))
        return F.array(
            F.struct(opening.alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(x["text"]).alias("text"), loss.alias("loss")),
            F.struct(closing.alias("text"), F.lit(False).alias("loss")),
        )

    out = chats.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), machine(F.transform("turns", lambda x: x["role"]), t).alias("first_bad_turn"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")).withColumn("valid", F.col("first_bad_turn") < 0)


def read_back(formatted: Column, t: Template = TEMPLATE) -> Column:
    """The turns of a formatted string: array<struct<role, text>>. Closing marks can't occur inside texts, so the string is
    split after each of them."""
    ends = [v[1] for v in t.roles.values()] + [t.other[1]]
    quoted = "|".join("".join("\\" + c if c in r"[]/<>\.()*+?|{}^$" and c not in "/<>" else c for c in e) for e in ends)
    parts = F.filter(F.split(formatted, f"(?<={quoted})"), lambda p: p != "")

    def turn(p: Column) -> Column:
        head = F.regexp_extract(p, r"^\[(?:[^\[\]<]|[\[\]<]\\)*+\] ", 0)
        tail = F.regexp_extract(p, f"(?:{quoted})$", 0)
        role = unescaped(F.substring(head, len(t.other[0]) + 1, F.length(head) - len(t.other[0]) - 2))
        for name, (opening, _, _) in t.roles.items():
            role = F.when(head == opening, F.lit(name)).otherwise(role)
        body = F.substring(p, F.length(head) + 1, F.length(p) - F.length(head) - F.length(tail))
        return F.struct(role.alias("role"), unescaped(body).alias("text"))

    return F.transform(parts, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7, 0, 'user', '{said}'), (-7, 1, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    extra = extra.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema])
    out = format_chats(rows.unionByName(extra)).withColumn("turns", read_back(F.col("formatted"))).withColumn("under_loss", loss_text(F.col("segments")))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("under_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("under_loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


_ESC = r"regexp_replace({}, '([<\[\]\\])', '\1\\', 'g')"
SQL = {
    "op2_chat": f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT *, lag(role) OVER w AS before, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
m AS (SELECT *, (CASE coalesce(before, '') WHEN '' THEN i = 1 AND role IN ('system', 'user') WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE false END)
   AND (i < n OR role = 'assistant') AS good,
  CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 14 WHEN 'assistant' THEN 10 ELSE 15 + length({_ESC.format('role')}) END + length({_ESC.format('text')}) AS chars FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, bool_and(good) AS valid
FROM m GROUP BY conv_id""",
}
QUERIES = {"op2_chat": op2_chat}
