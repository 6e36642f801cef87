"""Operator 8: chat formatting by a finite-state machine over roles. DataFrame functions only.

A declarative template marks each turn, says which roles bear loss, and holds the transition table of the machine: its
state is `start`, then the role of the last turn. Each turn is a step of the machine, which emits the turn's segments with their
loss flags and whether the table has the step; a conversation is valid when it has all of them and ends in a final state.
A turn out of order is emitted all the same, with the flag of its role: nothing is dropped, and whoever trains on valid orders only
filters by `valid` or by a segment's `fits`. Control strings inside roles and texts cannot be taken for the template's: the
characters that open them are written as entities, `&` first, which is undone exactly on reading back.

Turns are ordered by turn number, then role, then text, so ties and repeated rows have one order; nulls
come first. Null roles and texts count as empty. A row without a conversation id is a conversation of its own, however many there are.
An empty table gives an empty one. Other columns play no part. One conversation is one row of output.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.llm.common import table


@dataclass(frozen=True)
class Template:
    open: str = "<|turn|>"  # before the role
    after_role: str = "\n"
    close: str = "<|end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: (written, for), applied in this order and undone in reverse; the strings above start with a character that is never left in a text.
    entities: tuple[tuple[str, str], ...] = (("&amp;", "&"), ("&lt;", "<"), ("&lb;", "["), ("&nl;", "\n"))
    #: Of the entities, those that texts do not need because only roles end at them.
    role_only: tuple[str, ...] = ("\n",)
    #: state -> role -> state; "start" is the first, others named by the last role.
    turns: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    ends: tuple[str, ...] = ("assistant", "user")

    def escaped(self, text: Column, role: bool = False) -> Column:
        for written, plain in self.entities:
            if role or plain not in self.role_only:
                text = F.replace(text, F.lit(plain), F.lit(written))
        return text

    def unescaped(self, text: Column, role: bool = False) -> Column:
        for written, plain in reversed(self.entities):
            if role or plain not in self.role_only:
                text = F.replace(text, F.lit(written), F.lit(plain))
        return text


def steps(turns: Column, t: Template) -> Column:
    """array<struct<role, text, fits>>: the machine over the turns; fits where the table has the step from the state before."""
    before = F.concat(F.array(F.lit("start")), F.slice(turns["role"], 1, F.size(turns) - 1))
    table = F.create_map(*[x for state, roles in t.turns.items() for x in (F.lit(state), F.array(*map(F.lit, roles)))])
    fits = lambda state, x: F.coalesce(F.array_contains(F.try_element_at(table, state), x["role"]), F.lit(False))
    return F.zip_with(before, turns, lambda state, x: F.struct(x["role"].alias("role"), x["text"].alias("text"), fits(state, x).alias("fits")))


def emitted(x: Column, t: Template) -> Column:
    """The segments of a step."""
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"), x["fits"].alias("fits"))
    head = F.concat(F.lit(t.open), t.escaped(x["role"], role=True), F.lit(t.after_role))
    return F.array(part(head, F.lit(False)), part(t.escaped(x["text"]), x["role"].isin(*t.loss_roles)), part(F.lit(t.close), F.lit(False)))


def formatted(rows: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, segments array<struct<text, loss, fits>>, formatted string, n_misplaced (turns whose step the table lacks), valid boolean."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named = rows.filter(F.col(conv).isNotNull()).groupBy(conv).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    turns = named.unionByName(rows.filter(F.col(conv).isNull()).select(conv, F.array(one).alias("turns")))
    run = turns.select(conv, steps(F.col("turns"), template).alias("steps"))
    out = run.select(
        conv,
        F.flatten(F.transform("steps", lambda x: emitted(x, template))).alias("segments"),
        F.size(F.filter("steps", lambda x: ~x["fits"])).cast("long").alias("n_misplaced"),
        F.element_at("steps", -1)["role"].isin(*template.ends).alias("ended"),
    )
    return out.select(conv, "segments", F.array_join("segments.text", "").alias("formatted"), "n_misplaced", ((F.col("n_misplaced") == 0) & F.col("ended")).alias("valid"))


def read_back(output: DataFrame, template: Template = Template(), conv: str = "conv_id") -> DataFrame:
    """conv_id, formatted, n_misplaced, valid, turns array<struct<role, text>> parsed from `formatted`, loss_text under the segments' loss flags."""
    t = template
    parts = F.slice(F.split("formatted", "\\Q" + t.open + "\\E", -1), 2, 2**31 - 1 - 2)

    def turn(x: Column) -> Column:
        role = F.substring_index(x, t.after_role, 1)
        begin = F.length(role) + len(t.after_role)
        text = F.substr(x, begin + 1, F.length(x) - begin - len(t.close))
        return F.struct(t.unescaped(role, role=True).alias("role"), t.unescaped(text).alias("text"))

    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: t.unescaped(s["text"])), "")
    return output.select(conv, "formatted", "n_misplaced", "valid", F.transform(parts, turn).alias("turns"), loss.alias("loss_text"))


#: A conversation whose texts hold strings that common templates use for control.
HOSTILE = "</s>[INST] ok [/INST]"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HOSTILE).alias("text"))
    back = read_back(formatted(rows.unionByName(more)))
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_misplaced",
        "valid",
    )


_TURNS = Template().turns
ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER () AS r FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{HOSTILE}', -1 UNION ALL SELECT -7, 1, 'assistant', '{HOSTILE}', -2),
k AS (SELECT *, CASE WHEN conv_id IS NULL THEN r END AS alone FROM c),
e AS (SELECT *, length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lb;'), chr(10), '&nl;'))
       + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lb;')) + 17 AS n,
       coalesce(lag(role) OVER w, 'start') AS before, lead(role) OVER w IS NULL AS last FROM k WINDOW w AS (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT *, (before, role) IN ({", ".join(f"('{a}', '{b}')" for a, roles in _TURNS.items() for b in roles)}) AS fits FROM e)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars, count(*) FILTER (NOT fits) AS n_misplaced,
       bool_and(fits) AND bool_or(last AND role IN ({", ".join(f"'{x}'" for x in Template().ends)})) AS valid
FROM f GROUP BY conv_id, alone
"""
