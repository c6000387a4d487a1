"""Chat formatting by a finite-state machine over roles, in DataFrame functions only.

A template is data: the markers around each role's text, the roles whose text is trained on, and the machine's transitions.
Every turn becomes segments (text, loss): opening marker, escaped text, closing marker; only the texts of trained roles have
loss. The machine runs along the roles of a conversation and states whether the order of turns is allowed, and if not at
which turn it first is not.

Escaping: a backslash in a text is doubled, and one is put after the first character of every control string, so no text
holds a control string. Reading back takes a backslash away where one stands alone and one of two that stand together. So
the formatted text alone gives back every role and text (`parsed`), and the segments give back what is trained on.

Scale: texts are escaped where they are read; one shuffle then brings the turns of a conversation together. A conversation
is one row, as its text is one value, so it is to a worker what a long document is. A frequent conversation or first turn is
many rows with different keys.

Defined results: null text is empty; null role is the role of empty name; a role that the template does not name is framed by
its escaped name and has no loss; turns come by turn number (null first), ties by role and then text, repeated rows each
once more; rows with null conv_id are one conversation; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Template:
    """Markers by role as (opening, closing), trained roles, and transitions (state, role) -> state from `start`; a conversation
    is valid if every transition exists and the last state is accepting. other: the three control strings round the name
    and the text of a role without markers."""

    roles: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "system": ("<<SYS>>\n", "\n<</SYS>>\n\n"),
        "user": ("[INST] ", " [/INST]"),
        "assistant": (" ", "</s>"),
    })
    trained: tuple[str, ...] = ("assistant",)
    transitions: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "system",
        ("start", "user"): "user",
        ("system", "user"): "user",
        ("user", "assistant"): "assistant",
        ("assistant", "user"): "user",
    })
    start: str = "start"
    accepting: tuple[str, ...] = ("assistant",)
    other: tuple[str, str, str] = ("<<ROLE>>", "<</ROLE>>", "<<END>>")
    reserved: tuple[str, ...] = ("<s>",)

    @property
    def controls(self) -> list[str]:
        """Every string that no text may hold: the markers without the blanks around them, and the reserved ones."""
        found = {m.strip() for pair in self.roles.values() for m in pair} | set(self.other) | set(self.reserved)
        return sorted(found - {""})

    def check(self) -> None:
        """Fails for a template that could not be read back."""
        controls = self.controls
        if any("\\" in c or len(c) < 2 for c in controls):
            raise ValueError("control strings have two characters or more, none of them a backslash")
        if any(a != b and (b in a or any(a.endswith(b[:k]) for k in range(1, len(b)))) for a in controls for b in controls):
            raise ValueError("a control string may not hold or run into another")
        opens = [o for o, _ in self.roles.values()] + [self.other[0]]
        if any(a is not b and a.startswith(b) for a in opens for b in opens) or "" in opens:
            raise ValueError("opening markers must differ at their first characters")
        if "" in {self.start, *self.accepting, *(s for s, _ in self.transitions), *self.transitions.values()}:
            raise ValueError("a state needs a name")
        if any(not c.strip() for _, c in self.roles.values()):
            raise ValueError("every role needs a closing control string")


def _quoted(text: str) -> str:
    """text as a pattern that matches itself."""
    return "".join(c if c.isalnum() or c == " " else "\\n" if c == "\n" else "\\" + c for c in text)


def escaped(text: Column, template: Template) -> Column:
    ahead = "|".join(_quoted(c) for c in template.controls)
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), f"(?s)(?={ahead})(.)", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _by_role(role: Column, template: Template, known, other: Column) -> Column:
    """known(opening, closing, name) of the role's own markers, or other."""
    return reduce(lambda rest, item: F.when(role == item[0], known(*item[1], item[0])).otherwise(rest), template.roles.items(), other)


def _segments(template: Template) -> Column:
    """The segments of one turn of columns role and text."""
    piece = lambda text, loss=False: F.struct(text.alias("text"), F.lit(loss).alias("loss"))
    text = escaped(F.col("text"), template)
    name_open, name_close, end = template.other
    other = F.array(piece(F.concat(F.lit(name_open), escaped(F.col("role"), template), F.lit(name_close))), piece(text), piece(F.lit(end)))
    return _by_role(F.col("role"), template, lambda o, c, name: F.array(piece(F.lit(o)), piece(text, name in template.trained), piece(F.lit(c))), other)


def _machine(roles: Column, template: Template) -> Column:
    """struct(state, n, bad): the machine's last state (empty after a turn that is not allowed), the turns, the first such turn."""
    key = lambda state, role: F.concat(state, F.lit("\n"), role)
    table = F.create_map(*[F.lit(x) for (state, role), to in template.transitions.items() for x in (f"{state}\n{role}", to)])
    first = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))

    def step(at, role):
        to = F.coalesce(F.try_element_at(table, key(at["state"], role)), F.lit(""))
        return F.struct(to.alias("state"), (at["n"] + 1).alias("n"), F.coalesce(at["bad"], F.when(to == "", at["n"])).alias("bad"))

    return F.aggregate(roles, first, step)


def formatted(conversations: DataFrame, template: Template | None = None, strict: bool = False) -> DataFrame:
    """(conv_id, segments, valid, bad_turn): a row a conversation; segments array<struct<text, loss>>, whose texts in a row are
    the formatted conversation; bad_turn counts from 0 and is null if only the end is wrong. strict: valid ones only."""
    template = template or Template()
    template.check()
    turns = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = turns.select("conv_id", F.struct("turn", "role", _segments(template).alias("segments")).alias("t"))
    found = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    run = found.select("conv_id", F.flatten(F.col("turns.segments")).alias("segments"), _machine(F.col("turns.role"), template).alias("m"))
    out = run.select("conv_id", "segments", F.col("m.state").isin(*template.accepting).alias("valid"), F.col("m.bad").alias("bad_turn"))
    return out.filter("valid") if strict else out


def joined(segments: Column) -> Column:
    """The formatted text of segments."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def trained_text(segments: Column) -> Column:
    """All text under the loss mask, as it was before it was escaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def parsed(text: Column, template: Template | None = None) -> Column:
    """array<struct<role, text>>: the turns of a formatted text, read from the text alone."""
    template = template or Template()
    name_open, name_close, end = template.other
    frames = [f"{_quoted(o)}.*?{_quoted(c)}" for o, c in template.roles.values()] + [f"{_quoted(name_open)}.*?{_quoted(name_close)}.*?{_quoted(end)}"]

    def turn(frame):
        inner = lambda o, c: unescaped(F.substring(frame, F.lit(len(o) + 1), F.length(frame) - len(o) - len(c)))
        body = F.substring(frame, F.lit(len(name_open) + 1), F.length(frame) - len(name_open) - len(end))
        cut = F.locate(name_close, body)
        other = F.struct(unescaped(F.substring(body, F.lit(1), cut - 1)).alias("role"), unescaped(F.substring(body, cut + len(name_close), F.length(body))).alias("text"))
        known = lambda o, c, name: F.struct(F.lit(name).alias("role"), inner(o, c).alias("text"))
        return reduce(lambda rest, item: F.when(F.startswith(frame, F.lit(item[1][0])), known(*item[1], item[0])).otherwise(rest), template.roles.items(), other)

    return F.transform(F.regexp_extract_all(text, F.lit("(?s)" + "|".join(frames)), F.lit(0)), turn)


#: The conversation that the query adds, so that control strings occur in texts.
ADDED = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    out = formatted(given.unionByName(spark.createDataFrame(ADDED, given.schema)))
    out = out.select("conv_id", "valid", "bad_turn", joined(F.col("segments")).alias("text"), trained_text(F.col("segments")).alias("loss_text"))
    out = out.withColumn("turns", parsed(F.col("text")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"), "valid", F.col("bad_turn").cast("long").alias("bad_turn"),
    )


def _sql_escaped(column: str, template: Template) -> str:
    out = rf"replace({column}, '\', '\\')"
    for c in template.controls:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


def _oracle() -> str:
    t = Template()
    frame = " ".join(f"WHEN '{role}' THEN {len(o) + len(c)}" for role, (o, c) in t.roles.items())
    trained = ", ".join(f"'{r}'" for r in t.trained)
    allowed = ", ".join(f"'{state}>{role}'" for state, role in t.transitions)  # states of this template are named as the roles that lead to them
    return f"""
WITH t AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES {", ".join(str(r) for r in ADDED)}) v
), framed AS (
  SELECT *, length({_sql_escaped("text", t)}) + CASE role {frame} ELSE {sum(map(len, t.other))} + length({_sql_escaped("role", t)}) END AS chars,
    row_number() OVER w - 1 AS k, COALESCE(lag(role) OVER w, '{t.start}') || '>' || role NOT IN ({allowed}) AS bad
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(COALESCE(SUM(length(text)) FILTER (role IN ({trained})), 0) AS BIGINT) AS loss_chars,
  sha256(COALESCE(string_agg(text, '' ORDER BY k) FILTER (role IN ({trained})), '')) AS loss_sha256,
  CAST(SUM(chars) AS BIGINT) AS formatted_chars,
  NOT bool_or(bad) AND arg_max(role, k) IN ({", ".join(f"'{s}'" for s in t.accepting)}) AS valid, MIN(k) FILTER (bad) AS bad_turn
FROM framed GROUP BY conv_id"""


ORACLE_SQL = _oracle()
