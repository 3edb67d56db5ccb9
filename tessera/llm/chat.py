"""Chat formatting: a small template language, compiled once to Python closures that render conversations as marked segments.

Language: text, {{ value }}, {{ value | filter }}, {% for x in list %}, {% if condition %} {% elif condition %} {% else %},
{% generation %}; each block ends with {% end<name> %}. A value is a quoted string, a variable or variable.field; a condition is a
value, `not` value, or two values with == or !=. There are no calls, no indexes and no attributes of Python objects: fields are
looked up in plain dicts alone, so a template reaches nothing but what it is given.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A piece of output and whether it is under the loss mask.
Segment = tuple[str, bool]
Render = Callable[[dict], Iterator[Segment]]


class TemplateError(ValueError):
    pass


# --- the syntax tree


@dataclass(frozen=True)
class Const:
    value: str


@dataclass(frozen=True)
class Name:
    path: tuple[str, ...]


@dataclass(frozen=True)
class Filtered:
    value: Const | Name | Filtered
    name: str


@dataclass(frozen=True)
class Test:
    left: Const | Name | Filtered
    op: str  # "truth", "not", "==" or "!="
    right: Const | Name | Filtered | None = None


@dataclass
class Emit:
    value: Const | Name | Filtered


@dataclass
class For:
    name: str
    over: Name
    body: list = field(default_factory=list)


@dataclass
class If:
    arms: list = field(default_factory=list)  # (Test or None, body)


@dataclass
class Generation:
    body: list = field(default_factory=list)


# --- escaping: a backslash before each character that a control string could begin with, and before itself

_SPECIAL, _ESCAPED = re.compile(r"[\\\[<]"), re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _SPECIAL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_VALUE = re.compile(r"""\s*(?:"([^"]*)"|'([^']*)'|([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*))((?:\s*\|\s*[A-Za-z_]\w*)*)\s*""")


def _value(source: str) -> Const | Name | Filtered:
    m = _VALUE.fullmatch(source)
    if not m:
        raise TemplateError(f"not a value: {source!r}")
    out: Const | Name | Filtered = Name(tuple(m[3].split("."))) if m[3] else Const(m[1] if m[1] is not None else m[2])
    for name in re.findall(r"\w+", m[4]):
        if name not in FILTERS:
            raise TemplateError(f"no filter {name!r}")
        out = Filtered(out, name)
    return out


def _test(source: str) -> Test:
    quoted = re.sub(r"\"[^\"]*\"|'[^']*'", lambda m: "q" * len(m[0]), source)
    if m := re.search(r"==|!=", quoted):
        return Test(_value(source[: m.start()]), m[0], _value(source[m.end() :]))
    if m := re.match(r"\s*not\s+", source):
        return Test(_value(source[m.end() :]), "not")
    return Test(_value(source), "truth")


def parse(template: str) -> list:
    """The syntax tree of a template."""
    root: list = []
    open_: list[tuple[str, object, list]] = [("", None, root)]
    at = 0
    for m in [*_TAG.finditer(template), None]:
        if text := template[at : m.start() if m else len(template)]:
            open_[-1][2].append(Emit(Const(text)))
        if m is None:
            break
        at = m.end()
        if m[1] is not None:
            open_[-1][2].append(Emit(_value(m[1])))
            continue
        word, _, rest = m[2].strip().partition(" ")
        kind, node, _ = open_[-1]
        if word == "for" and (f := re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+([A-Za-z_][\w.]*)\s*", rest)):
            node = For(f[1], Name(tuple(f[2].split("."))))
            open_[-1][2].append(node)
            open_.append(("for", node, node.body))
        elif word == "if":
            node = If([(_test(rest), [])])
            open_[-1][2].append(node)
            open_.append(("if", node, node.arms[-1][1]))
        elif word in ("elif", "else") and kind == "if" and node.arms[-1][0] is not None:
            node.arms.append((_test(rest) if word == "elif" else None, []))
            open_[-1] = ("if", node, node.arms[-1][1])
        elif word == "generation":
            node = Generation()
            open_[-1][2].append(node)
            open_.append(("generation", node, node.body))
        elif word.startswith("end") and word[3:] == kind and kind:
            open_.pop()
        else:
            raise TemplateError(f"misplaced {{% {m[2].strip()} %}}")
    if len(open_) > 1:
        raise TemplateError(f"{open_[-1][0]} is not ended")
    return root


# --- constant folding


def _folded(value: Const | Name | Filtered) -> Const | Name | Filtered:
    if isinstance(value, Filtered):
        inner = _folded(value.value)
        return Const(FILTERS[value.name](inner.value)) if isinstance(inner, Const) else Filtered(inner, value.name)
    return value


def _decided(test: Test) -> bool | None:
    """The outcome of a test of constants alone."""
    left, right = _folded(test.left), _folded(test.right) if test.right else None
    if isinstance(left, Const) and test.op in ("truth", "not"):
        return bool(left.value) == (test.op == "truth")
    if isinstance(left, Const) and isinstance(right, Const):
        return (left.value == right.value) == (test.op == "==")
    return None


def fold(nodes: list) -> list:
    """The same tree with constant filters applied, decided branches resolved and neighbouring texts joined."""
    out: list = []

    def add(node: object) -> None:
        if isinstance(node, Emit) and isinstance(node.value, Const):
            if not node.value.value:
                return
            if out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const):
                out[-1] = Emit(Const(out[-1].value.value + node.value.value))
                return
        out.append(node)

    for node in nodes:
        if isinstance(node, Emit):
            add(Emit(_folded(node.value)))
        elif isinstance(node, For):
            add(For(node.name, node.over, fold(node.body)))
        elif isinstance(node, Generation):
            add(Generation(fold(node.body)))
        else:
            arms = []
            for test, body in node.arms:
                known = True if test is None else _decided(test)
                if known is False:
                    continue
                arms.append((None if known else test, fold(body)))
                if known:
                    break
            if arms and arms[0][0] is None:
                for inner in arms[0][1]:
                    add(inner)
            elif arms:
                add(If(arms))
    return out


# --- closures


def _getter(value: Const | Name | Filtered) -> Callable[[dict], object]:
    if isinstance(value, Const):
        return lambda scope, v=value.value: v
    if isinstance(value, Filtered):
        inner, f = _getter(value.value), FILTERS[value.name]
        return lambda scope: f(_text(inner(scope)))

    def look(scope: dict, path: tuple[str, ...] = value.path) -> object:
        found: object = scope
        for name in path:
            found = found.get(name) if isinstance(found, dict) else None
        return found

    return look


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _checker(test: Test | None) -> Callable[[dict], bool]:
    if test is None:
        return lambda scope: True
    left = _getter(test.left)
    if test.op in ("truth", "not"):
        want = test.op == "truth"
        return lambda scope: bool(left(scope)) == want
    right, want = _getter(test.right), test.op == "=="
    return lambda scope: (_text(left(scope)) == _text(right(scope))) == want


def _closure(nodes: list, masked: bool) -> Render:
    steps: list[Render] = []
    for node in nodes:
        if isinstance(node, Emit):
            get = _getter(node.value)
            steps.append(lambda scope, get=get: iter(((_text(get(scope)), masked),)))
        elif isinstance(node, Generation):
            steps.append(_closure(node.body, True))
        elif isinstance(node, For):
            over, body, name = _getter(node.over), _closure(node.body, masked), node.name

            def loop(scope: dict, over: Callable = over, body: Render = body, name: str = name) -> Iterator[Segment]:
                for item in over(scope) or ():
                    yield from body(scope | {name: item})

            steps.append(loop)
        else:
            arms = [(_checker(test), _closure(body, masked)) for test, body in node.arms]

            def branch(scope: dict, arms: list = arms) -> Iterator[Segment]:
                for holds, body in arms:
                    if holds(scope):
                        yield from body(scope)
                        return

            steps.append(branch)

    def run(scope: dict) -> Iterator[Segment]:
        for step in steps:
            yield from step(scope)

    return run


def compile_template(template: str) -> Render:
    """A function of the variables that yields segments as it goes, so that a long conversation is never held whole."""
    return _closure(fold(parse(template)), False)


# --- conversations

#: Each turn names its role; assistant texts are under the loss mask.
TEMPLATE = (
    "{% for m in messages %}<s>[ROLE]{{ m.role | escape }}[/ROLE]"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}[INST]{{ m.text | escape }}[/INST]{% endif %}</s>{% endfor %}"
)
_CONTROL = re.compile(r"\\.|<s>\[ROLE\]|\[/ROLE\]\[INST\]|\[/ROLE\]|\[/INST\]</s>|</s>", re.S)
#: Held for itself: a user and an assistant who both quote control strings.
QUOTING = -1, [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]


def read_back(segments: Iterable[Segment]) -> Iterator[tuple[str, str, str]]:
    """(role, text, masked text) of each turn, from the formatted output alone: control strings count where they are not escaped."""
    held, masked = "", ""
    for piece, under in segments:
        held += piece
        masked += piece if under else ""
        if piece.endswith("</s>") and (turn := _turn(held)):
            yield *turn, unescape(masked)
            held = masked = ""
    if held:
        raise ValueError("the output ends inside a turn")


def _turn(formatted: str) -> tuple[str, str] | None:
    """Role and text of one formatted turn; None if it is not complete."""
    marks = [(m.start(), m.end()) for m in _CONTROL.finditer(formatted) if m[0][0] != "\\"]
    if len(marks) < 3 or formatted[marks[-1][0] :] not in ("</s>", "[/INST]</s>"):
        return None
    (_, a), (b, c), (d, _) = marks[0], marks[1], marks[-1]
    return unescape(formatted[a:b]), unescape(formatted[c:d])


def _summary(conv: int | None, rows: Iterable[tuple[str, str]], render: Render) -> tuple:
    """Format one conversation turn by turn and digest what is read back; memory holds one turn."""
    turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def counted() -> Iterator[Segment]:
        nonlocal chars
        for piece, under in render({"messages": ({"role": r, "text": t} for r, t in rows)}):
            chars += len(piece)
            yield piece, under

    for role, text, masked in read_back(counted()):
        n += 1
        turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        loss.update(masked.encode("utf-8", "surrogatepass"))
        loss_chars += len(masked)
    return conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars


def _by_conversation(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int | None, Iterator[tuple[str, str]]]]:
    """Conversations of rows that are sorted by conversation; each is to be read before the next."""
    from itertools import groupby

    rows = (row for frame in frames for row in zip(frame["conv_id"], frame["role"], frame["text"], strict=True))
    same = lambda row: None if pd.isna(row[0]) else int(row[0])
    for conv, group in groupby(rows, key=same):
        yield conv, ((role, text) for _, role, text in group)


def arranged(conversations: DataFrame) -> DataFrame:
    """Rows with a conversation's turns together and in order; tied turns by role and text, null turns first, null role or text empty."""
    filled = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    return filled.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def formatted(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, segments: array of (text, loss), turn by turn. For templates of any kind; conversations must fit in a row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = compile_template(template)
        for conv, rows in _by_conversation(frames):
            segments = [{"text": p, "loss": m} for p, m in render({"messages": [{"role": r, "text": t} for r, t in rows]}) if p]
            yield pd.DataFrame({"conv_id": pd.array([conv], "Int64"), "segments": [segments]})

    return arranged(conversations).mapInPandas(run, "conv_id long, segments array<struct<text:string,loss:boolean>>")


def query(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """A row a conversation, digested from the formatted output; and the conversation QUOTING.

    A task reads its conversations as a stream, so even one with a third of all rows takes the memory of a batch. An empty table
    gives the row of QUOTING alone; repeated rows are turns of their own; rows without conv_id form one conversation.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = compile_template(template)
        out = []
        for conv, rows in _by_conversation(frames):
            out.append(_summary(conv, rows, render))
            if len(out) == 1000:
                yield _frame(out)
                out = []
        if out:
            yield _frame(out)

    conv, turns = QUOTING
    own = conversations.sparkSession.createDataFrame([(conv, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(own)
    return arranged(rows).mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    out["conv_id"] = out["conv_id"].astype("Int64")
    return out


SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(len(regexp_replace(role, '([\\\[<])', '\\\1', 'g')) + len(regexp_replace(text, '([\\\[<])', '\\\1', 'g'))
        + CASE WHEN role = 'assistant' THEN 20 ELSE 33 END) AS chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(len(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(chars AS BIGINT) AS formatted_chars FROM g
"""
