"""Chat formatting with a small compiled template language.

The language has text, ``{{ expression }}``, ``{% for %}``, ``{% if / elif / else %}``,
``{% set %}`` and ``{% generation %}``, which marks text that the loss covers. Expressions have
literals, names, ``.key``, ``[index]``, comparison, ``in``, ``and``, ``or``, ``not``, ``+``, ``~``
and a fixed list of filters. A name or key may not start with an underscore, nothing can be
called, and a key only looks into a mapping: a template can reach the conversation and nothing
else. A template is parsed to a tree, constants are folded, and the tree becomes Python closures.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.common import text_of
from trialweave.session import ship_package

#: Strings with a meaning in the formatted output. None has ``<`` or ``[`` but at its start, so a
#: text's end and a control string after it never make another one.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[TURN]", "[TEXT]", "[/TURN]")
ESCAPE = "\\"
_SPECIAL = re.compile("|".join(map(re.escape, (*CONTROLS, ESCAPE))))
_ESCAPED = re.compile(re.escape(ESCAPE) + "(" + _SPECIAL.pattern + ")")
_TOKEN = re.compile(_ESCAPED.pattern + "|(" + "|".join(map(re.escape, CONTROLS)) + ")")

TEMPLATE = (
    "<s>"
    "{% for turn in turns %}"
    "{% if turn.role == 'user' %}[INST] {{ turn.text | escape }} [/INST]"
    "{% elif turn.role == 'assistant' %}"
    "{% generation %}{{ turn.text | escape }}{% endgeneration %}</s>"
    "{% else %}[TURN]{{ turn.role | escape }}[TEXT]{{ turn.text | escape }}[/TURN]{% endif %}"
    "{% endfor %}"
)


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower,
}


class TemplateError(ValueError):
    pass


# The tree: tuples of a kind and its parts. Expressions: ("const", v), ("name", n), ("key", e, k),
# ("index", e, e), ("not", e), ("op", o, e, e), ("filter", f, e). Statements: ("text", s),
# ("show", e), ("for", name, e, body), ("if", [(e, body)], body), ("set", name, e),
# ("generation", body).
Node = tuple

_LEX = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)"
                  r"|(==|!=|<=|>=|[<>+~|.()\[\]=]))")
_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_LEVELS = (("or",), ("and",), ("==", "!=", "<", ">", "<=", ">=", "in"), ("+", "~"))
_OPS: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
    ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "+": lambda a, b: a + b, "~": lambda a, b: f"{a}{b}",
}
_CONSTANTS = {"true": True, "false": False, "none": None}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str) -> None:
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _LEX.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastindex, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (0, "")
        return text if kind in (3, 4) else ""

    def take(self, *wanted: str) -> str:
        if self.peek() not in wanted:
            raise TemplateError(f"expected {' or '.join(wanted)} at token {self.at}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def name(self) -> str:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (0, "")
        if kind != 3 or text.startswith("_"):
            raise TemplateError(f"{text!r} is not a name that a template may use")
        self.at += 1
        return text

    def whole(self) -> Node:
        node = self.binary(0)
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def binary(self, level: int) -> Node:
        if level == len(_LEVELS):
            return self.filtered()
        if level == 2 and self.peek() == "not":
            self.take("not")
            return ("not", self.binary(level))
        node = self.binary(level + 1)
        while self.peek() in _LEVELS[level]:
            op = self.take(*_LEVELS[level])
            node = ("op", op, node, self.binary(level + 1))
        return node

    def filtered(self) -> Node:
        node = self.primary()
        while self.peek() in ("|", ".", "["):
            mark = self.take("|", ".", "[")
            if mark == "|":
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                node = ("filter", name, node)
            elif mark == ".":
                node = ("key", node, self.name())
            else:
                node = ("index", node, self.binary(0))
                self.take("]")
        return node

    def primary(self) -> Node:
        if self.peek() == "(":
            self.take("(")
            node = self.binary(0)
            self.take(")")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, text = self.tokens[self.at]
        if kind == 1:
            self.at += 1
            return ("const", int(text))
        if kind == 2:
            self.at += 1
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]),
                                    text[1:-1]))
        if text in _CONSTANTS:
            self.at += 1
            return ("const", _CONSTANTS[text])
        return ("name", self.name())


class _Parser:
    def __init__(self, source: str) -> None:
        self.parts, at = [], 0
        for m in _TAG.finditer(source):
            self.parts.append(("text", source[at:m.start()]))
            self.parts.append(("show", m[1]) if m[1] is not None else ("tag", m[2].strip()))
            at = m.end()
        self.parts.append(("text", source[at:]))
        self.at = 0

    def body(self, *ends: str) -> tuple[list[Node], str]:
        """Statements up to a tag whose first word is one of ``ends``; that tag."""
        out: list[Node] = []
        while self.at < len(self.parts):
            kind, text = self.parts[self.at]
            self.at += 1
            if kind == "text":
                out.append(("text", text))
            elif kind == "show":
                out.append(("show", _Expression(text).whole()))
            else:
                word, _, rest = text.partition(" ")
                if word in ends:
                    return out, text
                out.append(self.statement(word, rest))
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return out, ""

    def statement(self, word: str, rest: str) -> Node:
        if word == "for":
            head = _Expression(rest)
            name = head.name()
            head.take("in")
            over = head.binary(0)
            return ("for", name, over, self.body("endfor")[0])
        if word == "if":
            cases, other, condition = [], [], rest
            while True:
                body, end = self.body("elif", "else", "endif")
                cases.append((_Expression(condition).whole(), body))
                first, _, condition = end.partition(" ")
                if first == "else":
                    other = self.body("endif")[0]
                if first != "elif":
                    return ("if", cases, other)
        if word == "set":
            head = _Expression(rest)
            name = head.name()
            head.take("=")
            return ("set", name, head.binary(0))
        if word == "generation":
            return ("generation", self.body("endgeneration")[0])
        raise TemplateError(f"unknown tag {word!r}")


def fold(node: Node) -> Node:
    """The expression with all parts that depend on no name worked out."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "op":
        a, b = fold(node[2]), fold(node[3])
        if a[0] == "const" and node[1] in ("and", "or"):
            return b if bool(a[1]) == (node[1] == "and") else a
        if a[0] == b[0] == "const":
            return ("const", _OPS[node[1]](a[1], b[1]))
        return ("op", node[1], a, b)
    if kind == "filter":
        e = fold(node[2])
        return ("const", FILTERS[node[1]](str(e[1]))) if e[0] == "const" else ("filter", node[1], e)
    if kind == "not":
        e = fold(node[1])
        return ("const", not e[1]) if e[0] == "const" else ("not", e)
    if kind == "key":
        return ("key", fold(node[1]), node[2])
    return ("index", fold(node[1]), fold(node[2]))


def fold_body(body: list[Node]) -> list[Node]:
    """Statements with constants shown as text, dead branches gone and neighbouring texts joined."""
    out: list[Node] = []
    for node in body:
        kind, made = node[0], [node]
        if kind == "show":
            e = fold(node[1])
            made = [("text", _shown(e[1])) if e[0] == "const" else ("show", e)]
        elif kind == "for":
            made = [("for", node[1], fold(node[2]), fold_body(node[3]))]
        elif kind == "set":
            made = [("set", node[1], fold(node[2]))]
        elif kind == "generation":
            made = [("generation", fold_body(node[1]))]
        elif kind == "if":
            cases, other = [], fold_body(node[2])
            for condition, inner in node[1]:
                c = fold(condition)
                if c[0] != "const":
                    cases.append((c, fold_body(inner)))
                elif c[1]:
                    other = fold_body(inner)
                    break
            made = [("if", cases, other)] if cases else other
        for m in made:
            if m[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + m[1])
            elif m != ("text", ""):
                out.append(m)
    return out


def _shown(value: Any) -> str:
    return "" if value is None else str(value)


@dataclass
class Output:
    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _value(node: Node) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "const":
        return lambda scope, v=node[1]: v
    if kind == "name":
        return lambda scope, n=node[1]: scope.get(n)
    if kind == "key":
        inner, key = _value(node[1]), node[2]

        def look(scope: dict) -> Any:
            holder = inner(scope)
            return holder.get(key) if isinstance(holder, dict) else None

        return look
    if kind == "index":
        inner, at = _value(node[1]), _value(node[2])

        def pick(scope: dict) -> Any:
            holder, i = inner(scope), at(scope)
            if isinstance(holder, dict):
                return holder.get(i)
            ok = isinstance(holder, (list, str)) and isinstance(i, int) and -len(holder) <= i < len(holder)
            return holder[i] if ok else None

        return pick
    if kind == "not":
        inner = _value(node[1])
        return lambda scope: not inner(scope)
    if kind == "filter":
        inner, f = _value(node[2]), FILTERS[node[1]]
        return lambda scope: f(_shown(inner(scope)))
    a, b = _value(node[2]), _value(node[3])
    if node[1] == "and":
        return lambda scope: a(scope) and b(scope)
    if node[1] == "or":
        return lambda scope: a(scope) or b(scope)
    op = _OPS[node[1]]
    return lambda scope: op(a(scope), b(scope))


def _run(body: list[Node]) -> Callable[[dict, Output], None]:
    steps = [_step(node) for node in body]

    def run(scope: dict, out: Output) -> None:
        for step in steps:
            step(scope, out)

    return run


def _step(node: Node) -> Callable[[dict, Output], None]:
    kind = node[0]
    if kind == "text":
        return lambda scope, out, t=node[1]: out.write(t)
    if kind == "show":
        value = _value(node[1])
        return lambda scope, out: out.write(_shown(value(scope)))
    if kind == "set":
        value = _value(node[2])

        def put(scope: dict, out: Output, n: str = node[1]) -> None:
            scope[n] = value(scope)

        return put
    if kind == "generation":
        inside = _run(node[1])

        def mark(scope: dict, out: Output) -> None:
            start = out.length
            inside(scope, out)
            out.spans.append((start, out.length))

        return mark
    if kind == "if":
        cases = [(_value(c), _run(b)) for c, b in node[1]]
        other = _run(node[2])

        def choose(scope: dict, out: Output) -> None:
            for condition, inside in cases:
                if condition(scope):
                    return inside(scope, out)
            return other(scope, out)

        return choose
    name, over, inside = node[1], _value(node[2]), _run(node[3])

    def loop(scope: dict, out: Output) -> None:
        items = list(over(scope) or [])
        for i, item in enumerate(items):
            state = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(items) - 1}
            inside({**scope, name: item, "loop": state}, out)

    return loop


def compile_template(source: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from a scope to the formatted text and the spans under the loss, in code points."""
    run = _run(fold_body(_Parser(source).body()[0]))

    def render(scope: dict) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        run(dict(scope), out)
        return "".join(out.parts), out.spans

    return render


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn, read back from text that ``TEMPLATE`` has formatted."""
    turns, role, start = [], "", 0
    for m in _TOKEN.finditer(formatted):
        mark = m[2]
        if mark is None:
            continue
        between = formatted[start:m.start()]
        if mark == "[/INST]":
            turns.append(("user", unescape(between[1:-1])))
        elif mark == "</s>":
            turns.append(("assistant", unescape(between)))
        elif mark == "[TEXT]":
            role = unescape(between)
        elif mark == "[/TURN]":
            turns.append((role, unescape(between)))
        start = m.end()
    return turns


FORMATTED = "conv_id bigint, formatted string, spans array<struct<start:int,end:int>>"


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, formatted, spans) for rows (conv_id, turn, role, text).

    Turns are in the order of ``turn``, nulls first, ties by role and text; repeated rows are turns
    of their own. A null text or role is empty, null ids are one conversation, other columns are
    not read, and an empty table gives an empty result. Rows are dealt by conversation and sorted,
    and a task holds one conversation at a time, which is one row of the output.
    """
    ship_package(turns.sparkSession)
    compile_template(template)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        now: Any = run  # no conversation yet
        held: list[dict] = []
        done: list[tuple] = []

        def finish() -> None:
            if held:
                text, spans = render({"turns": held})
                done.append((now, text, [{"start": a, "end": b} for a, b in spans]))

        def flush() -> pa.RecordBatch:
            rows = [dict(zip(("conv_id", "formatted", "spans"), d)) for d in done]
            done.clear()
            kind = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()),
                              ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
            return pa.RecordBatch.from_pylist(rows, schema=kind)

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if conv != now:
                    finish()
                    now, held = conv, []
                held.append({"role": role, "text": text})
            if done:
                yield flush()
        finish()
        if done:
            yield flush()

    rows = turns.select(F.col("conv_id").cast("long"), "turn",
                        text_of("role").alias("role"), text_of("text").alias("text"))
    return (rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .select("conv_id", "role", "text").mapInArrow(run, FORMATTED))


READ = ("conv_id bigint, n_turns bigint, turns array<struct<role:string,text:string>>, "
        "loss_text string, formatted_chars bigint")


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and the text under the loss, from nothing but formatted texts and their spans."""
    ship_package(formatted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = pa.struct([("role", pa.string()), ("text", pa.string())])
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns", pa.list_(turn)),
                            ("loss_text", pa.string()), ("formatted_chars", pa.int64())])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text = row["formatted"]
                turns = read_turns(text)
                loss = "".join(unescape(text[s["start"]:s["end"]]) for s in row["spans"])
                out.append({"conv_id": row["conv_id"], "n_turns": len(turns), "loss_text": loss,
                            "turns": [{"role": r, "text": t} for r, t in turns],
                            "formatted_chars": len(text)})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return formatted.mapInArrow(run, READ)


ORACLE_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, length(regexp_replace(text, '(<s>|</s>|\\[INST\\]|\\[/INST\\]|\\[TURN\\]|\\[TEXT\\]|\\[/TURN\\]|\\\\)', '\\\\\\1', 'g')) AS escaped,
    length(regexp_replace(role, '(<s>|</s>|\\[INST\\]|\\[/INST\\]|\\[TURN\\]|\\[TEXT\\]|\\[/TURN\\]|\\\\)', '\\\\\\1', 'g')) AS escaped_role
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(3 + sum(CASE role WHEN 'user' THEN escaped + 15 WHEN 'assistant' THEN escaped + 4
           ELSE escaped + escaped_role + 19 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.sql("""
        SELECT -7L AS conv_id, CAST(t AS BIGINT) AS turn, r AS role, '</s>[INST] ok [/INST]' AS text
        FROM VALUES (0, 'user'), (1, 'assistant') AS v(t, r)""")
    back = read_back(format_conversations(turns.unionByName(probe)))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", "n_turns", F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")
