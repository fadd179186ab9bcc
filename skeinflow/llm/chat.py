"""Chat formatting: a template compiler, and rendering of conversations in a stream.

The template language is sandboxed: text, ``{{ expression }}``, ``{% for x in y %}``, ``{% if %}/{% elif %}/{% else %}``,
``{% set x = e %}`` and ``{% generation %}...{% endgeneration %}``, which marks what a loss counts.  Expressions have
literals, names, fields of a mapping (``m.role``, ``m['role']``), ``not and or == != < <= > >= in ~ +`` and filters from a
fixed table.  There are no calls, no Python attributes and no loops but over what the context holds.

A template is parsed to a syntax tree, constants are folded (constant branches vanish, adjacent text joins), and each node
becomes a Python closure that yields ``(text, marked)`` pieces.  A conversation is rendered turn by turn from a sorted
stream and read back the same way, so a conversation of any length takes memory for one turn and one part only.
"""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Characters of a rendered part; a part ends with the turn that reaches this.
PART_CHARS = 1 << 16


class TemplateError(ValueError):
    """The template is not well formed or asks for something outside the sandbox."""


_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>~+|.\[\]()]))""")
_TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}

ESCAPED = str.maketrans({"\\": "\\\\", "<": "\\l", "[": "\\b"})
_PLAIN = {"\\": "\\", "l": "<", "b": "["}


def escape(text: str) -> str:
    """A text in which no control string can stand, as each holds ``<`` or ``[``."""
    return text.translate(ESCAPED)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _PLAIN[m[1]], text) if "\\" in text else text


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda x: escape(_text(x)), "trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(), "length": len, "string": lambda x: _text(x),
}
_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "+": operator.add, "~": lambda a, b: _text(a) + _text(b), "in": lambda a, b: a in b,
}


def _text(x: Any) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


# --- expressions: ("const", v) ("name", n) ("field", e, e) ("op", o, e, e) ("and"/"or", e, e) ("not", e) ("filter", f, e)


class _Reader:
    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") else None

    def take(self, *want: str) -> bool:
        if self.peek() in want:
            self.at += 1
            return True
        return False

    def need(self, want: str) -> None:
        if not self.take(want):
            raise TemplateError(f"{want!r} expected")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} left over")

    def expression(self) -> tuple:
        e = self.conjunction()
        while self.take("or"):
            e = ("or", e, self.conjunction())
        return e

    def conjunction(self) -> tuple:
        e = self.negation()
        while self.take("and"):
            e = ("and", e, self.negation())
        return e

    def negation(self) -> tuple:
        return ("not", self.negation()) if self.take("not") else self.comparison()

    def comparison(self) -> tuple:
        e = self.joined()
        while (o := self.peek()) in ("==", "!=", "<", "<=", ">", ">=", "in"):
            self.at += 1
            e = ("op", o, e, self.joined())
        return e

    def joined(self) -> tuple:
        e = self.piped()
        while (o := self.peek()) in ("+", "~"):
            self.at += 1
            e = ("op", o, e, self.piped())
        return e

    def piped(self) -> tuple:
        e = self.operand()
        while True:
            if self.take("."):
                e = ("field", e, ("const", self.name()))
            elif self.take("["):
                e = ("field", e, self.expression())
                self.need("]")
            elif self.take("|"):
                f = self.name()
                if f not in FILTERS:
                    raise TemplateError(f"no filter {f!r}")
                e = ("filter", f, e)
            else:
                return e

    def operand(self) -> tuple:
        if self.at >= len(self.tokens):
            raise TemplateError("an operand expected")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return ("const", int(text))
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1]))
        if kind == "name":
            known = {"true": True, "false": False, "none": None}
            return ("const", known[text.lower()]) if text.lower() in known else ("name", text)
        if text == "(":
            e = self.expression()
            self.need(")")
            return e
        raise TemplateError(f"{text!r} out of place")


def _whole(source: str) -> tuple:
    r = _Reader(source)
    e = r.expression()
    r.end()
    return e


# --- statements: ("text", s) ("put", e) ("for", name, e, body) ("if", [(e, body)...], else) ("set", name, e) ("mark", body)


def parse(template: str) -> list[tuple]:
    """The syntax tree."""
    pieces = _TAG.split(template)
    at = 0

    def block(*ends: str) -> tuple[list[tuple], str, str]:
        nonlocal at
        body: list[tuple] = []
        while at < len(pieces):
            p = pieces[at]
            at += 1
            if p.startswith("{{"):
                body.append(("put", _whole(p[2:-2])))
            elif p.startswith("{%"):
                word, _, rest = p[2:-2].strip().partition(" ")
                if word in ends:
                    return body, word, rest
                if word == "for":
                    r = _Reader(rest)
                    name = r.name()
                    r.need("in")
                    e = r.expression()
                    r.end()
                    inner, _, _ = block("endfor")
                    body.append(("for", name, e, inner))
                elif word == "if":
                    cases, test, word = [], rest, "elif"
                    while word == "elif":
                        e = _whole(test)
                        inner, word, test = block("elif", "else", "endif")
                        cases.append((e, inner))
                    body.append(("if", cases, block("endif")[0] if word == "else" else []))
                elif word == "set":
                    name, eq, value = rest.partition("=")
                    if not eq or not name.strip().isidentifier():
                        raise TemplateError(f"can't read set {rest!r}")
                    body.append(("set", name.strip(), _whole(value)))
                elif word == "generation":
                    body.append(("mark", block("endgeneration")[0]))
                else:
                    raise TemplateError(f"no statement {word!r} here")
            elif p:
                body.append(("text", p))
        if ends:
            raise TemplateError(f"{ends[-1]} missing")
        return body, "", ""

    return block()[0]


def _fold(e: tuple) -> tuple:
    kind = e[0]
    if kind in ("const", "name"):
        return e
    parts = [_fold(x) if isinstance(x, tuple) else x for x in e]
    inner = [x for x in parts if isinstance(x, tuple)]
    if kind in ("and", "or") and inner[0][0] == "const":
        return inner[1] if bool(inner[0][1]) == (kind == "and") else inner[0]
    return ("const", _value(tuple(parts))({})) if all(x[0] == "const" for x in inner) else tuple(parts)


def fold(body: list[tuple]) -> list[tuple]:
    """The tree with constant expressions and branches worked out and adjacent text joined."""
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in body:
        kind = node[0]
        if kind == "put":
            e = _fold(node[1])
            add(("text", _text(e[1])) if e[0] == "const" else ("put", e))
        elif kind == "for":
            add(("for", node[1], _fold(node[2]), fold(node[3])))
        elif kind == "if":
            cases, rest = [], fold(node[2])
            for e, inner in node[1]:
                e = _fold(e)
                if e[0] == "const":
                    if e[1]:
                        rest = fold(inner)
                        break
                    continue
                cases.append((e, fold(inner)))
            if cases:
                add(("if", cases, rest))
            else:
                for x in rest:
                    add(x)
        elif kind == "set":
            add(("set", node[1], _fold(node[2])))
        elif kind == "mark":
            add(("mark", fold(node[1])))
        else:
            add(node)
    return out


def _value(e: tuple) -> Callable[[dict], Any]:
    kind = e[0]
    if kind == "const":
        v = e[1]
        return lambda c: v
    if kind == "name":
        n = e[1]
        return lambda c: c.get(n)
    if kind == "field":
        of, key = _value(e[1]), _value(e[2])

        def field(c: dict) -> Any:
            x, k = of(c), key(c)
            if isinstance(x, dict):
                return x.get(k)
            return x[k] if isinstance(x, list | tuple) and isinstance(k, int) and k < len(x) else None

        return field
    if kind == "op":
        f, a, b = _BINARY[e[1]], _value(e[2]), _value(e[3])
        return lambda c: f(a(c), b(c))
    if kind == "and":
        a, b = _value(e[1]), _value(e[2])
        return lambda c: a(c) and b(c)
    if kind == "or":
        a, b = _value(e[1]), _value(e[2])
        return lambda c: a(c) or b(c)
    if kind == "not":
        a = _value(e[1])
        return lambda c: not a(c)
    f, a = FILTERS[e[1]], _value(e[2])
    return lambda c: f(a(c))


Piece = tuple[str, bool]


def _body(body: list[tuple], marked: bool) -> Callable[[dict], Iterator[Piece]]:
    parts = [_node(x, marked) for x in body]

    def run(c: dict) -> Iterator[Piece]:
        for p in parts:
            yield from p(c)

    return run


def _node(node: tuple, marked: bool) -> Callable[[dict], Iterator[Piece]]:
    kind = node[0]
    if kind == "text":
        piece = (node[1], marked)
        return lambda c: iter((piece,))
    if kind == "put":
        v = _value(node[1])
        return lambda c: iter(((_text(v(c)), marked),))
    if kind == "mark":
        return _body(node[1], True)
    if kind == "set":
        n, v = node[1], _value(node[2])

        def put(c: dict) -> Iterator[Piece]:
            c[n] = v(c)
            return iter(())

        return put
    if kind == "if":
        cases, rest = [(_value(e), _body(b, marked)) for e, b in node[1]], _body(node[2], marked)
        return lambda c: next((b for e, b in cases if e(c)), rest)(c)
    name, over, inner = node[1], _value(node[2]), _body(node[3], marked)

    def loop(c: dict) -> Iterator[Piece]:
        """One item is read ahead, for loop.last; nothing else of what it runs over is held."""
        items = iter(over(c) or ())
        end = object()
        item, i, outer = next(items, end), 0, c.get("loop")
        while item is not end:
            after = next(items, end)
            c[name] = item
            c["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": after is end}
            yield from inner(c)
            item, i = after, i + 1
        c["loop"] = outer

    return loop


def compile_template(template: str) -> Callable[[dict], Iterator[Piece]]:
    """A closure from a context to the pieces of its rendering."""
    return _body(fold(parse(template)), False)


# --- the template of the op1 query, and its inverse

TEMPLATE = (
    "{% for m in messages %}{% if m.role == 'assistant' %} {% generation %}{{ m.text|escape }}{% endgeneration %}</s>"
    "{% elif m.role == 'user' %}<s>[INST] {{ m.text|escape }} [/INST]"
    "{% else %}<s>[ROLE]{{ m.role|escape }}[/ROLE]{{ m.text|escape }}</s>{% endif %}{% endfor %}"
)
_TURN = re.compile(r" (?P<assistant>[^<\[]*)</s>|<s>\[INST\] (?P<user>[^<\[]*) \[/INST\]|<s>\[ROLE\](?P<role>[^<\[]*)\[/ROLE\](?P<text>[^<\[]*)</s>")


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a text rendered by TEMPLATE."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        at = m.end()
        if m["assistant"] is not None:
            yield "assistant", unescape(m["assistant"])
        elif m["user"] is not None:
            yield "user", unescape(m["user"])
        else:
            yield unescape(m["role"]), unescape(m["text"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, str, str]]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)


def _conversations(rows: Iterator[tuple[Any, str, str]]) -> Iterator[tuple[Any, Iterator[dict]]]:
    """Like groupby, with messages that end where the conversation does."""
    row = next(rows, None)

    def messages(conv: Any) -> Iterator[dict]:
        nonlocal row
        while row is not None and row[0] == conv:
            yield {"role": row[1] or "", "text": row[2] or ""}
            row = next(rows, None)

    while row is not None:
        conv = row[0]
        run = messages(conv)
        yield conv, run
        for _ in run:  # a template need not use all
            pass


def _render(template: str, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit = compile_template(template)
        out: list[tuple] = []
        held = 0
        for conv, messages in _conversations(_rows(batches)):
            ahead: list[bool] = []

            def counted(messages=messages, ahead=ahead) -> Iterator[dict]:
                for m in messages:
                    ahead.append(True)
                    yield m

            part, text, size, spans, turns = 0, [], 0, [], 0
            for piece, marked in emit({"messages": counted()}):
                if size >= PART_CHARS and len(ahead) > turns:
                    out.append((conv, part, "".join(text), spans, False))
                    part, text, size, spans, turns = part + 1, [], 0, [], len(ahead)
                if marked and piece:
                    spans.append({"start": size, "end": size + len(piece)})
                text.append(piece)
                size += len(piece)
                held += len(piece)
                if held > 4 * PART_CHARS and out:
                    yield _parts_batch(out, kind)
                    out, held = [], 0
            out.append((conv, part, "".join(text), spans, True))
        yield _parts_batch(out, kind)

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _parts_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = (kind, pa.int32(), pa.string(), _SPANS, pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["conv_id", "part", "formatted", "spans", "last"])


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, part, formatted, spans, last: the rendering of each conversation.

    ``spans`` are the stretches of ``formatted`` (code points) inside generation markers.  A long conversation has several
    parts, in order and in one partition.  Turns go by turn, nulls first, ties by role and text; null roles and texts are
    empty; a conv_id may be of any type, and turns of a null one are one conversation; repeated rows are turns of their own; very
    long texts are rendered whole, in memory for one turn and one part; other columns, whatever their names, are not looked at; no
    rows give no rows.
    """
    rows = turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    id_type = turns.schema["conv_id"].dataType
    schema = f"conv_id {id_type.simpleString()}, part int, formatted string, spans array<struct<start: long, end: long>>, last boolean"
    return rows.mapInArrow(_render(template, to_arrow_type(id_type)), schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    others = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    n = loss_chars = chars = 0
    turns, loss, rest, fresh = hashlib.sha256(), hashlib.sha256(), "", True
    for batch in batches:
        out: list[tuple] = []
        for conv, formatted, spans, last in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "spans", "last")), strict=True):
            if fresh:
                n = loss_chars = chars = 0
                turns, loss, rest, fresh = hashlib.sha256(), hashlib.sha256(), "", False
            chars += len(formatted)
            for span in spans:
                text = unescape(formatted[span["start"] : span["end"]])
                loss_chars += len(text)
                loss.update(text.encode("utf-8", "surrogatepass"))
            rest += formatted
            # A part may break within a turn; what follows the last whole turn waits for the next part.
            done = 0
            while m := _TURN.match(rest, done):
                done = m.end()
                for role, text in read_turns(m[0]):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            rest = rest[done:]
            if last:
                if rest:
                    raise ValueError(f"conversation {conv} can't be read back")
                out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                fresh = True
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((batch.schema.field("conv_id").type, *others))], names)


def read_back(formatted: DataFrame) -> DataFrame:
    """What op1 returns, from parts rendered by TEMPLATE: digests of the turns and of the unescaped text under the mask.

    The parts of a conversation must be in order and in one partition, as ``format_conversations`` gives them, and not null; what the
    template can't have rendered is an error; no rows give no rows; other columns, whatever their names, are not looked at.
    """
    schema = f"conv_id {formatted.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "spans", "last").mapInArrow(_digests, schema)


#: The conversation that op1 adds: control strings as text.
EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]

#: DuckDB SQL for op1's rows.
ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
sized AS (SELECT *, length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '[', '')) AS e,
  length(role) + length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '[', '')) AS er FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE role WHEN 'assistant' THEN e + 5 WHEN 'user' THEN e + 18 ELSE er + e + 20 END)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
