"""Chat templates as columns: a template's text becomes one expression over an array of messages.

Templates are written in the usual chat-template notation. What is understood: text, ``{{ ... }}``, ``for x in list``,
``if/elif/else``, comments and ``-`` trims, with a line's blanks before a block and the newline after it dropped; in
expressions: fields, indexes and ``list[1:]``, ``loop.first/last/index/index0``, strings and numbers, ``+`` and ``~``,
``==``, ``!=``, ``in``, ``and/or/not``, ``is defined/none``, and the filters ``trim``, ``upper``, ``lower``, ``length``,
``tojson`` (as written) and ``stable_json`` (sorted, compact). Anything else is refused when the template is read.

Null counts as undefined: it is false and renders as nothing, in JSON as null. Fields named in RAW_JSON hold JSON text.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, StringType, StructType

RAW_JSON = ("arguments",)
TAG = re.compile(r"\{%(-?)\s*(.*?)\s*(-?)%\}|\{\{(-?)\s*(.*?)\s*(-?)\}\}|\{#.*?#\}", re.S)
CALL = "struct<id:string,index:int,type:string,function:struct<name:string,arguments:string>>"
MESSAGE = f"struct<role:string,content:string,tool_calls:array<{CALL}>,tool_call_id:string,name:string,loss:boolean>"

# One message a line: what a tokenizer without a template of its own is given.
PLAIN = """{% for message in messages %}{% if not loop.first %}{{ '\\n' }}{% endif %}
{% if message.role == 'assistant' and message.tool_calls %}assistant:{"tool_calls":{{ message.tool_calls | stable_json }}}
{%- elif message.role == 'tool' %}tool {{ message.name }}[{{ message.tool_call_id }}]:{{ message.content }}
{%- else %}{{ message.role }}:{{ message.content }}{% endif %}{% endfor %}{% if add_generation_prompt %}{{ '\\nassistant:' }}{% endif %}"""
# Roles between marks, tools before the first message, calls in tool_call blocks.
MARKED = """{% if tools %}<|start|>tools
{{ tools | tojson }}<|end|>{{ '\\n' }}{% endif %}{% for message in messages %}<|start|>{{ message.role }}{{ '\\n' }}
{%- if message.role == 'tool' %}{{ message.name }} {{ message.tool_call_id }}: {% endif %}{{ message.content }}
{%- for call in message.tool_calls %}<tool_call>{"name": {{ call.function.name | tojson }}, "arguments": {{ call.function.arguments }}}</tool_call>{% endfor %}<|end|>{{ '\\n' }}{% endfor %}
{% if add_generation_prompt %}<|start|>assistant{{ '\\n' }}{% endif %}"""


def template_hash(template: str | None, family: str, tokenizer_class: str) -> str:
    """The version of what a template renders."""
    said = {"family": family, "chat_template": template, "tokenizer_class": tokenizer_class}
    return hashlib.sha256(json.dumps(said, separators=(",", ":"), sort_keys=True).encode()).hexdigest()


class TemplateError(ValueError):
    """A template says what columns can't."""


@dataclass
class Value:
    """A column and its type, or (type null) a constant."""

    of: Any
    type: DataType | None = None

    def column(self) -> Column:
        return self.of if self.type is not None else F.lit(self.of)

    def text(self) -> Column:
        if self.type is None:
            return F.lit("" if self.of is None else str(self.of))
        if isinstance(self.type, (ArrayType, StructType)):
            raise TemplateError("a list or an object has no text; use tojson")
        plain = F.initcap(self.of.cast("string")) if isinstance(self.type, BooleanType) else self.of.cast("string")
        return F.coalesce(plain, F.lit(""))

    def truth(self) -> Column:
        if self.type is None:
            return F.lit(bool(self.of))
        if isinstance(self.type, BooleanType):
            found = self.of
        elif isinstance(self.type, StringType):
            found = self.of != ""
        elif isinstance(self.type, ArrayType):
            found = F.size(self.of) > 0
        elif isinstance(self.type, StructType):
            found = self.of.isNotNull()
        else:
            found = self.of != 0
        return F.coalesce(found, F.lit(False))


def json_text(value: Column, kind: DataType, compact: bool, raw: bool = False) -> Column:
    """JSON of a column: sorted and compact, or in the order of its fields with a blank after commas and colons."""
    comma, colon = (",", ":") if compact else (", ", ": ")
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name) if compact else kind.fields
        parts = [F.concat(F.lit(json.dumps(f.name) + colon), json_text(value[f.name], f.dataType, compact, f.name in RAW_JSON)) for f in fields]
        made = F.concat(F.lit("{"), F.concat_ws(comma, *parts), F.lit("}"))
    elif isinstance(kind, ArrayType):
        made = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: json_text(x, kind.elementType, compact)), comma), F.lit("]"))
    elif isinstance(kind, StringType) and not raw:
        quoted = F.to_json(F.array(value))
        made = F.substring(quoted, F.lit(2), F.char_length(quoted) - 2)
    else:
        made = value.cast("string")
    return F.when(value.isNull(), "null").otherwise(made)


def _json(value: Value, compact: bool) -> Value:
    if value.type is None:
        return Value(json.dumps(value.of, ensure_ascii=False, sort_keys=True, separators=(",", ":")) if compact else json.dumps(value.of, ensure_ascii=False))
    return Value(json_text(value.of, value.type, compact), StringType())


def _length(value: Value) -> Value:
    if value.type is None:
        return Value(len(value.of))
    return Value(F.size(value.of) if isinstance(value.type, ArrayType) else F.char_length(value.of), IntegerType())


FILTERS = {
    "trim": lambda v: Value(F.regexp_replace(v.text(), r"^\s+|\s+$", ""), StringType()),
    "upper": lambda v: Value(F.upper(v.text()), StringType()),
    "lower": lambda v: Value(F.lower(v.text()), StringType()),
    "length": _length,
    "tojson": lambda v: _json(v, False),
    "stable_json": lambda v: _json(v, True),
}
NAMES = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}


def _parsed(source: str) -> ast.expr:
    """An expression. Filters bind closest, so ``|`` stands for the operator that binds closest while it is read."""
    parts = re.split(r"('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")", source)
    parts[::2] = [p.replace("|", "**").replace("~", "+") for p in parts[::2]]
    try:
        return ast.parse("".join(parts).strip(), mode="eval").body
    except SyntaxError as e:
        raise TemplateError(f"can't read {source!r}") from e


def _field(of: Value, name: str) -> Value:
    if of.type is None:
        return Value(of.of.get(name)) if isinstance(of.of, dict) else Value(None)
    if isinstance(of.type, StructType) and name in of.type.names:
        return Value(of.of[name], of.type[name].dataType)
    return Value(None)


def _compare(op: ast.cmpop, left: Value, right: Value, named: str | None) -> Value:
    if isinstance(op, (ast.Is, ast.IsNot)):
        if named not in ("defined", "none"):
            raise TemplateError(f"can't test for {named}")
        there = F.lit(left.of is not None) if left.type is None else left.of.isNotNull()
        return Value(there if (named == "defined") == isinstance(op, ast.Is) else ~there, BooleanType())
    if isinstance(op, (ast.Eq, ast.NotEq)):
        same = left.column().eqNullSafe(right.column())
        return Value(same if isinstance(op, ast.Eq) else ~same, BooleanType())
    if isinstance(op, (ast.In, ast.NotIn)):
        if right.type is None and isinstance(right.of, list):
            found = left.column().isin(right.of)
        elif isinstance(right.type, ArrayType):
            found = F.array_contains(right.of, left.column())
        else:
            found = F.contains(right.text(), left.text())
        found = F.coalesce(found, F.lit(False))
        return Value(found if isinstance(op, ast.In) else ~found, BooleanType())
    raise TemplateError("only ==, !=, in and is compare")


def _value(node: ast.expr, known: dict[str, Value]) -> Value:
    match node:
        case ast.Constant():
            return Value(node.value)
        case ast.Name():
            return known.get(node.id, Value(NAMES.get(node.id)))
        case ast.Attribute():
            return _field(_value(node.value, known), node.attr)
        case ast.List():
            return Value([_value(x, known).of for x in node.elts])
        case ast.Subscript(slice=ast.Slice(lower=ast.Constant(value=int(first)), upper=None, step=None)):
            of = _value(node.value, known)
            return Value(of.of[first:]) if of.type is None else Value(F.slice(of.of, F.lit(first + 1), F.size(of.of)), of.type)
        case ast.Subscript(slice=ast.Constant(value=str(name))):
            return _field(_value(node.value, known), name)
        case ast.Subscript(slice=ast.Constant(value=int(at))):
            of = _value(node.value, known)
            return Value(of.of[at]) if of.type is None else Value(F.get(of.of, at), of.type.elementType)
        case ast.BinOp(op=ast.Pow()):
            of, after = _value(node.left, known), node.right
            while isinstance(after, ast.BinOp) and isinstance(after.op, ast.Pow):
                of, after = _filtered(of, after.left), after.right
            return _filtered(of, after)
        case ast.BinOp(op=ast.Add()):
            return Value(F.concat(_value(node.left, known).text(), _value(node.right, known).text()), StringType())
        case ast.BoolOp():
            found = [_value(x, known).truth() for x in node.values]
            out = found[0]
            for x in found[1:]:
                out = out & x if isinstance(node.op, ast.And) else out | x
            return Value(out, BooleanType())
        case ast.UnaryOp(op=ast.Not()):
            return Value(~_value(node.operand, known).truth(), BooleanType())
        case ast.Compare(ops=[op], comparators=[right]):
            return _compare(op, _value(node.left, known), _value(right, known), getattr(right, "id", "none" if getattr(right, "value", "") is None else None))
    raise TemplateError(f"can't express {ast.dump(node)[:80]}")


def _filtered(of: Value, name: ast.expr) -> Value:
    if not isinstance(name, ast.Name) or name.id not in FILTERS:
        raise TemplateError(f"no filter {ast.unparse(name)}")
    return FILTERS[name.id](of)


def _pieces(source: str) -> list[tuple[str, str]]:
    """Text, output and block pieces, with blanks trimmed as blocks ask."""
    out, at, trim = [], 0, ""
    for tag in TAG.finditer(source):
        text, block = source[at : tag.start()], tag[2] is not None
        if trim == "-":
            text = text.lstrip()
        elif trim == "\n":
            text = text.removeprefix("\n")
        if tag[1] == "-" or tag[4] == "-":
            text = text.rstrip()
        elif block and (at == 0 or "\n" in source[at : tag.start()]) and re.search(r"(^|\n)[ \t]*$", source[at : tag.start()]):
            text = text.rstrip(" \t")
        out.append(("text", text))
        if block:
            out.append(("block", tag[2]))
        elif tag[5] is not None:
            out.append(("output", tag[5]))
        trim = "-" if "-" in (tag[3], tag[6]) else "\n" if block or tag[5] is None else ""
        at = tag.end()
    rest = source[at:]
    return [*out, ("text", rest.lstrip() if trim == "-" else rest.removeprefix("\n") if trim == "\n" else rest)]


@dataclass(frozen=True)
class Template:
    """A read template. ``render`` gives its column."""

    source: str
    nodes: tuple

    @staticmethod
    def read(source: str) -> Template:
        pieces = _pieces(source)
        nodes, at = _block(pieces, 0, ())
        if at < len(pieces):
            raise TemplateError(f"unexpected {pieces[at][1]!r}")
        return Template(source, nodes)

    def render(self, messages: Column, kind: ArrayType, generation: bool = False, **constants: Any) -> Column:
        known = {k: Value(v) for k, v in constants.items()}
        return _rendered(self.nodes, known | {"messages": Value(messages, kind), "add_generation_prompt": Value(generation)})


def _block(pieces: list, at: int, ends: tuple[str, ...]) -> tuple[tuple, int]:
    """Nodes up to a block that begins with one of ``ends``."""
    out: list[tuple] = []
    while at < len(pieces):
        kind, said = pieces[at]
        word = said.split(None, 1)[0] if kind == "block" and said else ""
        if kind == "block" and word in ends:
            return tuple(out), at
        at += 1
        if kind == "text":
            out.append(("text", said))
        elif kind == "output":
            out.append(("output", _parsed(said)))
        elif word == "for" and (m := re.fullmatch(r"for\s+(\w+)\s+in\s+(.+)", said, re.S)):
            body, at = _block(pieces, at, ("endfor",))
            out.append(("for", m[1], _parsed(m[2]), body))
            at += 1
        elif word == "if":
            arms, otherwise, test = [], (), _parsed(said[2:])
            while True:
                body, at = _block(pieces, at, ("elif", "else", "endif"))
                if at == len(pieces):
                    raise TemplateError("if without endif")
                arms.append((test, body))
                said = pieces[at][1]
                at += 1
                if said.startswith("elif"):
                    test = _parsed(said[4:])
                    continue
                if said == "else":
                    otherwise, at = _block(pieces, at, ("endif",))
                    at += 1
                break
            out.append(("if", arms, otherwise))
        else:
            raise TemplateError(f"no block {said!r}")
    if ends:
        raise TemplateError(f"missing {ends[-1]}")
    return tuple(out), at


def _rendered(nodes: tuple, known: dict[str, Value]) -> Column:
    parts = []
    for node in nodes:
        match node:
            case ("text", said):
                if said:
                    parts.append(F.lit(said))
            case ("output", expr):
                parts.append(_value(expr, known).text())
            case ("if", arms, otherwise):
                made = None
                for test, body in arms:
                    made = (F if made is None else made).when(_value(test, known).truth(), _rendered(body, known))
                parts.append(made.otherwise(_rendered(otherwise, known)))
            case ("for", name, expr, body):
                parts.append(_loop(name, _value(expr, known), body, known))
    return F.concat(*parts) if parts else F.lit("")


def _loop(name: str, over: Value, body: tuple, known: dict[str, Value]) -> Column:
    if over.type is None:
        rows = over.of or []
        at = lambda i: {"first": i == 0, "last": i == len(rows) - 1, "index0": i, "index": i + 1}
        return F.concat(F.lit(""), *[_rendered(body, known | {name: Value(x), "loop": Value(at(i))}) for i, x in enumerate(rows)])
    kind = StructType().add("first", BooleanType()).add("last", BooleanType()).add("index0", IntegerType()).add("index", IntegerType())

    def one(x: Column, i: Column) -> Column:
        loop = F.struct((i == 0).alias("first"), (i == F.size(over.of) - 1).alias("last"), i.alias("index0"), (i + 1).alias("index"))
        return _rendered(body, known | {name: Value(x, over.type.elementType), "loop": Value(loop, kind)})

    return F.coalesce(F.array_join(F.transform(over.of, one), ""), F.lit(""))


def template_messages(messages: Column) -> Column:
    """Stored messages as a template takes them: calls keep their content, tools their id and name, all others have a text."""
    has_calls = lambda m: (m["role"] == "assistant") & (F.size(m["tool_calls"]) > 0)

    def one(m: Column) -> Column:
        calls, tool = F.coalesce(has_calls(m), F.lit(False)), m["role"] == "tool"
        return F.struct(
            m["role"].alias("role"),
            F.when(calls, m["content"]).otherwise(F.coalesce(m["content"], F.lit(""))).alias("content"),
            F.when(calls, m["tool_calls"]).alias("tool_calls"),
            F.when(tool, m["tool_call_id"]).alias("tool_call_id"),
            F.when(tool, m["name"]).alias("name"),
            F.coalesce(m["loss"], F.lit(True)).alias("loss"),
        ).cast(MESSAGE)

    return F.transform(messages, one)
