"""Operator 10, chat formatting by a template compiler.

A small sandboxed template language (text, ``{{ expression }}``, ``{% for m in
messages %}``, ``{% if %} {% elif %} {% else %}``, ``{% generation %}``) is parsed
into a syntax tree, constants are folded, and the tree becomes Python closures that
render a conversation turn by turn, with a mark on what the model is to learn.
Expressions know names, ``.role`` and ``.content``, string and integer literals,
``+ == != in and or not``, parentheses and the filters below; nothing else, so a
template reaches no attribute, call or loop of the host.

Conversations stream: rows come sorted by conversation and turn, the template
renders from a lazy sequence of turns, and a reader parses the output as it
comes, so that no conversation is held whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from itertools import chain, groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The control strings of the format; ``escape`` hides them in texts.
START, SEP, END = "<s>[INST] ", " [/INST] ", " </s>"
#: Turns: start, escaped role, separator, escaped text, end.
TEMPLATE = (
    "{% for m in messages %}{{ '<s>' + '[INST] ' }}{{ m.role | escape }}{{ ' [/INST] ' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.content | escape }}{% endgeneration %}{% else %}{{ m.content | escape }}{% endif %}"
    "{{ ' </s>' }}{% endfor %}"
)

_HIDE = re.compile(r"[<>\[\]\\]")
_SHOW = re.compile(r"\\([0-9a-f]{2})")


def escape(text: str) -> str:
    """Write < > [ ] \\ as a backslash and two hex digits, so no control string can occur."""
    return _HIDE.sub(lambda m: f"\\{ord(m[0]):02x}", text)


def unescape(text: str) -> str:
    return _SHOW.sub(lambda m: chr(int(m[1], 16)), text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}
FIELDS = ("role", "content")


class TemplateError(ValueError):
    """The template is not in the language."""


@dataclass
class Node:
    kind: str
    value: Any = None
    kids: list[Any] = field(default_factory=list)


_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[()|.+]))")
_TAGS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)


class _Expression:
    """Recursive descent: or, and, not, comparison, sum, filters, primary."""

    def __init__(self, source: str) -> None:
        self.items, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:]!r}")
            self.items.append(m.groups())
            at = m.end()
        self.at = 0

    def peek(self, *words: str) -> str | None:
        if self.at < len(self.items):
            _, _, name, sign = self.items[self.at]
            if (name or sign) in words:
                self.at += 1
                return name or sign
        return None

    def parse(self) -> Node:
        node = self.either()
        if self.at < len(self.items):
            raise TemplateError("more than one expression")
        return node

    def either(self) -> Node:
        node = self.both()
        while self.peek("or"):
            node = Node("or", None, [node, self.both()])
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.peek("and"):
            node = Node("and", None, [node, self.negated()])
        return node

    def negated(self) -> Node:
        return Node("not", None, [self.negated()]) if self.peek("not") else self.compared()

    def compared(self) -> Node:
        node = self.total()
        while op := self.peek("==", "!=", "in"):
            node = Node(op, None, [node, self.total()])
        return node

    def total(self) -> Node:
        node = self.filtered()
        while self.peek("+"):
            node = Node("+", None, [node, self.filtered()])
        return node

    def filtered(self) -> Node:
        node = self.primary()
        while True:
            if self.peek("|"):
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name}")
                node = Node("filter", name, [node])
            elif self.peek("."):
                name = self.name()
                if name not in FIELDS:
                    raise TemplateError(f"no field {name}")
                node = Node("field", name, [node])
            else:
                return node

    def name(self) -> str:
        if self.at >= len(self.items) or not (name := self.items[self.at][2]):
            raise TemplateError("a name is missing")
        self.at += 1
        return name

    def primary(self) -> Node:
        if self.peek("("):
            node = self.either()
            if not self.peek(")"):
                raise TemplateError(") is missing")
            return node
        if self.at >= len(self.items):
            raise TemplateError("an expression is missing")
        text, number, name, sign = self.items[self.at]
        self.at += 1
        if text is not None:
            return Node("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1]))
        if number is not None:
            return Node("const", int(number))
        if name is None or name in ("and", "or", "not", "in"):
            raise TemplateError(f"unexpected {name or sign}")
        return Node("name", name)


def parse(source: str) -> list[Node]:
    """The syntax tree of a template."""
    stack: list[tuple[Node, list[Node]]] = [(Node("root"), [])]
    for part in _TAGS.split(source):
        body = stack[-1][1]
        if part.startswith("{{"):
            body.append(Node("emit", None, [_Expression(part[2:-2]).parse()]))
        elif part.startswith("{%"):
            word, _, rest = part[2:-2].strip().partition(" ")
            if word == "for":
                m = re.fullmatch(r"(\w+) in messages", rest.strip())
                if not m:
                    raise TemplateError("loops go over messages")
                stack.append((Node("for", m[1]), []))
            elif word == "if":
                stack.append((Node("if", [(_Expression(rest).parse(), branch := [])]), branch))
            elif word in ("elif", "else") and stack[-1][0].kind == "if":
                test = _Expression(rest).parse() if word == "elif" else Node("const", True)
                node = stack.pop()[0]
                node.value.append((test, branch := []))
                stack.append((node, branch))
            elif word == "generation":
                stack.append((Node("generation"), []))
            elif word.startswith("end") and stack[-1][0].kind == word[3:]:
                node, kids = stack.pop()
                node.kids = kids
                stack[-1][1].append(node)
            else:
                raise TemplateError(f"unexpected {word}")
        elif part:
            body.append(Node("emit", None, [Node("const", part)]))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0].kind} is not closed")
    return stack[0][1]


_BINARY: dict[str, Callable[[Any, Any], Any]] = {"+": lambda a, b: a + b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: a in b}


def fold(node: Node) -> Node:
    """An expression with its constant parts worked out."""
    kids = [fold(k) for k in node.kids]
    if node.kind in _BINARY or node.kind in ("filter", "not", "and", "or"):
        if all(k.kind == "const" for k in kids):
            return Node("const", expression(Node(node.kind, node.value, kids))({}))
    return Node(node.kind, node.value, kids)


def fold_all(body: list[Node]) -> list[Node]:
    """A tree with folded expressions, decided branches and joined neighbouring constants."""
    out: list[Node] = []
    for node in body:
        new = [node]
        if node.kind == "emit":
            new = [Node("emit", None, [fold(node.kids[0])])]
        elif node.kind == "if":
            branches = []
            for test, kids in node.value:
                test = fold(test)
                if test.kind == "const" and not test.value:
                    continue
                branches.append((test, fold_all(kids)))
                if test.kind == "const":
                    break
            new = branches[0][1] if branches and branches[0][0].kind == "const" else [Node("if", branches)] * bool(branches)
        else:
            new = [Node(node.kind, node.value, fold_all(node.kids))]
        for n in new:
            last = out[-1] if out else None
            if last and last.kind == n.kind == "emit" and last.kids[0].kind == n.kids[0].kind == "const":
                out[-1] = Node("emit", None, [Node("const", str(last.kids[0].value) + str(n.kids[0].value))])
            else:
                out.append(n)
    return out


def expression(node: Node) -> Callable[[dict], Any]:
    kids = [expression(k) for k in node.kids]
    value = node.value
    if node.kind == "const":
        return lambda env: value
    if node.kind == "name":
        return lambda env: env.get(value, "")
    if node.kind == "field":
        return lambda env: kids[0](env).get(value, "")
    if node.kind == "filter":
        f = FILTERS[value]
        return lambda env: f(str(kids[0](env)))
    if node.kind == "not":
        return lambda env: not kids[0](env)
    if node.kind == "and":
        return lambda env: kids[0](env) and kids[1](env)
    if node.kind == "or":
        return lambda env: kids[0](env) or kids[1](env)
    op = _BINARY[node.kind]
    return lambda env: op(kids[0](env), kids[1](env))


Piece = tuple[str, bool]


def closure(body: list[Node], learn: bool = False) -> Callable[[dict], Iterator[Piece]]:
    """A function of the environment that yields pieces (text, whether under the loss mask)."""
    steps: list[Callable[[dict], Iterator[Piece]]] = []
    for node in body:
        if node.kind == "emit":
            e = expression(node.kids[0])
            steps.append(lambda env, e=e: iter(((str(e(env)), learn),)))
        elif node.kind == "for":
            inner = closure(node.kids, learn)
            steps.append(lambda env, inner=inner, name=node.value: chain.from_iterable(inner({**env, name: m}) for m in env["messages"]))
        elif node.kind == "if":
            tests = [(expression(t), closure(kids, learn)) for t, kids in node.value]
            steps.append(lambda env, tests=tests: next((run(env) for test, run in tests if test(env)), iter(())))
        else:
            steps.append(closure(node.kids, True))
    return lambda env: chain.from_iterable(step(env) for step in steps)


def compile_template(source: str = TEMPLATE) -> Callable[[Iterator[dict]], Iterator[Piece]]:
    """A renderer: turns (dicts with role and content) to pieces of text with their loss mask."""
    run = closure(fold_all(parse(source)))
    return lambda messages: run({"messages": messages})


class Reader:
    """Parses formatted output as it comes: turns, and the text under the mask."""

    def __init__(self) -> None:
        self.turns, self.chars, self.learnt = sha256(), 0, sha256()
        self.n_turns = self.loss_chars = 0
        self.open = ""

    def read(self, text: str, learn: bool) -> None:
        self.chars += len(text)
        self.open += text
        if learn:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.learnt.update(plain.encode())
        while (end := self.open.find(END)) >= 0:
            turn, self.open = self.open[:end], self.open[end + len(END) :]
            role, _, body = turn.removeprefix(START).partition(SEP)
            self.turns.update(f"{unescape(role)}\n{unescape(body)}\n".encode())
            self.n_turns += 1


_OUT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, dict]]:
    for b in batches:
        for i in range(0, len(b), 256):
            for r in b.slice(i, 256).to_pylist():
                yield r["conv_id"], {"role": r["role"], "content": r["content"]}


def _digester(source: str):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, out = compile_template(source), []
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
            reader = Reader()
            for piece in render(m for _, m in rows):
                reader.read(*piece)
            out.append((conv, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.learnt.hexdigest(), reader.chars))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
                out = []
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)

    return digest


def _writer(source: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(source)
        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("learn", pa.bool_())])
        for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
            pieces = enumerate(render(m for _, m in rows))
            while part := [x for _, x in zip(range(512), pieces)]:
                yield pa.RecordBatch.from_pylist([{"conv_id": conv, "part": i, "text": t, "learn": learn} for i, (t, learn) in part], schema)

    return write


def _sorted(turns: DataFrame) -> DataFrame:
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "content").select("conv_id", "role", "content")


def format_chats(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """The formatted text in pieces (conv_id, part, text, learn), in the order of part.

    Turns go by ``turn``, nulls first, then role and text; repeated rows are turns
    of their own. Null roles and texts are empty; a null conv_id is one conversation.
    """
    return _sorted(turns).mapInArrow(_writer(template), "conv_id long, part long, text string, learn boolean")


def chat_digests(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row for each conversation, read back from the formatted text; empty tables give none.

    The order of turns and the treatment of nulls are those of ``format_chats``. The
    template must write turns as START, escaped role, SEP, escaped text, END.
    """
    return _sorted(turns).mapInArrow(_digester(template), _OUT)
