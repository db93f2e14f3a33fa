"""A small template language for chat formats, compiled to closures.

    {{ value }}   {# remark #}   {% if test %} {% elif test %} {% else %} {% endif %}
    {% for turn in turns %} ... {% endfor %}   {% generation %} ... {% endgeneration %}

A `-` inside a tag strips the white space on that side. Values are strings, whole numbers, `true`, `false`,
`none`, variables, `turn.role` or `turn["role"]`, and are combined by `or`, `and`, `not`, `==`, `!=`,
`in`, `not in`, `~`, `+`, `a if test else b` and filters (`value | trim`). Filters are those of `FILTERS`
and those that the caller gives. Nothing else can be reached: no calls, no attributes but the keys of
`turn` and `loop`, no other loops.

A conversation is rendered turn by turn: exactly one loop over the turns, at the top; what stands
before it is rendered with the first turn, what stands after it with the last one, so neither can use a
turn. In the loop `loop.index`, `loop.index0`, `loop.first` and `loop.last` tell the turn's place.

`compile_template` parses a source into a syntax tree, folds what is constant and returns closures.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from typing import NamedTuple

FILTERS: dict[str, Callable] = {
    "trim": lambda value: str(value).strip(),
    "lower": lambda value: str(value).lower(),
    "upper": lambda value: str(value).upper(),
    "length": lambda value: len(str(value)),
    "string": lambda value: _text(value),
}
NAMES = {"true": True, "false": False, "none": None}
WORDS = {"or", "and", "not", "in", "if", "else"}


class TemplateError(ValueError):
    pass


# Syntax tree.


class Const(NamedTuple):
    value: object


class Name(NamedTuple):
    name: str


class Key(NamedTuple):
    of: object
    key: object


class Op(NamedTuple):
    name: str
    args: tuple


class Text(NamedTuple):
    text: str


class Print(NamedTuple):
    value: object


class If(NamedTuple):
    test: object
    then: tuple
    other: tuple


class Loop(NamedTuple):
    name: str
    body: tuple


class Generation(NamedTuple):
    body: tuple


TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?)(.*?)(-?)#\}", re.S)
TOKEN = re.compile(r"""\s*(?:(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<sign>==|!=|[.\[\]()|~+]))""", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _pieces(source: str) -> list[tuple[str, str]]:
    """(kind, content): text, value or tag, in order."""
    out, at, strip = [], 0, False
    for found in TAG.finditer(source):
        kind = "value" if found[2] is not None else "tag" if found[5] is not None else "remark"
        left, content, right = found.groups()[{"value": 0, "tag": 3, "remark": 6}[kind] :][:3]
        text = source[at : found.start()]
        text = text.lstrip() if strip else text
        out.append(("text", text.rstrip() if left else text))
        if kind != "remark":
            out.append((kind, content.strip()))
        at, strip = found.end(), bool(right)
    tail = source[at:]
    out.append(("text", tail.lstrip() if strip else tail))
    return [piece for piece in out if piece != ("text", "")]


class _Expression:
    """Recursive descent over one tag's tokens, the loosest operators first."""

    def __init__(self, source: str, filters: Mapping[str, Callable]):
        self.source, self.filters, self.tokens, self.at = source, filters, [], 0
        at = 0
        while source[at:].strip():
            found = TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()

    def whole(self):
        value = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r} in {self.source!r}")
        return value

    def take(self, *texts: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in texts:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, text: str) -> None:
        if not self.take(text):
            raise TemplateError(f"{text!r} is missing in {self.source!r}")

    def choice(self):
        value = self.either()
        if self.take("if"):
            test = self.either()
            other = self.choice() if self.take("else") else Const("")
            return Op("choice", (test, value, other))
        return value

    def either(self):
        value = self.both()
        while self.take("or"):
            value = Op("or", (value, self.both()))
        return value

    def both(self):
        value = self.negated()
        while self.take("and"):
            value = Op("and", (value, self.negated()))
        return value

    def negated(self):
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        value = self.joined()
        while True:
            if sign := self.take("==", "!=", "in"):
                value = Op(sign, (value, self.joined()))
            elif self.tokens[self.at : self.at + 2] == [("name", "not"), ("name", "in")]:
                self.at += 2
                value = Op("not", (Op("in", (value, self.joined())),))
            else:
                return value

    def joined(self):
        value = self.filtered()
        while sign := self.take("~", "+"):
            value = Op(sign, (value, self.filtered()))
        return value

    def filtered(self):
        value = self.reached()
        while self.take("|"):
            name = self.name()
            if name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            value = Op("filter " + name, (value,))
        return value

    def reached(self):
        value = self.simple()
        while True:
            if self.take("."):
                value = Key(value, Const(self.name()))
            elif self.take("["):
                value = Key(value, self.choice())
                self.need("]")
            else:
                return value

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError(f"a name is missing in {self.source!r}")

    def simple(self):
        if self.at == len(self.tokens):
            raise TemplateError(f"a value is missing in {self.source!r}")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return Const(int(text))
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "name" and text not in WORDS:
            return Const(NAMES[text]) if text in NAMES else Name(text)
        if text == "(":
            value = self.choice()
            self.need(")")
            return value
        raise TemplateError(f"unexpected {text!r} in {self.source!r}")


def parse(source: str, filters: Mapping[str, Callable] = FILTERS) -> tuple:
    """The syntax tree: a tuple of statements."""
    pieces, at = _pieces(source), 0

    def body(*ends: str) -> tuple[tuple, str]:
        nonlocal at
        out = []
        while at < len(pieces):
            kind, content = pieces[at]
            at += 1
            word = content.split(None, 1)[0] if kind == "tag" and content else ""
            rest = content[len(word) :]
            if kind == "text":
                out.append(Text(content))
            elif kind == "value":
                out.append(Print(_Expression(content, filters).whole()))
            elif word in ends:
                return tuple(out), content
            elif word == "if":
                out.append(condition(rest))
            elif word == "for":
                found = re.fullmatch(r"\s+([A-Za-z_]\w*)\s+in\s+turns", rest)
                if not found:
                    raise TemplateError(f"a loop goes over turns, not {rest!r}")
                out.append(Loop(found[1], body("endfor")[0]))
            elif content == "generation":
                out.append(Generation(body("endgeneration")[0]))
            else:
                raise TemplateError(f"unexpected tag {content!r}")
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return tuple(out), ""

    def condition(test: str) -> If:
        value = _Expression(test, filters).whole()
        then, end = body("elif", "else", "endif")
        if end.startswith("elif"):
            return If(value, then, (condition(end[len("elif") :]),))
        return If(value, then, body("endif")[0] if end == "else" else ())

    return body()[0]


# Constant folding.


def fold(node, filters: Mapping[str, Callable] = FILTERS):
    """The same tree without what is known before any turn is: constant values, tests, empty and neighbouring texts."""
    if isinstance(node, Op):
        args = tuple(fold(arg, filters) for arg in node.args)
        if node.name == "choice" and isinstance(args[0], Const):
            return args[1] if args[0].value else args[2]
        if node.name in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.name == "and") else args[0]
        if all(isinstance(arg, Const) for arg in args):
            return Const(_apply(Op(node.name, args), filters)({}))
        return Op(node.name, args)
    if isinstance(node, Key):
        return Key(fold(node.of, filters), fold(node.key, filters))
    return node


def fold_body(body: tuple, filters: Mapping[str, Callable] = FILTERS) -> tuple:
    out: list = []
    for node in body:
        found: tuple = (node,)
        if isinstance(node, Print):
            value = fold(node.value, filters)
            found = (Text(_text(value.value)),) if isinstance(value, Const) else (Print(value),)
        elif isinstance(node, If):
            test, then, other = fold(node.test, filters), fold_body(node.then, filters), fold_body(node.other, filters)
            if isinstance(test, Const):
                found = then if test.value else other
            else:
                found = (If(test, then, other),) if then or other else ()
        elif isinstance(node, Loop):
            found = (Loop(node.name, fold_body(node.body, filters)),)
        elif isinstance(node, Generation):
            inner = fold_body(node.body, filters)
            found = (Generation(inner),) if inner else ()
        for each in found:
            if isinstance(each, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].text + each.text)
            elif each != Text(""):
                out.append(each)
    return tuple(out)


# Closures.


def _text(value) -> str:
    return "" if value is None else ("true" if value else "false") if isinstance(value, bool) else str(value)


def _apply(node, filters: Mapping[str, Callable]) -> Callable[[dict], object]:
    """A closure from variables to the value."""
    if isinstance(node, Const):
        value = node.value
        return lambda names: value
    if isinstance(node, Name):
        name = node.name
        return lambda names: _reach(names, name)
    if isinstance(node, Key):
        of, key = _apply(node.of, filters), _apply(node.key, filters)
        return lambda names: _reach(of(names), key(names))
    args = [_apply(arg, filters) for arg in node.args]
    if node.name.startswith("filter "):
        use, (one,) = filters[node.name.split()[1]], args
        return lambda names: use(one(names))
    if node.name == "not":
        (one,) = args
        return lambda names: not one(names)
    if node.name == "choice":
        test, yes, no = args
        return lambda names: yes(names) if test(names) else no(names)
    a, b = args
    return {
        "or": lambda names: a(names) or b(names),
        "and": lambda names: a(names) and b(names),
        "==": lambda names: a(names) == b(names),
        "!=": lambda names: a(names) != b(names),
        "in": lambda names: _text(a(names)) in _text(b(names)),
        "~": lambda names: _text(a(names)) + _text(b(names)),
        "+": lambda names: _sum(a(names), b(names)),
    }[node.name]


def _reach(of, key):
    if not isinstance(of, dict):
        raise TemplateError(f"{key!r} is asked of a plain value")
    if key not in of:
        raise TemplateError(f"there is no {key!r}")
    return of[key]


def _sum(a, b):
    if type(a) is not type(b) or not isinstance(a, (str, int)):
        raise TemplateError("+ takes two texts or two numbers")
    return a + b


class Out:
    """Rendered text in parts, and the spans of it that are generated, in code points."""

    def __init__(self):
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


Writer = Callable[[dict, Out], None]


def _writer(body: tuple, filters: Mapping[str, Callable]) -> Writer:
    steps = [_statement(node, filters) for node in body]

    def write(names: dict, out: Out) -> None:
        for step in steps:
            step(names, out)

    return steps[0] if len(steps) == 1 else write


def _statement(node, filters: Mapping[str, Callable]) -> Writer:
    if isinstance(node, Text):
        text = node.text
        return lambda names, out: out.put(text)
    if isinstance(node, Print):
        value = _apply(node.value, filters)
        return lambda names, out: out.put(_text(value(names)))
    if isinstance(node, If):
        test, then, other = _apply(node.test, filters), _writer(node.then, filters), _writer(node.other, filters)
        return lambda names, out: then(names, out) if test(names) else other(names, out)
    if isinstance(node, Generation):
        inner = _writer(node.body, filters)

        def generated(names: dict, out: Out) -> None:
            start = out.length
            inner(names, out)
            out.spans.append((start, out.length))

        return generated
    raise TemplateError("the loop over the turns must stand at the top")


def _inner(body: tuple):
    for node in body:
        yield node
        for part in (node.then + node.other) if isinstance(node, If) else getattr(node, "body", ()):
            yield from _inner((part,))


class Compiled(NamedTuple):
    head: Writer
    turn: Writer
    tail: Writer
    name: str

    def render(self, turn: dict, index: int, total: int, variables: dict | None = None) -> Out:
        """A turn's piece of its conversation, with the head before the first one and the tail after the last one."""
        out, names = Out(), dict(variables or {})
        if index == 0:
            self.head(names, out)
        place = {"index": index + 1, "index0": index, "first": index == 0, "last": index == total - 1}
        self.turn({**names, self.name: turn, "loop": place}, out)
        if index == total - 1:
            self.tail(names, out)
        return out


def compile_template(source: str, filters: Mapping[str, Callable] | None = None) -> Compiled:
    """Closures that render a conversation turn by turn; raises `TemplateError` on anything outside the language."""
    known = {**FILTERS, **(filters or {})}
    body = fold_body(parse(source, known), known)
    loops = [at for at, node in enumerate(body) if isinstance(node, Loop)]
    if len(loops) != 1 or sum(isinstance(node, Loop) for node in _inner(body)) != 1:
        raise TemplateError("a template has one loop over the turns, at the top")
    for node in _inner(body):
        if isinstance(node, Generation) and any(isinstance(part, Generation) for part in _inner(node.body)):
            raise TemplateError("generation tags can't be nested")
    (at,) = loops
    loop = body[at]
    return Compiled(_writer(body[:at], known), _writer(loop.body, known), _writer(body[at + 1 :], known), loop.name)
