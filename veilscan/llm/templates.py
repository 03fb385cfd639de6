"""A small sandboxed template language, compiled to Python closures.

    {{ expression }}                               its value
    {% for name in name %} ... {% endfor %}        over the named list
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}       marks what a model would write

Expressions are literals, names, fields of a message (m.role), ``+``,
comparisons with == and !=, and, or, not, in, and filters (m.text | escape).
Nothing can be called or imported, and fields are read from mappings only.
Constant parts are folded when a template is compiled. A template is a function
of its variables and ``emit(text, generated)``; it never holds its output, and
a list may be any iterable.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

Emit = Callable[[str, bool], None]
Closure = Callable[[dict, Emit, bool], None]
_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.DOTALL)


class TemplateError(ValueError):
    """The template is malformed, or asks for what the sandbox does not have."""


@dataclass
class Text:
    text: str


@dataclass
class Value:
    tree: ast.expr


@dataclass
class Loop:
    name: str
    over: str
    body: list


@dataclass
class Choice:
    branches: list  # (condition or None, body)


@dataclass
class Generation:
    body: list


def parse(source: str) -> list:
    """Syntax tree of a template."""
    root: list = []
    stack: list[tuple[str, Any, list]] = [("", None, root)]
    at = 0
    for tag in _TAG.finditer(source):
        if tag.start() > at:
            stack[-1][2].append(Text(source[at : tag.start()]))
        at = tag.end()
        if tag[1] is not None:
            stack[-1][2].append(Value(_expression(tag[1])))
            continue
        word, _, rest = tag[2].strip().partition(" ")
        _statement(stack, word, rest.strip())
    if len(stack) > 1:
        raise TemplateError(f"no end of {stack[-1][0]}")
    if at < len(source):
        root.append(Text(source[at:]))
    return root


def _statement(stack: list, word: str, rest: str) -> None:
    kind, node, body = stack[-1]
    if word == "for":
        found = re.fullmatch(r"(\w+)\s+in\s+(\w+)", rest)
        if not found:
            raise TemplateError(f"for {rest}")
        node = Loop(found[1], found[2], [])
        body.append(node)
        stack.append((word, node, node.body))
    elif word == "generation":
        node = Generation([])
        body.append(node)
        stack.append((word, node, node.body))
    elif word == "if":
        node = Choice([(_expression(rest), [])])
        body.append(node)
        stack.append((word, node, node.branches[0][1]))
    elif word in ("elif", "else") and kind == "if" and node.branches[-1][0] is not None:
        node.branches.append((_expression(rest) if word == "elif" else None, []))
        stack[-1] = (kind, node, node.branches[-1][1])
    elif word.startswith("end") and word[3:] == kind and kind:
        stack.pop()
    else:
        raise TemplateError(f"unexpected {word}")


def _expression(source: str) -> ast.expr:
    try:
        return ast.parse(source.strip(), mode="eval").body
    except SyntaxError as error:
        raise TemplateError(source) from error


def compile_template(source: str, filters: Mapping[str, Callable[[str], str]]) -> Callable[[dict, Emit], None]:
    closure = _body(parse(source), filters)
    return lambda variables, emit: closure(variables, emit, False)


def _body(nodes: list, filters: Mapping) -> Closure:
    """One closure for a list of nodes; neighbouring constants become one."""
    steps: list = []
    for node in nodes:
        for step in _steps(node, filters):
            if isinstance(step, str) and steps and isinstance(steps[-1], str):
                steps[-1] += step
            elif step != "":
                steps.append(step)
    runs = [_constant(s) if isinstance(s, str) else s for s in steps]
    if len(runs) == 1:
        return runs[0]

    def run(variables: dict, emit: Emit, generated: bool) -> None:
        for each in runs:
            each(variables, emit, generated)

    return run


def _constant(text: str) -> Closure:
    return lambda variables, emit, generated: emit(text, generated)


def _steps(node: Any, filters: Mapping) -> list:
    """Closures, or strings for constant output."""
    if isinstance(node, Text):
        return [node.text]
    if isinstance(node, Value):
        constant, value = _evaluator(node.tree, filters)
        if constant:
            return [str(value)]
        return [lambda variables, emit, generated: emit(str(value(variables)), generated)]
    if isinstance(node, Generation):
        body = _body(node.body, filters)
        return [lambda variables, emit, generated: body(variables, emit, True)]
    if isinstance(node, Loop):
        return [_loop(node, filters)]
    return _choice(node, filters)


def _loop(node: Loop, filters: Mapping) -> Closure:
    body = _body(node.body, filters)

    def run(variables: dict, emit: Emit, generated: bool) -> None:
        for item in variables[node.over]:
            body({**variables, node.name: item}, emit, generated)

    return run


def _choice(node: Choice, filters: Mapping) -> list:
    branches: list[tuple[Callable, list]] = []
    for condition, body in node.branches:
        constant, test = (True, True) if condition is None else _evaluator(condition, filters)
        if constant and not test:
            continue
        if constant and not branches:  # decided when compiled
            return [step for part in body for step in _steps(part, filters)]
        branches.append(((lambda variables: True) if constant else test, _body(body, filters)))
        if constant:
            break

    def run(variables: dict, emit: Emit, generated: bool) -> None:
        for test, body in branches:
            if test(variables):
                body(variables, emit, generated)
                return

    return [run] if branches else []


def _evaluator(tree: ast.expr, filters: Mapping) -> tuple[bool, Any]:
    """(True, value) of a constant expression, else (False, function of the
    variables)."""
    match tree:
        case ast.Constant(value=value) if isinstance(value, str | int | bool | None):
            return True, value
        case ast.Name(id=name):
            return False, lambda variables: variables[name]
        case ast.Attribute(value=inner, attr=field):
            return _applied(lambda item: _field(item, field), filters, inner)
        case ast.BinOp(left=inner, op=ast.BitOr(), right=ast.Name(id=name)) if name in filters:
            chosen = filters[name]
            return _applied(lambda item: chosen(str(item)), filters, inner)
        case ast.BinOp(left=left, op=ast.Add(), right=right):
            return _applied(lambda a, b: str(a) + str(b), filters, left, right)
        case ast.UnaryOp(op=ast.Not(), operand=inner):
            return _applied(lambda a: not a, filters, inner)
        case ast.BoolOp(op=op, values=values):
            every = isinstance(op, ast.And)
            return _applied(lambda *x: all(x) if every else any(x), filters, *values)
        case ast.Compare(left=left, ops=[op], comparators=[right]):
            tests = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.In: lambda a, b: a in b}
            if type(op) in tests:
                return _applied(tests[type(op)], filters, left, right)
        case ast.Tuple(elts=parts):
            return _applied(lambda *x: x, filters, *parts)
    raise TemplateError(f"not allowed: {ast.unparse(tree)}")


def _applied(function: Callable, filters: Mapping, *inner: ast.expr) -> tuple[bool, Any]:
    parts = [_evaluator(x, filters) for x in inner]
    if all(constant for constant, _ in parts):
        return True, function(*(value for _, value in parts))
    getters = [(lambda variables, value=value: value) if constant else value for constant, value in parts]
    return False, lambda variables: function(*(get(variables) for get in getters))


def _field(item: Any, name: str) -> Any:
    if not isinstance(item, Mapping):
        raise TemplateError(f"no field {name}")
    return item[name]
