"""Definitions in Python, JavaScript, TypeScript and Go sources.

Python goes through the standard parser, or, where the text does not parse,
through an indentation scan.  The brace languages go through a lexer and a
matcher of declarations.  Each definition is (text, first line, last line,
kind, name), outer ones before inner ones; a text without any is one block.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator
from typing import NamedTuple


class Definition(NamedTuple):
    text: str
    start_line: int
    end_line: int
    chunk_type: str
    name: str | None


def definitions(text: str, language: str) -> list[Definition]:
    if language not in ("python", "javascript", "typescript", "go"):
        raise ValueError(f"Unsupported language: {language}")
    if not text.strip():
        return []
    found = _python(text) if language == "python" else _go(text) if language == "go" else _script(text, language == "typescript")
    return found or [Definition(text, 1, text.count("\n") + 1, "block", None)]


# Python ------------------------------------------------------------------------------------


def _python(text: str) -> list[Definition]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _indented(text)
    lines = text.encode().split(b"\n")

    def cut(first: int, col: int, last: int, end: int) -> str:
        part = lines[first - 1 : last]
        part[-1] = part[-1][:end]
        part[0] = part[0][col:]
        return b"\n".join(part).decode("utf-8", "replace")

    out: list[Definition] = []
    todo: list[ast.AST] = [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            body, start = cut(node.lineno, node.col_offset, node.end_lineno, node.end_col_offset), node.lineno
            if node.decorator_list:
                d = node.decorator_list[0]
                mark = "@" + cut(d.lineno, d.col_offset, d.end_lineno, d.end_col_offset)
                body, start = f"{mark}\n{body}", start - (mark.count("\n") + 1)
            out.append(Definition(body, start, node.end_lineno, "class" if isinstance(node, ast.ClassDef) else "function", node.name))
        todo.extend(reversed(list(ast.iter_child_nodes(node))))
    return out


_HEAD = re.compile(r"^([ \t]*)(?:async[ \t]+)?(?:def[ \t]+(\w+)[ \t]*\(|class[ \t]+(\w+)[ \t]*[(:])")


def _indented(text: str) -> list[Definition]:
    """Definitions of a Python text that does not parse, by indentation."""
    lines = text.split("\n")
    out = []
    for i, line in enumerate(lines):
        m = _HEAD.match(line)
        if not m:
            continue
        depth, j = 0, i
        while j < len(lines):  # the head ends with a colon outside brackets
            depth += sum(c in "([{" for c in lines[j]) - sum(c in ")]}" for c in lines[j])
            if depth <= 0:
                break
            j += 1
        if j >= len(lines) or ":" not in lines[j]:
            continue
        indent, last = len(m[1].expandtabs()), j
        for k in range(j + 1, len(lines)):
            if lines[k].strip():
                if len(lines[k].expandtabs()) - len(lines[k].expandtabs().lstrip()) <= indent:
                    break
                last = k
        body = "\n".join([line[len(m[1]) :], *lines[i + 1 : last + 1]])
        out.append(Definition(body, i + 1, last + 1, "function" if m[2] else "class", m[2] or m[3]))
    return out


# Brace languages ---------------------------------------------------------------------------


class Token(NamedTuple):
    kind: str  # name, number, string, regex or mark
    text: str
    start: int
    end: int


_LEX = re.compile(r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<name>[A-Za-z_$#\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*)|(?P<number>\d[\w.]*)|(?P<string>\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?)|(?P<mark>=>|\.\.\.|\?\.|\?\?|&&|\|\||:=|[-+*/%=<>!&|^]=|.)", re.S)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "yield", "await"}


def _template_end(text: str, at: int) -> int:
    """The end of a template literal that begins at a backquote."""
    i = at + 1
    while i < len(text):
        if text[i] == "\\":
            i += 2
        elif text[i] == "`":
            return i + 1
        elif text.startswith("${", i):
            depth, i = 1, i + 2
            while i < len(text) and depth:
                if text[i] == "`":
                    i = _template_end(text, i)
                    continue
                depth += (text[i] == "{") - (text[i] == "}")
                i += 1
        else:
            i += 1
    return len(text)


def _tokens(text: str, go: bool) -> Iterator[Token]:
    at, before = 0, None
    while at < len(text):
        if text[at] == "`":
            end = (text.find("`", at + 1) + 1 or len(text)) if go else _template_end(text, at)
            token = Token("string", text[at:end], at, end)
        else:
            m = _LEX.match(text, at)
            kind, end = m.lastgroup, m.end()
            if kind in ("space", "comment"):
                at = end
                continue
            value_before = before and (before.kind in ("number", "string", "regex") or before.kind == "name" and before.text not in _BEFORE_REGEX or before.text in (")", "]", "}"))
            if not go and m[0][0] == "/" and not value_before and (r := _REGEX.match(text, at)):
                kind, end = "regex", r.end()
            token = Token(kind, text[at:end], at, end)
        at = token.end
        before = token
        yield token


_PAIRS = {"(": ")", "[": "]", "{": "}"}


def _matched(tokens: list[Token]) -> dict[int, int] | None:
    """The closing token of each opening one, both ways; None if brackets do not balance."""
    out: dict[int, int] = {}
    open_: list[int] = []
    for i, t in enumerate(tokens):
        if t.kind != "mark":
            continue
        if t.text in _PAIRS:
            open_.append(i)
        elif t.text in ")]}":
            if not open_ or _PAIRS[tokens[open_[-1]].text] != t.text:
                return None
            j = open_.pop()
            out[i], out[j] = j, i
    return None if open_ else out


class _Source:
    def __init__(self, text: str, go: bool = False):
        self.text = text
        self.tokens = list(_tokens(text, go))
        self.pair = _matched(self.tokens)
        self.breaks = [i for i, c in enumerate(text) if c == "\n"]
        self.found: list[tuple[int, int, str, str | None]] = []

    def at(self, i: int) -> str:
        t = self.tokens[i] if 0 <= i < len(self.tokens) else None
        return t.text if t and t.kind in ("name", "mark") else ""

    def named(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "name"

    def line(self, place: int) -> int:
        return bisect.bisect_left(self.breaks, place) + 1

    def new_line(self, i: int) -> bool:
        """Does a line end before token i?"""
        return i == 0 or self.line(self.tokens[i - 1].end) < self.line(self.tokens[i].start)

    def add(self, first: int, last: int, kind: str, name: str | None) -> None:
        self.found.append((self.tokens[first].start, self.tokens[last].end, kind, name))

    def result(self) -> list[Definition]:
        self.found.sort(key=lambda d: (d[0], -d[1]))
        return [Definition(self.text[a:b], self.line(a), self.line(b - 1), kind, name) for a, b, kind, name in self.found]


_CONTINUES = set("=.?:+-*/%&|^<>,([") | {"=>", "?.", "??", "&&", "||", "in", "instanceof", "extends", "keyof", "as", "is"}


class _Script(_Source):
    def __init__(self, text: str, typed: bool):
        super().__init__(text)
        self.typed = typed

    def statement(self, i: int) -> bool:
        before = self.at(i - 1)
        return i == 0 or before in (";", "{", "}", ")", "export", "default", "declare", ":") or before not in _CONTINUES and before not in ("new", "return", "typeof", "!", "~") and self.new_line(i)

    def expression_end(self, i: int) -> int:
        """The last token of an expression or type that begins at token i."""
        last = i
        while i < len(self.tokens):
            t = self.at(i)
            if t in (";", ",", ")", "]", "}"):
                break
            if i > last and self.new_line(i) and t not in _CONTINUES and self.at(last) not in _CONTINUES and self.at(last) not in ("await", "async", "typeof", "new", "!"):
                break
            if t in _PAIRS:
                i = self.pair[i]
            last = i
            i += 1
        return last

    def skip_type(self, i: int) -> int:
        """The place after a type annotation that begins at a colon: of the body's brace, an arrow or an end."""
        i += 1
        fresh = True
        while i < len(self.tokens):
            t = self.at(i)
            if t in (";", "=", ")") or t == "=>" and not self.function_type(i) or t == "{" and not fresh:
                return i
            if t in _PAIRS:
                i = self.pair[i]
                fresh = False
            else:
                fresh = t in ("|", "&", "=>", "<", ",", ":", "is", "keyof")
            i += 1
        return i

    def function_type(self, i: int) -> bool:
        """Is the arrow at i part of a function type rather than of an arrow function?"""
        return self.at(i - 1) == ")" and self.at(self.pair[i - 1] - 1) in (":", "|", "&", "<", "=>")

    def skip_generics(self, i: int) -> int:
        if self.at(i) != "<":
            return i
        depth = 0
        while i < len(self.tokens):
            t = self.at(i)
            depth += (t == "<") - (t == ">")
            if t in _PAIRS:
                i = self.pair[i]
            i += 1
            if depth <= 0:
                break
        return i

    def body(self, i: int) -> int | None:
        """For parameters (with generics) at token i: the closing brace of the body after them."""
        i = self.skip_generics(i)
        if self.at(i) != "(":
            return None
        i = self.pair[i] + 1
        if self.at(i) == ":" and self.typed:
            i = self.skip_type(i)
        return self.pair[i] if self.at(i) == "{" else None

    def run(self) -> list[Definition]:
        if self.pair is None:
            return []
        classes: dict[int, int] = {}
        for i in range(len(self.tokens)):
            t = self.at(i)
            if t == "function" and self.tokens[i].kind == "name":
                first = i - 1 if self.at(i - 1) == "async" else i
                k = i + 1 + (self.at(i + 1) == "*")
                if self.named(k) and self.statement(first) and (end := self.body(k + 1)) is not None:
                    self.add(first, end, "function", self.at(k))
            elif t == "class" and self.named(i + 1) and self.at(i - 1) not in (".", "?."):
                first = i - 1 if self.at(i - 1) == "abstract" else i
                k = i + 1
                while k < len(self.tokens) and self.at(k) not in ("{", ";"):
                    k = self.pair[k] + 1 if self.at(k) in ("(", "[") else k + 1
                if self.at(k) == "{":
                    classes[k] = self.pair[k]
                    if self.statement(first):
                        self.add(first, self.pair[k], "class", self.at(i + 1))
            elif self.typed and t in ("interface", "type") and self.named(i + 1) and self.statement(i):
                k = self.skip_generics(i + 2)
                if t == "interface":
                    while k < len(self.tokens) and self.at(k) not in ("{", ";"):
                        k += 1
                    if self.at(k) == "{":
                        self.add(i, self.pair[k], "interface", self.at(i + 1))
                elif self.at(k) == "=":
                    end = self.expression_end(k + 1)
                    self.add(i, end + (self.at(end + 1) == ";"), "type", self.at(i + 1))
            elif t in ("const", "let", "var") and self.tokens[i].kind == "name":
                self.declarators(i + 1)
        for a, b in classes.items():
            self.methods(a, b)
        for i, t in enumerate(self.tokens):
            if t.text == "{" and t.kind == "mark" and i not in classes and self.at(i - 1) in ("=", "(", ",", ":", "return", "[", "default", "?"):
                self.methods(i, self.pair[i], True)
        return self.result()

    def declarators(self, i: int) -> None:
        while self.named(i):
            name, k = i, i + 1
            if self.at(k) == ":" and self.typed:
                k = self.skip_type(k)
            if self.at(k) != "=":
                return
            end = self.expression_end(self.skip_generics(k + 1) if self.typed else k + 1)
            inner = k + 1
            last = end
            if self.at(inner) == "(" and self.pair[inner] == end:  # an arrow function in parentheses counts
                inner, last = inner + 1, end - 1
            if self.arrow(inner, last):
                self.add(name, end, "function", self.at(name))
            if self.at(end + 1) != ",":
                return
            i = end + 2

    def arrow(self, i: int, last: int) -> bool:
        i += self.at(i) == "async"
        if self.named(i):
            return self.at(i + 1) == "=>"
        i = self.skip_generics(i)
        if self.at(i) != "(" or i > last:
            return False
        i = self.pair[i] + 1
        if self.at(i) == ":" and self.typed:
            i = self.skip_type(i)
        return self.at(i) == "=>" and i <= last

    def methods(self, a: int, b: int, literal: bool = False) -> None:
        """Methods directly inside the braces a and b."""
        i = first = a + 1
        while i < b:
            t = self.at(i)
            if t in (";", ",") or literal and t == "...":
                i += 1
                first = i
                continue
            if self.at(i) in ("(", "<") and i > first:
                end = self.body(i)
                if end is not None and end < b and (self.tokens[i - 1].kind in ("name", "string", "number") or self.at(i - 1) == "]"):
                    name = self.tokens[i - 1].text if self.tokens[i - 1].kind == "name" else None
                    while self.at(first) == "@":  # decorators stand before a method
                        first = first + 2 + (self.at(first + 2) == "(") * (self.pair.get(first + 2, first + 2) - first - 1)
                    self.add(first, end, "function", name)
                    i = first = end + 1
                    continue
            if t in ("=", ":"):
                i = self.expression_end(i + 1) + 1
                first = i
                continue
            if t in _PAIRS:
                i = self.pair[i] + 1
                if t == "{":
                    first = i
                continue
            if i > first and self.new_line(i) and self.at(i - 1) not in ("async", "static", "get", "set", "*", "public", "private", "protected", "readonly", "override", "abstract") and not (self.at(i - 1) == ")"):
                first = i
            i += 1


def _script(text: str, typed: bool) -> list[Definition]:
    return _Script(text, typed).run()


class _Go(_Source):
    def line_end(self, i: int) -> int:
        """The last token of a declaration from token i: brackets and operators carry it over lines."""
        last = i
        while i < len(self.tokens):
            if i > last and (self.new_line(i) or self.at(i) in (";", ")")):
                break
            if self.at(i) in _PAIRS:
                i = self.pair[i]
            last = i
            i += 1
        return last

    def type_spec(self, i: int) -> int:
        """Adds the type at token i and returns the token after it."""
        k = i + 1
        if self.at(k) == "[" and self.named(k + 1) and self.pair[k] > k + 2:
            k = self.pair[k] + 1
        end = self.line_end(k)
        if self.at(k) != "=":
            self.add(i, end, "type", self.at(i))
        return end + 1

    def run(self) -> list[Definition]:
        if self.pair is None:
            return []
        i = 0
        while i < len(self.tokens):
            t = self.at(i)
            if t == "func" and self.new_line(i):
                k = i + 1
                if self.at(k) == "(":
                    k = self.pair[k] + 1
                if self.named(k):
                    end = self.line_end(k)
                    self.add(i, end, "function", self.at(k))
            elif t == "type" and (self.new_line(i) or self.at(i - 1) in ("{", ";")):
                if self.at(i + 1) == "(":
                    k, end = i + 2, self.pair[i + 1]
                    while k < end:
                        k = self.type_spec(k) if self.named(k) else k + 1
                elif self.named(i + 1):
                    self.type_spec(i + 1)
            i += 1
        return self.result()


def _go(text: str) -> list[Definition]:
    return _Go(text, True).run()
