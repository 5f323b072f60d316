"""Facts of Julia files from a token and block reader.

The reader knows tokens, brackets, blocks and statements, not full expressions: facts that need types or
macro expansion are out of its reach.  One pass over a file gives all facts.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

OPENERS = {"module", "baremodule", "struct", "function", "macro", "if", "for", "while", "let", "begin", "try", "quote", "do", "abstract", "primitive"}
PARTS = {"else", "elseif", "catch", "finally"}
KEYWORDS = OPENERS | PARTS | {"end", "const", "global", "local", "using", "import", "export", "public", "return", "break", "continue", "mutable", "in", "isa", "where"}
_OPERATORS = sorted("=== !== .== .!= .<= .>= .&& .|| ... <-> --> <-- <== ==> => -> == != <= >= && || :: <: >: |> <| .= += -= *= /= ^= %= ÷= |= &= // << >> >>> .+ .- .* ./ .^ := ∈ ∉ ≤ ≥ ≠ ≈ ⊆ ∘ ÷ √ + - * / \\ ^ % = < > ! ~ & | ? : . $ '".split(), key=len, reverse=True)
_NAME = re.compile(r"[^\W\d]\w*(?:!+(?!=(?!=)))?")
_NUMBER = re.compile(r"0[xbo][0-9a-fA-F_]+|(\d[\d_]*\.?(?!\.)[\d_]*|\.\d[\d_]*)([eEf][+-]?\d+)?(im\b)?")
ASSIGN = {"=", "+=", "-=", "*=", "/=", "^=", "%=", "÷=", "|=", "&=", ".="}
INFIX = {"+", "-", "*", "/", "^", "%", "÷", "==", "!=", "<", ">", "<=", ">=", "===", "!==", "|>", "//", "\\", "&", "|", "<<", ">>", "∈", "∉", "≤", "≥", "≠", "≈", ".+", ".-", ".*", "./", ".^"}
CLOSERS = {"(": ")", "[": "]", "{": "}"}


class SyntaxFault(ValueError):
    """The file is not well formed."""


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int
    tight: bool = False  # nothing stands between it and the token before
    inner: list["Token"] = field(default_factory=list)


@dataclass
class Block:
    word: str
    start: int
    end: int = 0
    parts: list[tuple[str, list, list]] = field(default_factory=list)  # (word, header items, statements)
    tight: bool = False
    doc: str | None = None

    @property
    def kind(self) -> str:
        return "block"

    @property
    def text(self) -> str:
        return self.word

    @property
    def header(self) -> list:
        return self.parts[0][1]

    @property
    def body(self) -> list:
        return self.parts[0][2]


def _string(source: str, at: int, quote: str) -> tuple[int, list[Token]]:
    """End of a string or command literal, and the tokens interpolated in it."""
    inner: list[Token] = []
    n = len(source)
    while at < n:
        c = source[at]
        if c == "\\":
            at += 2
        elif source.startswith(quote, at):
            return at + len(quote), inner
        elif c == "$" and at + 1 < n and source[at + 1] == "(":
            depth, end = 0, at + 1
            while end < n:
                if source[end] == "(":
                    depth += 1
                elif source[end] == ")":
                    depth -= 1
                    if not depth:
                        break
                elif source[end] == '"':
                    close, _ = _string(source, end + 1, '"')
                    end = close - 1
                end += 1
            inner += [Token(t.kind, t.text, t.start + at + 2, t.end + at + 2, t.tight, t.inner) for t in tokens(source[at + 2 : end])[0] if t.kind != "newline"]
            at = end + 1
        elif c == "$" and (m := _NAME.match(source, at + 1)):
            inner.append(Token("name", m.group(0), at + 1, m.end()))
            at = m.end()
        else:
            at += 1
    raise SyntaxFault("a string does not end")


def tokens(source: str) -> tuple[list[Token], list[tuple[int, int]]]:
    """Tokens without trivia, and the spans of comments."""
    out: list[Token] = []
    comments: list[tuple[int, int]] = []
    at, n, last = 0, len(source), -1
    add = lambda kind, end, inner=(): out.append(Token(kind, source[at:end], at, end, at == last, list(inner)))
    while at < n:
        c = source[at]
        if c == "\n":
            add("newline", at + 1)
            at += 1
            continue
        if c.isspace():
            at += 1
            continue
        if source.startswith("#=", at):
            depth, end = 1, at + 2
            while end < n and depth:
                if source.startswith("#=", end):
                    depth, end = depth + 1, end + 2
                elif source.startswith("=#", end):
                    depth, end = depth - 1, end + 2
                else:
                    end += 1
            if depth:
                raise SyntaxFault("a comment does not end")
            comments.append((at, end))
            at = end
            continue
        if c == "#":
            end = source.find("\n", at)
            end = n if end < 0 else end
            comments.append((at, end))
            at = end
            continue
        before = out[-1] if out else None
        if source.startswith('"""', at) or c == '"' or c == "`":
            quote = '"""' if source.startswith('"""', at) else "```" if source.startswith("```", at) else c
            end, inner = _string(source, at + len(quote), quote)
            add("string", end, inner)
        elif c == "'" and not (at == last and before and (before.kind in ("name", "number") or before.text in (")", "]", "}", "'"))):
            m = re.compile(r"'(\\.[^']*|[^'\\])'", re.S).match(source, at)
            if not m:
                raise SyntaxFault("a character does not end")
            end = m.end()
            add("char", end)
        elif c == "@" and (m := re.compile(r"@[\w.!]+|@\.").match(source, at)):
            end = m.end()
            add("macro", end)
        elif (c.isdigit() or (c == "." and at + 1 < n and source[at + 1].isdigit())) and (m := _NUMBER.match(source, at)):
            end = m.end()
            add("number", end)
        elif m := _NAME.match(source, at):
            end = m.end()
            word = m.group(0)
            field_ = before and before.text == "." and at == last
            symbol = before and before.text == ":" and at == last and not (before.tight and len(out) > 1 and out[-2].kind in ("name", "number", "string"))
            add("keyword" if word in KEYWORDS and not field_ and not symbol else "name", end)
        elif c in "()[]{},;":
            end = at + 1
            add("mark", end)
        else:
            end = next((at + len(o) for o in _OPERATORS if source.startswith(o, at)), at + 1)
            add("operator", end)
        at = last = end
    return out, comments


class _Reader:
    def __init__(self, items: list[Token]) -> None:
        self.items, self.at = items, 0

    def statements(self, stops: set[str], closer: str = "") -> list[list]:
        """Statements up to a stopping keyword (left in place) or closing mark."""
        out: list[list] = []
        now: list = []
        while self.at < len(self.items):
            t = self.items[self.at]
            if t.kind == "keyword" and t.text in stops:
                break
            if t.kind == "newline" or t.text == ";" and t.kind == "mark":
                goes_on = t.kind == "newline" and now and now[-1].kind in ("operator",) and now[-1].text not in ("...", "'", "!", ":") or (t.kind == "newline" and now and now[-1].text == "," and now[-1].kind == "mark")
                self.at += 1
                if now and not goes_on:
                    out.append(now)
                    now = []
                continue
            now += self.item()
        if now:
            out.append(now)
        return out

    def item(self) -> list:
        """One token, or a bracketed run of tokens, or a block."""
        t = self.items[self.at]
        if t.kind == "mark" and t.text in CLOSERS:
            return self.bracket()
        if t.kind == "mark" and t.text in ")]}":
            raise SyntaxFault(f"unexpected {t.text}")
        if t.kind == "keyword" and t.text == "mutable":
            self.at += 1
            return []
        if t.kind == "keyword" and t.text in OPENERS:
            return [self.block()]
        if t.kind == "keyword" and t.text == "end":
            raise SyntaxFault("unexpected end")
        self.at += 1
        return [t]

    def bracket(self) -> list:
        opening = self.items[self.at]
        out = [opening]
        self.at += 1
        while self.at < len(self.items):
            t = self.items[self.at]
            if t.kind == "mark" and t.text == CLOSERS[opening.text]:
                self.at += 1
                return [*out, t]
            if t.kind == "newline":
                self.at += 1
                continue
            if t.kind == "keyword" and t.text in ("for", "if", "end") or (t.kind == "keyword" and t.text in ("begin",) and opening.text == "["):
                starts = out[-1].text in ("(", ",", "=", "->", "[", "{") or out[-1].kind == "newline"
                if t.text == "end" or t.text == "begin" or not starts:
                    out.append(Token("name" if t.text in ("end", "begin") else "generator", t.text, t.start, t.end, t.tight))
                    self.at += 1
                    continue
            out += self.item()
        raise SyntaxFault(f"{opening.text} does not end")

    def block(self) -> Block:
        opening = self.items[self.at]
        block = Block(opening.text, opening.start, tight=opening.tight)
        self.at += 1
        word = opening.text
        while True:
            header: list = []
            bare = word in ("begin", "quote", "try", "else", "finally")
            while self.at < len(self.items) and not bare:
                t = self.items[self.at]
                if t.kind == "newline" or t.text == ";" or (t.kind == "keyword" and t.text in PARTS | {"end"}):
                    if not (t.kind == "newline" and header and header[-1].text in (",", "&&", "||") and word != "catch"):
                        break
                    self.at += 1
                    continue
                if word == "catch" and header:
                    break
                header += self.item()
            body = self.statements(PARTS | {"end"})
            block.parts.append((word, header, body))
            if self.at >= len(self.items):
                raise SyntaxFault(f"{opening.text} does not end")
            closing = self.items[self.at]
            self.at += 1
            if closing.text == "end":
                block.end = closing.end
                return block
            word = closing.text


def flat(items: list) -> Iterator[Token]:
    """All tokens of items, blocks and interpolations included."""
    for t in items:
        if isinstance(t, Block):
            for _, header, body in t.parts:
                yield from flat(header)
                for statement in body:
                    yield from flat(statement)
        else:
            yield t
            yield from t.inner


def split_at(items: list, mark: str) -> list[list]:
    """Cut items at a mark that stands outside of brackets."""
    out: list[list] = [[]]
    depth = 0
    for t in items:
        depth += t.kind == "mark" and t.text in CLOSERS
        depth -= t.kind == "mark" and t.text in (")", "]", "}")
        if not depth and t.text == mark and t.kind in ("mark", "operator"):
            out.append([])
        else:
            out[-1].append(t)
    return out


def group(items: list, at: int) -> int:
    """The index behind the bracket that opens at ``at``."""
    depth = 0
    for k in range(at, len(items)):
        t = items[k]
        depth += t.kind == "mark" and t.text in CLOSERS
        depth -= t.kind == "mark" and t.text in (")", "]", "}")
        if not depth:
            return k + 1
    return len(items)


@dataclass
class Function:
    name: str
    start: int
    end: int
    parameters: list[list]
    body: list
    header: list
    block: Block | None
    scope: list[str]
    doc: str | None
    named: bool = True
    expression: list = field(default_factory=list)


def signature(items: list) -> tuple[str, list[list], int] | None:
    """Name, positional parameters and length of a call-like head at the start of items."""
    at, name = 0, ""
    if items and items[0].text == "(" and items[0].kind == "mark":
        end = group(items, 0)
        if end < len(items) and items[end].text == "(" and items[end].tight:
            name = next((t.text for t in reversed(items[1 : end - 1]) if t.kind == "name"), "")
            at = end
        else:
            return None
    elif items and (items[0].kind == "name" or (items[0].kind == "operator" and len(items) > 1 and items[1].text == "(" and items[1].tight and items[0].text not in (":", "!", "$"))):
        name, at = items[0].text, 1
        while at + 1 < len(items) and items[at].text == "." and items[at].tight and (items[at + 1].kind == "name" or items[at + 1].text == ":"):
            name, at = name + "." + items[at + 1].text, at + 2
        if at < len(items) and items[at].text == "{" and items[at].tight:
            at = group(items, at)
    if not name or at >= len(items) or items[at].text != "(" or not items[at].tight:
        return None
    end = group(items, at)
    inside = split_at(items[at + 1 : end - 1], ";")[0]
    return name, [p for p in split_at(inside, ",") if p], end


def short_function(statement: list) -> tuple[str, list[list], list] | None:
    """A definition by assignment: name, parameters and the body's items."""
    head = signature(statement)
    if not head:
        return None
    name, parameters, at = head
    depth = 0
    for k in range(at, len(statement)):
        t = statement[k]
        depth += t.kind == "mark" and t.text in CLOSERS
        depth -= t.kind == "mark" and t.text in (")", "]", "}")
        if not depth and t.text == "=" and t.kind == "operator":
            between = statement[at:k]
            return (name, parameters, statement[k + 1 :]) if not between or between[0].text in ("::", "where") else None
        if not depth and t.kind == "operator" and t.text in ASSIGN | {"&&", "||", "?", "->"}:
            return None
    return None


def parameter_name(items: list) -> str | None:
    return items[0].text if items and items[0].kind == "name" else None


class File:
    """All facts of one file."""

    def __init__(self, path: str, source: str) -> None:
        self.path, self.source = path, source
        self.starts = [0] + [m.end() for m in re.finditer("\n", source)]
        self.facts: dict[str, list[dict]] = {k: [] for k in ("declarations", "imports", "references", "calls", "interop", "dependencies", "modules", "clones", "functions", "names", "globals", "order", "behavior", "tuples", "docs", "parens")}
        self.structs = 0
        self.error: str | None = None
        self.doc_lines: set[int] = set()
        self._functions: list[Function] = []
        try:
            self.tokens, self.comments = tokens(source)
            reader = _Reader(self.tokens)
            body = reader.statements(set())
            self.comment_lines = self._comment_lines()
            self.statements(body, [], None, True)
            self.metrics()
            self.closing()
        except SyntaxFault as e:
            for rows in self.facts.values():
                rows.clear()
            self.structs, self.error = 0, str(e)

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at)

    def column(self, at: int) -> int:
        """Byte column from 1."""
        return len(self.source[self.starts[self.line(at) - 1] : at].encode("utf-8")) + 1

    def add(self, fact: str, at: int, **row: object) -> None:
        self.facts[fact].append({"path": self.path, **row, "line": self.line(at), "column": self.column(at)})

    def _comment_lines(self) -> set[int]:
        code = {self.line(t.start) for t in self.tokens if t.kind != "newline"} | {self.line(t.end - 1) for t in self.tokens if t.kind == "string"}
        held = {k for a, b in self.comments for k in range(self.line(a), self.line(max(a, b - 1)) + 1)}
        return held - code

    def declare(self, name: str, kind: str, at: int, scope: list[str]) -> None:
        self.add("declarations", at, language="julia", name=name, qualified_name=".".join([*scope, name]), kind=kind, scope=".".join(scope) or None)

    def statements(self, body: list[list], scope: list[str], function: Function | None, module_level: bool) -> None:
        functions_begun, types = False, set()
        doc: tuple[str, Token] | None = None
        for statement in body:
            first = statement[0]
            if len(statement) == 1 and first.kind == "string" and first.text.startswith('"'):
                doc = (first.text, first)
                continue
            given = doc[0].strip('"').strip() if doc else None
            if doc:
                self._doc_lines(doc[1], first.start)
            doc = None
            while statement and statement[0].kind == "macro" and statement[0].text in ("@inline", "@noinline", "@doc", "@kwdef", "@static", "@generated") or statement and statement[0].text == "@Base":
                statement = statement[1:]
            if not statement:
                continue
            first = statement[0]
            word = first.text if isinstance(first, Block) or first.kind == "keyword" else ""
            made = None
            if isinstance(first, Block) and word in ("function", "macro") or (not word and short_function(statement)):
                made = self.function(statement, scope, given)
                name = made.name if made else ""
                if module_level and not (name.rpartition(".")[2] in types):
                    functions_begun = True
            elif word in ("module", "baremodule"):
                name = next((t.text for t in first.header if t.kind == "name"), "")
                self.declare(name, "module", first.start, scope)
                self.add("names", first.start, kind="module", name=name)
                self.facts["modules"].append({"path": self.path, "name": ".".join([*scope, name]), "start_line": self.line(first.start), "end_line": self.line(first.end - 1), "depth": len(scope) + 1})
                self.statements(first.body, [*scope, name], None, True)
            elif word in ("struct", "abstract", "primitive"):
                name = next((t.text for t in first.header if t.kind == "name" and t.text != "type"), "")
                self.declare(name, "type", first.start, scope)
                self.add("names", first.start, kind="type", name=name)
                self.facts["docs"].append({"path": self.path, "name": name, "doc": given, "line": self.line(first.start), "function": False})
                if word == "struct":
                    self.structs += 1
                    types.add(name)
                    if module_level and functions_begun:
                        self.add("order", first.start, kind="struct", name=name)
                    for field_ in first.body:
                        if field_[0].kind == "name" and not short_function(field_):
                            self.add("names", field_[0].start, kind="field", name=field_[0].text)
                self.scan(first.header, scope, {name})
                for field_ in first.body:
                    if isinstance(field_[0], Block) or short_function(field_):
                        self.statements([field_], [*scope, name], None, False)
                    else:
                        self.scan(field_, [*scope, name], set())
            elif word == "const":
                rest = statement[1:]
                left = split_at(rest, "=")[0]
                for part in split_at(left[1:-1] if left and left[0].text == "(" else left, ","):
                    if part and part[0].kind == "name":
                        self.declare(part[0].text, "constant", part[0].start, scope)
                        self.add("names", part[0].start, kind="constant", name=part[0].text)
                        if module_level and functions_begun:
                            self.add("order", part[0].start, kind="const", name=part[0].text)
                self.scan(rest, scope, {t.text for t in left if t.kind == "name"})
            elif word in ("using", "import"):
                self.imports(word, statement[1:], first.start)
            elif word in ("export", "public"):
                self.scan(statement[1:], scope, set())
            else:
                if word == "global":
                    if function:
                        self.add("behavior", first.start, rule="JULIA-GLOBAL-WRITE", subject=function.name)
                    elif module_level:
                        for part in split_at(split_at(statement[1:], "=")[0], ","):
                            if part and part[0].kind == "name":
                                self.add("globals", part[0].start, name=part[0].text)
                elif not word:
                    self.assignment(statement, function, module_level)
                self.scan(statement, scope, set(), function, module_level)

    def _doc_lines(self, token: Token, target: int) -> None:
        for k in range(self.line(token.start), self.line(token.end - 1) + 1):
            text = self.source[self.starts[k - 1] :].split("\n", 1)[0]
            if text.strip() and k != self.line(target):
                self.doc_lines.add(k)

    def assignment(self, statement: list, function: Function | None, module_level: bool) -> None:
        sides = split_at(statement, "=")
        target = sides[0]
        if len(sides) < 2 or not target or target[0].kind == "macro":
            return
        if function and not function.name.endswith("!") and len(target) > 2 and target[0].kind == "name" and target[0].text in {parameter_name(p) for p in function.parameters}:
            indexed = target[1].text == "[" and target[1].tight and group(target, 1) == len(target)
            member = target[1].text == "." and len(target) == 3
            if indexed or member:
                self.add("behavior", target[0].start, rule="JULIA-UNSIGNALED-ARGUMENT-MUTATION", subject=target[0].text)
        for part in split_at(target[1:-1] if target[0].text == "(" and group(target, 0) == len(target) else target, ","):
            if part and part[0].kind == "name" and (len(part) == 1 or part[1].text == "::"):
                self.add("names", part[0].start, kind="variable", name=part[0].text)
                if module_level and part[0].text != "_":
                    self.add("globals", part[0].start, name=part[0].text)

    def function(self, statement: list, scope: list[str], doc: str | None) -> Function | None:
        first = statement[0]
        if isinstance(first, Block):
            head = signature(first.header)
            anonymous = not head and bool(first.header) and first.header[0].text == "("
            if not head and not anonymous:
                return None  # a declaration without methods
            name, parameters, _ = head or ("", [p for p in split_at(split_at(first.header[1 : group(first.header, 0) - 1], ";")[0], ",") if p], 0)
            name = ("@" if first.word == "macro" else "") + name
            made = Function(name or "<anonymous>", first.start, first.end, parameters, first.body, first.header, first, scope, doc, bool(name))
        else:
            name, parameters, expression = short_function(statement)
            last = max((t.end for t in flat_ends(statement)), default=first.end)
            made = Function(name, first.start, last, parameters, [expression] if expression else [], statement[: len(statement) - len(expression)], None, scope, doc, True, expression)
        self._functions.append(made)
        if made.named:
            self.declare(made.name.lstrip("@"), "macro" if made.name.startswith("@") else "function", first.start, scope)
            self.add("names", first.start, kind="function", name=made.name.lstrip("@"))
            self.facts["docs"].append({"path": self.path, "name": made.name, "doc": doc, "line": self.line(first.start), "function": True})
        for p in made.parameters:
            if parameter_name(p):
                self.add("names", p[0].start, kind="parameter", name=parameter_name(p))
        inner = [*scope, made.name.lstrip("@")] if made.named else scope
        self.references(made.header, inner, {made.name.lstrip("@")})
        self.returns(made)
        if made.block:
            self.statements(made.body, inner, made, False)
        else:
            self.scan(made.expression, inner, set(), made, False)
        return made

    def imports(self, word: str, items: list, at: int) -> None:
        colon = split_at(items, ":")
        module = split_at(colon[0], ",")
        text = lambda part: "".join(t.text for t in part if t.text != "as" and t.kind != "keyword")
        for part in module if len(colon) == 1 else module[:1]:
            name = text([t for t in part][: next((k for k, t in enumerate(part) if t.text == "as"), len(part))])
            self.add("dependencies", at, language="julia", kind=word, target=name)
            if len(colon) == 1 and word == "import" and part:
                alias = next((part[k + 1].text for k, t in enumerate(part[:-1]) if t.text == "as"), name.lstrip("."))
                self.add("imports", part[0].start, language="julia", target=name, name=alias, kind=word)
        if len(colon) > 1:
            for part in split_at(colon[1], ","):
                if part:
                    self.add("imports", part[0].start, language="julia", target=text(colon[0]), name=next((part[k + 1].text for k, t in enumerate(part[:-1]) if t.text == "as"), part[0].text), kind=word)

    def references(self, items: list, scope: list[str], excluded: set[str]) -> None:
        for t in flat(items):
            if t.kind == "name":
                if t.text in excluded:
                    excluded = excluded - {t.text}
                    continue
                self.add("references", t.start, language="julia", name=t.text, scope=".".join(scope) or None)

    def scan(self, items: list, scope: list[str], excluded: set[str], function: Function | None = None, module_level: bool = False) -> None:
        """References, calls, blocks and nested functions of an expression."""
        caller = ".".join(scope) if function else None
        self.references([t for t in items if not isinstance(t, Block)], scope, excluded)
        k = 0
        while k < len(items):
            t = items[k]
            if isinstance(t, Block):
                self.nested(t, scope, function)
                k += 1
                continue
            if t.text == ":" and k + 1 < len(items) and items[k + 1].text == "(" and items[k + 1].tight and not (t.tight and k and items[k - 1].kind in ("name", "number")):
                k = group(items, k + 1)  # quoted code
                continue
            if t.text == "->":
                self.lambda_(items, k, scope)
            if t.kind == "macro" and t.text in ("@ccall", "@cfunction"):
                self.foreign_macro(t, items[k + 1 :])
            opening = k + 1
            if t.kind == "name" and opening < len(items) and items[opening].text == "{" and items[opening].tight:
                opening = group(items, opening)
            if opening < len(items) and items[opening].text == "." and items[opening].tight and opening + 1 < len(items) and items[opening + 1].text == "(" and items[opening + 1].tight:
                opening += 1
            called = opening < len(items) and items[opening].text == "(" and items[opening].kind == "mark" and items[opening].tight
            if t.kind == "name" and called:
                start = k
                while start >= 2 and items[start - 1].text == "." and items[start - 1].tight and items[start - 2].kind == "name" and items[start].tight:
                    start -= 2
                name = "".join(x.text for x in items[start : k + 1])
                kind = "direct" if start == k else "qualified"
                if start == k and k and items[k - 1].text == "." and items[k - 1].tight:
                    kind, name = "dynamic", "." + name
                self.call(items[start].start, caller, name, kind)
                if name == "ccall":
                    self.foreign_call(items[opening + 1 : group(items, opening) - 1], t)
            elif called and t.text in (")", "]") and t.kind == "mark" and items[opening].tight:
                self.call(items[opening].start, caller, self.source[self.starts[self.line(t.start) - 1] : t.end].strip(), "dynamic")
            elif t.kind == "operator" and t.text in INFIX and k and k + 1 < len(items) and (items[k - 1].kind in ("name", "number", "string", "char") or items[k - 1].text in (")", "]", "}", "'")):
                self.call(t.start, caller, t.text, "direct")
            if t.inner:
                self.calls_only(t.inner, scope, function)
            k += 1

    def calls_only(self, items: list, scope: list[str], function: Function | None) -> None:
        """Calls of interpolated code, whose references the string already gave."""
        before = len(self.facts["references"])
        self.scan(items, scope, set(), function)
        del self.facts["references"][before:]

    def call(self, at: int, caller: str | None, callee: str, kind: str) -> None:
        self.add("calls", at, language="julia", caller=caller, callee=callee, kind=kind)

    def lambda_(self, items: list, at: int, scope: list[str]) -> None:
        left = items[:at]
        if left and left[-1].text == ")":
            begin = at - 1
            depth = 0
            for b in range(at - 1, -1, -1):
                depth += items[b].text in (")", "]", "}")
                depth -= items[b].text in ("(", "[", "{")
                if not depth:
                    begin = b
                    break
            parameters = [p for p in split_at(split_at(items[begin + 1 : at - 1], ";")[0], ",") if p]
        else:
            begin, parameters = at - 1, [left[-1:]] if left else []
        right, depth = [], 0
        for t in items[at + 1 :]:
            depth += t.kind == "mark" and t.text in CLOSERS
            depth -= t.kind == "mark" and t.text in (")", "]", "}")
            if depth < 0 or (not depth and t.text == "," and t.kind == "mark"):
                break
            right.append(t)
        if begin >= 0 and right:
            end = max(t.end for t in flat_ends(right))
            self._functions.append(Function("<anonymous>", items[begin].start, end, parameters, [right], items[begin : at + 1], None, scope, None, False, right))

    def nested(self, block: Block, scope: list[str], function: Function | None) -> None:
        if block.word == "quote":
            return
        if block.word in ("function", "macro"):
            self.function([block], scope, None)
            return
        if block.word in ("module", "struct", "abstract", "primitive"):
            self.statements([[block]], scope, function, False)
            return
        for k, (word, header, body) in enumerate(block.parts):
            if word == "catch":
                binding = header[0].text if header and header[0].kind == "name" else None
                if not body:
                    self.add("behavior", block.start, rule="JULIA-EMPTY-CATCH", subject=None)
                elif binding is None or not any(t.kind == "name" and t.text == binding for s in body for t in flat(s)):
                    self.add("behavior", block.start, rule="JULIA-BROAD-CATCH", subject=binding)
            self.scan(header, scope, set(), function)
            self.statements(body, scope, function, False)

    def foreign_macro(self, macro: Token, items: list) -> None:
        if macro.text == "@cfunction":
            if items and items[0].text == "(":
                parts = split_at(items[1 : group(items, 0) - 1], ",")
                if len(parts) >= 3:
                    self.interop(macro, _text(parts[0]), "export", None, [_text(p) for p in split_at(_inside(parts[2]), ",") if p], _text(parts[1]))
            return
        library = None
        if len(items) > 2 and items[1].text == "." and items[0].kind == "name":
            library, items = items[0].text, items[2:]
        if len(items) > 1 and items[0].kind == "name" and items[1].text == "(":
            end = group(items, 1)
            kinds = [_text(split_at(p, "::")[-1]) for p in split_at(items[2 : end - 1], ",") if p]
            if end < len(items) and items[end].text == "::":
                self.interop(macro, items[0].text, "import", library, kinds, _text(_type(items[end + 1 :])))

    def foreign_call(self, items: list, at: Token) -> None:
        parts = split_at(items, ",")
        if len(parts) < 3:
            return
        target, library = parts[0], None
        if target and target[0].text == "(":
            inner = split_at(_inside(target), ",")
            target, library = inner[0], _text(inner[1]).strip('":') if len(inner) > 1 else None
        self.interop(at, _text(target).strip(':"'), "import", library, [_text(p) for p in split_at(_inside(parts[2]), ",") if p], _text(parts[1]))

    def interop(self, at: Token, symbol: str, direction: str, library: str | None, parameters: list[str], returns: str) -> None:
        from factloom.extract.abi import neutral

        self.add("interop", at.start, language="julia", symbol=symbol, direction=direction, library=library, calling_convention="c", parameter_types=[neutral(p) for p in parameters], return_types=[] if neutral(returns) == "void" else [neutral(returns)])

    def returns(self, made: Function) -> None:
        found: list[tuple[Token, int]] = []

        def look(statement: list) -> None:
            for k, t in enumerate(statement):
                if isinstance(t, Block):
                    if t.word not in ("function", "macro", "quote"):
                        for _, _, body in t.parts:
                            for s in body:
                                if not short_function(s):
                                    look(s)
                elif t.kind == "keyword" and t.text == "return":
                    n = arity(statement[k + 1 :])
                    if n:
                        found.append((t, n))

        for s in made.body:
            if made.block is None or not short_function(s):
                look(s)
        if made.body and not isinstance(made.body[-1][0], Block):
            last = made.body[-1]
            if last[0].text != "return" and not short_function(last) and not any(t.text in ASSIGN for t in split_at(last, "(")[0]):
                n = arity(last)
                if n:
                    found.append((last[0], n))
        for t, n in found:
            self.add("tuples", t.start, name=made.name, arity=n)

    def metrics(self) -> None:
        order = sorted(self._functions, key=lambda f: (f.start, -f.end))
        for f in order:
            start, end = self.line(f.start), self.line(max(f.start, f.end - 1))
            cyclomatic, cognitive = self.complexity(f)
            if f.block is not None:
                body_start, body_end = start + 1, end - 1
            else:
                body_start, body_end = start, end
            lines = [k for k in range(body_start, body_end + 1) if self._code_line(k)]
            self.facts["functions"].append({"path": self.path, "language": "julia", "name": f.name, "start_line": start, "end_line": end, "executable_lines": len(lines), "parameter_count": len(f.parameters), "cyclomatic": cyclomatic, "cognitive": cognitive, "documented": bool(f.doc)})
            if f.named and f.block is not None and f.block.word == "function":
                body = [t for s in f.body for t in flat(s)]
                self.facts["clones"].append({"path": self.path, "language": "julia", "name": f.name, "start_line": start, "end_line": end, "body": "\x1f".join(t.text for t in body), "token_count": len(body), "executable_lines": len(lines)})

    def _code_line(self, k: int) -> bool:
        end = self.starts[k] if k < len(self.starts) else len(self.source)
        return bool(self.source[self.starts[k - 1] : end].strip()) and k not in self.comment_lines

    def complexity(self, f: Function) -> tuple[int, int]:
        """Cyclomatic and cognitive complexity; nested named functions and lambdas count for themselves."""
        count = {"cyclomatic": 1, "cognitive": 0}
        inner = [(g.start, g.end) for g in self._functions if g is not f and f.start <= g.start and g.end <= f.end and (g.start, g.end) != (f.start, f.end)]
        own = lambda t: not any(a <= t.start < b for a, b in inner)
        last_name = f.name.lstrip("@")

        def walk(items: list, depth: int) -> None:
            logic = ""
            for k, t in enumerate(items):
                if not own(t):
                    continue
                if isinstance(t, Block):
                    if t.word in ("function", "macro", "quote"):
                        continue
                    for word, header, body in t.parts:
                        branch = word in ("if", "elseif", "for", "while", "catch")
                        count["cyclomatic"] += branch
                        count["cognitive"] += 1 + depth if word in ("if", "for", "while", "catch") else 1 if word in ("elseif", "else") else 0
                        walk(header, depth)
                        deeper = depth + (word not in ("begin", "let", "try", "finally", "do"))
                        for s in body:
                            walk(s, deeper)
                    continue
                if t.text in ("&&", "||"):
                    count["cyclomatic"] += 1
                    count["cognitive"] += t.text != logic
                    logic = t.text
                elif t.text == "?" and t.kind == "operator":
                    count["cyclomatic"] += 1
                    count["cognitive"] += 2 + depth
                elif t.kind == "generator":
                    count["cyclomatic"] += 1
                    count["cognitive"] += 1 + depth
                elif t.kind == "macro" and t.text == "@goto":
                    count["cyclomatic"] += 1
                    count["cognitive"] += 1
                elif t.kind == "name" and t.text == last_name and f.named and k + 1 < len(items) and items[k + 1].text == "(" and items[k + 1].tight:
                    count["cognitive"] += 1

        for s in f.body:
            walk(s, 0)
        return count["cyclomatic"], count["cognitive"]

    def closing(self) -> None:
        """A closing parenthesis stands on the line of the last token inside it."""
        stack: list[tuple[Token, Token | None]] = []
        for t in self.tokens:
            if t.kind == "newline":
                continue
            if t.text == ")" and t.kind == "mark" and stack:
                opening, last = stack.pop()
                if last is not None and self.line(t.start) != self.line(last.end - 1):
                    self.facts["parens"].append({"path": self.path, "line": self.line(t.start), "column": t.start - self.starts[self.line(t.start) - 1] + 1})
            if stack:
                stack[-1] = (stack[-1][0], t)
            if t.text == "(" and t.kind == "mark":
                stack.append((t, None))


def flat_ends(items: list) -> Iterator[Token | Block]:
    for t in items:
        yield t


def arity(items: list) -> int:
    """Elements of a tuple expression, 0 for anything else (named tuples as well)."""
    parts = split_at(items, ",")
    if len(parts) == 1 and items and items[0].text == "(" and group(items, 0) == len(items):
        inside = items[1:-1]
        if len(split_at(inside, ";")) > 1:
            return 0
        parts = split_at(inside, ",")
        if any(len(p) > 1 and p[1].text == "=" for p in parts):
            return 0
    return len([p for p in parts if p]) if len(parts) > 1 else 0


def _text(items: list) -> str:
    return "".join(t.text for t in items)


def _inside(items: list) -> list:
    return items[1 : group(items, 0) - 1] if items and items[0].text == "(" else items


def _type(items: list) -> list:
    end = 1
    if len(items) > 1 and items[1].text == "{":
        end = group(items, 1)
    return items[:end]
