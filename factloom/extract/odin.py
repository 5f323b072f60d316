"""Facts of Odin files from a token reader with brace blocks; one pass over a file gives all facts."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""(?P<space>[ \t\r]+)|(?P<newline>\n)|(?P<line>//[^\n]*)|(?P<string>"(?:\\.|[^"\\\n])*"|`[^`]*`)|(?P<rune>'(?:\\.[^']*|[^'\\])')"""
    r"""|(?P<number>0[xbo][0-9a-fA-F_]+|\d[\d_]*(?:\.(?!\.)\d[\d_]*)?(?:[eE][+-]?\d+)?)|(?P<directive>\#\+[^\n]*|\#\w+)|(?P<name>[^\W\d]\w*)"""
    r"""|(?P<operator>:=|::|->|\.\.=|\.\.<|\.\.|&&=|\|\|=|&~=|<<=|>>=|&&|\|\||==|!=|<=|>=|<<|>>|\+=|-=|\*=|/=|%=|&=|\|=|~=|---|[-+*/%&|~^!<>=?.:@$])|(?P<mark>[()\[\]{},;])"""
)
WORDS = {"import", "package", "proc", "struct", "enum", "union", "bit_set", "bit_field", "if", "else", "for", "switch", "case", "when", "return", "defer", "using", "in", "not_in", "do", "foreign", "map", "dynamic", "cast", "transmute", "auto_cast", "distinct", "where", "break", "continue", "fallthrough", "or_else", "or_return", "or_break", "or_continue", "matrix"}
ADA = re.compile(r"^[A-Z][a-z0-9]*(?:_[A-Z][a-z0-9]*)*$")
CLOSERS = {"(": ")", "[": "]", "{": "}"}
GROWTH = {"append", "append_elem", "append_elems", "reserve", "resize"}


class SyntaxFault(ValueError):
    """The file is not well formed."""


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int
    pair: int = -1  # index of the matching bracket


def tokens(source: str) -> tuple[list[Token], list[tuple[int, int]]]:
    """Tokens with a newline token where one ends a line, and the spans of comments (blocks nest)."""
    out: list[Token] = []
    comments: list[tuple[int, int]] = []
    stack: list[int] = []
    at, n = 0, len(source)
    while at < n:
        if source.startswith("/*", at):
            depth, end = 1, at + 2
            while end < n and depth:
                if source.startswith("/*", end):
                    depth, end = depth + 1, end + 2
                elif source.startswith("*/", end):
                    depth, end = depth - 1, end + 2
                else:
                    end += 1
            if depth:
                raise SyntaxFault("a comment does not end")
            comments.append((at, end))
            at = end
            continue
        m = _TOKEN.match(source, at)
        if not m:
            raise SyntaxFault(f"unexpected {source[at]!r}")
        kind = m.lastgroup or ""
        if kind == "line":
            comments.append((at, m.end()))
        elif kind != "space":
            t = Token("word" if kind == "name" and m.group(0) in WORDS else kind, m.group(0), at, m.end())
            if kind == "mark" and t.text in CLOSERS:
                stack.append(len(out))
            elif kind == "mark" and t.text in ")]}":
                if not stack or CLOSERS[out[stack[-1]].text] != t.text:
                    raise SyntaxFault(f"unexpected {t.text}")
                t.pair = stack.pop()
                out[t.pair].pair = len(out)
            out.append(t)
        at = m.end()
    if stack:
        raise SyntaxFault(f"{out[stack[-1]].text} does not end")
    return out, comments


@dataclass
class Procedure:
    name: str
    start: int
    end: int
    body: tuple[int, int]  # token range inside the braces
    parameters: int
    returns: int
    allocators: set[str] = field(default_factory=set)
    cyclomatic: int = 1
    nested: bool = False


class File:
    """All facts of one file."""

    def __init__(self, path: str, source: str) -> None:
        self.path, self.source = path, source
        self.starts = [0] + [m.end() for m in re.finditer("\n", source)]
        self.facts: dict[str, list[dict]] = {k: [] for k in ("declarations", "imports", "references", "calls", "interop", "dependencies", "clones", "functions", "names", "globals", "allocations", "tuples", "docs", "parens")}
        self.structs = 0
        self.errors = 0
        self.package = ""
        self.procedures: list[Procedure] = []
        self.heap: set[str] = set()
        try:
            self.tokens, self.comments = tokens(source)
            self.closing()
            self.t = [k for k in self.tokens if k.kind != "newline"]
            for i, x in enumerate(self.t):
                x.pair = -1
            self._pair()
            self.declared: set[int] = set()
            self.silent: set[int] = set()  # names that are no expressions
            self.level(0, len(self.t), None)
            self.walk()
            self.finish()
        except (SyntaxFault, IndexError) as e:
            parens = self.facts["parens"]
            for rows in self.facts.values():
                if rows is not parens:
                    rows.clear()
            self.structs, self.errors, self.error = 0, 1, str(e)

    def _pair(self) -> None:
        stack: list[int] = []
        for i, x in enumerate(self.t):
            if x.kind == "mark" and x.text in CLOSERS:
                stack.append(i)
            elif x.kind == "mark" and x.text in ")]}":
                x.pair = stack.pop()
                self.t[x.pair].pair = i

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at)

    def add(self, fact: str, at: int, **row: object) -> None:
        line = self.line(at)
        self.facts[fact].append({"path": self.path, **row, "line": line, "column": len(self.source[self.starts[line - 1] : at].encode("utf-8")) + 1})

    def symbol(self, i: int, kind: str, owner: str | None) -> None:
        t = self.t[i]
        self.declared.add(i)
        if t.text == "_":
            return
        self.add("names", t.start, kind=kind, name=t.text)
        scope = owner or None
        self.add("declarations", t.start, language="odin", name=t.text, qualified_name=f"{scope}.{t.text}" if scope else t.text, kind=kind, scope=scope)

    def newline_before(self, i: int) -> bool:
        return i > 0 and "\n" in self.source[self.t[i - 1].end : self.t[i].start]

    def names_before(self, i: int, low: int) -> list[int]:
        """Indices of the comma-separated names that end before token i."""
        out, k = [], i - 1
        while k >= low and self.t[k].kind == "name":
            out.append(k)
            if k - 1 >= low and self.t[k - 1].text == "," and not (out and self.newline_before(k) and False):
                k -= 2
            else:
                break
        return out[::-1]

    def level(self, low: int, high: int, owner: str | None) -> None:
        """Declarations of a brace level (or the file) and of what is nested in it."""
        i = low
        while i < high:
            t = self.t[i]
            if t.text == "package" and owner is None:
                self.package = self.t[i + 1].text
                self.silent.add(i + 1)
                i += 2
            elif t.text == "import":
                i = self.import_(i)
            elif t.text == "::":
                i = self.constant(i, low, owner)
            elif t.text == ":=":
                for k in self.names_before(i, low):
                    self.symbol(k, "variable", owner)
                    if owner is None and self.t[k].text != "_":
                        self.add("globals", self.t[k].start, name=self.t[k].text)
                i += 1
            elif t.text == ":" and i > low and self.t[i - 1].kind == "name" and i + 1 < high and self.statement_start(self.names_before(i, low), low) and self.t[i + 1].text not in ("{",):
                for k in self.names_before(i, low):
                    self.symbol(k, "variable", owner)
                    if owner is None and self.t[k].text != "_":
                        self.add("globals", self.t[k].start, name=self.t[k].text)
                i += 1
            elif t.text == "proc" and i + 1 < high:
                i = self.procedure_literal(i, "", owner)
            else:
                i += 1

    def statement_start(self, names: list[int], low: int) -> bool:
        if not names:
            return False
        k = names[0]
        return k == low or self.newline_before(k) or self.t[k - 1].text in ("{", ";", "}", "for", "do", ")")

    def import_(self, i: int) -> int:
        k, alias = i + 1, None
        using = i > 0 and self.t[i - 1].text == "using"
        if self.t[k].kind == "name":
            alias, k = k, k + 1
        target = self.t[k].text.strip('"`')
        name = self.t[alias].text if alias else re.split(r"[/:]", target)[-1]
        self.add("dependencies", self.t[i].start, language="odin", target=target, kind="import")
        if alias:
            self.symbol(alias, "import", None)
            self.silent.add(alias)
        if not using and name != "_":
            self.add("imports", self.t[i].start, language="odin", target=target, name=name, kind="import")
        if target == "core:mem/heap" or target.endswith("mem/heap"):
            self.heap.add(name)
        return k + 1

    def constant(self, i: int, low: int, owner: str | None) -> int:
        names = self.names_before(i, low)
        if not names:
            return i + 1
        k = i + 1
        while self.t[k].kind == "directive" or self.t[k].text == "distinct":
            k += 1
        t = self.t[k]
        if t.text == "proc":
            for n in names:
                self.symbol(n, "procedure", owner)
            return self.procedure_literal(k, self.t[names[0]].text, owner, names)
        if t.text in ("struct", "enum", "union", "bit_set", "bit_field"):
            for n in names:
                self.symbol(n, "type", owner)
            self.structs += t.text == "struct"
            while k < len(self.t) and self.t[k].text != "{" and not (self.newline_before(k) and k > i + 2):
                k = self.t[k].pair + 1 if self.t[k].text in "([" and self.t[k].kind == "mark" else k + 1
            if k < len(self.t) and self.t[k].text == "{":
                self.fields(k + 1, self.t[k].pair, t.text, self.t[names[0]].text)
                return self.t[k].pair + 1
            return k
        forward = t.kind == "name" and self.t[k + 1].text == "." if k + 1 < len(self.t) else False
        last = self.t[k]
        j = k
        while j + 2 < len(self.t) and self.t[j + 1].text == "." and self.t[j + 2].kind == "name":
            j += 2
        last = self.t[j]
        for n in names:
            is_type = bool(ADA.match(last.text)) and (forward or t.kind == "name") and not last.text.isupper()
            self.symbol(n, "type" if is_type else "constant", owner)
        return i + 1

    def fields(self, low: int, high: int, kind: str, owner: str) -> None:
        i, start = low, True
        while i < high:
            t = self.t[i]
            if t.text in CLOSERS and t.kind == "mark":
                if kind == "struct" and t.text == "{" and i > low and self.t[i - 1].text in ("struct", "enum", "union"):
                    self.fields(i + 1, t.pair, self.t[i - 1].text, owner)
                i, start = t.pair + 1, False
                continue
            if t.text == ",":
                start = True
            elif start and t.kind == "name":
                if kind == "struct":
                    j = i
                    while j < high and self.t[j].kind == "name" and self.t[j + 1].text == ",":
                        j += 2
                    if self.t[j + 1].text == ":":
                        for n in range(i, j + 1, 2):
                            self.symbol(n, "field", owner)
                        i = j + 1
                elif kind == "enum":
                    self.symbol(i, "enum_value", owner)
                start = False
            i += 1

    def procedure_literal(self, i: int, name: str, owner: str | None, names: list[int] | None = None) -> int:
        """A procedure type or literal at ``proc``; returns where the surrounding level goes on."""
        k = i + 1
        convention = "odin"
        if self.t[k].kind == "string":
            convention, k = self.t[k].text.strip('"'), k + 1
        if self.t[k].text != "(":
            if self.t[k].text == "{":
                return self.t[k].pair + 1  # a group of procedures
            return i + 1
        opening, closing = k, self.t[k].pair
        scope = name or owner
        types: list[str] = []
        parameters = self.parameters(opening + 1, closing, scope, bool(name), types)
        k = closing + 1
        returns: list[str] = []
        if k < len(self.t) and self.t[k].text == "->":
            k += 1
            if self.t[k].text == "!":
                k += 1
            elif self.t[k].text == "(":
                self.parameters(k + 1, self.t[k].pair, scope, False, returns)
                k = self.t[k].pair + 1
            else:
                start = k
                while k < len(self.t) and self.t[k].text not in ("{", ";", ",", ")", "}", "---", "where") and not (k > start and self.newline_before(k)):
                    k = self.t[k].pair + 1 if self.t[k].text in "([" and self.t[k].kind == "mark" else k + 1
                returns.append(self.text(start, k))
        while k < len(self.t) and (self.t[k].kind == "directive" or self.t[k].text == "where"):
            if self.t[k].text == "where":
                while self.t[k].text != "{":
                    k += 1
            else:
                k += 1
        bodyless = k >= len(self.t) or self.t[k].text != "{"
        if names:
            for n in names:
                self.foreign(n, convention, types, returns, bodyless)
        if bodyless:
            return k + (k < len(self.t) and self.t[k].text == "---")
        end = self.t[k].pair
        if names:
            top = owner is None
            for n in names:
                p = Procedure(self.t[n].text, self.t[n].start, self.t[end].end, (k + 1, end), parameters, len(returns), nested=not top)
                p.allocators = {self.t[j].text for j in range(opening + 1, closing) if self.t[j].kind == "name" and j in self.declared and "Allocator" in self.text(j, closing).split(",")[0]}
                self.procedures.append(p)
                self.facts["docs"].append({"path": self.path, "name": p.name, "doc": self.doc_before(n), "line": self.line(p.start), "top": top})
        self.level(k + 1, end, scope)
        return end + 1

    def doc_before(self, n: int) -> str | None:
        """The comments that end on the line above a declaration (attributes in between don't count)."""
        at = n
        while at > 0 and self.t[at - 1].text == ")" and self.t[at - 1].pair > 0 and self.t[self.t[at - 1].pair - 1].text == "@":
            at = self.t[at - 1].pair - 1
        line = self.line(self.t[at].start)
        out: list[str] = []
        for a, b in reversed(self.comments):
            if b <= self.t[at].start and self.line(max(a, b - 1)) == line - 1 and not self.source[self.starts[self.line(a) - 1] : a].strip():
                out.append(self.source[a:b])
                line = self.line(a)
        return "\n".join(reversed(out)) or None

    def text(self, low: int, high: int) -> str:
        return self.source[self.t[low].start : self.t[high - 1].end] if high > low else ""

    def parameters(self, low: int, high: int, owner: str | None, declare: bool, types: list[str]) -> int:
        count, i = 0, low
        while i < high:
            begin, names = i, []
            while i < high:
                while i < high and (self.t[i].text in ("using", "$") or self.t[i].kind == "directive"):
                    i += 1
                if i < high and self.t[i].kind == "name" and i + 1 < high and self.t[i + 1].text == ",":
                    names.append(i)
                    i += 2
                    continue
                break
            if i < high and self.t[i].kind == "name" and i + 1 < high and self.t[i + 1].text in (":", ":="):
                names.append(i)
                default = self.t[i + 1].text == ":="
                i += 2
            else:
                default, i, names = False, begin, []
            start = i
            while i < high and self.t[i].text != ",":
                i = self.t[i].pair + 1 if self.t[i].kind == "mark" and self.t[i].text in CLOSERS else i + 1
            stop = next((j for j in range(start, i) if self.t[j].text == "="), i)
            kind = "" if default else self.text(start, stop)
            for n in names:
                if declare:
                    self.symbol(n, "parameter", owner)
            count += max(1, len(names)) if start < i or names else 0
            types += [kind] * (max(1, len(names)) if start < i or names else 0)
            i += 1
        return count

    def foreign(self, n: int, convention: str, types: list[str], returns: list[str], bodyless: bool) -> None:
        attributes = self.attributes(n)
        export = bool(re.search(r"\bexport\b", attributes))
        if not bodyless and not export:
            return
        m = re.search(r'link_name\s*=\s*"([^"]*)"', attributes)
        clean = lambda t: re.sub(r"\s+", "", t).replace("rawptr", "^void")
        self.add("interop", self.t[n].start, language="odin", symbol=m.group(1) if m else self.t[n].text, direction="export" if export else "import", library=None, calling_convention=convention, parameter_types=[clean(t) for t in types], return_types=[clean(t) for t in returns])

    def attributes(self, n: int) -> str:
        k = n
        while k > 0 and self.t[k - 1].text == "," and self.t[k - 2].kind == "name":
            k -= 2
        out, at = "", k
        while at > 0:
            if self.t[at - 1].text == ")" and self.t[at - 1].pair > 0 and self.t[self.t[at - 1].pair - 1].text == "@":
                begin = self.t[at - 1].pair - 1
            elif at > 1 and self.t[at - 1].kind == "name" and self.t[at - 2].text == "@":
                begin = at - 2
            else:
                break
            out, at = self.text(begin, at) + " " + out, begin
        return out

    def containing(self, at: int) -> Procedure | None:
        """The narrowest procedure that holds a position; the first of equal ones."""
        held = [p for p in self.procedures if p.start <= at <= p.end]
        return min(held, key=lambda p: p.end - p.start, default=None)

    def walk(self) -> None:
        """References, calls, decisions and allocations."""
        for i, t in enumerate(self.t):
            if t.kind == "name" and t.text != "_" and i not in self.silent:
                p = self.containing(t.start)
                self.add("references", t.start, language="odin", name=t.text, scope=p.name if p else None)
            if t.text in ("if", "for", "case", "when") and t.kind == "word":
                p = self.containing(t.start)
                if p and t.text != "when" and not (t.text == "case" and self.t[i + 1].text == ":" and False):
                    p.cyclomatic += 1
            if t.text == "(" and t.kind == "mark" and i and not self.newline_before(i):
                self.call(i)

    def call(self, i: int) -> None:
        before = self.t[i - 1]
        if before.kind == "name":
            start = i - 1
            while start >= 2 and self.t[start - 1].text == "." and (self.t[start - 2].kind == "name"):
                start -= 2
            if start and (self.t[start - 1].text in ("proc", "@") or self.t[start - 1].kind == "directive"):
                return
            kind = "direct" if start == i - 1 else "qualified"
            if start and self.t[start - 1].text == ".":
                kind = "dynamic"
            name = "".join(x.text for x in self.t[start:i])
        elif before.text in (")", "]") and before.kind == "mark" and self.t[before.pair - 1].kind != "directive" and before.pair > 0 and self.t[before.pair - 1].text not in ("proc", "cast", "transmute", "@", "map", "[") and self.t[before.pair - 1].kind in ("name", "mark"):
            if before.text == "]" and self.t[before.pair - 1].kind != "name":
                return
            name, kind, start = self.text(before.pair, i), "dynamic", before.pair
        else:
            return
        p = self.containing(self.t[start].start)
        self.add("calls", self.t[start].start, language="odin", caller=p.name if p else None, callee=name, kind=kind)
        self.allocation(i, start, name, p)

    def arguments(self, i: int) -> list[tuple[int, int]]:
        out, start, k, end = [], i + 1, i + 1, self.t[i].pair
        while k < end:
            if self.t[k].text == "," and self.t[k].kind == "mark":
                out.append((start, k))
                start = k + 1
            k = self.t[k].pair + 1 if self.t[k].kind == "mark" and self.t[k].text in CLOSERS else k + 1
        return [*out, (start, end)] if start < end else out

    def allocation(self, i: int, start: int, name: str, p: Procedure | None) -> None:
        last = name.rpartition(".")[2]
        arguments = self.arguments(i)
        first = self.text(*arguments[0]).lstrip("&") if arguments else None
        row = {"operation": last, "procedure": p.name if p else None, "allocation_target": first, "allocator_source": None, "certainty": "definite"}
        if last == "arena_init_static":
            self.add("allocations", self.t[start].start, rule_id="ODIN-ALLOCATION-ARENA", **row)
        elif last in GROWTH and "." not in name:
            self.add("allocations", self.t[start].start, rule_id="ODIN-ALLOCATION-DYNAMIC-GROWTH", **{**row, "certainty": "potential"})
        elif last in ("make", "new") and "." not in name:
            source = None
            for k, (a, b) in enumerate(arguments):
                text = self.text(a, b)
                named = re.match(r"allocator\s*=\s*(.*)", text, re.S)
                if named:
                    source = named.group(1).strip()
                elif k and (re.search(r"allocator", text, re.I) or (p and text in p.allocators)):
                    source = text
            rule = self.allocator_rule(source, p)
            self.add("allocations", self.t[start].start, rule_id=rule, **{**row, "allocator_source": source})

    def allocator_rule(self, source: str | None, p: Procedure | None) -> str:
        if source is None:
            kind = "IMPLICIT"
        elif source == "context.temp_allocator":
            kind = "TEMPORARY"
        elif any(source.startswith(h + ".") for h in self.heap):
            kind = "HEAP"
        elif p and source in p.allocators:
            kind = "CUSTOM"
        else:
            kind = "UNKNOWN"  # context.allocator as well: configuration names it
        return f"ODIN-ALLOCATION-{kind}"

    def finish(self) -> None:
        lines = self.source.split("\n")
        code = set()
        for t in self.t:
            code |= {self.line(t.start), self.line(t.end - 1)}
        for p in self.procedures:
            start, end = self.line(p.start), self.line(p.end - 1)
            executable = 1 if start == end else sum(1 for k in range(start + 1, end) if lines[k - 1].strip() and k in code)
            self.facts["functions"].append({"path": self.path, "language": "odin", "name": p.name, "start_line": start, "end_line": end, "executable_lines": executable, "parameter_count": p.parameters, "cyclomatic": p.cyclomatic, "cognitive": None, "documented": any(d["name"] == p.name and d["doc"] for d in self.facts["docs"])})
            body = self.t[p.body[0] : p.body[1]]
            self.facts["clones"].append({"path": self.path, "language": "odin", "name": p.name, "start_line": start, "end_line": end, "body": "\x1f".join(t.text for t in body), "token_count": len(body), "executable_lines": max(0, end - start - 1)})
            if p.returns:
                self.add("tuples", p.start, name=p.name, arity=p.returns)

    def closing(self) -> None:
        stack: list[tuple[Token, Token | None]] = []
        for t in self.tokens:
            if t.kind == "newline":
                continue
            if t.text == ")" and stack:
                _, last = stack.pop()
                if last is not None and self.line(t.start) != self.line(last.end - 1):
                    self.facts["parens"].append({"path": self.path, "line": self.line(t.start), "column": t.start - self.starts[self.line(t.start) - 1] + 1})
            if stack:
                stack[-1] = (stack[-1][0], t)
            if t.text == "(":
                stack.append((t, None))
