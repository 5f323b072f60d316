"""State machines over the lines of one file: comments, strings, fences, tables, effective widths."""

from __future__ import annotations

import re

#: Line comment, block comment opening and closing.
MARKS = {"julia": ("#", "#=", "=#"), "odin": ("//", "/*", "*/")}
_FENCE = re.compile(r"^ {0,3}(?P<mark>```+|~~~+)(?P<info>.*)$")
_LINK = re.compile(r"\[[^\]]*\]\([^)]*\)|\[[^\]]*\]\[[^\]]*\]|\A[ \t]*\[[^\[\]]+\]:[ \t]*\S|<https?://[^>]+>|https?://\S+")
_RULE = re.compile(r":?-+:?")


def table_rule(line: str) -> bool:
    """Whether a line is the rule under a table's header: dashes in every cell."""
    cells = [c.strip() for c in line.strip().strip("|").split("|")]
    return all(map(_RULE.fullmatch, cells))


def comment_line(line: str, depth: int, marks: tuple[str, str, str]) -> tuple[bool, int]:
    """Whether the line holds nothing but comment, and the block depth behind it.

    Blocks nest.  A block is only recognised where no code came before it on the line; code makes the line
    no comment line and ends the scan.
    """
    single, opening, closing = marks
    at, seen = 0, depth > 0
    while at < len(line):
        if depth:
            o, c = line.find(opening, at), line.find(closing, at)
            if c < 0 and o < 0:
                return True, depth
            if o >= 0 and (c < 0 or o < c):
                depth, at = depth + 1, o + len(opening)
            else:
                depth, at = depth - 1, c + len(closing)
            continue
        if line[at].isspace():
            at += 1
        elif line.startswith(opening, at):
            depth, at, seen = depth + 1, at + len(opening), True
        elif line.startswith(single, at):
            return True, 0
        else:
            return False, 0
    return seen, depth


def code_states(language: str, lines: list[str]) -> list[bool]:
    """For each line, whether it is a comment line."""
    depth, out = 0, []
    for line in lines:
        found, depth = comment_line(line, depth, MARKS[language])
        out.append(found)
    return out


def markdown_exempt(lines: list[str]) -> list[bool]:
    """Lines in fences, with links, or of tables."""
    exempt, outside = [False] * len(lines), [True] * len(lines)
    fence = ""
    for k, line in enumerate(lines):
        m = _FENCE.match(line)
        if fence:
            exempt[k], outside[k] = True, False
            if m and m.group(1)[0] == fence[0] and len(m.group(1)) >= len(fence):
                fence = ""
        elif m:
            fence, exempt[k], outside[k] = m.group(1), True, False
        elif _LINK.search(line):
            exempt[k] = True
    row = lambda k: 0 <= k < len(lines) and outside[k] and "|" in lines[k] and bool(lines[k].strip())
    for k, line in enumerate(lines):
        if outside[k] and "-" in line and "|" in line and table_rule(line) and row(k - 1):
            exempt[k - 1] = exempt[k] = True
            below = k + 1
            while row(below):
                exempt[below] = True
                below += 1
    return exempt


def string_widths(language: str, lines: list[str]) -> list[int]:
    """Widths without the content of strings and without closing signs and blanks behind a string."""
    out, quote, escape_ok, trailing = [], "", True, False
    depth = 0
    _, opening, closing = MARKS[language]
    single = MARKS[language][0]
    for line in lines:
        width, at, n = 0, 0, len(line)
        if not quote:
            trailing = False
        while at < n:
            if quote:
                if escape_ok and line[at] == "\\":
                    at += 2
                elif line.startswith(quote, at):
                    width += len(quote)
                    at += len(quote)
                    quote, trailing = "", True
                else:
                    at += 1
                continue
            if depth:
                if line.startswith(closing, at):
                    depth, width, at = depth - 1, width + len(closing), at + len(closing)
                elif line.startswith(opening, at):
                    depth, width, at = depth + 1, width + len(opening), at + len(opening)
                else:
                    width, at = width + 1, at + 1
                continue
            if line.startswith(opening, at):
                depth, width, at, trailing = depth + 1, width + len(opening), at + len(opening), False
            elif line.startswith(single, at):
                width, at = width + n - at, n
            elif line.startswith('"""', at) and language == "julia":
                quote, escape_ok, width, at = '"""', True, width + 3, at + 3
            elif line[at] == '"' or (line[at] == "`" and language == "odin"):
                quote, escape_ok = line[at], line[at] == '"'
                width, at = width + 1, at + 1
            elif line[at] == "'" and (m := re.match(r"'(\\.[^']*|[^'\\])'", line[at:])):
                width, at = width + len(m.group(0)), at + len(m.group(0))
            else:
                if not (trailing and (line[at].isspace() or line[at] in ")]},;")):
                    trailing = False
                    width += 1
                at += 1
        if quote in ('"',):
            # a plain string does not run on
            quote = ""
        out.append(width)
    return out


def states(language: str, text: str) -> list[tuple[int, str, int, bool, bool, bool]]:
    """(line, content, effective width, exempt from width rules, blank, comment) of every line."""
    lines = text.split("\n")
    if language in MARKS:
        comments = code_states(language, lines)
        widths = string_widths(language, lines)
        exempt = comments
    else:
        comments = [False] * len(lines)
        widths = [len(x) for x in lines]
        exempt = markdown_exempt(lines) if language == "markdown" else comments
    return [(k + 1, x, w, e, not x.strip(), c) for k, (x, w, e, c) in enumerate(zip(lines, widths, exempt, comments))]
