"""Facts of Markdown files: headings, fences, links and images."""

from __future__ import annotations

import re

_FENCE = re.compile(r"^ {0,3}(?P<mark>```+|~~~+)(?P<info>.*)$")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_LINK = re.compile(r"(!?)\[((?:[^\[\]]|\[[^\]]*\])*)\]\(\s*<?([^)\s>]*)>?(?:\s+[\"'(][^)]*)?\)")
_DEFINITION = re.compile(r"^ {0,3}\[([^\]]+)\]:\s*<?(\S+?)>?(?:\s|$)")
_REFERENCE = re.compile(r"(!?)\[((?:[^\[\]]|\[[^\]]*\])+)\]\[([^\]]*)\]")
_SCHEME = re.compile(r"[a-z][a-z\d+.-]*:", re.IGNORECASE)


def is_relative(destination: str) -> bool:
    """A destination below the document: no anchor, root, host or scheme."""
    return bool(destination) and not destination.startswith(("#", "/")) and not _SCHEME.match(destination)


class File:
    """Headings ``(line, level)``, fences without a language, and links in order."""

    def __init__(self, path: str, source: str) -> None:
        self.path = path
        self.headings: list[dict] = []
        self.fences: list[dict] = []
        self.links: list[dict] = []
        self._fence_languages(source)
        lines = source.split("\n")
        fence, paragraph = "", False
        definitions: dict[str, str] = {}
        outside: list[tuple[int, str]] = []
        for k, line in enumerate(lines):
            bare = re.sub(r"^(?: {0,3}> ?)+", "", line)
            m = _FENCE.match(bare)
            if fence:
                if m and m.group(1)[0] == fence[0] and len(m.group(1)) >= len(fence):
                    fence = ""
                paragraph = False
                continue
            if m:
                fence, paragraph = m.group(1), False
                continue
            outside.append((k + 1, bare))
            if d := _DEFINITION.match(bare):
                definitions[d.group(1).lower()] = d.group(2)
            if h := _ATX.match(bare):
                self._heading(k + 1, len(h.group(1)))
                paragraph = False
            elif paragraph and (h := _SETEXT.match(bare)):
                self._heading(k, 1 if h.group(1)[0] == "=" else 2)
                paragraph = False
            else:
                paragraph = bool(bare.strip()) and not bare.startswith("    ")
        for n, line in outside:
            text = re.sub(r"(`+).*?\1", lambda m: " " * len(m.group(0)), line)
            found = [(m.start(), m.group(1), m.group(2), m.group(3)) for m in _LINK.finditer(text)]
            found += [(m.start(2) + i.start(), "!", i.group(2), i.group(3)) for m in _LINK.finditer(text) for i in _LINK.finditer(m.group(2)) if i.group(1)]
            found += [(m.start(), m.group(1), m.group(2), definitions.get((m.group(3) or m.group(2)).lower(), "")) for m in _REFERENCE.finditer(text)]
            for at, image, label, destination in sorted(found):
                self.links.append({"path": path, "line": n, "column": at + 1, "image": bool(image), "label": label, "destination": destination, "target": re.split(r"[?#]", destination)[0], "relative": is_relative(destination)})

    def _heading(self, line: int, level: int) -> None:
        self.headings.append({"path": self.path, "line": line, "level": level, "ord": len(self.headings) + 1})

    def _fence_languages(self, source: str) -> None:
        """Opening fences with a blank info string; here only a fence with nothing behind it closes."""
        fence = ""
        for k, line in enumerate(source.split("\n")):
            m = _FENCE.match(line)
            if not m:
                continue
            if fence:
                if m.group(1)[0] == fence[0] and len(m.group(1)) >= len(fence) and not m.group(2).strip():
                    fence = ""
            else:
                fence = m.group(1)
                if not m.group(2).strip():
                    self.fences.append({"path": self.path, "line": k + 1, "column": line.index(fence[0]) + 1})
