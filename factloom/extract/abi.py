"""Neutral names of foreign-call types, for extractors; the same table as the column function."""

from __future__ import annotations

from factloom.functions.scalars import ABI_TYPES


def neutral(text: str) -> str:
    name = text.replace(" ", "")
    if name.startswith("Ptr{") and name.endswith("}"):
        return "^" + ABI_TYPES.get(name[4:-1], name[4:-1])
    return ABI_TYPES.get(name, name)
