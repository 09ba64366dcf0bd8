"""XML without namespaces: names, children and attributes by local name."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree


def parse(raw: bytes | None):
    """Root element; nothing for a missing or malformed part."""
    try:
        return ElementTree.fromstring(raw) if raw else None
    except ElementTree.ParseError:
        return None


def name(el) -> str:
    return el.tag.rpartition("}")[2] if isinstance(el.tag, str) else ""


def attr(el, key: str, default: str | None = None) -> str | None:
    if el is None:
        return default
    return next((v for k, v in el.attrib.items() if k.rpartition("}")[2] == key), default)


def kids(el, *names: str) -> list:
    return [c for c in el if not names or name(c) in names] if el is not None else []


def down(el, *path: str):
    """The first child by each name in turn; nothing where one is missing."""
    for step in path:
        el = next(iter(kids(el, step)), None)
        if el is None:
            return None
    return el


def every(el, *names: str) -> Iterator:
    return (x for x in el.iter() if name(x) in names) if el is not None else iter(())


def first_text(el, *names: str) -> str | None:
    """Text of the first element by the first of the names that has any."""
    return next((" ".join(x.text.split()) for n in names for x in every(el, n) if x.text and x.text.strip()), None)


def number(value: str | None, default: int = 0) -> int:
    return int(value) if (value or "").isdigit() else default
