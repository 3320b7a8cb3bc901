"""L4: complete objects in truncated or broken JSON text.

A scan from an opening brace reads the text once, token by token, with a stack of the
open brackets.  Each object that closes leaves its span and whether it carries a sku or
a name; when the text breaks (a token that can't stand there, or the end), the spans
found so far stay.  Braces that the scan met as structure are settled by it: an object
is complete or not whatever encloses it.  Only braces it saw inside strings are scanned
on their own, because the enclosing text may be what is broken.  Of all spans, the
outermost ones with a sku or a name are the result.  Nesting of any depth costs one
stack entry a level, not a call.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

NAMED_BY = ("sku_selecionado", "nome_produto")

_BLANK = re.compile(r"[ \t\n\r]*+")
_TOKEN = re.compile(
    r'(?P<string>"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+")'
    r"|(?P<number>-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?)"
    r"|(?P<word>true|false|null|NaN|-?Infinity)"
    r"|(?P<mark>[{}\[\]:,])")

# what may come next inside an object or a list
_KEY_OR_END, _KEY, _COLON, _VALUE, _VALUE_OR_END, _MORE_OR_END = range(6)


class _Open:
    """A bracket that is not closed yet."""
    __slots__ = ("start", "is_object", "wants", "key", "named", "filled")

    def __init__(self, start: int, is_object: bool):
        self.start, self.is_object = start, is_object
        self.wants = _KEY_OR_END if is_object else _VALUE_OR_END
        self.key, self.named, self.filled = "", dict.fromkeys(NAMED_BY, False), False

    def take(self, truthy: bool) -> None:
        """A value is complete; of equal keys the last one counts."""
        self.filled, self.wants = True, _MORE_OR_END
        if self.is_object and self.key in self.named:
            self.named[self.key] = truthy


def _is_truthy(kind: str, token: str) -> bool:
    if kind == "string":
        return len(token) > 2
    if kind == "number":
        return float(token) != 0
    return token not in ("false", "null")


def scan(text: str, at: int) -> tuple[list[tuple[int, int, bool]], int]:
    """(start, end, named?) of every object that closes, and where the scan that begins at the brace ``at`` ended."""
    spans, stack = [], []
    while True:
        at = _BLANK.match(text, at).end()
        token = _TOKEN.match(text, at)
        if token is None:
            return spans, at
        kind, value, top = token.lastgroup, token.group(), stack[-1] if stack else None
        wants = top.wants if top else _VALUE
        if value in ("{", "["):
            if wants not in (_VALUE, _VALUE_OR_END):
                return spans, at
            stack.append(_Open(at, value == "{"))
        elif value in ("}", "]"):
            ends = wants in (_KEY_OR_END, _VALUE_OR_END, _MORE_OR_END)
            if not ends or top.is_object != (value == "}"):
                return spans, at
            stack.pop()
            if top.is_object:
                spans.append((top.start, token.end(), any(top.named.values())))
            if not stack:
                return spans, token.end()
            stack[-1].take(top.filled)
        elif value == ",":
            if wants != _MORE_OR_END:
                return spans, at
            top.wants = _KEY if top.is_object else _VALUE
        elif value == ":":
            if wants != _COLON:
                return spans, at
            top.wants = _VALUE
        elif wants in (_KEY, _KEY_OR_END) and kind == "string":
            top.key, top.wants = value[1:-1], _COLON
        elif wants in (_VALUE, _VALUE_OR_END):
            top.take(_is_truthy(kind, value))
        else:
            return spans, at
        at = token.end()


def _structural(text: str, begin: int, end: int) -> Iterable[int]:
    """Braces between ``begin`` and ``end`` that stand outside strings, as the scan from ``begin`` saw them."""
    at = begin
    while at < end:
        token = _TOKEN.match(text, at)
        if token is None:
            at += 1
            continue
        if token.group() == "{":
            yield at
        at = token.end()


def complete_objects(text: str) -> list[str]:
    """Outermost complete objects with a sku or a name, in text order."""
    ends: dict[int, int] = {}     # brace: end of its named object, or 0
    for brace in re.finditer(r"\{", text):
        if brace.start() not in ends:
            spans, end = scan(text, brace.start())
            ends.update(dict.fromkeys(_structural(text, brace.start(), end), 0))
            ends.update((start, stop if named else 0) for start, stop, named in spans)
    out, upto = [], 0
    for start in sorted(s for s, end in ends.items() if end):
        if start >= upto:
            upto = ends[start]
            out.append(text[start:upto])
    return out
