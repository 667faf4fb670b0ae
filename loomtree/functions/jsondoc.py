"""Reading one JSON text of any depth."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
_WORDS = {"true": True, "false": False, "null": None}


def loads(text: str):
    """The value of a JSON text; ValueError if it is broken. Nesting is limited by memory only."""
    try:
        return json.loads(text)
    except RecursionError:
        return _loads_deep(text)


def _scalar(text: str, at: int):
    if text[at : at + 1] == '"':
        return scanstring(text, at + 1)
    for word, value in _WORDS.items():
        if text.startswith(word, at):
            return value, at + len(word)
    m = _NUMBER.match(text, at)
    if not m:
        raise ValueError(f"no JSON value at {at}")
    return json.loads(m.group()), m.end()


def _loads_deep(text: str):
    """The same grammar with an explicit stack, for texts nested deeper than the C scanner's recursion limit."""
    skip = lambda i: _SPACE.match(text, i).end()
    stack: list[tuple[object, str | None]] = []  # open containers with the key their next value takes
    at = skip(0)
    while True:
        char = text[at : at + 1]
        if char in ("{", "["):
            value: object = {} if char == "{" else []
            at = skip(at + 1)
            closing = "}" if char == "{" else "]"
            if text[at : at + 1] != closing:
                key = None
                if char == "{":
                    key, at = _key(text, at, skip)
                stack.append((value, key))
                continue
            at += 1
        else:
            value, at = _scalar(text, at)
        while True:  # the value is complete: hand it to what encloses it
            at = skip(at)
            if not stack:
                if at != len(text):
                    raise ValueError(f"extra data at {at}")
                return value
            outer, key = stack.pop()
            if isinstance(outer, dict):
                outer[key] = value
            else:
                outer.append(value)
            end = "}" if isinstance(outer, dict) else "]"
            char = text[at : at + 1]
            if char == ",":
                at = skip(at + 1)
                key = None
                if isinstance(outer, dict):
                    key, at = _key(text, at, skip)
                stack.append((outer, key))
                break
            if char != end:
                raise ValueError(f"expected , or {end} at {at}")
            value, at = outer, at + 1


def _key(text: str, at: int, skip):
    if text[at : at + 1] != '"':
        raise ValueError(f"expected a key at {at}")
    key, at = scanstring(text, at + 1)
    at = skip(at)
    if text[at : at + 1] != ":":
        raise ValueError(f"expected : at {at}")
    return key, skip(at + 1)
