"""Reading of one JSON record as a stream of tokens, into triples of path, ordinals and value.

Open objects and lists stand on a list of our own, not on the interpreter's stack, so a record may be
nested to any depth; nothing of a record is kept but its triples.
"""

from __future__ import annotations

import re
from json.decoder import scanstring

Triple = tuple[str, list[int], str, str | None]

_TOKEN = re.compile(
    r'[ \t\n\r]*(?:(?P<mark>[\[\]{},:])|"(?P<plain>[^"\\\x00-\x1f]*)"|(?P<quoted>")'
    r"|(?P<number>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|NaN|-?Infinity)|(?P<word>true|false|null))"
)
_ESCAPED = re.compile(r"[.\[\]\\]")
#: Byte order mark and white space around a text.
_AROUND = "﻿ \t\r\n"
#: Names kept for reuse in one process, if not longer than this; the cache is emptied when it holds so many.
_MOST_NAMES, _LONGEST_NAME = 100_000, 200
_names: dict[tuple[str, str], str] = {}


def below(path: str, key: str) -> str:
    """The path of a key of the object at ``path``; dots, brackets and backslashes of a key are escaped by a backslash."""
    name = _names.get((path, key))
    if name is None:
        own = _ESCAPED.sub(r"\\\g<0>", key)
        name = f"{path}.{own}" if path else own
        if len(name) <= _LONGEST_NAME:
            if len(_names) >= _MOST_NAMES:
                _names.clear()
            _names[path, key] = name
    return name


class Unreadable(ValueError):
    """The text is no JSON, or holds no object."""


def read(text: str, lists: frozenset[str] = frozenset(), wrappers: tuple[str, ...] = (), only: frozenset[str] | None = None) -> list[Triple]:
    """Path, ordinals, kind and value of every node of the record in a text, parents before children.

    A text that holds a JSON text as its string is read again; an object under one of ``wrappers``
    (or a string there, which is read again) is the record in place of the object around it. Objects
    and scalars that stand where one of ``lists`` belongs are its only element. Nulls give no triple, but
    keep their position. Of a repeated key the last value counts. ``only`` keeps some paths' triples.
    """
    inner: str | None = text
    while inner is not None:
        found, inner = _scan(inner.strip(_AROUND), lists, wrappers, only)
    return found


def _scan(text: str, lists: frozenset[str], wrappers: tuple[str, ...], only: frozenset[str] | None) -> tuple[list[Triple], str | None]:
    """The triples, and the text that must be read in their place if there is one."""
    out: list[Triple | None] = []
    inner: str | None = None
    match, at, end = _TOKEN.match, 0, len(text)
    # each open container: is it an object, its path, its ordinals, its elements so far or the places of its keys' triples, the key, where that began
    open_: list[list] = []
    base, closed = 1, False  # how many containers are open inside the record itself; whether it is over
    path, ordinals = "", []
    want = "value"  # or "first" (element or end), "key", "first key", "colon", "next" (comma or end)
    while True:
        token = match(text, at)
        if token is None:
            raise Unreadable(f"no JSON at {at}")
        at, group = token.end(), token.lastgroup
        value = token[group]
        if group == "quoted":
            try:
                value, at = scanstring(text, at, True)
            except ValueError as error:
                raise Unreadable(str(error)[:100]) from None
            group = "plain"
        if want == "colon":
            if value != ":" or group != "mark":
                raise Unreadable(f"no colon at {at}")
            want = "value"
            continue
        if want in ("key", "first key"):
            if group == "plain":
                frame = open_[-1]
                if value in frame[3]:
                    a, b = frame[3][value]
                    out[a:b] = [None] * (b - a)
                frame[4], frame[5] = value, len(out)
                path, ordinals, want = below(frame[1], value), frame[2], "colon"
                continue
            if value != "}" or want == "key":
                raise Unreadable(f"no key at {at}")
            want = "next"
        if group == "mark" and value in "]}," and want in ("next", "first"):
            frame = open_[-1]
            if value == ",":
                if want == "first":
                    raise Unreadable(f"no value at {at}")
                if frame[0]:
                    frame[3][frame[4]] = (frame[5], len(out))
                    want = "key"
                else:
                    frame[3] += 1
                    path, ordinals, want = frame[1] + "[]", [*frame[2], frame[3]], "value"
                continue
            if (value == "}") != frame[0]:
                raise Unreadable(f"wrong end at {at}")
            open_.pop()
            closed = closed or len(open_) < base
            want = "next"
            if not open_:
                break
            continue
        if want == "next":
            raise Unreadable(f"no comma at {at}")
        # a value at path and ordinals
        if not open_ and (group != "mark" or value != "{"):
            if group == "plain":
                inner = value
                break
            raise Unreadable("no object")
        if wrappers and not closed and inner is None and len(open_) == base and open_[-1][4] in wrappers and open_[-1][0]:
            if group == "plain":
                inner, want = value, "next"
                continue
            if value == "{" and group == "mark":
                out.clear()
                for frame in open_:
                    frame[3] = {}
                base, path, ordinals = len(open_) + 1, "", []
        live = not closed and inner is None
        want = "next"
        if group == "mark" and value == "[":
            open_.append([False, path, ordinals, 0, None, 0])
            path, ordinals, want = path + "[]", [*ordinals, 0], "first"
            continue
        if path in lists and value != "null":
            path, ordinals = path + "[]", [*ordinals, 0]
        if group == "mark":
            if value != "{":
                raise Unreadable(f"no value at {at}")
            if live and (only is None or path in only):
                out.append((path, ordinals, "object", None))
            open_.append([True, path, ordinals, {}, None, 0])
            want = "first key"
        elif live and value != "null" and (only is None or path in only):
            out.append((path, ordinals, "string" if group == "plain" else "number" if group == "number" else "boolean", value))
        elif live and value == "null" and group == "plain" and (only is None or path in only):
            out.append((path, ordinals, "string", value))
    if text[at:].strip(_AROUND):
        raise Unreadable(f"text after the record at {at}")
    return [x for x in out if x is not None], inner
