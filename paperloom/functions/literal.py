"""Python literals as JSON text, as a Column function.

A tokenizer with a stack reads dicts, lists, tuples, sets, strings of any quotes and prefixes with their escapes, numbers and names, nested to any depth, in one pass over each
text. Lists, tuples and sets become arrays (of equal members of a set the first stays), bytes become text, keys become strings as JSON writes them.

Defined cases: what is no literal is null, and so is what JSON cannot hold (complex numbers, infinities, keys that are containers).
"""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_SPACE = re.compile(r"(?:[ \t\n\r\f]|\\\r?\n|#[^\n]*)*+")
_STRING = re.compile(r"(?i)([ub]|r|br|rb)?('''|\"\"\"|'|\")")
_NUMBER = re.compile(r"(?i)[+-]?[ \t]*(?:0x(?:_?[0-9a-f])+|0o(?:_?[0-7])+|0b(?:_?[01])+|(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:e[+-]?\d(?:_?\d)*)?)(?![\w.])")
_WORD = re.compile(r"(None|True|False|set[ \t]*\([ \t]*\))(?!\w)")
_ESCAPE = re.compile(r"\\(?:\r?\n|[0-7]{1,3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|N\{[^}]*\}|.)", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "\\": "\\", "'": "'", '"': '"'}
_CLOSING = {"[": "]", "(": ")", "{": "}"}


class _Wrong(Exception):
    pass


def _escaped(m: re.Match[str], of_bytes: bool) -> str:
    body = m[0][1:]
    if body[0] in "\r\n":
        return ""
    if body[0] in "01234567":
        code = int(body, 8)
        return chr(code & 0xFF if of_bytes else code)
    if body[0] == "x":
        if len(body) < 3:
            raise _Wrong
        return chr(int(body[1:], 16))
    if body[0] in "uUN" and not of_bytes:
        if len(body) == 1:
            raise _Wrong
        try:
            return unicodedata.lookup(body[2:-1]) if body[0] == "N" else chr(int(body[1:], 16))
        except (KeyError, ValueError, OverflowError):
            raise _Wrong from None
    return _PLAIN.get(body, m[0])


def _string(text: str, at: int, head: re.Match[str]) -> tuple[str, int, bool]:
    """The string that begins here, where it ends, and whether it is of bytes."""
    prefix, quote = (head[1] or "").lower(), head[2]
    end = re.compile(rf"(?:[^\\{quote[0]}]|\\.|{quote[0]}(?!{quote[0] * 2}))*+{quote}" if len(quote) == 3 else rf"(?:[^\\{quote}\n]|\\.)*+{quote}", re.S).match(text, head.end())
    if not end:
        raise _Wrong
    body = end[0][: -len(quote)]
    if "b" in prefix and not body.isascii():
        raise _Wrong
    return (body if "r" in prefix else _ESCAPE.sub(lambda m: _escaped(m, "b" in prefix), body)), end.end(), "b" in prefix


def _number(text: str) -> str:
    text = text.replace(" ", "").replace("\t", "").replace("_", "")
    sign, digits = (text[0], text[1:]) if text[0] in "+-" else ("", text)
    sign = "-" if sign == "-" else ""
    if digits[:2].lower() in ("0x", "0o", "0b"):
        return sign + str(int(digits, 0)) if int(digits, 0) else "0"
    if digits.isdigit():
        if digits[0] == "0" and digits.strip("0"):
            raise _Wrong
        digits = digits.lstrip("0") or "0"
        return digits if digits == "0" else sign + digits
    value = float(sign + digits)
    if value in (float("inf"), float("-inf")):
        raise _Wrong
    return repr(value)


_Value = tuple[str, str, object]  # JSON, JSON as a key ("" if it can be none), and what Python compares it by


def _atom(text: str, at: int) -> tuple[_Value, int]:
    """The string, number or name here, and where it ends."""
    if head := _STRING.match(text, at):
        whole, kind = [], None
        while head:
            part, at, of_bytes = _string(text, at, head)
            if kind not in (None, of_bytes):
                raise _Wrong
            whole, kind = [*whole, part], of_bytes
            following = _SPACE.match(text, at).end()
            head = _STRING.match(text, following)
            at = following if head else at
        out = json.dumps("".join(whole), ensure_ascii=False)
        return (out, out, (kind, out)), at
    if m := _WORD.match(text, at):
        out, value = {"None": ("null", None), "True": ("true", 1), "False": ("false", 0)}.get(m[1], ("[]", ("[]",)))
        return (out, "" if out == "[]" else f'"{out}"', value), m.end()
    if m := _NUMBER.match(text, at):
        out = _number(m[0])
        return (out, f'"{out}"', float(out) if "." in out or "e" in out else int(out)), m.end()
    raise _Wrong


class _Open:
    """An open container. kind: list, (, {, dict or set; key: the one that waits for its value."""

    def __init__(self, bracket: str, kind: str):
        self.bracket, self.kind, self.closing = bracket, kind, _CLOSING.get(bracket, "")
        self.items: list[_Value] = []
        self.keys: list[_Value] = []
        self.commas, self.key = 0, None

    def closed(self) -> _Value:
        if self.kind in ("dict", "{"):
            out: dict[object, list[str]] = {}
            for key, item in zip(self.keys, self.items, strict=True):
                out.setdefault(key[2], [key[1], ""])[1] = item[0]  # as in Python, the first key and the last value of equal ones
            text = "{" + ", ".join(f"{k}: {v}" for k, v in out.values()) + "}"
        elif self.kind == "(" and len(self.items) == 1 and not self.commas:
            return self.items[0]
        else:
            items: dict[object, str] = {}
            for place, item in enumerate(self.items):
                items.setdefault(item[2] if self.kind == "set" else place, item[0])
            text = "[" + ", ".join(items.values()) + "]"
        return text, "", (text,)


def to_json(source: str) -> str | None:
    """The JSON text of a Python literal; of one that is no dict, {"_value": ...}."""
    text, at = source.strip(), 0
    stack = [_Open("", "(")]
    ready: _Value | None = None  # a value that ends here
    if "\0" in text:
        return None
    try:
        while True:
            at = _SPACE.match(text, at).end()
            frame, c = stack[-1], text[at : at + 1]
            if ready is not None:
                if c == ":" and frame.kind in ("{", "dict") and frame.key is None:
                    if not ready[1]:
                        return None
                    frame.kind, frame.key, ready, at = "dict", ready, None, at + 1
                    continue
                if frame.kind == "{":
                    frame.kind = "set"
                if frame.kind == "dict":
                    if frame.key is None:
                        return None
                    frame.keys.append(frame.key)
                    frame.key = None
                frame.items.append(ready)
                ready = None
                if c == ",":
                    frame.commas, at = frame.commas + 1, at + 1
                    continue
                if c != frame.closing:
                    return None
            if c == frame.closing and frame.key is None:
                if len(stack) == 1:
                    if not frame.items or at < len(text):
                        return None
                    value = frame.closed()[0]
                    return value if value[0] == "{" else f'{{"_value": {value}}}'
                stack.pop()
                ready, at = frame.closed(), at + 1
            elif c and c in _CLOSING:
                stack.append(_Open(c, "list" if c == "[" else c))
                at += 1
            else:
                ready, at = _atom(text, at)
    except (_Wrong, ValueError, IndexError):
        return None


@F.pandas_udf(StringType())
def literal_json(texts: pd.Series) -> pd.Series:
    """JSON text of Python literals; null where a text is none."""
    return pd.Series([None if t is None else to_json(t) for t in texts], dtype=object)
