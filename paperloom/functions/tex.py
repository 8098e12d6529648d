"""LaTeX and BibTeX by their delimiters, as Column functions.

One pass over a text with a stack pairs braces, options and environments at any depth; comments, verbatim text and what follows the document are left out,
and escaped characters pair nothing. The pass is a helper of one text (slices of Arrow batches, no state); rows, order and links are DataFrame work of the operators.

Defined cases: null has no items; a delimiter without a partner pairs nothing, so that its command has no argument and its environment is none; an option ends at the first
bracket outside braces; time grows in proportion to the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.slices import by_slices

#: Environments whose text is not LaTeX.
VERBATIM = frozenset("verbatim Verbatim lstlisting minted comment filecontents".split())

_TOKEN = re.compile(r"\\verb\*?([^A-Za-z\s*])|\\([A-Za-z]+)\*?|\\(?:.|\n|\Z)|%[^\n]*|[{}\[\]]")
#: The next token where commands and braces do not matter, after all that is passed over in one step; its place is the first group.
_COARSE = re.compile(r"(?:[^\\%]++|\\(?!verb\*?[^A-Za-z\s*]|(?:begin|end)(?![A-Za-z]))(?:[A-Za-z]++|.|\n|\Z))*+()(?:\\verb\*?([^A-Za-z\s*])|\\(begin|end)\*?|%[^\n]*)")
_SPACE = re.compile(r"\s*+")
_NAME = re.compile(r"\s*\{\s*([^{}\\%]*?)\s*\}")


def _scan(source: str, coarse: bool = False) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The text without comments, and its tokens: (kind, first, after, name) with kind one of {, }, [, ], command, begin and end; a coarse scan has the last two alone."""
    pieces, tokens, at, copied, gone = [], [], 0, 0, 0
    following = _COARSE.match if coarse else _TOKEN.search
    while m := following(source, at):
        first, at = m.start(1) if coarse else m.start(), m.end()
        verb, command = m.groups()[-2:]
        if source[first] == "%":
            pieces.append(source[copied:first])
            copied, gone = at, gone + at - first
        elif verb:
            end = source.find(verb, at)
            at = end + 1 if end >= 0 else at
        elif command in ("begin", "end") and (name := _NAME.match(source, at)):
            tokens.append((command, first - gone, name.end() - gone, name[1].rstrip("*")))
            at = name.end()
            if command == "end" and name[1] == "document":
                source = source[:first]
                break
            if command == "begin" and name[1].rstrip("*") in VERBATIM:
                end = source.find(f"\\end{{{name[1]}}}", at)
                at = end if end >= 0 else len(source)
        elif coarse:
            continue
        elif command:
            tokens.append(("command", first - gone, at - gone, command))
        elif source[first] != "\\":
            tokens.append((source[first], first - gone, at - gone, ""))
    pieces.append(source[copied:])
    return "".join(pieces), tokens


def _partners(text: str, tokens: list[tuple[str, int, int, str]]) -> dict[int, int]:
    """Where each brace, and each bracket that follows a command or an argument, is closed."""
    found, open_, before = {}, [], -1
    for kind, first, after, _ in tokens:
        if kind == "{" or kind == "[" and before >= 0 and not text[before:first].strip():
            open_.append((kind, first))
        elif kind == "]" and open_ and open_[-1][0] == "[":
            found[open_.pop()[1]] = first
        elif kind == "}":
            while open_ and open_[-1][0] == "[":
                open_.pop()
            if open_:
                found[open_.pop()[1]] = first
        before = -1 if kind == "[" else after
    return found


def _environments(tokens: list[tuple[str, int, int, str]], names: frozenset[str]) -> Iterator[tuple[str, int, int, int, int]]:
    """Outermost environments of the names, in order: name, first, first inside, end inside, after."""
    open_: list[tuple[str, int, int]] = []
    counts: dict[str, int] = {}
    found = []
    for kind, first, after, name in tokens:
        if kind == "begin":
            open_.append((name, first, after))
            counts[name] = counts.get(name, 0) + 1
        elif kind == "end" and counts.get(name):
            while True:  # environments left open inside end here
                own, begin, inside = open_.pop()
                counts[own] -= 1
                if own == name:
                    break
            if name in names:
                found.append((name, begin, inside, first, after))
    last = 0
    for item in sorted(found, key=lambda x: x[1]):
        if item[1] >= last:
            last = item[4]
            yield item


def parse(source: str | None, commands: frozenset[str], environments: frozenset[str], bare: frozenset[str]) -> tuple[list[dict], str | None]:
    """Items in order, and the text without them.

    A command counts with its argument (bare ones without), outside the environments that are asked for; its content runs to the next command that is asked for. Of environments the
    outermost count; theirs is what they hold.
    """
    if source is None:
        return [], None
    coarse = not any(name in source for name in commands | bare)  # then no command can be found, and braces pair for nothing
    text, tokens = _scan(source, coarse)
    closed = {} if coarse else _partners(text, tokens)
    spans = []
    for name, first, inside, end, after in _environments(tokens, environments):
        spans.append((first, after, {"name": name, "whole": text[first:after], "content": text[inside:end]}))
    heads, inner, k = [], [(s[0], s[1]) for s in spans], 0
    for kind, first, at, name in tokens:
        while k < len(inner) and inner[k][1] <= first:
            k += 1
        if kind != "command" or name not in commands and name not in bare or k < len(inner) and inner[k][0] <= first:
            continue
        item: dict = {"name": name}
        while name not in bare:
            at = _SPACE.match(text, at).end()
            if at not in closed:
                break
            key = "option" if text[at] == "[" else "value"
            item.setdefault(key, text[at + 1 : closed[at]])
            at = closed[at] + 1
            if key == "value":
                break
        if name in bare or "value" in item:
            item["whole"] = text[first:at]
            heads.append((first, at, item))
    for k, (_, after, item) in enumerate(heads):
        item["content"] = text[after : heads[k + 1][0] if k + 1 < len(heads) else len(text)]
    rest, at = [], 0
    spans = sorted(spans + heads, key=lambda s: s[0])
    for first, after, _ in spans:
        if first >= at:
            rest.append(text[at:first])
            at = after
    return [item for _, _, item in spans], "".join([*rest, text[at:]])


_FIELDS = ("name", "option", "value", "whole", "content")


def _list(rows: list[list], make: Callable[[list], pa.Array]) -> pa.Array:
    """A list for each row (None: null), its values made into an array at once."""
    ends = list(accumulate((len(r or ()) for r in rows), initial=0))
    offsets = [None if r is None else at for r, at in zip(rows, ends, strict=False)] + ends[-1:]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), make([x for r in rows for x in r or ()]))


def _array(rows: list[list[dict]], fields: tuple[str, ...]) -> pa.Array:
    return _list(rows, lambda found: pa.StructArray.from_arrays([pa.array([x.get(f) for x in found], pa.string()) for f in fields], names=list(fields)))


def _kind(fields: tuple[str, ...]) -> str:
    return f"array<struct<{', '.join(f'{f}: string' for f in fields)}>>"


def _sets(*names: str) -> tuple[frozenset[str], ...]:
    return tuple(frozenset(x.split()) for x in names)


@lru_cache(maxsize=64)
def _function(commands: frozenset[str], environments: frozenset[str], bare: frozenset[str], fields: tuple[str, ...]):
    def make(texts: list[str | None]) -> pa.Array:
        found = [parse(t, commands, environments, bare) for t in texts]
        return pa.StructArray.from_arrays([_array([items for items, _ in found], fields), pa.array([rest for _, rest in found], pa.string())], names=["items", "rest"])

    return by_slices(f"struct<items: {_kind(fields)}, rest: string>", make)


def parsed(c: Column | str, commands: str = "", environments: str = "", bare: str = "", fields: str = "") -> Column:
    """struct<items: array<struct<name, option, value, whole, content>>, rest> of the named commands and environments (names with blanks between; stars do not count); of an item the named fields, if any are."""
    return _function(*_sets(commands, environments, bare), tuple(fields.split()) or _FIELDS)(c)


@lru_cache(maxsize=64)
def _items_function(commands: frozenset[str], environments: frozenset[str], bare: frozenset[str], fields: tuple[str, ...]):
    return by_slices(_kind(fields), lambda texts: _array([parse(t, commands, environments, bare)[0] for t in texts], fields))


def items(c: Column | str, commands: str = "", environments: str = "", bare: str = "", fields: str = "") -> Column:
    """The items alone, as parsed() has them."""
    return _items_function(*_sets(commands, environments, bare), tuple(fields.split()) or _FIELDS)(c)


@lru_cache(maxsize=64)
def _each_function(commands: frozenset[str], fields: tuple[str, ...]):
    def make(lists: list[list[str] | None]) -> pa.Array:
        rows = [None if texts is None else [parse(t, commands, frozenset(), frozenset())[0] for t in texts] for texts in lists]
        return _list(rows, lambda found: _array(found, fields))

    return by_slices(f"array<{_kind(fields)}>", make)


def items_of_each(c: Column | str, commands: str, fields: str = "") -> Column:
    """array<array<item>>: the named commands of each text of an array."""
    return _each_function(*_sets(commands), tuple(fields.split()) or _FIELDS)(c)


def named(found: Column, name: str) -> Column:
    """The items of a name."""
    return F.filter(found, lambda x: x["name"] == name)


_ENTRY = re.compile(r"(?m)^[ \t]*@")
_HEAD = re.compile(r"\s*(\w+)\s*[{(]\s*([^,\s{}()=]+)\s*,")
_MACRO = re.compile(r"\s*string\s*[{(]", re.I)
_FIELD = re.compile(r"(?<![\w-])([A-Za-z][\w-]*+)\s*+=\s*")
_PLUS = re.compile(r"\s*+#\s*")
_BARE = re.compile(r"[^\s,{}\"#()]+")
_DELIMITER = re.compile(r"\\.|[{}\"]", re.S)


def _value(text: str, at: int, macros: dict[str, str]) -> tuple[str | None, int]:
    """A field's value from here, its parts joined, and where it ends; None if a part never ends."""
    parts = []
    while True:
        if text[at : at + 1] in ("{", '"'):
            quoted, depth, first = text[at] == '"', 0, at + 1
            at += 1
            while m := _DELIMITER.search(text, at):
                at = m.end()
                if m[0] == "{":
                    depth += 1
                elif m[0] == "}" and depth:
                    depth -= 1
                elif depth == 0 and m[0] == ('"' if quoted else "}"):
                    break
            if m is None:
                return None, len(text)
            parts.append(text[first : at - 1])
        elif m := _BARE.match(text, at):
            parts.append(macros.get(m[0].lower(), m[0]))
            at = m.end()
        else:
            return None, at + 1
        more = _PLUS.match(text, at)
        if not more:
            return "".join(parts), at
        at = more.end()


def bib_parse(source: str | None) -> list[dict]:
    """Entries (kind, key, entry, fields) of a BibTeX file; an entry that is not closed ends before the next one."""
    found, macros = [], {}
    for entry in _ENTRY.split(source or "")[1:]:
        head = _HEAD.match(entry)
        macro = _MACRO.match(entry)
        if not head and not macro:
            continue
        fields: dict[str, str] = {}
        at = (macro or head).end()
        while m := _FIELD.search(entry, at):
            value, at = _value(entry, m.end(), macros)
            if value is not None:
                fields.setdefault(m[1].lower(), value)
        if macro:
            macros |= fields
        else:
            found.append({"kind": head[1].lower(), "key": head[2], "entry": entry, "fields": fields})
    return found


_ENTRY_FIELDS = pa.list_(pa.struct([("kind", pa.string()), ("key", pa.string()), ("entry", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))]))


def bib_entries(c: Column | str) -> Column:
    """The entries of BibTeX files, with their fields by lower-case name."""
    return _bib(c)


_bib = by_slices(
    "array<struct<kind: string, key: string, entry: string, fields: map<string, string>>>",
    lambda texts: pa.array([[e | {"fields": list(e["fields"].items())} for e in bib_parse(t)] for t in texts], _ENTRY_FIELDS),
)
