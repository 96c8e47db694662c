"""Tokens of PDF values: one lexer that knows strings, hexadecimal strings, comments and nesting.

What a dictionary says is read from its entries, so numbers inside a string are no references and a
word inside a comment is no key.  Texts are Latin-1, one character a byte; every step moves on, whatever
the bytes are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lucerna.sources.shared import in_slices

#: A string without brackets inside is one token; of any other the opening bracket is found here, its end by :func:`string_end`.
_LEX = re.compile(r"<<|>>|[\[\]]|<[0-9A-Fa-f\s]*>|\((?:[^()\\]++|\\.)*+\)|\(|%[^\r\n]*|/[^\s\x00/<>\[\](){}%]*|[^\s\x00/<>\[\](){}%]+", re.S)
_STRING = re.compile(r"\\.|[()]", re.S)
_CODE = re.compile("#([0-9A-Fa-f]{2})")
#: Values of so many characters at most are kept with what they say, so many of them in a worker: one file's are asked for several times.
SHORT, KEPT = 512, 2_048

#: An entry of a dictionary: nesting (1: the outermost dictionary's own), key, where key and value begin, where the value ends.
Entry = tuple[int, str, int, int, int]


def string_end(t: str, at: int) -> int:
    """Behind the closing bracket of the string that opens at ``at``."""
    depth = 0
    for m in _STRING.finditer(t, at):
        depth += {"(": 1, ")": -1}.get(m.group(), 0)
        if not depth:
            return m.end()
    return len(t)


def name_of(word: str) -> str:
    """The name that ``/word`` writes, codes (#4A) worked out."""
    return _CODE.sub(lambda m: chr(int(m[1], 16)), word[1:]) if "#" in word else word[1:]


def tokens(t: str, at: int = 0) -> Iterator[tuple[str, int, int]]:
    """(first character or kind, start, end) of each token; comments are left out."""
    while m := _LEX.search(t, at):
        word, at = m.group(), m.end()
        if word[0] == "(":
            at = string_end(t, m.start()) if word == "(" else at
            yield "string", m.start(), at
        elif word in ("<<", ">>", "[", "]"):
            yield word, m.start(), at
        elif word[0] != "%":
            yield {"/": "name", "<": "string"}.get(word[0], "word"), m.start(), at


def structure(t: str) -> tuple[list[Entry], list[int]]:
    """(entries of all dictionaries in a value, numbers of the objects that it refers to), in the order of the text.

    The lists are shared between callers, who only read them.
    """
    return _kept(t) if len(t) <= SHORT else _structure(t)


def _structure(t: str) -> tuple[list[Entry], list[int]]:
    # One loop without calls: every value of every object comes through here.
    entries: list[list] = []
    refs: list[int] = []
    #: Open brackets, and for a dictionary the entry whose value is being read.
    stack: list[list] = []
    before = last = None
    at, search = 0, _LEX.search
    while m := search(t, at):
        word = m.group()
        start, at = m.span()
        first = word[0]
        if first == "%":
            continue
        if word == "(":
            at = string_end(t, start)
        top = stack[-1] if stack else None
        closes = word == ">>" or first == "]"
        if closes:
            if top and top[0] == ("<<" if first == ">" else "["):
                stack.pop()
                top = stack[-1] if stack else None
            else:
                before = last = None
                continue
        elif first == "/" and top and top[0] == "<<" and (top[1] is None or entries[top[1]][3] >= 0):
            top[1] = len(entries)
            entries.append([len(stack), name_of(word), start, -1, at])
            before = last = None
            continue
        if top and top[1] is not None:
            e = entries[top[1]]
            if e[3] < 0:
                e[3] = start
            e[4] = at
        if word == "<<" or first == "[":
            stack.append([word, None])
        elif word == "R" and before is not None:
            refs.append(before)
        before, last = (last, int(word)) if len(word) <= 10 and word.isdecimal() and word.isascii() else (None, None)
    return [(d, k, a, b if b >= 0 else c, c) for d, k, a, b, c in entries], refs


_kept = lru_cache(KEPT)(_structure)


def own(t: str | None) -> dict[str, str]:
    """The outermost dictionary's own entries as they are written; of a repeated key the first."""
    out: dict[str, str] = {}
    for depth, key, _, start, end in structure(t or "")[0]:
        if depth == 1:
            out.setdefault(key, t[start:end])
    return out


def integer(value: str | None) -> int | None:
    """A value that is a whole number of at most twelve digits, else None."""
    m = re.fullmatch(r"\s*([0-9]{1,12})\s*", value or "")
    return int(m[1]) if m else None


def reference(value: str | None) -> int | None:
    """The number of the object that a value refers to, if it is nothing but a reference."""
    m = re.fullmatch(r"\s*([0-9]{1,10})\s+[0-9]{1,5}\s+R\s*", value or "")
    return int(m[1]) if m else None


_ENTRIES = pa.list_(pa.struct([("depth", pa.int32()), ("key", pa.string()), ("key_start", pa.int32()), ("val_start", pa.int32()), ("val_end", pa.int32())]))
ENTRIES = "array<struct<depth:int,key:string,key_start:int,val_start:int,val_end:int>>"
_FACTS = pa.struct([("type", pa.string()), ("refs", pa.list_(pa.int64()))])


def entries(text: Column) -> Column:
    """Entries of every dictionary in a value, as :data:`ENTRIES`."""

    def read(texts: pa.Array) -> pa.Array:
        names = ("depth", "key", "key_start", "val_start", "val_end")
        return pa.array([[dict(zip(names, e, strict=True)) for e in structure(x or "")[0]] for x in texts.to_pylist()], _ENTRIES)

    return in_slices(read, ENTRIES)(text)


def facts(text: Column) -> Column:
    """``type`` (the own /Type that is a name) and ``refs`` (distinct) of an object's value."""

    def read(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts.to_pylist():
            found, refs = structure(x or "")
            kind = next((x[s:e] for depth, key, _, s, e in found if depth == 1 and key == "Type"), "")
            out.append({"type": name_of(kind) if kind.startswith("/") else None, "refs": list(dict.fromkeys(refs))})
        return pa.array(out, _FACTS)

    return in_slices(read, "struct<type:string,refs:array<bigint>>")(text)


def own_entries(text: Column) -> Column:
    """The own entries of a dictionary as a map from key to value, as written."""

    def read(texts: pa.Array) -> pa.Array:
        return pa.array([list(own(x).items()) if x is not None else None for x in texts.to_pylist()], pa.map_(pa.string(), pa.string()))

    return in_slices(read, "map<string,string>")(text)


def referred(value: Column) -> Column:
    """The number in a value that is a reference, else null."""
    return F.regexp_extract(value, r"^\s*(\d{1,10})\s+\d{1,5}\s+R\s*$", 1).try_cast("long")


def filters(t: str) -> tuple[bool, bool, int]:
    """How a stream is written: (its only filter is Flate, there is some other filter, columns of its predictor or 0)."""
    found, _ = structure(t)
    names = next((t[s:e] for depth, key, _, s, e in found if depth == 1 and key in ("Filter", "F")), "")
    named = [name_of(names[s:e]) for kind, s, e in tokens(names) if kind == "name"]
    flate = named in (["FlateDecode"], ["Fl"])
    said = {key: t[s:e] for depth, key, _, s, e in reversed(found) if depth > 1 and key in ("Predictor", "Columns")}
    predicted = (integer(said.get("Predictor")) or 1) >= 10
    return flate, bool(named) and not flate, min(integer(said.get("Columns")) or 1, 1 << 20) if predicted else 0


_NODE = pa.struct([("kids", pa.list_(pa.int64())), ("names", pa.list_(pa.struct([("name", pa.string()), ("num", pa.int64())])))])


def _node(t: str) -> dict:
    kids, names = [], []
    for _, key, _, start, end in structure(t)[0]:
        if key == "Kids":
            kids += structure(t[start:end])[1]
        elif key == "Names" and t[start:end].startswith("["):
            # Names and values take turns in the array itself; what a value holds is not looked into.
            level, pending, words = 0, None, list(tokens(t[start:end]))
            for i, (kind, a, b) in enumerate(words):
                level += (kind in ("<<", "[")) - (kind in (">>", "]"))
                if level == 1 and kind == "string" and pending is None:
                    pending = t[start + a : start + b]
                elif pending is not None:
                    three = " ".join(t[start + x : start + y] for _, x, y in words[i : i + 3])
                    names.append({"name": pending, "num": reference(three)})
                    pending = None
    return {"kids": kids, "names": names}


def tree_node(text: Column) -> Column:
    """What a node of a name tree holds: ``kids`` (objects), and ``names`` as written, each with the object of its value (null: the value stands in the node)."""

    def read(texts: pa.Array) -> pa.Array:
        return pa.array([_node(x or "") for x in texts.to_pylist()], _NODE)

    return in_slices(read, "struct<kids:array<bigint>,names:array<struct<name:string,num:bigint>>>")(text)
