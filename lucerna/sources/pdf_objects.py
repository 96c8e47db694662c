"""Objects of a PDF file: one pass over it that skips streams by their length.

Files are read as Latin-1 text, which keeps every byte.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from lucerna.sources.pdf_tokens import integer, own, reference, string_end

#: No object can have a higher number (a limit of the format's readers); files that keep one are refused.
HIGHEST = 8_388_607
START = re.compile(r"(?<![0-9])([0-9]{1,10})\s+([0-9]{1,5})\s+obj\b")
_TOKEN = re.compile(r"<<|>>|<[0-9A-Fa-f\s]*>|\(|%[^\r\n]*|\bstream\r?\n|\bendobj\b")
_NUMBER = re.compile(r"(?<![0-9])([0-9]{1,10})\s+[0-9]{1,5}\s+obj\s+([0-9]{1,12})\s+endobj\b")
_END = re.compile(r"\s*endstream\b")


def body_end(t: str, at: int) -> tuple[int, int, bool]:
    """(end of an object's value, behind the word that ends it, whether that word begins a stream)."""
    depth = 0
    while m := _TOKEN.search(t, at):
        word, at = m.group(), m.end()
        if word == "<<":
            depth += 1
        elif word == ">>":
            depth -= 1
        elif word == "(":
            at = string_end(t, m.start())
        elif word == "endobj" or word.startswith("stream") and depth <= 0:
            return m.start(), at, word != "endobj"
    return len(t), len(t), False


def undo_predictor(data: bytes, columns: int) -> bytes:
    """Rows of PNG-predicted bytes (one byte a sample) as they were; ValueError on a broken row."""
    width, above, out = columns + 1, bytearray(columns), bytearray()
    for at in range(0, len(data) - len(data) % width, width):
        kind, row = data[at], bytearray(data[at + 1 : at + width])
        if kind > 4:
            raise ValueError("unknown predictor")
        for i in range(columns):
            left, up, corner = row[i - 1] if i else 0, above[i], above[i - 1] if i else 0
            guess = left + up - corner
            near = min((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner))[2]
            row[i] = (row[i] + (0, left, up, (left + up) // 2, near)[kind]) & 0xFF
        out += row
        above = row
    return bytes(out)


def stream_of(content: bytes, t: str, value: str, at: int, length_of: Callable[[int], int | None]) -> tuple[bytes, int]:
    """(the stream that starts at ``at``, where it ends), by its length if that can be true."""
    told = own(value).get("Length")
    elsewhere = reference(told)
    size = length_of(elsewhere) if elsewhere is not None else integer(told)
    if size is not None and _END.match(t, at + size):
        stop = at + size
    else:  # no length, or a wrong one
        found = t.find("endstream", at)
        stop = found if found >= 0 else len(t)
        stop -= 2 if t[stop - 2 : stop] == "\r\n" and stop - 2 >= at else 1 if t[stop - 1 : stop] in ("\n", "\r") and stop > at else 0
    return content[at:stop], stop


def objects_of(content: bytes) -> Iterator[tuple[int, int, int, str, int, bytes | None]]:
    """(offset, num, gen, what precedes a stream, where it starts, stream) of each object in the order of the file; one without an end is left out."""
    t = content.decode("latin-1")
    numbers: dict[int, int] | None = None

    def length_of(num: int) -> int | None:
        nonlocal numbers
        if numbers is None:
            numbers = {int(n): int(v) for n, v in _NUMBER.findall(t)}
        return numbers.get(num)

    at = 0
    while m := START.search(t, at):
        end, at, has_stream = body_end(t, m.end())
        if end == len(t):
            return
        value, begin, stream = t[m.end() : end].strip(), at, None
        if has_stream:
            stream, at = stream_of(content, t, value, at, length_of)
        yield m.start(), int(m[1]), int(m[2]), value, begin, stream
