"""Token ids of whole texts by a public word-level BPE file, through a cache of words.

The file splits a normalised text into words and encodes each on its own, so a text's ids are the
concatenated ids of its words.  Most words recur: each Python worker keeps a cache of packed ids, bounded in
entries and in characters, and asks the tokenizer only for words it has not seen.  Texts with characters for which
this split is not reproduced here go to the tokenizer whole, so the ids are always the tokenizer's.

A file may name added tokens, such as an end mark, that are found in a text before it is split.  With
``added`` their written form in a text gives their id, as the tokenizer does by default; without it, it
is text like any other, so that a document cannot forge a mark.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lucerna.llm.common import lasting

#: Chunks and words kept by each worker, and characters of each; a full cache starts anew.  Longer ones are not kept.
CACHE_CHUNKS, CACHE_WORDS, CACHE_CHARS, LONGEST = 900_000, 500_000, 16 << 20, 64
#: Characters up to here are split by the pattern below (Latin letters); other texts go whole.
_LAST = 0x17F
_WHITE = "\t\n\v\f\r \x85\xa0"


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_LAST + 1) if unicodedata.category(chr(c))[0] == kind)


_LETTERS, _NUMBERS = _class("L"), _class("N")
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_WHITE}{_LETTERS}{_NUMBERS}]+")
#: Other characters; the capital whose lower case has two; separators that only Python takes for white space.
_FOREIGN = re.compile(f"[^\x00-{chr(_LAST)}]|\u0130|[\x1c-\x1f]")
_SUFFIX = "</w>"


def _foreign(text: str) -> bool:
    if text.isascii():
        return any(c in text for c in "\x1c\x1d\x1e\x1f")
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return bool(_FOREIGN.search(text))
    return any(c in text for c in "\x1c\x1d\x1e\x1f")


class WordTokenizer:
    """Ids of whole texts, as unsigned 32-bit numbers."""

    def __init__(self, path: str, added: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        told = json.loads(self.tokenizer.to_str())
        pre = json.dumps(told.get("pre_tokenizer"))
        #: Texts that hold one of these go to the tokenizer whole.
        self.marks = [t["content"].lower() for t in told.get("added_tokens", []) if t["content"] and (added or not t["special"])]
        self.by_word = "'ll|'d|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" in pre
        #: What every mark begins with up to its first letter: a text without it is not looked at closer.
        self.leads = {re.match(r"[^a-zA-Z]*", m).group() if m.isascii() else "" for m in self.marks}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(_SUFFIX)]] = True
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        #: Characters held by each cache.
        self.held: dict[int, int] = {}

    def _marked(self, text: str) -> bool:
        if not any(x in text for x in self.leads):
            return False
        low = text.lower()
        return any(m in low for m in self.marks)

    def whole(self, texts: list[str]) -> list[bytes]:
        """Without the caches."""
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _encoded(self, new: list[str]) -> dict[str, bytes]:
        """Ids of words, from the tokenizer."""
        out: dict[str, bytes] = {}
        for i in range(0, len(new), 500):
            part = new[i : i + 500]
            ids = np.asarray(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            after = np.flatnonzero(self.ends[ids]) + 1
            if len(after) == len(part):
                raw, bounds = ids.tobytes(), [0, *(4 * after).tolist()]
                out.update((w, raw[a:b]) for w, a, b in zip(part, bounds, bounds[1:], strict=False))
            else:
                out.update(zip(part, self.whole(part), strict=True))
        return out

    def _keep(self, cache: dict[str, bytes], found: dict[str, bytes], most: int) -> None:
        """Put what is short into a cache; one that would be too full starts anew, and what alone is too much is not kept."""
        short = {w: i for w, i in found.items() if len(w) <= LONGEST}
        size = sum(map(len, short))
        if len(short) > most or size > CACHE_CHARS:
            return
        if len(cache) + len(short) > most or self.held.get(id(cache), 0) + size > CACHE_CHARS:
            cache.clear()
            self.held[id(cache)] = 0
        cache.update(short)
        self.held[id(cache)] = self.held.get(id(cache), 0) + size

    def _of_chunks(self, new: list[str]) -> dict[str, bytes]:
        """Ids of chunks that are not kept, by those of their words."""
        split = [_SPLIT.findall(c) for c in new]
        words = {w for x in split for w in x}
        known = {w: self.words[w] for w in words if w in self.words}
        fresh = self._encoded(list(words - known.keys()))
        self._keep(self.words, fresh, CACHE_WORDS)
        get = (known | fresh).__getitem__
        return {c: b"".join(map(get, x)) for c, x in zip(new, split, strict=True)}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in one array, and where each text's begin (one more bound than texts).

        Chunks between white space are told apart once a batch, outside Python; only distinct ones
        are looked up.
        """
        plain: list[str] = []
        foreign: dict[int, np.ndarray] = {}
        for i, text in enumerate(texts):
            if not text.isascii() and self.by_word and not _foreign(text):
                text = unicodedata.normalize("NFC", text)
            if not self.by_word or _foreign(text) or self.marks and self._marked(text):
                foreign[i] = np.frombuffer(self.whole([text])[0], "<u4")
                text = ""
            elif not text.isascii():
                text = text.replace("\x85", " ").replace("\xa0", " ")
            plain.append(text.lower())
        lists = pc.ascii_split_whitespace(pa.array(plain, pa.large_string()))
        coded = lists.values.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        fresh = self._of_chunks([c for c in distinct if c not in self.chunks])
        known = [fresh[c] if c in fresh else self.chunks[c] for c in distinct]
        self._keep(self.chunks, fresh, CACHE_CHUNKS)
        ids = np.frombuffer(b"".join(known), "<u4")
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        start = np.concatenate([[0], np.cumsum(size)])[:-1]
        at = coded.indices.to_numpy()
        lengths = size[at]
        ends = np.cumsum(lengths)
        ids = ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[at] - ends + lengths, lengths)]
        bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy()]
        if foreign:
            parts = [foreign.get(i, ids[bounds[i] : bounds[i + 1]]) for i in range(len(texts))]
            ids = np.concatenate(parts).astype("<u4")
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, bounds


#: Whose tasks share a worker's tokenizers.
OWNER = "tokens"
_loaded: dict[tuple[str, bool], WordTokenizer] = {}


def tokenizer(path: str, added: bool = False) -> WordTokenizer:
    """One at a time in a worker process, until another one is asked for or another operator's task runs there."""
    if (path, added) not in _loaded:
        _loaded.clear()
        _loaded[path, added] = WordTokenizer(path, added)
        lasting(OWNER, _loaded.clear)
    return _loaded[path, added]


def public_path(name: str) -> str:
    """Where the installed public vocabulary file lies; a parameter everywhere, never copied."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
