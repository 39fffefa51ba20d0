"""Whole-text encoding by the tokenizers library, with each distinct chunk of text encoded once a worker.

Both vocabularies cut a text into pieces before they merge anything, so its ids are those of its chunks in
turn.  Chunks are runs between places where a piece always ends: before white space, between white space and
a word, and, in texts of Latin letters, where letters, numbers and other characters meet.  The places are
found on arrays of code points, PIECE_CHARS at a time, whatever the length of a text; the distinct chunks of
a group are looked up in a two-generation cache of bounded size, and those not seen lately are encoded
together in one call of the library.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from tracelake.llm.common import kept_in_worker

#: Unicode White_Space.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters, numbers and all characters of texts that are cut finely; none of them is changed by NFC.
_L, _N = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u017f", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
_LATIN = re.compile("[\\x00-\\u012f\\u0131-\\u017f]*").fullmatch
_SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
#: Where a long text may be cut: at white space after a word.
_PAUSE = re.compile(f"(?<=[^{_SPACE}])[{_SPACE}]")
_BLANK = re.compile(f"[{_SPACE}]").match
#: Characters that are cut into chunks at once.
PIECE_CHARS = 1 << 19
#: Chunks kept in each of the two generations, and the longest chunk kept.
CACHE_CHUNKS = 250_000
CACHE_CHARS = 48
#: Kinds of characters by code point; all above count as OTHER, and only Latin texts are cut between kinds.
SPACE, LETTER, NUMBER, OTHER = range(4)
_KIND = np.full(0x3002, OTHER, np.uint8)
for _kind, _class in ((SPACE, _SPACE), (LETTER, _L), (NUMBER, _N)):
    _KIND[[i for i in range(_KIND.size) if re.match(f"[{_class}]", chr(i))]] = _kind

_encoders: dict[tuple[str, bool], ChunkEncoder] = kept_in_worker({})


def encoder(path: str, special: bool = True) -> ChunkEncoder:
    """One encoder a worker and vocabulary file."""
    if (path, special) not in _encoders:
        _encoders[path, special] = ChunkEncoder(path, special)
    return _encoders[path, special]


def pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` in parts of about ``limit`` characters, cut where a word ends."""
    at = 0
    while len(text) - at > limit:
        found = _PAUSE.search(text, at + limit)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    if text:
        yield text[at:] if at else text


class ChunkEncoder:
    """``special``: the strings of added tokens in a text become their ids, as the library has it by default."""

    def __init__(self, path: str, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # added tokens are cut out of a text beforehand
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word or not t.special for t in added.values()):
            raise ValueError("added tokens that don't stand for just their string")
        self.added = {t.content: i for i, t in added.items()} if special else {}
        strings = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.cut_added = re.compile(f"({'|'.join(strings)})").split if strings else lambda text: [text]
        self.spaced = self.tokenizer.normalizer is None  # byte-level: white space has ids of its own
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocabulary.values(), default=0) < 1 << 16 else "<u4")
        if self.spaced:
            self.leads = np.zeros(max(vocabulary.values()) + 1, bool)
            self.leads[[i for token, i in vocabulary.items() if token[0] == "Ġ"]] = True
            (self.mark,) = self._ids("\n")
        else:
            self.fine = re.compile(f"{_SUFFIXES}|[{_L}]+|[{_N}]|[^{_SPACE}{_L}{_N}]+").findall
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
            (self.mark,) = self._ids("\x01")
            self.normalized = Tokenizer.from_file(path)  # for chunks that the normalizer would not change
            self.normalized.encode_special_tokens = True
            self.normalized.normalizer = None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, text: str, tokenizer=None) -> list[int]:
        return (tokenizer or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _encode(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of distinct chunks, in few calls."""
        found: dict[str, bytes] = {}
        alone, spaced, plain, single = [], [], [], []
        for c in chunks:
            if self.spaced:
                (alone if c.isspace() or len(c) > 4096 else spaced if c[0] == " " else plain).append(c)
            else:
                one = len(c) <= 4096 and _LATIN(c) and c == c.lower() and len(self.fine(c)) == 1
                (single if one else alone if "\x01" in c or len(c) > 4096 else plain).append(c)
        for c in alone:
            found[c] = np.array(self._ids(c), self.dtype).tobytes()
        for part in (spaced[i : i + 2000] for i in range(0, len(spaced), 2000)):
            ids = np.array(self._ids("".join(part)), self.dtype)
            self._split(found, part, ids, np.flatnonzero(self.leads[ids]), 0)
        for part in (single[i : i + 2000] for i in range(0, len(single), 2000)):
            ids = np.array(self._ids(" ".join(part), self.normalized), self.dtype)
            self._split(found, part, ids, np.concatenate(([0], np.flatnonzero(self.ends[ids])[:-1] + 1)), 0)
        for part in (plain[i : i + 2000] for i in range(0, len(plain), 2000)):
            ids = np.array(self._ids(("\n" if self.spaced else " \x01 ").join(part)), self.dtype)
            self._split(found, part, ids, np.concatenate(([-1], np.flatnonzero(ids == self.mark))), 1)
        return found

    def _split(self, found: dict[str, bytes], part: list[str], ids: np.ndarray, at: np.ndarray, skip: int) -> None:
        if at.size != len(part):  # some chunk has a boundary inside: encode each alone
            found.update((c, np.array(self._ids(c), self.dtype).tobytes()) for c in part)
            return
        size, raw = self.dtype.itemsize, ids.tobytes()
        bounds = [*((at + skip) * size).tolist(), (ids.size + skip) * size]
        for c, a, b in zip(part, bounds, bounds[1:]):
            found[c] = raw[a : b - skip * size]

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; a null text has none."""
        waiting: list[list[np.ndarray]] = []  # ids of the texts that are not handed out yet
        group: list[str] = []
        owner: list[int] = []  # the text of each piece of the group
        size = 0

        def flush() -> None:
            nonlocal size
            for i, ids in zip(owner, self._group(group)):
                waiting[i].append(ids)
            group.clear()
            owner.clear()
            size = 0

        for text in texts:
            waiting.append([])
            parts = self.cut_added(text) if text else []
            for n, part in enumerate(parts):
                if n % 2:  # an added token: what comes before it has to be encoded first
                    flush()
                    waiting[-1].append(np.array([self.added[part]], self.dtype))
                    continue
                for piece in pieces(part):
                    group.append(piece)
                    owner.append(len(waiting) - 1)
                    size += len(piece)
                    if size >= PIECE_CHARS:
                        flush()
            if not group:
                yield from map(self._joined, waiting)
                waiting.clear()
        flush()
        yield from map(self._joined, waiting)

    def _joined(self, parts: list[np.ndarray]) -> np.ndarray:
        return parts[0] if len(parts) == 1 else np.concatenate([*parts, np.zeros(0, self.dtype)])

    def chunks(self, texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The chunks of non-empty texts, and how many each text has."""
        fine = np.array([_LATIN(t) is not None for t in texts])
        if not self.spaced:
            texts = [t.lower() if f else t for t, f in zip(texts, fine)]
        body = "".join(texts)
        point = np.frombuffer(body.encode("utf-32-le"), np.uint32)
        begin = np.cumsum([0, *map(len, texts)])
        kind = _KIND[np.minimum(point, _KIND.size - 1)]
        space = kind == SPACE
        before, after = space[:-1], space[1:]
        first = np.zeros(point.size, bool)
        first[begin[:-1]] = True
        cut = first.copy()
        cut[1:] |= ~before & after
        if self.spaced:  # the last white space before a word is a chunk of its own, or a blank of the word
            last = before & ~after & ~first[1:]
            cut[:-1] |= last
            cut[1:] |= last & (point[:-1] != 32)
        else:
            cut[1:] |= before & ~after
        turn = (kind[1:] != kind[:-1]) if self.spaced else (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        turn &= ~before & ~after & (point[:-1] != 39)  # an apostrophe may belong to the letters after it
        if not fine.all():
            turn &= np.repeat(fine, np.diff(begin))[1:]
        cut[1:] |= turn
        at = np.flatnonzero(cut)
        data = body.encode()
        if len(data) == point.size:
            places = np.append(at, point.size).astype(np.int64)
        else:
            width = 1 + (point >= 0x80).astype(np.int64) + (point >= 0x800) + (point >= 0x10000)
            places = np.concatenate(([0], np.cumsum(width)))[np.append(at, point.size)]
        found = pa.LargeStringArray.from_buffers(at.size, pa.py_buffer(places), pa.py_buffer(data)).dictionary_encode()
        return found, np.diff(np.searchsorted(at, begin))

    def _group(self, texts: list[str]) -> Iterator[np.ndarray]:
        if not texts:
            return
        chunks, count = self.chunks(texts)
        distinct = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        looked = list(map(self.young.get, distinct))
        missing = [c for c, p in zip(distinct, looked) if p is None]
        if missing:
            found = {c: p for c in missing if (p := self.old.get(c)) is not None}
            found |= self._encode([c for c in missing if c not in found and (self.spaced or not _BLANK(c))])
            looked = [found.get(c, b"") if p is None else p for c, p in zip(distinct, looked)]
            self.young.update((c, p) for c, p in found.items() if len(c) <= CACHE_CHARS)
            if len(self.young) > CACHE_CHUNKS:
                self.old, self.young = self.young, {}
        size = np.fromiter(map(len, looked), np.int64, len(looked)) // self.dtype.itemsize
        start = np.cumsum(size) - size
        index = chunks.indices.to_numpy()
        n = size[index]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(start[index] - (ends - n), n)
        ids = np.frombuffer(b"".join(looked), self.dtype)[at]
        yield from np.split(ids, ends[np.cumsum(count)[:-1] - 1])
