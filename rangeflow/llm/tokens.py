"""Tokenising whole texts with the tokenizers library, one cached word at a time.

The vocabularies used here never merge across a single space or line feed that stands between two
other characters, so the ids of a text are the ids of its words, each with the space before it, in
order.  A batch is cut into words and its words are told apart by vectorised 64-bit hashes; each
distinct word goes through the library once per worker (the caches are bounded, about 90 MB in all).  A
text in which white space touches white space, or that holds other white space or what may be an added
token's text, is encoded as a whole instead.
"""

from __future__ import annotations

import ctypes
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from contextlib import suppress
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from .text import mix

#: Words (17 bytes each, thrice that while tables merge), their ids (4 bytes each) and pieces of words (about 200 bytes each) that a worker keeps.
CACHE_WORDS = 1_000_000
CACHE_IDS = 4_000_000
CACHE_PIECES = 80_000
PIECE_LETTERS = 64
BATCH_BYTES = 1_000_000
SLICE_ROWS = 500
SLICE_BYTES = 2_000_000
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(1, 2**63, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LEAD = np.uint64(0xA5A5A5A5DEADBEEF)


def _as_whole(text: str) -> bool:
    """Whether white space touches white space or an end of the text, or there is other white space."""
    return (
        "  " in text
        or "\n\n" in text
        or " \n" in text
        or "\n " in text
        or text[:1] in (" ", "\n")
        or text[-1:] == " "
        or _ODD.search(text) is not None
    )


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte that byte-level vocabularies use."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Known:
    """Ids of known words by the words' hashes: a large sorted table and a small one of new words."""

    def __init__(self) -> None:
        self.pool = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.old = self.new = (np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.uint8))

    def __len__(self) -> int:
        return len(self.old[0]) + len(self.new[0])

    @staticmethod
    def _at(table: tuple, keys: np.ndarray) -> np.ndarray:
        """Row of each key in a table, -1 if it has none."""
        if not len(table[0]):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        return np.where(table[0][at] == keys, at, -1)

    def missing(self, keys: np.ndarray) -> np.ndarray:
        return (self._at(self.old, keys) < 0) & (self._at(self.new, keys) < 0)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of known words begin in the pool, and how many they are."""
        at = self._at(self.old, keys)
        begin, count = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        for table, row in ((self.old, at), (self.new, np.where(at < 0, self._at(self.new, keys), -1))):
            has = row >= 0
            begin[has], count[has] = table[1][row[has]], table[2][row[has]]
            table[3][row[has]] = np.minimum(table[3][row[has]], 99) + 1
        return begin, count

    def add(self, keys: np.ndarray, ids: list[str]) -> None:
        """Ids come as strings, a character an id: compact, and quick to join."""
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(count.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(len(self.pool), np.uint32)])
        self.pool[self.used : self.used + total] = np.frombuffer("".join(ids).encode("utf-32-le", "surrogatepass"), "<u4")
        self.new = self._merged(self.new, (keys, (self.used + np.cumsum(count) - count).astype(np.int32), count.astype(np.int32), np.zeros(len(keys), np.uint8)))
        self.used += total
        if len(self.new[0]) > max(20_000, len(self.old[0]) // 4):
            self.old, self.new = self._merged(self.old, self.new), tuple(x[:0] for x in self.new)

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")
        return (keys[order], *(np.concatenate([x, y])[order] for x, y in zip(a[1:], b[1:], strict=True)))

    def shrink(self) -> None:
        """Forget words met in one batch only, or all if most were met again."""
        table = self._merged(self.old, self.new)
        keep = table[3] > 1
        if 2 * keep.sum() > CACHE_WORDS or 2 * table[2][keep].sum() > CACHE_IDS:
            keep[:] = False
        keys, begin, count, _ = (x[keep] for x in table)
        to = np.cumsum(count, dtype=np.int64)
        size = int(to[-1]) if len(to) else 0
        kept = self.pool[np.repeat(begin - (to - count), count) + np.arange(size)]
        self.__init__()
        self.pool = np.concatenate([kept, self.pool])
        self.used = size
        self.old = keys, (to - count).astype(np.int32), count, np.zeros(len(keys), np.uint8)


class WordTokenizer:
    """``flat(column)`` gives the ids of all texts of a string column, and where each text ends."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.added = sorted({t.content.lower()[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.model = self.tokenizer.model
        self.lower = json.loads(self.tokenizer.to_str())["normalizer"] is not None
        digit = r"\p{N}" if self.lower else r"\p{N}+"
        self.piece = regex.compile(rf"\p{{L}}+|{digit}|[^\s\p{{L}}\p{{N}}]+")
        self.letters = _byte_letters()
        self.pieces: dict[str, str] = {}
        self.marks = {m: self._word(m, False) for m in ".,;:!?"}
        self.feed = self._encode("\n")
        self.power = np.cumprod(np.full(1 << 16, _BASE), dtype=np.uint64)
        self.known = _Known()

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _word(self, word: str, lead: bool) -> str:
        """Ids of one word, as characters: those of its pieces, which the vocabulary's model looks up."""
        if "'" in word or "’" in word or "İ" in word or "Σ" in word or (self.lower and not unicodedata.is_normalized("NFC", word)):
            return "".join(map(chr, self._encode(" " + word if lead else word)))
        parts = self.piece.findall(word.lower() if self.lower else word)
        if lead and not self.lower:
            parts[0] = " " + parts[0]
        pieces = self.pieces
        try:
            return "".join([pieces[p] for p in parts])
        except KeyError:
            pass
        if len(pieces) >= CACHE_PIECES:
            pieces.clear()
        out = []
        for p in parts:
            got = pieces.get(p)
            if got is None:
                got = "".join([chr(t.id) for t in self.model.tokenize(p.encode().decode("latin-1").translate(self.letters))])
                if len(p) <= PIECE_LETTERS:
                    pieces[p] = got
            out.append(got)
        return "".join(out)

    def _learn(self, keys: np.ndarray, words: list[bytes], leads: np.ndarray) -> None:
        """Words made of letters, perhaps with one mark at their end, are pieces as they are; others are cut first."""
        tokenize, letters, lower, marks, out = self.model.tokenize, self.letters, self.lower, self.marks, []
        space = letters[32]
        for raw, lead in zip(words, leads.tolist(), strict=True):
            whole = word = raw.decode()
            mark = marks.get(word[-1], "")
            if mark:
                word = word[:-1]
            if not word.isalpha():
                out.append(self._word(whole, lead))
                continue
            if word.isascii():
                piece = word.lower() if lower else space + word if lead else word
            elif not lower:
                piece = (" " + word if lead else word).encode().decode("latin-1").translate(letters)
            elif "İ" in word or "Σ" in word or not unicodedata.is_normalized("NFC", whole):
                out.append(self._word(whole, lead))
                continue
            else:
                piece = word.lower().encode().decode("latin-1").translate(letters)
            out.append("".join([chr(t.id) for t in tokenize(piece)]) + mark)
        self.known.add(keys, out)

    def _split(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts whose only white space is single spaces and line feeds; ids of each text."""
        n = len(data)
        if n > len(self.power):
            self.power = np.cumprod(np.full(n, _BASE), dtype=np.uint64)
        space, feed = data == 32, data == 10
        gap = space | feed
        first = np.zeros(n, bool)
        begins = np.concatenate([[0], ends[:-1]])
        first[begins[begins < n]] = True
        head = ~gap & (first | np.concatenate([[True], gap[:-1]]))
        s = np.flatnonzero(head)
        after = np.concatenate([gap[1:] | first[1:], [True]])
        e = np.flatnonzero(~gap & after) + 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * self.power[:n], dtype=np.uint64)])
        # equal words at different places differ by a power of the base: divide it out
        h = (sums[e] - sums[s]) * self._inverse(s)
        lead = (s > 0) & space[s - 1] & ~first[s]
        h = mix(h ^ np.where(lead, _LEAD, np.uint64(0)))
        keys, at, inv = np.unique(h, return_index=True, return_inverse=True)
        new = self.known.missing(keys)
        if new.any():
            raw, which = data.tobytes(), at[new]
            if len(self.known) + len(which) > CACHE_WORDS or self.known.used > CACHE_IDS:
                self.known.shrink()  # it may forget words of this batch
                new = self.known.missing(keys)
                which = at[new]
            self._learn(keys[new], [raw[a:b] for a, b in zip(s[which].tolist(), e[which].tolist(), strict=True)], lead[which])
        begin, count = (x[inv] for x in self.known.get(keys))
        place, pool = s, self.known.pool[: self.known.used]
        if self.feed:  # line feeds are words of their own
            f = np.flatnonzero(feed)
            place = np.concatenate([s, f])
            order = np.argsort(place, kind="stable")
            place = place[order]
            begin = np.concatenate([begin, np.full(len(f), len(pool))])[order]
            count = np.concatenate([count, np.full(len(f), len(self.feed))])[order]
            pool = np.concatenate([pool, np.array(self.feed, np.uint32)])
        to = np.cumsum(count)
        ids = pool[np.repeat(begin - (to - count), count) + np.arange(to[-1] if len(to) else 0)]
        upto = np.concatenate([[0], to])[np.searchsorted(place, ends)]
        return ids, np.diff(upto, prepend=0)

    def _inverse(self, s: np.ndarray) -> np.ndarray:
        if not hasattr(self, "back") or len(self.back) < len(self.power):
            inv = np.uint64(pow(int(_BASE), -1, 2**64))
            self.back = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(self.power), inv), dtype=np.uint64)])
        return self.back[s]

    def flat(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned 32-bit) of the texts, null as empty, and how many each text has."""
        texts = ["" if x is None else x for x in column.to_pylist()]
        whole = [_as_whole(x) or any(a in x.lower() for a in self.added if a[0] in x) for x in texts]
        ids, counts = [], []
        k = 0
        while k < len(texts):
            if whole[k]:
                got = self._encode(texts[k])
                ids.append(np.array(got, np.uint32))
                counts.append(np.array([len(got)]))
                k += 1
                continue
            part, size = [], 0
            while k < len(texts) and not whole[k] and (not part or size + len(texts[k]) < BATCH_BYTES):
                part.append(texts[k].encode())
                size += len(part[-1])
                k += 1
            ends = np.cumsum([len(x) for x in part])
            a, b = self._split(np.frombuffer(b"".join(part), np.uint8), ends)
            ids.append(a)
            counts.append(b)
        if not ids:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        return np.concatenate(ids), np.concatenate(counts)

    def closed(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``flat``, with the id ``end`` after every text."""
        ids, counts = self.flat(column)
        return np.insert(ids, np.cumsum(counts), np.uint32(end)), counts + 1


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` and about ``size`` bytes of text, which bounds what Python holds at a time."""
    for b in batches:
        ends = np.zeros(b.num_rows, np.int64)
        for c in {"text", "__text"} & set(b.schema.names):
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(c)), 0).to_numpy().astype(np.int64))
        lo = before = 0
        while lo < b.num_rows:
            hi = min(lo + rows, max(lo + 1, int(np.searchsorted(ends, before + size, side="right"))))
            yield b.slice(lo, hi - lo)
            lo, before = hi, int(ends[hi - 1])


def released(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; at their end the worker, which later tasks use again, gives free memory back to the system."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other systems' C libraries do without
        ctypes.CDLL(None).malloc_trim(0)


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One per worker process and vocabulary."""
    return WordTokenizer(path)
