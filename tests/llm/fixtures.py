"""Small tables with every odd case, and brute-force forms of the operators."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, spans string, score string"


def prose(rng: random.Random, n: int, size: int = 300) -> str:
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def corpus(seed: int = 1) -> list[tuple]:
    """Nulls, empty and white-space texts, copies, near copies, shared passages, repeats, odd characters."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(5, 300), 4000) for _ in range(30)]
    passage = prose(rng, 70, 4000)
    texts: list[str | None] = [None, "", "  \n\t ", "a", "Word", "a b c", "é" * 150, "x " * 400, "ab" * 300, "日本語 " * 60]
    texts += base
    texts += base[:6] + [base[7] + " tail", "head " + base[8], base[9].upper()]
    for k in range(8):
        w = base[10].split()
        if w:
            w[rng.randrange(len(w))] = f"e{k}"
        texts.append(" ".join(w))
    texts += [prose(rng, 40, 4000) + "\n" + passage + "\n" + prose(rng, 30, 4000) for _ in range(6)]
    texts += [passage, passage + " " + passage, "tab\tsep\x0bvt  two   spaces\r\nend \n", "don't <|endoftext|> it's"]
    rng.shuffle(texts)
    return [(k, t, "en", f"s{k % 3}", len(t or ""), 7, "x", "y") for k, t in enumerate(texts)]


def words(t: str | None) -> list[bytes]:
    return WORDS.findall((t or "").encode())


def components(docs: list[tuple], k: int, num: int, den: int) -> dict:
    sets = {}
    for d, t, *_ in docs:
        w = [x.lower() for x in words(t)]
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and den * n >= num * len(sets[a] | sets[b]):
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    return {d: (len(s), find(d)) for d, s in sets.items()}


def without_repeated_words(docs: list[tuple], window: int = 50) -> dict:
    first: dict[bytes, int] = {}
    for d, t, *_ in docs:
        w = words(t)
        for i in range(len(w) - window + 1):
            k = b" ".join(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, t, *_ in docs:
        w = words(t)
        gone = {i + j for i in range(len(w) - window + 1) if first[b" ".join(w[i : i + window])] < d for j in range(window)}
        out[d] = (len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())
    return out


def without_repeated_bytes(docs: list[tuple], window: int = 100) -> dict:
    seen, out = set(), {}
    for d, t, *_ in sorted(docs, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - window + 1):
            k = b[i : i + window]
            if k in seen:
                gone[i : i + window] = True
            seen.add(k)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def repeat_words(t: str | None, window: int = 8) -> int:
    w = words(t)
    keys = [tuple(w[i : i + window]) for i in range(len(w) - window + 1)]
    n = collections.Counter(keys)
    return len({i + j for i, k in enumerate(keys) if n[k] > 1 for j in range(window)})


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
