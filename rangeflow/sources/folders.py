"""Mounted folders of many files: told one after the other and listed in files, so the driver holds no list that grows with them."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import batched
from urllib.parse import unquote, urlparse

#: Threads that name and open files on the driver, and how many files they are handed at once.
THREADS, CHUNK = 16, 4096


def local_path(path: str) -> str:
    """The path in this machine's file system of a plain path or ``file:`` address."""
    at = urlparse(path)
    if at.scheme not in ("", "file"):
        raise ValueError(f"logs are opened by name and {path} is in no mounted folder; read_messages takes logs of any store")
    return unquote(at.path) if at.scheme else path


def is_local(path: str) -> bool:
    """Whether a path is in this machine's file system, be it there or not."""
    return urlparse(path).scheme in ("", "file")


def walked(root: str, names: tuple[str, ...], follow: bool = False) -> Iterator[str]:
    """Files below a folder whose names end so, in the order of ``place``; hidden folders are left out."""
    for folder, below, found in os.walk(root, followlinks=follow):
        below[:] = sorted(d for d in below if d[:1] not in "._")
        yield from (os.path.join(folder, n) for n in sorted(found) if n.endswith(names))


def place(path: str) -> list[tuple[int, str]]:
    """The order of ``walked``: a folder's files, then the folders in it."""
    *folders, name = path.split("/")
    return [*((1, d) for d in folders), (0, name)]


def in_chunks(f: Callable, items: Iterable) -> Iterator:
    """``f`` of each item in order, by threads; few items are held at once."""
    with ThreadPoolExecutor(THREADS) as pool:
        for some in batched(items, CHUNK):
            yield from pool.map(f, some)


def put_lines(path: str, rows: Iterable) -> None:
    """Write rows as lines of JSON; the file appears whole."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "w", encoding="ascii") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")
    os.replace(part, path)


def lines(path: str, start: int = 0, stop: int | None = None) -> Iterator:
    """Rows of ``put_lines`` from one byte to another."""
    with open(path, "rb") as f:
        f.seek(start)
        at = start
        while (stop is None or at < stop) and (line := f.readline()):
            at += len(line)
            yield json.loads(line)
