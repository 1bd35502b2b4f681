"""Plain single-machine forms of what the operators compute."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import xxhash


def rows(folder: str, table: str) -> list[dict]:
    return pq.read_table(f"{folder}/{table}.parquet").to_pylist()


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def fingerprint(text) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def connected(ids: list, linked) -> dict:
    """Smallest id reachable, by plain search; ``linked(i)`` gives neighbours' positions."""
    root: dict[int, int] = {}
    for start in sorted(range(len(ids)), key=lambda i: ids[i]):
        if start in root:
            continue
        todo = [start]
        root[start] = ids[start]
        while todo:
            for j in linked(todo.pop()):
                if j not in root:
                    root[j] = ids[start]
                    todo.append(j)
    return root


def removed(docs: list[tuple[int, bytes]], length: int) -> dict[int, tuple[int, int, int, str]]:
    low: dict[bytes, int] = {}
    for i, t in docs:
        for j in range(len(t) - length + 1):
            w = t[j:j + length]
            low[w] = min(low.get(w, i), i)
    out = {}
    for i, t in docs:
        gone = np.zeros(len(t) + 1, bool)
        for j in range(len(t) - length + 1):
            if low[t[j:j + length]] < i:
                gone[j:j + length] = True
        gone = gone[:len(t)]
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def unigram_scores(docs: list[tuple[int, str]]) -> dict[int, tuple]:
    words = {i: [*(t or "").encode().lower().split(), None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs}
    count = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    return {i: (held[i], len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in words.items()}


def smith_waterman(a, b) -> int:
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())
