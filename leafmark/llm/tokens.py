"""Whole-text encoding with a public tokenizer, with a bounded cache of words.

The tokenizer drops white space and never merges across it, so the ids of a text
are those of its pieces between spaces and line feeds, one after another. Pieces
seen before come from the cache; new ones are given to the library together.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np

#: Pieces in each of the two generations of a worker's cache; what is dropped is encoded again when it comes back.
CACHE_PIECES = 450_000
#: A line of Latin letters in lower case and symbols that never join a letter before them in one token; else nothing.
LETTERS = re.compile(r"^(?:([a-zß-öø-ÿ]+)([.,!?*$%&#|;:]*)|.*)$", re.M)
WORDS_A_CALL = 200
CHARACTERS_A_GROUP = 4_000_000


class WordEncoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes, as ``Tokenizer.encode(text, add_special_tokens=False)`` would."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same model for words that the normal form leaves as they are, without its bookkeeping
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _library(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _take(self, words: list[str]) -> None:
        """Puts words as the tokenizer has them, one token run each, into the cache."""
        for i in range(0, len(words), WORDS_A_CALL):
            some = words[i:i + WORDS_A_CALL]
            ids = np.array(self.words.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) == len(some) and stops[-1] == 4 * len(ids):
                raw = ids.tobytes()
                self.cache.update(zip(some, map(raw.__getitem__, map(slice, [0, *stops], stops))))
            else:
                self.cache.update((w, self._library(w)) for w in some)

    def _learn(self, pieces: set[str]) -> None:
        """Puts the pieces into the cache.

        A piece of Latin letters and symbols after them is its letters in lower case, which
        have no other normal form, and its symbols; any other goes to the library as it is.
        """
        cache, older = self.cache, self.older
        known = [p for p in pieces if p in older]
        cache.update(zip(known, map(older.__getitem__, known)))
        pieces = list(pieces.difference(known))
        # one line a piece; a letter of another script may change its length, but no line end
        parts = LETTERS.findall("\n".join(pieces).lower()) if pieces else []
        bases, tails = {b for b, _ in parts}.difference(cache), {t for _, t in parts}.difference(cache)
        known = [p for p in bases if p in older]
        cache.update(zip(known, map(older.__getitem__, known)))
        self._take(list(bases.difference(known, ("",))))
        cache[""] = b""
        cache.update((tail, self._library(tail)) for tail in tails if tail)
        cache.update((piece, cache[base] + cache[tail] if base else self._library(piece)) for piece, (base, tail) in zip(pieces, parts))

    def encode(self, texts) -> list[bytes]:
        out: list[bytes] = []
        group: list[list[str]] = []
        held = 0
        for text in texts:
            group.append((text or "").replace("\n", " ").split(" "))
            held += len(text or "")
            if held > CHARACTERS_A_GROUP:
                out += self._encode(group)
                group, held = [], 0
        return out + self._encode(group)

    def _encode(self, group: list[list[str]]) -> list[bytes]:
        if len(self.cache) > CACHE_PIECES:
            self.older, self.cache = self.cache, {}
        flat = [p for pieces in group for p in pieces]
        found = list(map(self.cache.get, flat))
        missing = [i for i, v in enumerate(found) if v is None]
        if missing:
            self._learn({flat[i] for i in missing})
            for i in missing:
                found[i] = self.cache[flat[i]]
        out, at = [], 0
        for pieces in group:
            out.append(b"".join(found[at:at + len(pieces)]))
            at += len(pieces)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder a worker and vocabulary."""
    return WordEncoder(path)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
