"""Edit-aware token counts: a segment tree of pre-token runs per document.

The pattern of pre-tokens is that of the byte-level vocabularies: an optional space and letters, digits or
other symbols, contractions, white space. A document is cut into leaves of whole pre-tokens; a leaf keeps its characters' and
tokens' numbers, inner nodes their sums. An edit re-encodes the leaves that it touches, and a neighbour
where the edit reaches a leaf's edge and the pre-tokens there may join, and updates
the sums on the way to the root. The rest of the text is not encoded again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

#: Characters of a leaf, about.
LEAF = 512
#: Where a pre-token ends whatever follows, and the next one begins: before a space or line feed after
#: another character; between letters, digits and other symbols, but after an apostrophe, which may join letters.
CUT = regex.compile(r"\S(?=[ \n])|\p{L}(?=[^\s\p{L}])|\p{N}(?=[^\s\p{N}])|[^\s\p{L}\p{N}'](?=[\p{L}\p{N}])")
TREE = "struct<width: int, chars: array<int>, tokens: array<int>>"
EDITS = "array<struct<pos: int, remove: int, insert: string>>"
COUNTS = "struct<n_tokens: long, n_tokens_edited: long, reencoded_chars: long, n_leaves: int>"


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    """The public byte-level vocabulary at ``path``, once a worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def joined_bytes(path: str, pattern: str) -> frozenset[int]:
    """Pairs of bytes next to each other in a token; between any others nothing ever merges."""
    return frozenset(a << 8 | b for t in encoding(path, pattern).token_byte_values() for a, b in zip(t, t[1:]))


def separate(a: str, b: str, joined: frozenset[int] = frozenset()) -> bool:
    """Whether no token reaches from the character ``a`` to ``b`` after it, whatever stands around them.

    Two letters are apart where ``joined`` is given and lacks the bytes that meet there.
    """
    if CUT.match(a + b):
        return True
    return bool(joined) and a.isalpha() and b.isalpha() and (a.encode("utf-8", "surrogatepass")[-1] << 8 | b.encode("utf-8", "surrogatepass")[0]) not in joined


def leaves_of(text: str, size: int = LEAF, joined: frozenset[int] = frozenset()) -> list[str]:
    """Consecutive parts of about ``size`` characters that no token crosses: whole pre-tokens, and parts of long runs of letters."""
    out, at = [], 0
    while at < len(text):
        begin = min(len(text), at + size - 1)
        found = CUT.search(text, begin, min(len(text), begin + size))
        stop = found.end() if found else next((i for i in range(begin + 1, min(len(text), begin + size)) if separate(text[i - 1], text[i], joined)), None)
        if stop is None:
            found = CUT.search(text, min(len(text), begin + size - 1))
            stop = found.end() if found else len(text)
        out.append(text[at:stop])
        at = stop
    return out


class SegmentTree:
    """Leaves with sums of characters and tokens; node i has the children 2i and 2i + 1."""

    def __init__(self, leaves: list[str], count, tokens: list[int] | None = None, joined: frozenset[int] = frozenset()):
        self.leaves, self.count, self.joined = list(leaves), count, joined
        self.tokens_of = list(tokens) if tokens is not None else [count(x) for x in leaves]
        self._sum_up()

    def _sum_up(self) -> None:
        self.width = 1
        while self.width < len(self.leaves):
            self.width *= 2
        self.chars, self.tokens = ([0] * (2 * self.width) for _ in range(2))
        for i, (leaf, n) in enumerate(zip(self.leaves, self.tokens_of)):
            self.chars[self.width + i], self.tokens[self.width + i] = len(leaf), n
        for sums in (self.chars, self.tokens):
            for i in range(self.width - 1, 0, -1):
                sums[i] = sums[2 * i] + sums[2 * i + 1]

    def locate(self, pos: int) -> tuple[int, int]:
        """The leaf with the character at ``pos`` (the last with characters, for the end), and its start."""
        if not self.chars[1]:
            return 0, 0
        pos, node, start = min(pos, self.chars[1] - 1), 1, 0
        while node < self.width:
            node *= 2
            if pos - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.width, start

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf], self.tokens_of[leaf] = text, tokens
        for sums, new in ((self.chars, len(text)), (self.tokens, tokens)):
            node = self.width + leaf
            change = new - sums[node]
            while node and change:
                sums[node] += change
                node //= 2

    def _next(self, leaf: int, step: int) -> int | None:
        leaf += step
        while 0 <= leaf < len(self.leaves) and not self.leaves[leaf]:
            leaf += step
        return leaf if 0 <= leaf < len(self.leaves) else None

    def edit(self, pos: int, remove: int, insert: str) -> int:
        """Replaces ``remove`` characters at ``pos`` (both brought into the text); the number of characters encoded again."""
        if not self.leaves:
            self.leaves, self.tokens_of = [""], [0]
            self._sum_up()
        pos = max(0, min(pos, self.chars[1]))
        remove = max(0, min(remove, self.chars[1] - pos))
        first, start = self.locate(pos)
        last = self.locate(pos + remove)[0] if remove else first
        text = "".join(self.leaves[first:last + 1])
        text = text[: pos - start] + insert + text[pos - start + remove:]
        while (before := self._next(first, -1)) is not None and not (text and separate(self.leaves[before][-1], text[0], self.joined)):
            text, first = self.leaves[before] + text, before
        while (after := self._next(last, 1)) is not None and not (text and separate(text[-1], self.leaves[after][0], self.joined)):
            text, last = text + self.leaves[after], after
        if len(text) > 4 * LEAF and len(parts := leaves_of(text, LEAF, self.joined)) > last - first + 1:
            self.leaves[first:last + 1] = parts
            self.tokens_of[first:last + 1] = [self.count(x) for x in parts]
            self._sum_up()
        else:
            self._set(first, text, self.count(text))
            for leaf in range(first + 1, last + 1):
                self._set(leaf, "", 0)
        return len(text)


def _counter(path: str, pattern: str):
    encode = encoding(path, pattern).encode_ordinary
    return lambda text: len(encode(text))


def _trees(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, joined = _counter(path, pattern), joined_bytes(path, pattern)
        for batch in batches:
            trees = [SegmentTree(leaves_of(t or "", LEAF, joined), count) for t in batch.column(0).to_pylist()]
            yield batch.append_column("tree", pa.array([{"width": t.width, "chars": t.chars, "tokens": t.tokens} for t in trees], pa.struct([("width", pa.int32()), ("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])))

    return run


def _edited(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, joined = _counter(path, pattern), joined_bytes(path, pattern)
        for batch in batches:
            out = []
            for text, tree, edits in zip(batch.column("text").to_pylist(), batch.column("tree").to_pylist(), batch.column("edits").to_pylist()):
                text, width, leaves, at = text or "", tree["width"], [], 0
                for n in tree["chars"][width:]:
                    leaves.append(text[at:at + n])
                    at += n
                t = SegmentTree(leaves, count, tree["tokens"][width:], joined)
                before = t.tokens[1]
                again = sum(t.edit(e["pos"] or 0, e["remove"] or 0, e["insert"] or "") for e in edits or [] if e)
                out.append({"n_tokens": before, "n_tokens_edited": t.tokens[1], "reencoded_chars": again, "n_leaves": sum(map(bool, t.leaves))})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.struct([("n_tokens", pa.int64()), ("n_tokens_edited", pa.int64()), ("reencoded_chars", pa.int64()), ("n_leaves", pa.int32())]))], names=["doc_id", "counts"])

    return run


def build_trees(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text, doc_id, tree`` of every row; a null or empty text has an empty tree, repeated rows a tree each; an empty table gives no rows."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    return rows.mapInArrow(_trees(path, pattern), f"text string, doc_id long, tree {TREE}")


def count_after_edits(trees: DataFrame, edits: Column, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, n_tokens_edited, reencoded_chars, n_leaves``: counts before and after ``edits``.

    ``edits`` is an array of ``(pos, remove, insert)``, applied one after another, each to the text that the
    one before left. Positions past the end mean the end; nulls mean 0, nothing and no edit.
    """
    rows = trees.select("text", "doc_id", "tree", edits.cast(EDITS).alias("edits"))
    return rows.mapInArrow(_edited(path, pattern), f"doc_id long, counts {COUNTS}").select("doc_id", "counts.*")
