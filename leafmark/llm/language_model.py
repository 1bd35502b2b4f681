"""Language-model scores by deleted interpolation.

P(w | h) = a(h) c(h, w) / c(h) + b(h) c(w) / N + c(h) / (V + 1) with weights that sum to
1 and depend on the bucket (by powers of two) of the context's frequency c(h). The
training documents are split: counts from one part, and expectation-maximisation of the
weights on the counts of the part left out. The final scores take the counts of all.

Counts of the whole corpus are never in one place: batches of documents send their
different n-grams to hashed buckets and get the sums back (see ``batches``). N-grams are told apart by 64-bit
hashes.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .batches import batched, bound, bound2, rows_of, unpacked
from .common import stored

FOLDS = 5
HELD_OUT = 1
#: The training fold whose counts the weights are learned on.
LEFT_OUT = 4
END = np.uint64(0x632BE59BD9B4E019)
START = np.uint64(0x2545F4914F6CDD1D)
#: N-grams in a bucket, about.
BUCKET_KEYS = 1_000_000
CACHE_WORDS = 120_000
#: Bins an octave of a probability, for the expectation-maximisation.
BINS = 4
SENT = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("words", pa.binary()), ("word_counts", pa.binary()), ("pairs", pa.binary()), ("pair_counts", pa.binary())])
TOTALS = pa.schema([("batch", pa.int32()), ("bucket", pa.int32()), ("words", pa.binary()), ("pairs", pa.binary()), ("vocabulary", pa.int64()), ("counted", pa.int64()), ("left_out", pa.int64())])
BINNED = pa.schema([("bucket", pa.int32()), ("bin2", pa.int32()), ("bin1", pa.int32()), ("n", pa.int64()), ("p2", pa.float64()), ("p1", pa.float64())])
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
DDL = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.float64(): "double", pa.bool_(): "boolean"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {DDL[f.type]}" for f in schema)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


@lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


def fold(doc_id: int | None) -> int:
    """crc32 of the id as text, by 5; a null id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def fold_column(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


class Grams:
    """The words and word pairs of a batch: different ones in ascending order, and where each token finds its own."""

    def __init__(self, ids: list[int | None], texts: list[bytes]):
        known = _words()
        get = known.__getitem__
        parts = []
        for t in texts:
            words = t.lower().split()
            parts += [np.fromiter(map(get, words), np.uint64, len(words)), np.array([END])]
        token = np.concatenate(parts)
        self.sizes = np.array([len(p) + 1 for p in parts[::2]])
        del parts
        if len(known) > CACHE_WORDS:
            known.clear()
        begin = np.cumsum(self.sizes) - self.sizes
        context = np.concatenate([[START], token[:-1]])
        context[begin] = START
        folds = np.array([fold(i) for i in ids])
        self.folds = folds
        of = np.repeat(folds, self.sizes)
        left, counted = of == LEFT_OUT, (of != LEFT_OUT) & (of != HELD_OUT)
        # what follows START is counted as a word of its own, so that START has a frequency as a context
        self.words, self.word_at = np.unique(np.concatenate([token, [START]]), return_inverse=True)
        self.start_at, self.word_at = self.word_at[-1], self.word_at[:-1]
        self.context_at = np.concatenate([[self.start_at], self.word_at[:-1]])
        self.context_at[begin] = self.start_at
        self.pairs, self.pair_at = np.unique(_mix(context * np.uint64(0x9E3779B97F4A7C15) ^ token), return_inverse=True)
        count = lambda at, n, which: np.bincount(at[which], minlength=n).astype(np.uint32)
        self.word_counts = np.stack([count(self.word_at, len(self.words), w) for w in (counted, left)], axis=1)
        self.word_counts[self.start_at] = [(folds[folds != HELD_OUT] != LEFT_OUT).sum(), (folds == LEFT_OUT).sum()]
        self.pair_counts = np.stack([count(self.pair_at, len(self.pairs), w) for w in (counted, left)], axis=1)

    def cuts(self, keys: np.ndarray, buckets: int) -> np.ndarray:
        """Where each bucket's keys begin; buckets are ranges of the hash."""
        bounds = np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)
        return np.concatenate([np.searchsorted(keys, bounds), [len(keys)]])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def packed(counts: np.ndarray) -> bytes:
    """Counts, most of them small, in little space."""
    return zstandard.compress(np.ascontiguousarray(counts).tobytes(), 1)


def unpacked_counts(parts: list[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(map(zstandard.decompress, parts)), kind).reshape(-1, 2)


def _send(table: pa.Table, buckets: int) -> pa.Table:
    g = Grams(*unpacked(table))
    batch = table.column("batch")[0].as_py()
    w, p = g.cuts(g.words, buckets), g.cuts(g.pairs, buckets)
    rows = [
        (b, batch, g.words[w[b]:w[b + 1]].tobytes(), packed(g.word_counts[w[b]:w[b + 1]]), g.pairs[p[b]:p[b + 1]].tobytes(), packed(g.pair_counts[p[b]:p[b + 1]]))
        for b in range(buckets) if w[b] < w[b + 1] or p[b] < p[b + 1]
    ]
    return rows_of(SENT, list(zip(*rows)))


def _summed(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    lists = [np.frombuffer(k, np.uint64) for k in keys]
    unique, at = np.unique(np.concatenate(lists), return_inverse=True)
    each = unpacked_counts(counts, np.uint32)
    total = np.stack([np.bincount(at, each[:, i], len(unique)) for i in (0, 1)], axis=1).astype(np.uint64)
    return unique, total, np.split(at, np.cumsum([len(x) for x in lists])[:-1])


def _total(table: pa.Table) -> pa.Table:
    c = {n: table.column(n).to_pylist() for n in table.column_names}
    words, word_total, word_at = _summed(c["words"], c["word_counts"])
    _, pair_total, pair_at = _summed(c["pairs"], c["pair_counts"])
    real = words != START
    sums = (int((word_total[real].sum(axis=1) > 0).sum()), int(word_total[real, 0].sum()), int(word_total[real, 1].sum()))
    rows = [
        (batch, bucket, packed(word_total[w]), packed(pair_total[p]), *(sums if i == 0 else (0, 0, 0)))
        for i, (batch, bucket, w, p) in enumerate(zip(c["batch"], c["bucket"], word_at, pair_at))
    ]
    return rows_of(TOTALS, list(zip(*rows)))


def _looked_up(docs: pa.Table, totals: pa.Table) -> tuple[list[int | None], Grams, np.ndarray, np.ndarray]:
    """The batch's grams with the corpus counts (counted part, part left out) of its words and pairs."""
    ids, texts = unpacked(docs)
    g = Grams(ids, texts)
    totals = totals.sort_by("bucket")
    return ids, g, *(unpacked_counts(totals.column(c).to_pylist(), np.uint64) for c in ("words", "pairs"))


def context_bucket(n: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the whole part of log2."""
    return np.frexp(n.astype(np.float64))[1].astype(np.int64)


def _binned(docs: pa.Table, totals: pa.Table, counted: int) -> pa.Table:
    """Held-out tokens by context bucket and by the size of their estimates from the counted part."""
    if not docs.num_rows:
        return rows_of(BINNED, [[]] * 6)
    _, g, words, pairs = _looked_up(docs, totals)
    c2, c1, ch = pairs[g.pair_at, 0].astype(float), words[g.word_at, 0].astype(float), words[g.context_at, 0].astype(float)
    p2, p1 = c2 / np.maximum(ch, 1), c1 / max(counted, 1)
    size = lambda p: np.where(p > 0, 1 + np.floor(-BINS * np.log2(np.where(p > 0, p, 1))), 0).astype(np.int64)
    b2, b1 = size(p2), size(p1)
    kinds, at = np.unique((context_bucket(ch) * 1024 + b2) * 1024 + b1, return_inverse=True)
    return rows_of(BINNED, [kinds >> 20, (kinds >> 10) & 1023, kinds & 1023, np.bincount(at), np.bincount(at, p2), np.bincount(at, p1)])


def learn_weights(rows: list[tuple[int, int, float, float]], vocabulary: int, rounds: int = 200) -> np.ndarray:
    """Expectation-maximisation of the three weights for each context bucket from ``(bucket, n, p2, p1)``; (64, 3).

    A bucket without held-out tokens has the weights of the nearest lower one that has
    some. An unseen context has no weight on pairs.
    """
    out = np.zeros((64, 3))
    last = np.array([0.0, 0.9, 0.1])
    for b in range(64):
        own = np.array([r[1:] for r in rows if r[0] == b], float).reshape(-1, 3)
        if len(own):
            n, p = own[:, 0], np.stack([own[:, 1], own[:, 2], np.full(len(own), 1 / (vocabulary + 1))], axis=1)
            w = np.array([0.0, 0.5, 0.5]) if b == 0 else np.array([0.4, 0.4, 0.2])
            for _ in range(rounds):
                share = w * p
                new = (n[:, None] * share / share.sum(axis=1, keepdims=True)).sum(axis=0) / n.sum()
                done = np.abs(new - w).max() < 1e-7
                w = new
                if done:
                    break
            # no token is impossible, even if none of the part left out was new
            last = np.maximum(w, [0.0 if b == 0 else 1e-6, 1e-6, 1e-6])
            last = last / last.sum()
        out[b] = last
    return out


def _scored(docs: pa.Table, totals: pa.Table, tokens: int, vocabulary: int, weights: np.ndarray) -> pa.Table:
    if not docs.num_rows:
        return rows_of(SCORES, [[]] * 6)
    ids, g, words, pairs = _looked_up(docs, totals)
    words, pairs = words.sum(axis=1).astype(float), pairs.sum(axis=1).astype(float)
    c1, ch = words[g.word_at], words[g.context_at]
    w = weights[context_bucket(ch)]
    p = w[:, 0] * pairs[g.pair_at] / np.maximum(ch, 1) + w[:, 1] * c1 / max(tokens, 1) + w[:, 2] / (vocabulary + 1)
    begin = np.cumsum(g.sizes) - g.sizes
    each = lambda x: np.add.reduceat(x, begin)
    base = np.log10((c1 + 0.5) / (tokens + 0.5 * (vocabulary + 1)))
    return rows_of(SCORES, [ids, g.folds == HELD_OUT, g.sizes, each((c1 > 0).astype(np.int64)), each(base), each(np.log10(p))])


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Whole texts; null texts are empty and have the end token only. A null id is a training document.
    Repeated rows count and are scored as often as they occur. Without any training document
    the model is uniform over the end token and one unknown word.
    """
    texts, _, size = batched(docs, id_col, text_col, apart=lambda i: fold_column(i) == LEFT_OUT)
    buckets = max(1, size // (6 * BUCKET_KEYS))
    groups = texts.groupBy("batch")
    sent = groups.applyInArrow(bound(_send, buckets=buckets), ddl(SENT))
    totals = stored(sent.groupBy("bucket").applyInArrow(_total, ddl(TOTALS)), "gram-totals")
    sums = totals.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("vocabulary", "counted", "left_out")]).first()
    held = texts.where("batch < 0").groupBy("batch").cogroup(totals.where("batch < 0").groupBy("batch")).applyInArrow(bound2(_binned, counted=sums["counted"]), ddl(BINNED))
    # bounded: context buckets times bins, whatever the corpus
    bins = held.groupBy("bucket", "bin2", "bin1").agg(F.sum("n").alias("n"), F.sum("p2").alias("p2"), F.sum("p1").alias("p1")).collect()
    weights = learn_weights([(r["bucket"], r["n"], r["p2"] / r["n"], r["p1"] / r["n"]) for r in bins], sums["vocabulary"])
    tokens = sums["counted"] + sums["left_out"]
    scored = groups.cogroup(totals.groupBy("batch")).applyInArrow(bound2(_scored, tokens=tokens, vocabulary=sums["vocabulary"], weights=weights), ddl(SCORES))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
