"""Quality classifier by co-training on two views of a document.

The text view sees the content only, the metadata view everything but the content (length,
language, source). Both are logistic regressions, first fitted on the labelled documents. Each round both
score all unlabelled documents, and each is fitted again on the labelled ones and on those that
the other is sure of, weighted so that they never outweigh the labels. At the end each view is calibrated
on one half of the labelled documents kept aside, and a regression on the other half combines the two.

A document is fit if its quality is 1 and it isn't toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from .batches import slices
from .common import stored

#: Labelled documents that are learned from at most: those with the smallest hashes of their ids.
LABELLED = 20_000
#: Words and word beginnings that tell, at most; in so many labelled documents at least.
TELLING, TELLING_DOCS, TELLING_Z = 2_000, 8, 2.0
#: Toxic words are told apart from the rest by so large a log-odds ratio at least.
TELLING_ODDS = 3.0
ROUNDS = 3
#: Steps of a fit at most; each is a job over all rows learned from.
STEPS = 20
SURE = 0.97
#: Share of the labelled documents kept aside for calibration.
ASIDE = 4
SOURCES = 32
LANGUAGES = 8
WORD_BYTES = bytes.maketrans(bytes(range(65, 91)) + bytes(c for c in range(33, 127) if not chr(c).isalnum()), bytes(range(97, 123)) + b" " * 32)
#: Classes of bytes whose shares of a text are features.
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b"|", b"!?", b"*$%&#@~^_=+<>{}[]\\/", b".,;:", b"\"'()-"]
IN_CLASS = np.stack([np.isin(np.arange(256), list(c)) for c in CLASSES] + [np.arange(256) >= 128]).astype(np.float64)
TEXT_FEATURES = len(IN_CLASS) + 10
METADATA_FEATURES = 4 + SOURCES + LANGUAGES


def tokens_of(raw: bytes) -> set[bytes]:
    """Lower-cased words, and their first five letters with a mark."""
    words = set(raw.translate(WORD_BYTES).split())
    return words | {w[:5] + b"~" for w in words if len(w) > 5}


def text_features(text: str | None, telling: dict[bytes, float]) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    shares = IN_CLASS @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / max(1, len(raw))
    words = raw.translate(WORD_BYTES).split()
    different = set(words)
    n = max(1, len(words))
    again = sum(map(bytes.__eq__, words, words[1:])) / n
    lines = raw.split(b"\n")
    weights = [v for v in map(telling.get, different | {w[:5] + b"~" for w in different if len(w) > 5}) if v is not None]
    bad = sorted((v for v in weights if v > 0), reverse=True)
    return [*np.sqrt(shares), np.log1p(len(raw)), np.log1p(len(words)), len(different) / n, np.sqrt(again), 1 - len(set(lines)) / len(lines), min(30.0, len(raw) / n), float(min(5, len(bad))), sum(bad[:3]), float(min(5, len(weights) - len(bad))), float(not words)]


def metadata_features(lang: str | None, source: str | None, chars: int | None) -> list[float]:
    one = lambda value, n: [float(i == (n - 1 if value is None else xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass"), 3) % (n - 1))) for i in range(n)]
    size = float(np.log1p(max(0, chars or 0)))
    return [size, float(size < 4), float(size > 10), float(chars is None), *one(lang, LANGUAGES), *one(source, SOURCES)]


@dataclass
class Model:
    """What scoring needs: two linear views, their calibrations and the combination."""

    telling: dict[bytes, float] = field(default_factory=dict)
    text: np.ndarray = field(default_factory=lambda: np.zeros(TEXT_FEATURES + 1))
    metadata: np.ndarray = field(default_factory=lambda: np.zeros(METADATA_FEATURES + 1))
    calibration: tuple[tuple[float, float], tuple[float, float]] = ((1.0, 0.0), (1.0, 0.0))
    combined: tuple[float, float, float] = (1.0, 1.0, 0.0)
    least: float = 0.5

    def score(self, text: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of being fit: by the text, by the metadata, by both."""
        logits = [x @ w[:-1] + w[-1] for x, w in ((text, self.text), (metadata, self.metadata))]
        a, b = ((s * z + c) for z, (s, c) in zip(logits, self.calibration))
        both = self.combined[0] * a + self.combined[1] * b + self.combined[2]
        return tuple(1 / (1 + np.exp(-np.clip(z, -50, 50))) for z in (a, b, both))


def _columns(batch: pa.RecordBatch, at: dict[str, int | None]) -> tuple[list, list, list, list]:
    get = lambda c: [None] * batch.num_rows if at[c] is None else batch.column(at[c]).to_pylist()
    return get("text"), get("lang"), get("source"), get("n_chars")


def _features(batch: pa.RecordBatch, at: dict[str, int | None], telling: dict[bytes, float]) -> tuple[np.ndarray, np.ndarray]:
    texts, langs, sources, chars = _columns(batch, at)
    return (
        np.array([text_features(t, telling) for t in texts]).reshape(-1, TEXT_FEATURES),
        np.array([metadata_features(*m) for m in zip(langs, sources, chars)]).reshape(-1, METADATA_FEATURES),
    )


def _places(docs: DataFrame) -> dict[str, int | None]:
    return {c: docs.columns.index(c) if c in docs.columns else None for c in ("text", "lang", "source", "n_chars")}


def _feature_rows(telling):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text, metadata = _features(batch, {"text": 1, "lang": 2, "source": 3, "n_chars": 4}, telling.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(text.astype(np.float32)), pa.list_(pa.float32())), pa.array(list(metadata.astype(np.float32)), pa.list_(pa.float32()))], names=["doc_id", "t", "m"])

    return run


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [[w.decode("utf-8", "replace") for w in tokens_of((t or "").encode("utf-8", "surrogatepass"))] for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), batch.column(1)], names=["tokens", "bad"])


def _telling_words(labelled: DataFrame) -> dict[bytes, float]:
    """Words and word beginnings that come far more often in documents that aren't fit, or that are, by labelled documents; the log-odds ratios."""
    totals = labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    n1, n0 = totals["bad"], totals["n"] - totals["bad"]
    if not n0 or not n1:
        return {}
    counts = labelled.select("text", "bad").mapInArrow(_token_rows, "tokens array<string>, bad int").select(F.explode("tokens").alias("token"), "bad").groupBy("token").agg(F.sum("bad").alias("a"), F.sum(1 - F.col("bad")).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (n1 - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (n0 - F.col("b") + 0.5))
    z = odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    rows = counts.where(F.col("a") + F.col("b") >= TELLING_DOCS).select("token", odds.alias("odds"), z.alias("z")).where((F.abs("odds") >= TELLING_ODDS) & (F.abs("z") >= TELLING_Z)).orderBy(F.abs("z").desc(), "token").limit(TELLING).collect()
    return {r["token"].encode(): float(r["odds"]) for r in rows}


def _fit(rows: DataFrame, view: str, width: int, regularised: float = 1e-4) -> np.ndarray:
    """Weights and intercept of a logistic regression on ``view``, ``good`` and ``weight``; constant if only one class is there."""
    seen = {r["good"]: r["w"] for r in rows.groupBy("good").agg(F.sum("weight").alias("w")).collect()}
    if len(seen) < 2:
        return np.concatenate([np.zeros(width), [0.0 if not seen else 5.0 if 1 in seen else -5.0]])
    data = rows.select(array_to_vector(F.col(view).cast("array<double>")).alias("features"), F.col("good").cast("double").alias("label"), "weight")
    model = LogisticRegression(maxIter=STEPS, regParam=regularised, weightCol="weight").fit(data)
    return np.concatenate([model.coefficients.toArray(), [model.intercept]])


def _logit(view: str, w: np.ndarray) -> Column:
    """The linear score as a column."""
    products = F.zip_with(F.col(view).cast("array<double>"), F.array(*map(F.lit, w[:-1].tolist())), lambda x, y: x * y)
    return F.aggregate(products, F.lit(float(w[-1])), lambda s, x: s + x)


def _calibrate(x: np.ndarray, y: np.ndarray, columns: int) -> np.ndarray:
    """A small logistic regression by Newton steps: slopes and intercept."""
    x = np.concatenate([x.reshape(len(y), columns), np.ones((len(y), 1))], axis=1)
    prior = np.array([1.0] * columns + [0.0])
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + np.eye(columns + 1) * 0.1
        step = np.linalg.solve(h, x.T @ (p - y) + 0.1 * (w - prior))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, labelled: int = LABELLED) -> Model:
    """Co-trains on ``docs(doc_id, text[, lang, source, n_chars])`` and ``labels(doc_id, quality, toxic)``.

    At most ``labelled`` labels are learned from; all documents without one are candidates
    for pseudo-labels. A null quality is no label, a null toxic is 0, repeated labels are
    one (the worst). Without labels the model accepts every document. An empty table of documents
    teaches nothing beyond that. Which labels are taken depends on hashes of their ids alone, so repeated
    rows and ties change nothing.
    """
    spark = docs.sparkSession
    column = lambda c, t: (F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c)
    rows = docs.select(column("doc_id", "long"), column("text", "string"), column("lang", "string"), column("source", "string"), column("n_chars", "long"))
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("good"))
    # at most `labelled` rows of two numbers
    sample = stored(known.orderBy(F.xxhash64("label_id"), "label_id").limit(labelled), "label-sample")
    aside = F.pmod(F.xxhash64("label_id", F.lit(1)), F.lit(ASIDE)) == 0
    told = rows.join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))
    telling = _telling_words(told.where(~aside).select("text", (1 - F.col("good")).alias("bad")))
    features = stored(rows.mapInArrow(_feature_rows(spark.sparkContext.broadcast(telling)), "doc_id long, t array<float>, m array<float>"), "quality-features")
    marked = features.join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"), "left").withColumn("aside", aside)
    base = marked.where("good is not null and not aside").withColumn("weight", F.lit(1.0))
    rest = marked.where("good is null")
    model = Model(telling=telling)
    if not sample.count():
        model.combined = (0.0, 0.0, 5.0)
        return model
    n_base = base.count()
    logit_sure = float(np.log(SURE / (1 - SURE)))
    model.text, model.metadata = _fit(base, "t", TEXT_FEATURES), _fit(base, "m", METADATA_FEATURES, 1e-2)
    for _ in range(rounds):
        taught = {}
        for pupil, teacher, w in (("m", "t", model.text), ("t", "m", model.metadata)):
            sure = rest.withColumn("z", _logit(teacher, w)).where(F.abs("z") >= logit_sure).withColumn("good", (F.col("z") > 0).cast("int"))
            n = sure.count()
            taught[pupil] = base.unionByName(sure.withColumn("weight", F.lit(min(0.5, 0.5 * n_base / n) if n else 0.0)).drop("z")) if n else base
        model.text, model.metadata = _fit(taught["t"], "t", TEXT_FEATURES), _fit(taught["m"], "m", METADATA_FEATURES, 1e-2)
    # at most `labelled` rows of four numbers
    held = marked.where("good is not null and aside").select(_logit("t", model.text).alias("a"), _logit("m", model.metadata).alias("b"), "good", (F.pmod(F.xxhash64("label_id", F.lit(2)), F.lit(2)) == 0).alias("half")).collect()
    if held:
        a, b, y, half = (np.array([float(r[c]) for r in held]) for c in ("a", "b", "good", "half"))
        one, other = half == 1, half == 0
        if len(set(y[one])) < 2 or len(set(y[other])) < 2:  # too few for halves
            one = other = np.ones(len(y), bool)
        model.calibration = tuple(tuple(float(v) for v in _calibrate(np.clip(x[one], -20, 20), y[one], 1)) for x in (a, b))
        z = np.stack([s * x + c for x, (s, c) in zip((a, b), model.calibration)], axis=1)
        model.combined = tuple(float(v) for v in _calibrate(np.clip(z[other], -20, 20), y[other], 2))
    return model


def _scored(model, at: dict[str, int | None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in slices(batches):
            scores = m.score(*_features(batch, at, m.telling))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, scores), pa.array(scores[2] >= m.least)], names=["doc_id", "text_score", "metadata_score", "score", "accepted"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, text_score, metadata_score, score, accepted`` of every row; null and empty texts are scored like any other.

    One row each, repeats too; other columns don't come along. An empty table gives no rows.
    A score of exactly the least one is accepted.
    """
    column = lambda c, t: (F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c)
    rows = docs.select(column("doc_id", "long"), column("text", "string"), column("lang", "string"), column("source", "string"), column("n_chars", "long"))
    return rows.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model), {"text": 1, "lang": 2, "source": 3, "n_chars": 4}), "doc_id long, text_score double, metadata_score double, score double, accepted boolean")


def _accepted(model, at: dict[str, int | None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in slices(batches):
            yield batch.filter(pa.array(m.score(*_features(batch, at, m.telling))[2] >= m.least))

    return run


def keep_accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, whatever their names, that the model accepts; repeated rows share their fate, an empty table stays empty."""
    return docs.mapInArrow(_accepted(docs.sparkSession.sparkContext.broadcast(model), _places(docs)), docs.schema)
