"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Tokens are runs of letters, runs of digits and single other signs of the lower-cased text, hashed into
``buckets``. Every bucket has a sparse ternary index vector, made from its number. A bucket's word
vector is the sum of the index vectors of its tokens' neighbours over the whole corpus: each task
adds up its own part, and an aggregate by bucket (combined before the shuffle) adds the parts. The
table of vectors has ``buckets`` x ``DIM`` numbers whatever the corpus, which bounds what is
collected and broadcast. A document is the mean and the spread of its words' vectors, and the logarithm of their number.

The network is fitted on at most ``max_train_rows`` labelled documents (those of least hash of the
id), and a temperature on a fifth of them, which the network doesn't learn from, makes its scores probabilities. Labels are learned only from
rows whose crc32(id as text) mod 5 is not 0.

Defined results: null and empty texts are scored like any (as no words); a null id is not held out
and teaches nothing; labels of one document are averaged, null labels ignored; without labels, or with labels of one
kind only, every score is the mean label (0.5 without any). Repeated rows are scored each; of the texts of one
labelled id the one of least hash teaches. Ids may be of any type that casts to a string. Other columns are ignored. A very
long text is tokenised whole, in memory that is a multiple of its size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.shared import materialise
from emberlog.llm.words import WordHashes, slices, word_slices

DIM = 32
NONZERO = 4
FEATURES = 2 * DIM + 1
FOLDS = 5
THRESHOLD = 0.3

#: Characters whose word vectors are laid out at a time: 32 floats a token, twice.
POOL_CHARS = 300_000
_TOKEN = re.compile(rb"[a-z\x80-\xff]+|[0-9]+|[^\s]")
_U = np.uint64


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def index_vectors(buckets: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the NONZERO entries of every bucket's index vector."""
    rng = np.random.default_rng(seed)
    places = np.argsort(rng.random((buckets, DIM)), axis=1)[:, :NONZERO]
    return places, rng.choice(np.array([-1, 1]), (buckets, NONZERO))


def tokens(texts: list[str | None], buckets: int, seen: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all tokens of the texts in a row, and the n + 1 places where texts start and end."""
    found: list[bytes] = []
    ends = [0]
    for t in texts:
        if t:
            found += _TOKEN.findall(t.encode().lower())
        ends.append(len(found))
    return (seen.of(found) % _U(buckets)).astype(np.int64), np.array(ends, np.int64)


def _neighbours(buckets: int, seed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, (places, signs) = WordHashes(2), index_vectors(buckets, seed)
    sums = np.zeros(buckets * DIM, np.int64)
    for batch in batches:
        for part in slices(batch, 0):
            at, ends = tokens(part.column(0).to_pylist(), buckets, seen)
            if len(at) < 2:
                continue
            within = np.ones(len(at) - 1, bool)
            within[ends[(ends > 0) & (ends < len(at))] - 1] = False
            left, right = at[:-1][within], at[1:][within]
            for a, b in ((left, right), (right, left)):
                for k in range(NONZERO):
                    sums += np.bincount(a * DIM + places[b, k], weights=signs[b, k], minlength=len(sums)).astype(np.int64)
    table = sums.reshape(buckets, DIM)
    some = np.flatnonzero(table.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(table[some, d]) for d in range(DIM))], names=["bucket", *(f"v{d}" for d in range(DIM))])


def word_vectors(docs: DataFrame, text: str, buckets: int, seed: int) -> np.ndarray:
    """The random-indexing table over all documents, each row at unit length (buckets x DIM; zero where no word is)."""
    schema = ", ".join(["bucket long", *(f"v{d} long" for d in range(DIM))])
    parts = docs.select(F.col(text)).mapInArrow(lambda it: _neighbours(buckets, seed, it), schema)
    rows = parts.groupBy("bucket").agg(*(F.sum(f"v{d}").alias(f"v{d}") for d in range(DIM))).toPandas()
    table = np.zeros((buckets, DIM), np.float64)
    if len(rows):
        table[rows["bucket"].to_numpy()] = rows.drop(columns="bucket").to_numpy(np.float64)
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled_all(texts: list[str | None], table: np.ndarray, seen: WordHashes, limit: int = POOL_CHARS) -> np.ndarray:
    """``pooled`` of any number of texts of any length: ``limit`` characters at a time, and a longer text by sums over its slices."""
    out, group, size = [np.zeros((0, FEATURES), np.float32)], [], 0
    for t in texts:
        n = len(t or "")
        if group and (size + n > limit or len(group) == 64):
            out.append(pooled(group, table, seen))
            group, size = [], 0
        if n > limit:
            out.append(_pooled_long(t, table, seen, limit))
            continue
        group.append(t)
        size += n
    return np.concatenate([*out, pooled(group, table, seen)]) if group else np.concatenate(out)


def _pooled_long(text: str, table: np.ndarray, seen: WordHashes, limit: int) -> np.ndarray:
    n, total, squares = 0, np.zeros(DIM), np.zeros(DIM)
    for words in word_slices(text, limit):
        at, _ = tokens([b" ".join(words).decode()], len(table), seen)
        for start in range(0, len(at), limit):
            vectors = table[at[start : start + limit]]
            total += vectors.sum(axis=0, dtype=np.float64)
            squares += (vectors * vectors).sum(axis=0, dtype=np.float64)
        n += len(at)
    out = np.zeros((1, FEATURES), np.float32)
    out[0, -1] = np.log1p(n) / 4
    if n:
        mean = total / n
        out[0, :DIM], out[0, DIM : 2 * DIM] = mean, np.sqrt(np.maximum(squares / n - mean * mean, 0))
    return out


def pooled(texts: list[str | None], table: np.ndarray, seen: WordHashes) -> np.ndarray:
    """Mean, spread and log number of the word vectors of each text."""
    at, ends = tokens(texts, len(table), seen)
    n = np.diff(ends)
    out = np.zeros((len(texts), FEATURES), np.float32)
    out[:, -1] = np.log1p(n) / 4
    some = np.flatnonzero(n > 0)
    if len(some):
        vectors = table[at]
        mean = np.add.reduceat(vectors, ends[some], axis=0) / n[some, None]
        square = np.add.reduceat(vectors * vectors, ends[some], axis=0) / n[some, None]
        out[some, :DIM] = mean
        out[some, DIM : 2 * DIM] = np.sqrt(np.maximum(square - mean * mean, 0))
    return out


class Model(NamedTuple):
    table: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.centre) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit(table: np.ndarray, x: np.ndarray, y: np.ndarray, check: np.ndarray, *, hidden: int = 32, epochs: int = 60, seed: int = 7) -> Model:
    """Two layers by Adam on the rows that ``check`` does not mark; the epoch and the temperature of least loss on those it marks."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.array(np.log(y.mean() / (1 - y.mean())))]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    z = (x - centre) / scale
    xt, yt = z[~check], y[~check]
    xc, yc = z[check], y[check]
    run = lambda q, a: np.maximum(a @ q[0] + q[1], 0) @ q[2] + q[3]
    best, step = (np.inf, p), 0
    for _ in range(epochs):
        order = rng.permutation(len(xt))
        for i in range(0, len(order), 256):
            a, t = xt[order[i : i + 256]], yt[order[i : i + 256]]
            h = np.maximum(a @ p[0] + p[1], 0)
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - t) / len(t)
            back = np.outer(g, p[2]) * (h > 0)
            grads = [a.T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ g + 1e-4 * p[2], g.sum()]
            step += 1
            for k, d in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                p[k] = p[k] - 3e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        if (now := _loss(run(p, xc), yc)) < best[0]:
            best = now, [q.copy() for q in p]
    p = best[1]
    temperatures = np.exp(np.linspace(-1.5, 1.5, 61))
    temperature = float(min(temperatures, key=lambda t: _loss(run(p, xc) / t, yc)))
    return Model(table, centre, scale, p[0], p[1], p[2], float(p[3]), temperature)


def train(docs: DataFrame, labels: DataFrame, *, max_train_rows: int = 20_000, buckets: int = 1 << 14, seed: int = 7, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model | float:
    """The fitted model, or a constant score if the labels can't teach one."""
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    known = known.groupBy(F.col(doc_id).cast("string").alias("l_id")).agg((F.avg(F.col(label)) >= 0.5).cast("int").alias("y"))
    sample = materialise(known.orderBy(F.xxhash64("l_id"), "l_id").limit(max_train_rows), "sample")
    table = word_vectors(docs, text, buckets, seed)
    broadcast = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("array<float>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen = WordHashes(2)
        for s in batches:
            yield pd.Series(list(pooled_all(list(s), broadcast.value, seen)), dtype=object)

    # The sample has max_train_rows rows at most, so it may be broadcast.
    taught = docs.select(F.col(doc_id).cast("string").alias("d"), F.col(text).alias("t"), F.xxhash64(text).alias("tie")).join(F.broadcast(sample), F.col("d") == F.col("l_id"))
    one = taught.select("d", "y", "tie", features("t").alias("x")).groupBy("d", "y").agg(F.min(F.struct("tie", "x")).alias("one"))
    rows = one.select("d", "y", F.col("one.x").alias("x")).toPandas().sort_values("d")
    if not len(rows) or rows["y"].nunique() < 2:
        return float(rows["y"].mean()) if len(rows) else 0.5
    check = np.random.default_rng(seed).permutation(len(rows)) % 5 == 0  # one row at least, as there are two or more
    return fit(table, np.stack(rows["x"].to_numpy()).astype(np.float64), rows["y"].to_numpy(np.float64), check, seed=seed)


def score(docs: DataFrame, model: Model | float, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per document."""
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen = WordHashes(2)
        for s in batches:
            if isinstance(m := broadcast.value, float):
                yield pd.Series(np.full(len(s), m))
                continue
            yield pd.Series(m.scores(pooled_all(list(s), m.table, seen).astype(np.float64)))

    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), scored(F.col(text)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    names = {k: options[k] for k in ("doc_id", "text") if k in options}
    return score(docs, train(docs, labels, **options), **names)
