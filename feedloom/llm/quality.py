"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Words are the runs of letters and digits and the runs of other signs of a
text; a word in capitals and a word that repeats its predecessor are followed
by a marker word.  Words are hashed into BUCKETS.  A bucket has a fixed sparse
ternary index vector; its word vector is the sum of the index vectors of all
neighbours within WINDOW words, over all documents, made a unit vector with the
common part taken out, plus a share of its own index vector.  Integer sums, so
reruns agree.  A task adds up its own documents' sums and sends one row per
block of buckets; the table of vectors has a fixed size whatever the corpus.

A document is the mean of its words' vectors and the logarithm of their number.
A network (tanh layer, sigmoid) is fitted in numpy on a bounded sample of
labelled rows (``most`` in expectation, by a hash of the id); a fifth of it is
set aside and sets the temperature of the probabilities.  Everything else
covers all rows and whole texts.

Defined cases: null and empty texts have no words and get the score of a
document of none; labels count only as 0 or 1, and an id with both is learned
as both; rows that repeat an id are scored each by its text and learned as one;
a null id is never learned from and counts as held out; with no labels every
score is 0.5, with labels of one kind their smoothed share.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import IDS, broadcast_if_small, map_arrow, table
from feedloom.llm.words import LOWER, _powers, chunks, mix

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
DIM = 32
#: Non-zero places of an index vector.
SIGNS = 4
WINDOW = 3
#: Share of a bucket's own index vector in its word vector.
OWN = 0.5
#: Buckets whose sums travel in one row, and words whose vectors are held at once.
BLOCK, PIECE = 1024, 1 << 16
#: Expected labelled documents that the network is fitted on.
MOST_ROWS = 20_000
HIDDEN = 24
THRESHOLD = 0.7
FEATURES = DIM + 1

#: 0 blank, 1 letters and digits, 2 other signs.
KIND = np.full(256, 2, np.uint8)
KIND[0:33] = KIND[127] = 0
KIND[48:58] = KIND[65:91] = KIND[97:123] = KIND[128:] = 1
UPPER, SMALL = np.zeros(256, bool), np.zeros(256, bool)
UPPER[65:91] = SMALL[97:123] = True
CAPITALS, AGAIN = BUCKETS - 1, BUCKETS - 2


def index_vectors(seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIM), np.int8)
    places = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :SIGNS]
    out[np.arange(BUCKETS)[:, None], places] = rng.choice(np.array([-1, 1], np.int8), (BUCKETS, SIGNS))
    return out


def word_buckets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and markers of each text, end to end, and the texts' offsets."""
    kind, n = KIND[data], len(data)
    begin, end = kind > 0, kind > 0
    if n:
        cut = np.zeros(n, bool)
        cut[off[(off > 0) & (off < n)]] = True
        change = (kind[1:] != kind[:-1]) | cut[1:]
        begin[1:] &= change
        end[:-1] &= change
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = _powers(1 << max(19, int(n + 1).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = mix((sums[stop] - sums[start]) * down[start])

    def held(flags: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(flags[data])])
        return run[stop] - run[start]

    first = np.searchsorted(start, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    caps = (held(UPPER) >= 2) & (held(SMALL) == 0)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    size = 1 + caps.astype(np.int64) + again
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(at[-1]), np.int64)
    out[at[:-1]] = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) % AGAIN
    out[at[:-1][caps] + 1] = CAPITALS
    out[at[1:][again] - 1] = AGAIN
    return out, at[first]


def neighbour_sums(words: np.ndarray, first: np.ndarray, index: np.ndarray, total: np.ndarray) -> None:
    """Add to ``total`` (BUCKETS x DIM + 1) the neighbours' index vectors of each word, and its count."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for lo in range(0, len(words), PIECE):
        hi = min(len(words), lo + PIECE)
        a, b = max(0, lo - WINDOW), min(len(words), hi + WINDOW)
        vec, d = index[words[a:b]], doc[a:b]
        near = np.zeros((b - a, DIM + 1), np.int16)
        near[:, DIM] = 1
        for j in range(1, WINDOW + 1):
            same = (d[j:] == d[:-j])[:, None]
            near[:-j, :DIM] += vec[j:] * same
            near[j:, :DIM] += vec[:-j] * same
        own = words[lo:hi]
        order = np.argsort(own, kind="stable")
        at = np.flatnonzero(np.diff(own[order], prepend=-1))
        total[own[order][at]] += np.add.reduceat(near[lo - a:hi - a][order], at, axis=0, dtype=np.int64)


def context_sums(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The sums of all documents: fixed size, BUCKETS x (DIM + 1)."""
    def gather(batches):
        index, total = index_vectors(), np.zeros((BUCKETS, DIM + 1), np.int64)
        for b in batches:
            for _, _, data, off in chunks(b.column(0)):
                words, first = word_buckets(data, off)
                if len(words):
                    neighbour_sums(words, first, index, total)
        yield from rows_of(total)

    def rows_of(total):
        used = np.flatnonzero(total[:, DIM])
        for block in np.unique(used // BLOCK):
            own = used[used // BLOCK == block]
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([int(block)], pa.int32()), "ids": pa.array([own.astype(np.int32).tobytes()], pa.binary()),
                "sums": pa.array([total[own].tobytes()], pa.binary())})

    def add_up(batches):
        total = np.zeros((BUCKETS, DIM + 1), np.int64)
        for b in batches:
            for ids, sums in zip(b.column(1), b.column(2), strict=True):
                total[np.frombuffer(ids.as_buffer(), np.int32)] += np.frombuffer(sums.as_buffer(), np.int64).reshape(-1, DIM + 1)
        yield from rows_of(total)

    schema = "block int, ids binary, sums binary"
    parts = map_arrow(docs.select(F.col(text_col).alias("text")), gather, schema)
    got = map_arrow(parts.repartition("block"), add_up, schema).toArrow()
    total = np.zeros((BUCKETS, DIM + 1), np.int64)
    for ids, sums in zip(got["ids"], got["sums"], strict=True):
        total[np.frombuffer(ids.as_buffer(), np.int32)] = np.frombuffer(sums.as_buffer(), np.int64).reshape(-1, DIM + 1)
    return total


def word_vectors(total: np.ndarray) -> np.ndarray:
    """BUCKETS x DIM float32; a bucket without words has only its own index vector."""
    own = index_vectors().astype(np.float64) / np.sqrt(SIGNS)
    ctx, n = total[:, :DIM].astype(np.float64), total[:, DIM].astype(np.float64)
    size = np.linalg.norm(ctx, axis=1, keepdims=True)
    ctx = np.divide(ctx, size, out=np.zeros_like(ctx), where=size > 0)
    if n.sum():
        ctx = np.where(size > 0, ctx - (ctx * n[:, None]).sum(0) / n.sum(), 0)
    return (ctx + OWN * own).astype(np.float32)


def pooled(rows: DataFrame, vectors: np.ndarray, text_col: str = "text") -> DataFrame:
    """All columns of ``rows`` but the text under ``row``, with ``features`` (float32 bytes) of each text."""
    own = [c for c in rows.columns if c != text_col]
    keep = rows.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(text_col).alias("text"))
    schema = keep.schema["row"].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = []
            for lo, hi, data, off in chunks(b.column(1)):
                words, first = word_buckets(data, off)
                x = np.zeros((hi - lo, FEATURES))
                doc = np.repeat(np.arange(hi - lo), np.diff(first))
                for p in range(0, len(words), PIECE):
                    d = doc[p:p + PIECE]
                    at = np.flatnonzero(np.diff(d, prepend=-1))
                    x[d[at], :DIM] += np.add.reduceat(vectors[words[p:p + PIECE]], at, axis=0, dtype=np.float64)
                n = np.diff(first)
                x[:, :DIM] /= np.maximum(n, 1)[:, None]
                x[:, DIM] = np.log1p(n)
                out.extend(r.tobytes() for r in x.astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["row", "features"])

    return map_arrow(keep, run, f"row {schema}, features binary")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


@dataclass
class Network:
    """Two layers over standardised features; without weights the constant ``prior``."""
    prior: float = 0.5
    weights: tuple[np.ndarray, ...] | None = None
    centre: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((x - self.centre) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return sigmoid(self.logits(x) / self.temperature)


def train(x: np.ndarray, y: np.ndarray, steps: int = 6000, batch: int = 64, rate: float = 0.01, decay: float = 1e-4,
          seed: int = 5) -> Network:
    """Fit by mini-batch gradient descent (Adam); the order of the rows must be fixed."""
    if not len(y):
        return Network()
    prior = float((y.sum() + 1) / (len(y) + 2))
    if y.min() == y.max():
        return Network(prior)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    aside = order[: len(y) // 5] if len(y) >= 50 else order[:0]
    learn = order[len(aside):]
    net = Network(prior, None, x[learn].mean(0), x[learn].std(0) + 1e-6)
    w = [rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), np.zeros(HIDDEN),
         rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.array(np.log(prior / (1 - prior)))]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    z = (x - net.centre) / net.scale
    for step in range(1, steps + 1):
        ix = learn[rng.integers(0, len(learn), batch)]
        h = np.tanh(z[ix] @ w[0] + w[1])
        g = (sigmoid(h @ w[2] + w[3]) - y[ix]) / batch
        back = np.outer(g, w[2]) * (1 - h * h)
        for k, grad in enumerate((z[ix].T @ back + decay * w[0], back.sum(0), h.T @ g + decay * w[2], g.sum())):
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad * grad
            now = rate * (1 - (step - 1) / steps)
            w[k] = w[k] - now * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    net.weights = tuple(w)
    if len(aside):
        logit, t = net.logits(x[aside]), y[aside]
        # smoothed targets, so that an error-free fifth does not make every probability 0 or 1
        t = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))
        scales = np.geomspace(0.05, 20, 121)
        loss = [-(t * np.log(sigmoid(logit / s) + 1e-12) + (1 - t) * np.log(sigmoid(-logit / s) + 1e-12)).mean() for s in scales]
        net.temperature = float(scales[int(np.argmin(loss))])
    return net


def labelled_sample(features: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a bounded sample of rows not held out, in a fixed order."""
    known = table(labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("quality"))
                  .where("quality IN (0, 1) AND crc32(CAST(id AS string)) % 4 <> 2").distinct())
    n = known.count()
    chosen = known.where(f"crc32(concat('s', CAST(id AS string))) / 4294967296D < {most / max(1, n)}D")
    j = features.join(broadcast_if_small(chosen, IDS), F.col("row.doc_id") == F.col("id"))
    got = (j.groupBy("id", "quality").agg(F.min("features").alias("features"))
           .select(F.col("id").cast("string").alias("id"), "quality", "features").toArrow().sort_by(
               [("id", "ascending"), ("quality", "ascending")]))
    x = np.array([np.frombuffer(f.as_buffer(), np.float32) for f in got["features"]], np.float64)
    return x.reshape(-1, FEATURES), got["quality"].to_numpy().astype(np.float64)


def scored(features: DataFrame, net: Network) -> DataFrame:
    """``row`` and the score of each document."""
    schema = features.schema["row"].dataType.simpleString()

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b"".join(f.as_py() for f in b.column(1)), np.float32).reshape(-1, FEATURES)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(net.scores(x.astype(np.float64)), pa.float64())],
                                                 names=["row", "score"])

    return map_arrow(features.select("row", "features"), run, f"row {schema}, score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    texts = docs.select("doc_id", "text")
    features = table(pooled(texts, word_vectors(context_sums(texts))))
    net = train(*labelled_sample(features, labels))
    s = scored(features, net)
    return s.select(F.col("row.doc_id").alias("doc_id"),
                    F.expr("coalesce(crc32(CAST(row.doc_id AS string)) % 4 = 2, true)").alias("held_out"), "score",
                    F.expr(f"CAST(score >= {THRESHOLD}D AS int)").alias("predicted"))
