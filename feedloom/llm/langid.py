"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's letters (bytes, A-Z lower-cased, anything that is no letter taken as
one blank) give its subwords: all runs of ORDERS bytes.  Each is hashed into
one of BUCKETS embeddings; their average goes through a linear softmax.  Both
are trained by mini-batch stochastic gradient descent in numpy on a bounded
sample of labelled rows (``per_lang`` in expectation for each language, fewer
if there are many languages, chosen by a hash of the id); every labelled
language is learned.  A fifth of the sample is set aside: it fits the
temperature that calibrates the probabilities, and the least probability that
accepts at ``precision``; below it a text is rejected.

A probability only compares the learned languages, so a text must also fit the
one it is given: the mean log frequency of its subwords in that language's
sampled rows.  The least fit is set against real negatives: sampled rows by
the languages that are not their own (as if theirs had never been labelled),
and runs of random letters.  Every row is held against the counts of the
others, so this needs no fifth and works on small samples too.

Prediction is a table look-up: embedding times weights gives each bucket K
numbers, of which a text has the mean; the fit is one more look-up.  Whole texts are read.

Defined cases: null texts and texts without a letter are ``und`` (rejected,
score 0); with no labelled row every text is ``und``; rows with null lang are
never learned from; repeated rows get equal results; a null id is never
learned from and counts as held out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import broadcast_if_small, map_arrow, table
from feedloom.llm.words import LOWER, chunks

ORDERS = (2, 3, 4)
BUCKETS = 1 << 15
DIM = 8
#: Expected labelled documents taken per language, and in all; then the languages' shares shrink, down to LEAST_ROWS each.
PER_LANG = 700
MOST_ROWS = 20_000
LEAST_ROWS = 20
PRECISION = 0.95
#: Least probability that is accepted, in multiples of chance: texts that mix languages are unsure, but not rejected.
CHANCE = 1.2
#: Subwords of typical fit that each text is credited with, so that a few odd ones reject no short text.
CREDIT = 10
#: Count that each bucket has in each language beforehand.
SMOOTH = 0.5
#: Most sampled rows that set the least fit, and the number and length of the random texts.
FIT_ROWS, NOISE, NOISE_LETTERS = 4000, 200, 300

IS_LETTER = np.zeros(256, bool)
IS_LETTER[97:123] = IS_LETTER[128:] = True
LETTER = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"


def subwords(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword of each text, end to end, and the texts' offsets."""
    low = LOWER[data]
    low = np.where(IS_LETTER[low], low, np.uint8(32))
    low = np.insert(low, off, np.uint8(32))  # a blank before each text and after the last
    at = off + np.arange(len(off))
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    first = np.zeros(len(low) + 1, np.int64)
    np.cumsum(keep, out=first[1:])
    b = np.append(low[keep], np.full(max(ORDERS), 32, np.uint8)).astype(np.uint32)
    n = int(first[-1])
    # a text's subwords begin from its own leading blank (or the one it shares) up to the next text's
    edge = np.maximum(first[at + 1] - 1, 0)
    doc = np.searchsorted(edge, np.arange(n), "right") - 1
    ids, docs = [], []
    for k in ORDERS:
        v = np.zeros(n, np.uint32)
        for j in range(k):
            v = (v << np.uint32(8)) | b[j:n + j]
        v = (v + np.uint32(k)) * np.uint32(0x9E3779B1)
        inside = (doc >= 0) & (doc < len(off) - 1)
        inside &= np.arange(n) + k <= edge[np.minimum(doc + 1, len(off) - 1)] + 1
        ids.append((v >> np.uint32(32 - BUCKETS.bit_length() + 1))[inside])
        docs.append(doc[inside])
    ids, docs = np.concatenate(ids), np.concatenate(docs)
    order = np.argsort(docs, kind="stable")
    return ids[order].astype(np.int64), np.searchsorted(docs[order], np.arange(len(off)))


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x K: embedding times weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    frequency: np.ndarray | None = None  # BUCKETS x K: log frequencies
    typical: float = 0.0
    least_fit: float = -np.inf

    def fits(self, ids: np.ndarray, first: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Whether each text's subwords are those of its class."""
        n = np.diff(first)
        if self.frequency is None:
            return n > 0
        run = np.concatenate([[0.0], np.cumsum(self.frequency[ids, np.repeat(best, n)], dtype=np.float64)])
        return (n > 0) & (credited(run[first[1:]] - run[first[:-1]], n, self.typical) >= self.least_fit)

    def predict(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best class (-1: no subword) and its calibrated probability for each text."""
        n = np.diff(first)
        sums = np.zeros((len(n), len(self.langs)))
        some = np.flatnonzero(n > 0)
        if len(some):
            for c in range(len(self.langs)):
                run = np.concatenate([[0.0], np.cumsum(self.table[ids, c], dtype=np.float64)])
                sums[:, c] = run[first[1:]] - run[first[:-1]]
        z = (sums / np.maximum(n, 1)[:, None] + self.bias) / self.temperature
        p = softmax(z)
        best = p.argmax(1)
        return np.where(n > 0, best, -1), np.where(n > 0, p[np.arange(len(n)), best], 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def credited(sums: np.ndarray, n: np.ndarray, typical: float) -> np.ndarray:
    return (sums + CREDIT * typical) / (n + CREDIT)


def set_least_fit(model: Model, rows: list[tuple[str, np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 7) -> None:
    """Log frequencies, and the fit that best parts the rows from rows of unlearned languages and random letters."""
    k, rng = len(model.langs), np.random.default_rng(seed)
    count = np.zeros((BUCKETS, k), np.float32)
    for c, (_, b, m) in zip(y, rows, strict=True):
        count[b, c] += m
    total = count.sum(0, dtype=np.float64) + SMOOTH * BUCKETS
    model.frequency = (np.log(count + SMOOTH) - np.log(total)).astype(np.float32)
    own, other, n = [], [], []
    for i in np.sort(rng.permutation(len(rows))[:FIT_ROWS]):
        _, b, m = rows[i]
        size = m.sum()
        # by the counts of the other rows alone
        own.append(float(m @ (np.log(count[b, y[i]] - m + SMOOTH) - np.log(total[y[i]] - size))))
        other.append(float(np.delete(m @ model.frequency[b], y[i]).max()) if k > 1 else np.nan)
        n.append(size)
    own, other, n = np.array(own), np.array(other), np.array(n)
    model.typical = float(np.median(own / n))
    noise = b"abcdefghijklmnopqrstuvwxyz    "
    data = np.frombuffer(noise, np.uint8)[rng.integers(0, len(noise), NOISE * NOISE_LETTERS)]
    ids, first = subwords(data, np.arange(NOISE + 1) * NOISE_LETTERS)
    wild = np.array([model.frequency[ids[lo:hi]].sum(0, dtype=np.float64).max() for lo, hi in zip(first, first[1:], strict=False)])
    good = np.sort(credited(own, n, model.typical))
    bad = [np.sort(credited(wild, np.diff(first), model.typical))]
    if k > 1:
        bad.append(np.sort(credited(other, n, model.typical)))
    # the share of rows kept and of each kind of negatives rejected count alike; within a gap its middle is taken
    at = np.unique(np.concatenate([good, *bad]))
    kept = 1 - np.searchsorted(good, at, "left") / len(good)
    gain = kept + np.mean([np.searchsorted(b, at, "left") / len(b) for b in bad], axis=0)
    best = int(np.flatnonzero(gain == gain.max())[-1])
    model.least_fit = float((at[best] + at[max(0, best - 1)]) / 2)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], steps: int = 1500, batch: int = 16, rate: float = 2.0,
          precision: float = PRECISION, seed: int = 7) -> Model | None:
    """Fit on (lang, distinct buckets, their counts); the order of ``rows`` must be fixed."""
    langs = sorted({r[0] for r in rows})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    y = np.array([langs.index(r[0]) for r in rows])
    weight = [(r[2] / r[2].sum()).astype(np.float32) for r in rows]
    emb = rng.uniform(-1, 1, (BUCKETS, DIM)).astype(np.float32) / DIM
    out, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    order = rng.permutation(len(rows))
    aside = order[: len(rows) // 5] if len(rows) >= 20 * len(langs) else order[:0]
    learn = order[len(aside):]

    def averages(ix):
        starts = np.cumsum([0] + [len(weight[i]) for i in ix])[:-1]
        idx, w = np.concatenate([rows[i][1] for i in ix]), np.concatenate([weight[i] for i in ix])
        return idx, w, np.add.reduceat(emb[idx] * w[:, None], starts, axis=0)

    epochs = max(1, -(-steps * batch // max(1, len(learn))))  # about as many steps however few the rows are
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        rng.shuffle(learn)
        for lo in range(0, len(learn), batch):
            ix = learn[lo:lo + batch]
            idx, w, x = averages(ix)
            g = softmax(x @ out + bias)
            g[np.arange(len(ix)), y[ix]] -= 1
            g = (g / len(ix)).astype(np.float32)
            back = g @ out.T
            out -= step * (x.T @ g)
            bias -= step * 0.1 * g.sum(0)
            of = np.repeat(np.arange(len(ix)), [len(weight[i]) for i in ix])
            # a bucket's share of one text is small, so its own step is larger
            np.subtract.at(emb, idx, (50 * step) * w[:, None] * back[of])
    model = Model(langs, emb @ out, bias.astype(np.float64))
    set_least_fit(model, rows, y, seed)
    if len(aside):
        z = np.vstack([averages([i])[2] @ out + bias for i in aside]).astype(np.float64)
        t = y[aside]
        scale = np.geomspace(0.02, 20, 61)
        # smoothed targets, so that an error-free fifth does not make every probability 1
        hit, miss = (len(t) + 1) / (len(t) + 2), 1 / (len(t) + 2)
        best = [softmax(z / s)[np.arange(len(t)), t] for s in scale]
        loss = [-(hit * np.log(b + 1e-12) + miss * np.log(1 - b + 1e-12)).mean() for b in best]
        model.temperature = float(scale[int(np.argmin(loss))])
        p = softmax(z / model.temperature)
        conf, right = p.max(1), p.argmax(1) == t
        down = np.argsort(-conf, kind="stable")
        good = np.cumsum(right[down]) / np.arange(1, len(t) + 1) >= precision
        if not good[-1]:
            model.threshold = float(conf[down][np.flatnonzero(good)[-1]]) if good.any() else 1.0
        model.threshold = max(model.threshold, min(0.5, CHANCE / len(langs)))  # and never near chance
    return model


def labelled_sample(docs: DataFrame, per_lang: int = PER_LANG) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Bucket counts of a bounded sample of rows not held out, with a lang; the same rows on every run."""
    known = docs.select("doc_id", "text", "lang").where(
        "lang IS NOT NULL AND text IS NOT NULL AND crc32(CAST(doc_id AS string)) % 5 <> 0")
    n = table(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    langs = n.count()
    if not langs:
        return []
    each = min(per_lang, max(LEAST_ROWS, MOST_ROWS // langs))
    rates = broadcast_if_small(n.select("lang", F.expr(f"{each}D / n").alias("rate")))
    chosen = known.join(rates, "lang").where("crc32(concat('s', CAST(doc_id AS string))) / 4294967296D < rate")

    def run(batches):
        for b in batches:
            for lo, hi, data, off in chunks(b.column(1)):
                ids, first = subwords(data, off)
                got = [np.unique(ids[first[i]:first[i + 1]], return_counts=True) for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo),
                    pa.array([u.astype(np.int32) for u, _ in got], pa.list_(pa.int32())),
                    pa.array([c.astype(np.int32) for _, c in got], pa.list_(pa.int32()))],
                    names=["id", "lang", "buckets", "counts"])

    got = map_arrow(chosen.select(F.col("doc_id").cast("string"), "text", "lang"), run,
                    "id string, lang string, buckets array<int>, counts array<int>").toArrow()
    rows = sorted(zip(got["id"].to_pylist(), got["lang"].to_pylist(), range(got.num_rows), strict=True))
    # views of the Arrow buffers, so that the sample is held once
    b, c = got["buckets"].combine_chunks(), got["counts"].combine_chunks()
    rows = [(lang, b[i].values.to_numpy(), c[i].values.to_numpy()) for _, lang, i in rows]
    return [r for r in rows if len(r[1])]


def predicted(rows: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All columns of ``rows`` under ``row``, with lang_pred, score and accepted."""
    keep = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(text_col).alias("text"))
    schema = keep.schema["row"].dataType.simpleString()

    def run(batches):
        for b in batches:
            lang, score, ok = [], [], []
            for lo, hi, data, off in chunks(b.column(1)):
                best, p, fits = np.full(hi - lo, -1), np.zeros(hi - lo), np.zeros(hi - lo, bool)
                if model is not None:
                    ids, first = subwords(data, off)
                    best, p = model.predict(ids, first)
                    fits = model.fits(ids, first, best)
                for i, (k, s, f) in enumerate(zip(best.tolist(), p.tolist(), fits.tolist(), strict=True)):
                    t = b.column(1)[lo + i].as_py()
                    if k < 0 or t is None or not LETTER.search(t):
                        k, s = -1, 0.0
                    lang.append(model.langs[k] if k >= 0 else UNDETERMINED)
                    score.append(min(1.0, s))
                    ok.append(k >= 0 and f and s >= model.threshold)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(ok, pa.bool_())], names=["row", "lang_pred", "score", "accepted"])

    return map_arrow(keep, run, f"row {schema}, lang_pred string, score double, accepted boolean")


def fitted(docs: DataFrame) -> Model | None:
    return train(labelled_sample(docs))


def query(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, accepted."""
    p = predicted(docs.select("doc_id", "text"), fitted(docs))
    return p.select(F.col("row.doc_id").alias("doc_id"),
                    F.expr("coalesce(crc32(CAST(row.doc_id AS string)) % 5 = 0, true)").alias("held_out"),
                    "lang_pred", "score", "accepted")


def recognised(docs: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, all their columns."""
    return predicted(docs, fitted(docs)).where("accepted").select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns])
