"""Personal data: base forms, and identifiers found by bootstrapped contexts.

1. Base spans (e-mail, IP, card, phone) are found in whole texts.  Each is a
   seed; the CONTEXT words before it and its kind are a pattern.
2. Patterns with at least SEEDS different seeds are looked up in all texts
   (through a fixed-size bitmap, then exactly): every identifier-like token
   or run of digit groups (joined by blanks, dots, hyphens, brackets) after
   such a context is an instance unless a base span covers it; each different
   word without a digit counts against the context, once like an instance.  A
   task folds these words over its whole partition into one row per context,
   the KEPT smallest of their hashes: a union of such rows counts exactly below
   KEPT different words and within some 1 / sqrt(KEPT) above.
3. On the graph of patterns and instances Spark repeats ROUNDS times:
   a pattern's score is the sum of its instances' scores over all it was seen
   with (+ 1); a new instance's score is 1 - prod(1 - score) of its patterns.
4. Instances after a pattern of ACCEPT or more are spans of its kind.

The two scans of the texts emit seeds, instances and counts only.

Defined cases: null and empty texts have no spans; rows that repeat an id are
told apart by their texts, equal ones get equal rows; offsets count code
points; very long runs are scanned in linear time.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import bitmap_of, in_bitmap, map_arrow, table
from feedloom.llm.words import Words, chunks, mix

# The kinds in order and their forms.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

CONTEXT = 2
SEEDS = 3
ROUNDS = 3
ACCEPT = 0.8
#: Smallest hashes that count a context's other words, and pairs that a task holds before it folds them.
KEPT = 256
HELD = 1 << 19
#: Digits from which a token looks like an identifier (as does one with @).
DIGITS = 5
#: Most digits of a run of several groups, and such a run (a group after a blank has two digits or more).
MOST_DIGITS = 19
_RUN = re.compile(rb"[0-9]++(?:(?:[.()-]{1,2}|[().-]?\x20[(]?(?=[0-9]{2}))[0-9]++(?![A-Za-z\x80-\xFF])){1,18}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @ (no local part or host holds one)."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > last and text[lo - 1] in _LOCAL_CHARS:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            out.append((lo, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base forms, by kind, then start."""
    out = [(0, s, e) for s, e in emails(text)]
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text)
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _interesting(w: Words, off: np.ndarray) -> np.ndarray:
    """Texts of a chunk that hold a digit or an @ at all."""
    marks = np.zeros(len(w.low) + 1, np.int64)
    np.cumsum(((w.low >= 48) & (w.low <= 57)) | (w.low == 64), out=marks[1:])
    return np.flatnonzero(np.diff(marks[off]))


def seeds(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: id, th (hash of its text), spans, and for each the context before it and its text."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            n = b.num_rows
            spans: list[list] = [[] for _ in range(n)]
            for lo, _, data, off in chunks(b.column(1)):
                w = Words(data, off)
                for i in _interesting(w, off).tolist():
                    text = b.column(1)[lo + i].as_py()
                    for kind, s, e in base_spans(text):
                        at = int(off[i]) + len(text[:s].encode())
                        k = int(np.searchsorted(w.end, at, "right"))  # the word that the span begins with, or is before
                        first = max(int(w.first[i]), k - CONTEXT)
                        full = k - first == CONTEXT
                        spans[lo + i].append({"kind": kind, "start": s, "end": e, "inst": text[s:e].lower(),
                                              "ctx": w.text(first, k) if full else None,
                                              "hash": int(w.grams(CONTEXT)[0][first].view(np.int64)) if full else None})
            kind_t = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
                                         ("inst", pa.string()), ("ctx", pa.string()), ("hash", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(spans, kind_t)], names=["id", "th", "spans"])

    return map_arrow(_keyed(docs, id_col, text_col), run, f"id {id_type}, th bigint, spans array<struct<"
                     "kind: int, start: int, end: int, inst: string, ctx: string, hash: bigint>>")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))


def smallest_words(ctx: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different (context, word hash) pairs, sorted, of each context the KEPT smallest hashes."""
    order = np.lexsort((word, ctx))
    ctx, word = ctx[order], word[order]
    new = np.ones(len(ctx), bool)
    new[1:] = (ctx[1:] != ctx[:-1]) | (word[1:] != word[:-1])
    ctx, word = ctx[new], word[new]
    rank = np.arange(len(ctx)) - np.searchsorted(ctx, ctx)
    return ctx[rank < KEPT], word[rank < KEPT]


def others_count(rows: DataFrame) -> DataFrame:
    """(hash, wrong): how many different words followed each context, from the tasks' rows (hash, words)."""
    def run(batches):
        held, words = None, np.zeros(0, np.uint64)

        def row():
            n = len(words)
            if n == KEPT:  # the KEPT-th smallest of the hashes, as a share of their range
                n = round((KEPT - 1) / ((float(words[-1]) + 1) / 2.0 ** 64))
            return pa.RecordBatch.from_pydict({"hash": pa.array([held], pa.int64()), "wrong": pa.array([n], pa.int64())})

        for b in batches:
            for h, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if h != held and held is not None:
                    yield row()
                    words = np.zeros(0, np.uint64)
                held, words = h, np.union1d(words, np.frombuffer(w, np.uint64))[:KEPT]
        if held is not None:
            yield row()

    return map_arrow(rows.repartition("hash").sortWithinPartitions("hash"), run, "hash bigint, wrong bigint")


def instances(docs: DataFrame, id_col: str, text_col: str, bitmap: np.ndarray) -> DataFrame:
    """After the contexts that the bitmap lets through: identifier-like tokens; and (with id null) a row per
    task and context, the smallest hashes of the other words."""
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    names = ["id", "th", "hash", "ctx", "inst", "start", "end", "words"]

    def run(batches):
        others, n_others = [], 0
        for b in batches:
            for lo, _, data, off in chunks(b.column(1)):
                w = Words(data, off)
                g, ok = w.grams(CONTEXT + 1)
                at = np.flatnonzero(ok)
                ctx = w.grams(CONTEXT)[0].view(np.int64)
                at = at[in_bitmap(shared.value, ctx[at])]
                digits = np.zeros(len(w.low) + 1, np.int64)
                np.cumsum((w.low >= 48) & (w.low <= 57), out=digits[1:])
                rows = []
                tok = at + CONTEXT
                # bytes up to the next white space, at most as far as the text goes
                stop = np.append(np.flatnonzero(np.isin(w.low, [9, 10, 11, 12, 13, 32])), len(w.low))
                end = np.minimum(stop[np.searchsorted(stop, w.start[tok])], off[1:][w.doc[tok]])
                has_at = np.zeros(len(w.low) + 1, np.int64)
                np.cumsum(w.low == 64, out=has_at[1:])
                begin, one, stops = w.start[tok], end, off[1:][w.doc[tok]]
                end = one.copy()
                held = data.tobytes()
                for k in np.flatnonzero((w.low[begin] >= 48) & (w.low[begin] <= 57)).tolist():
                    m = _RUN.match(held, int(begin[k]), int(stops[k]))
                    if m and m.end() > one[k] and digits[m.end()] - digits[m.start()] <= MOST_DIGITS:
                        end[k] = m.end()
                like = (digits[end] - digits[begin] >= DIGITS) | (has_at[one] > has_at[begin])
                for p, t, e in zip(at[like].tolist(), tok[like].tolist(), end[like].tolist(), strict=True):
                    d, s = int(w.doc[p]), int(w.start[t])
                    if s > off[d] and held[s - 1:s] == b"(" and held.find(b")", s, e) >= 0:
                        s -= 1
                    raw = data[s:e].tobytes().decode("utf-8", "replace").rstrip(".,;:!?)]}>\"'|*#$%&")
                    start = len(data[off[d]:s].tobytes().decode("utf-8", "replace"))
                    rows.append((d, int(ctx[p]), w.text(p, p + CONTEXT), raw.lower(), start, start + len(raw)))
                other = (digits[end] == digits[begin]) & ~like  # a few digits may be part of a number: neither
                others.append(smallest_words(ctx[at[other]], mix(w.hash[tok[other]])))
                n_others += len(others[-1][0])
                if n_others > HELD:
                    others = [smallest_words(*map(np.concatenate, zip(*others, strict=True)))]
                    n_others = len(others[0][0])
                pick = pa.array([lo + r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(pick), b.column(2).take(pick),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.string()),
                    pa.array([r[4] for r in rows], pa.int32()), pa.array([r[5] for r in rows], pa.int32()),
                    pa.nulls(len(rows), pa.binary())], names=names)
                id_arrow = b.column(0).type
        if n_others:
            c, h = smallest_words(*map(np.concatenate, zip(*others, strict=True)))
            at = np.append(np.flatnonzero(np.diff(c, prepend=c[0] - 1)), len(c))
            n = len(at) - 1
            yield pa.RecordBatch.from_arrays([
                pa.nulls(n, id_arrow), pa.nulls(n, pa.int64()), pa.array(c[at[:-1]], pa.int64()), pa.nulls(n, pa.string()),
                pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()),
                pa.array([h[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=names)

    return map_arrow(_keyed(docs, id_col, text_col), run, f"id {id_type}, th bigint, hash bigint, ctx string, "
                     "inst string, start int, end int, words binary")


def pattern_scores(known: DataFrame, seen: DataFrame, against: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(ctx, hash, kind, score) from (ctx, hash, kind, inst) seeds, (hash, ctx, inst) instances and (hash, wrong) counts.

    Every step is a join or a pre-aggregated sum over distinct edges.
    """
    patterns = known.groupBy("ctx", "hash", "kind").agg(F.count(F.lit(1)).alias("n_seeds")).where(f"n_seeds >= {SEEDS}")
    edges = (seen.join(patterns.select("ctx", "hash", "kind"), ["ctx", "hash"])
             .join(known.select("ctx", "hash", "inst", F.col("kind").alias("seed_kind")), ["ctx", "hash", "inst"], "left")
             .groupBy("ctx", "hash", "kind", "inst").agg(
                 F.max(F.expr("coalesce(seed_kind = kind, false)")).alias("own"),
                 F.max(F.expr("seed_kind IS NOT NULL AND seed_kind <> kind")).alias("other")))
    seeds_of = known.join(patterns.select("ctx", "hash", "kind"), ["ctx", "hash", "kind"]).select(
        "ctx", "hash", "kind", "inst", F.lit(True).alias("own"), F.lit(False).alias("other"))
    edges = table(edges.union(seeds_of).groupBy("ctx", "hash", "kind", "inst").agg(
        F.max("own").alias("own"), F.max("other").alias("other")))
    against = table(against.select("hash", "wrong"))
    scored = edges.withColumn("s", F.expr("IF(own, 1D, 0D)"))
    for _ in range(rounds):
        score = table(scored.groupBy("ctx", "hash", "kind").agg(F.sum("s").alias("good"), F.count(F.lit(1)).alias("n"))
                      .join(against, "hash", "left")
                      .withColumn("score", F.expr("good / (n + coalesce(wrong, 0) + 1D)")))
        inst = (edges.join(score.select("ctx", "hash", "kind", "score"), ["ctx", "hash", "kind"])
                .groupBy("kind", "inst").agg(F.expr("1D - exp(sum(ln(1D - score)))").alias("i")))
        scored = edges.join(inst, ["kind", "inst"], "left").withColumn(
            "s", F.expr("CASE WHEN own THEN 1D WHEN other THEN 0D ELSE coalesce(i, 0D) END"))
    return score.select("ctx", "hash", "kind", "score")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """(id, base, found): arrays of (kind, start, end), base ones and those the patterns add."""
    base = table(seeds(docs, id_col, text_col))
    known = table(base.select(F.explode("spans").alias("s")).select("s.*").where("ctx IS NOT NULL")
                  .select("ctx", "hash", "kind", "inst").distinct())
    common = known.groupBy("ctx", "hash", "kind").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {SEEDS}")
    got = table(instances(docs, id_col, text_col, bitmap_of(common, "hash")))
    spans = base.where("size(spans) > 0").select(F.col("id").alias("bid"), F.col("th").alias("bth"), "spans")
    seen = table(got.where("inst IS NOT NULL").join(spans, F.expr("id <=> bid AND th <=> bth"), "left").where(
        "spans IS NULL OR NOT exists(spans, s -> s.start < end AND start < s.end)").drop("bid", "bth", "spans"))
    scores = pattern_scores(known, seen.select("ctx", "hash", "inst").distinct(), 
                            others_count(got.where("words IS NOT NULL").select("hash", "words")))
    best = scores.where(f"score >= {accept}D").groupBy("ctx", "hash").agg(F.max_by("kind", "score").alias("kind"))
    found = (seen.join(best, ["ctx", "hash"]).select("id", "th", "kind", "start", "end").distinct()
             .groupBy(F.col("id").alias("fid"), F.col("th").alias("fth"))
             .agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("all")))
    j = base.join(found, F.expr("id <=> fid AND th <=> fth"), "left")
    plain = "transform(spans, s -> struct(s.kind AS kind, s.start AS start, s.end AS end))"
    return j.select("id", F.expr(plain).alias("base"), F.expr(
        "coalesce(all, filter(" + plain + ", s -> false))").alias("found"))


def _listed(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform(array_sort({spans}), s -> concat({names}[s.kind], ':', s.start, ':', s.end)), ',')"


def query(docs: DataFrame) -> DataFrame:
    p = personal_data(docs)
    return p.select(F.col("id").alias("doc_id"),
                    *[F.expr(f"CAST(size(filter(base, s -> s.kind = {i})) AS bigint)").alias(f"n_{k}")
                      for i, k in enumerate(KINDS)],
                    F.sha2(F.expr(_listed("base")), 256).alias("base_sha256"),
                    F.expr(_listed("concat(base, found)")).alias("spans"),
                    F.expr("CAST(size(found) AS bigint)").alias("n_found"))
