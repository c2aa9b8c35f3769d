"""Filter audit, quality classifier and Merkle manifest against brute force."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np

from feedloom.llm import filter_audit, merkle, quality
from feedloom.llm.common import read

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"


def fails_of(docs):
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = {}
    for i, t, lang, *_ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {f for f, bad in (("A", len(w) < 100), ("B", 100 * len(set(w)) < 80 * len(w)),
                                ("C", 100 * len(re.findall("[A-Z]", t)) > 10 * len(t)), ("D", bool(re.search(r"[#$%&*|]", t))),
                                ("E", i is not None and first[t] < i)) if bad}
        out.setdefault((lang or "", i), set()).update(own)
    return out


def audited(docs, labels):
    fails = fails_of(docs)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    rows = {}
    for part in {p for p, _ in fails}:
        own = {i: f for (p, i), f in fails.items() if p == part}
        for order in permutations("ABCDE"):
            alive = set(own)
            for n, f in enumerate(order):
                gone = {i for i in alive if f in own[i]}
                redundant = sum(f in x for x in own.values()) - len(gone)
                alive -= gone
                rows[part, "".join(order), n + 1] = [len(alive), len(gone), redundant, sum(x == {f} for x in own.values()),
                                                     len(gone & good), len(gone & toxic)]
        for f in "ABCDE":
            total = sum(v[1] for (p, o, s), v in rows.items() if p == part and o[s - 1] == f)
            for (p, o, s), v in rows.items():
                if p == part and o[s - 1] == f:
                    v.append(total)
    return rows


def test_audit_against_all_orders(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "GAMMA", "d#lta", "eps|lon", "zeta", "eta x", "été"]
    docs = [(i, " ".join(rng.choice(words[: rng.choice((2, 3, 8))]) + str(rng.randrange(rng.choice((3, 900))))
                         for _ in range(rng.choice((0, 3, 99, 100, 150)))), rng.choice(("en", "de", None, "")), None, 1)
            for i in range(160)]
    docs += [(200 + i, docs[i % 7][1], "en", "s", 1) for i in range(60)]  # copies
    docs += [(300, None, "fr", "s", None), (301, "", "fr", "s", 0), (302, "x " * 4000, "fr", "s", 1), (5, "again", "en", "s", 1),
             (None, "no id", "en", "s", 1), (None, None, "en", "s", 1), (303, " \t\x0b ", "fr", "s", 1)]
    docs += [docs[3], docs[-1]]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(250)]
    labels += [(7, 1, 1), (7, 0, 0), (None, 1, 1), (9999, 1, 1)]
    d = spark.createDataFrame(docs, DOCS)
    clashing = d.selectExpr("*", "1 AS part", "2 AS id", "3 AS filter", "4 AS words", "5 AS A")
    want = audited(docs, labels)
    for rows in (d, clashing):
        got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in (
            "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
            for r in filter_audit.query(rows, spark.createDataFrame(labels, LABELS)).collect()}
        assert got == want
    empty = filter_audit.query(d, spark.createDataFrame([], LABELS)).collect()
    assert len(empty) == len(want) and all(r["good_lost"] == r["toxic_lost"] == 0 for r in empty)
    assert filter_audit.query(d.limit(0), spark.createDataFrame(labels, LABELS)).collect() == []


def test_audit_of_other_filters(spark):
    people = spark.createDataFrame([("p", i) for i in range(10)], "part string, id int")
    relations = {"X": people.where("id < 4"), "Y": people.where("id % 2 = 0").union(people.where("id = 0")), "Z": people.limit(0)}
    got = filter_audit.audit(people, filter_audit.store(relations), "XYZ", spark.createDataFrame([], "id int, label string"))
    rows = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"])
            for r in got.collect()}
    assert len(rows) == 18
    assert rows["XYZ", 1] == (6, 4, 0, 2, 18) and rows["XYZ", 2] == (3, 3, 2, 3, 24) and rows["ZYX", 3] == (3, 2, 2, 2, 18)
    assert rows["XYZ", 3] == (3, 0, 0, 0, 0)


# ---------------------------------------------------------------- Merkle
def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    i, t, lang, source, n = row[:5]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, t)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][k:k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


def steps(tree, r):
    for lv in tree[:-1]:
        run = r // 8 * 8
        yield "".join(lv[run:r]), "".join(lv[r + 1:run + 8])
        r //= 8


def manifest_of(docs):
    groups = {}
    for d in docs:
        groups.setdefault((d[2] is not None, (d[2] or "").encode()), []).append(d)
    keys = sorted(groups)
    own = {k: levels([leaf(d) for d in sorted(groups[k], key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))]) for k in keys}
    whole = levels([own[k][-1][0] for k in keys])
    root, out = whole[-1][0], []
    for g, k in enumerate(keys):
        ranked = sorted(groups[k], key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
        for r, d in enumerate(ranked):
            path = [*steps(own[k], r), *steps(whole, g)]
            text = d[1]
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0 and text is not None:
                text = re.sub("[A-Z]", lambda m: m.group().lower(), text)
            x = leaf((d[0], text, *d[2:]))
            for lo, hi in path:
                x = h(lo + x + hi)
            out.append((d[0], leaf(d), own[k][-1][0], root, h("".join(a + b for a, b in path)), x, x == root))
    return sorted(out, key=str)


def test_manifest_against_brute_force(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice(("Some TEXT", "low", "", None, "Été ß" * 5)), "en", rng.choice(("a", None)), i % 7) for i in range(0, 1400, 2)]
    docs += [(i, "One", "fr", "s", 3) for i in range(8)] + [(i, "Two", "de", "s", 3) for i in range(100, 109)]
    docs += [(1, "Lone", "es", "s", None), (-3, "Null lang", None, "s", 1), (4, "No lang", "", "s", 1),
             (None, "No Id", "en", "s", 1), (None, None, "en", None, None), (6, "x" * 300_000, "zz", "s", 1)]
    docs += [docs[0], docs[0], (0, "other", "en", "b", 1)]
    docs += [(i, "Group", f"g{i}", "s", 1) for i in range(20)]
    d = spark.createDataFrame(docs, DOCS)
    want = manifest_of(docs)
    for rows in (d.repartition(5), d.selectExpr("*", "'x' AS grp", "1 AS pos", "2 AS digest", "3 AS path", "4 AS leaf")):
        got = merkle.query(rows)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
    for some in (docs[:1], docs[:3], docs[700:708], []):
        got = merkle.query(spark.createDataFrame(some, DOCS)).collect()
        assert sorted((tuple(r) for r in got), key=str) == (manifest_of(some) if some else [])


def test_single_requests_descend_alone(spark):
    docs = spark.createDataFrame([(i, f"T{i}", "en" if i % 3 else "de", "s", 1) for i in range(300)], DOCS)
    m = merkle.manifest(docs)
    every = {r["id"]: r for r in merkle.leaf_proofs(m).collect()}
    some = merkle.leaf_proofs(m, spark.createDataFrame([(7,), (8,), (299,), (5000,)], "id bigint")).collect()
    assert sorted(r["id"] for r in some) == [7, 8, 299]
    assert all(r["path"] == every[r["id"]]["path"] and r["subroot"] == every[r["id"]]["subroot"] for r in some)
    # records are content-addressed: a digest names its children
    for records in m.groups.records:
        assert all(h("".join(r["children"])) == r["digest"] and len(r["children"]) <= 8 for r in records.collect())


# ---------------------------------------------------------------- quality
def buckets_of(text):
    """Words and markers of a text, one at a time."""
    out, last = [], None
    for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+", text.encode()):
        low = w.lower()
        out.append(low)
        if len(re.findall(rb"[A-Z]", w)) >= 2 and not re.search(rb"[a-z]", w):
            out.append("CAPITALS")
        if low == last:
            out.append("AGAIN")
        last = low
    return out


def test_word_buckets_and_sums_against_a_loop(spark):
    texts = ["The the THE cat!! sat.\nÉTÉ ABC-abc", "", None, "a b c d e f g " * 30, "***", " \t ", "x" * 70_000 + " tail tail"]
    rows = [buckets_of(t or "") for t in texts]
    names = {}
    import pyarrow as pa
    for _, _, data, off in quality.chunks(pa.array(texts)):
        got, first = quality.word_buckets(data, off)
        assert [int(n) for n in np.diff(first)] == [len(r) for r in rows]
        for name, b in zip((w for r in rows for w in r), got.tolist(), strict=True):
            assert names.setdefault(name, b) == b
    assert names["CAPITALS"] == quality.CAPITALS and names["AGAIN"] == quality.AGAIN
    index = quality.index_vectors().astype(int)
    want = np.zeros((quality.BUCKETS, quality.DIM + 1), int)
    for r in rows:
        ids = [names[w] for w in r]
        for i, b in enumerate(ids):
            want[b, quality.DIM] += 1
            for j in range(max(0, i - quality.WINDOW), min(len(ids), i + quality.WINDOW + 1)):
                if j != i:
                    want[b, : quality.DIM] += index[ids[j]]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    assert np.array_equal(quality.context_sums(df), want)
    vec = quality.word_vectors(want)
    got = {r["row"]["i"]: np.frombuffer(r["features"], np.float32) for r in quality.pooled(
        spark.createDataFrame(list(enumerate(texts)), "i int, text string"), vec).collect()}
    for i, r in enumerate(rows):
        mean = np.mean([vec[names[w]] for w in r], axis=0) if r else np.zeros(quality.DIM)
        assert np.allclose(got[i][: quality.DIM], mean, atol=1e-5) and np.isclose(got[i][quality.DIM], np.log1p(len(r)))


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = read(spark, sf, "labels")
    docs = read(spark, sf, "documents")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = {r["doc_id"]: r for r in quality.query(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got.values())
    held = [(r["score"], truth[i], r["predicted"]) for i, r in got.items() if r["held_out"] and i in truth]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7)
               for i, r in got.items())
    assert np.mean([p == q for _, q, p in held]) >= 0.95
    assert -np.mean([np.log(s if q else 1 - s) for s, q, _ in held]) < 0.15  # probabilities, not only an order
    # held-out labels, ids and the other columns change nothing
    flipped = labels.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS string)) % 4 = 2, 1 - quality, quality) AS quality", "toxic")
    again = quality.query(docs.selectExpr("doc_id", "text", "'x' AS lang", "'y' AS source", "1 AS row", "2 AS features", "3 AS score"),
                          flipped)
    assert {r["doc_id"]: r["score"] for r in again.collect()} == {i: r["score"] for i, r in got.items()}


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "word"), (3, "word"), (None, "some words"), (4, "A " * 100_000)],
                                 "doc_id bigint, text string")
    none = quality.query(docs, spark.createDataFrame([], LABELS)).collect()
    assert len(none) == 6 and {r["score"] for r in none} == {0.5}
    one = quality.query(docs, spark.createDataFrame([(1, 1, 0), (3, 1, 0), (3, None, 0), (4, 7, 0), (None, 1, 0)], LABELS)).collect()
    learned = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in (1, 3))
    assert {round(r["score"], 6) for r in one} == {round((learned + 1) / (learned + 2), 6) if learned else 0.5}
    assert [r["held_out"] for r in one if r["doc_id"] is None] == [True]
    assert quality.query(docs.limit(0), spark.createDataFrame([(1, 1, 0)], LABELS)).collect() == []
