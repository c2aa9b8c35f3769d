import random

import pytest
from pyspark.sql import functions as F

from feedloom.llm import decontam, langid, line_dedup, lm_score, minhash_forest, mixing, pii
from feedloom.llm.common import read
from tests.llm import helpers

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, KIND int, `select` string, row string, id int"


def documents(spark, rows):
    """A documents table with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", s, None, 1, "x", "r", 7) for i, t, s in rows], DOC)


def sentence(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(90))
                    for _ in range(n))


def odd_texts(rng):
    long = sentence(rng, 30_000)
    base = sentence(rng, 60)
    return [(1, base, "a"), (2, base + " tail", "a"), (3, base, None), (4, None, "b"), (5, "", "b"), (6, "Two words", "b"),
            (7, "two WORDS", "c"), (8, long, "c"), (9, long + " more", "c"), (10, "é ß 北京 x y z", "a"), (11, "...", "a"),
            (None, base, "a"), (12, "a\nb\nc\n\nd\na\nb\nc\nx", "a"), (13, "q\na \n\tb\nc", "a"), (14, "s\ns\ns\ns\ns\ns", "b"),
            (15, "x" * 200_000, "c")]


ITEMS = [(1, None), (2, ""), (3, "two words"), (4, "é ß 北京"), (5, "unseen thing here")]


def items(spark, rng_text):
    rows = ITEMS + [(6, "zz " + " ".join(rng_text.split()[20:35]) + " yy"), (7, " ".join(rng_text.split()[30:42])), (7, "two words")]
    return rows, spark.createDataFrame([(i, t, 0) for i, t in rows], "item_id bigint, text string, gram int")


def test_winnowing_equals_all_windows(spark):
    rows = odd_texts(random.Random(1))
    bench, table = items(spark, rows[0][1])
    got = {r["doc_id"]: r for r in decontam.query(documents(spark, rows), table).collect()}
    want = helpers.decontaminated([(i, t) for i, t, _ in rows], bench)
    assert len(got) == len(rows)
    full = {r["id"]: r["items"] for r in decontam.contamination(documents(spark, rows), table).collect()}
    for i, (n, hit, found) in want.items():
        assert (got[i]["n_words"], got[i]["n_hit"], full[i]) == (n, hit, found), i
        assert got[i]["contaminated"] == (hit > 0)


def test_winnowing_on_random_overlaps(spark):
    rng = random.Random(2)
    vocabulary = "a b c d".split()
    bench = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 25)))) for k in range(12)]
    rows = []
    for i in range(120):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))]
        if i % 3 == 0:
            text[5:5] = rng.choice(bench)[1].split()
        rows.append((i, " ".join(text), "s"))
    got = {r["id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontam.contamination(
        documents(spark, rows), spark.createDataFrame(bench, "item_id bigint, text string")).collect()}
    assert got == helpers.decontaminated([r[:2] for r in rows], bench)


def test_clean_keeps_columns_and_empty_benchmark(spark):
    rows = odd_texts(random.Random(1))
    docs = documents(spark, rows)
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.clean(docs, empty).count() == len(rows)
    assert decontam.clean(docs, empty).columns == docs.columns
    assert decontam.query(docs.limit(0), empty).collect() == []


def test_minhash_forest_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = odd_texts(rng)[:-1]
    base = [sentence(rng, 80).split() for _ in range(3)]
    for i in range(100, 300):
        text = list(base[i % 3])
        for _ in range(rng.randrange(0, 3)):
            text[rng.randrange(80)] = "edit" + str(rng.randrange(1000))
        rows.append((i, " ".join(text), "s"))
    want_n, want_c = helpers.near_duplicates([r[:2] for r in rows if r[0] is not None])
    docs = documents(spark, rows)
    for part, block in ((4096, 512), (20, 16)):  # the second: long runs in parts, classes in block pairs
        monkeypatch.setattr(minhash_forest, "PART", part)
        monkeypatch.setattr(minhash_forest, "BLOCK", block)
        got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in minhash_forest.query(docs).collect()}
        assert got.pop(None) == (0, None)
        assert {i: v[1] for i, v in got.items()} == want_c
        assert {i: v[0] for i, v in got.items()} == want_n


def test_one_of_each_class_stays(spark):
    rows = odd_texts(random.Random(1))
    docs = documents(spark, rows + [(1, rows[0][1], "a")])  # a repeated row
    kept = sorted(r["doc_id"] or 0 for r in minhash_forest.representatives(docs).collect())
    assert kept == [0, 1, 4, 5, 6, 8, 10, 11, 12, 13, 14, 15]
    assert minhash_forest.representatives(docs).columns == docs.columns
    assert minhash_forest.query(docs.limit(0)).collect() == []


def test_each_text_of_a_repeated_id_is_judged(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(0, a), (1, b), (1, c), (2, d), (3, a), (3, c + " more"), (3, "x y z"), (4, "u v"), (4, "u v"), (None, a), (None, a),
            (5, None), (5, ""), (6, d.replace("d7", "q"))]
    docs = spark.createDataFrame([(i, t, "k", "r") for i, t in rows], "doc_id bigint, text string, key string, row string")
    got = sorted(((r["doc_id"], r["text"]) for r in minhash_forest.representatives(docs).collect()), key=str)
    for want in ((0, a), (1, b), (1, c), (2, d), (3, "x y z"), (4, "u v")):
        assert got.count(want) == 1
    assert got.count((None, a)) == 2 and sum(i == 5 for i, _ in got) == 1
    assert len(got) == 6 + 2 + 1 + sum(g == rows[-1] for g in got)
    assert minhash_forest.representatives(docs).columns == docs.columns


def test_depth_shortens_to_recall():
    assert minhash_forest.depth(recall=0.999) == 4
    assert minhash_forest.depth(recall=0.5) == minhash_forest.DEEPEST
    assert minhash_forest.depth(recall=1.0) == 1


def test_line_windows(spark):
    rows = odd_texts(random.Random(1))
    rows = [r for r in rows if r[0] is not None]
    docs = documents(spark, rows)
    got = {r["doc_id"]: r["text"] for r in line_dedup.query(docs).collect()}
    assert got == helpers.line_windows([r[:2] for r in rows])
    assert got[12] == "a\nb\nc\n\nd\nx" and got[13] == "q" and got[14] == "s\ns\ns"
    assert line_dedup.query(docs.limit(0)).collect() == []


def test_line_windows_random(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", " a"]) for _ in range(rng.randrange(0, 14))), "s") for i in range(80)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.query(documents(spark, rows)).collect()}
    assert got == helpers.line_windows([r[:2] for r in rows])


def test_mix_reaches_targets(spark):
    rng = random.Random(5)
    rows = [(i, sentence(rng, rng.randrange(1, 60)), f"s{i % 5}" if i % 11 else None) for i in range(900)]
    rows += [(901, None, "s0"), (902, "", "t"), (5, rows[5][1], rows[5][2])]
    docs = documents(spark, rows)
    got = mixing.query(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert r["taken"] <= 2 * r["size"] and r["taken"] % max(1, r["size"]) == 0
        s = by.setdefault(r["source"], [0, 0, r["source_size"], r["target"]])
        s[0] += r["size"]
        s[1] += r["taken"]
    names = sorted((n for n in by if n is not None)) + [None]
    want = helpers.mix_targets([by[n][0] for n in names])
    for n, t in zip(names, want, strict=True):
        size, taken, told, target = by[n]
        assert told == size and target == pytest.approx(t) and abs(taken - target) <= max(5, 0.01 * target)
    assert sorted(got, key=str) == sorted(mixing.query(docs.repartition(7)).collect(), key=str)
    kept = mixing.mixed(docs)
    assert kept.agg(F.sum("taken")).first()[0] == sum(r["taken"] for r in got)
    assert mixing.query(docs.limit(0)).collect() == []


def test_targets_water_fill(spark):
    for sizes in ([10, 10, 10], [1, 100, 1], [0, 5, 0], [7], [1000, 1, 1, 1, 900, 3]):
        t = mixing.targets(spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, source_size bigint"))
        got = [r["target"] for r in sorted(t.collect())]
        assert got == pytest.approx(helpers.mix_targets(sizes))


def test_language_accuracy_and_rejection(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    got = langid.query(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = got.count(), got.where("lang = lang_pred").count()
    assert n > 100 and right >= 0.98 * n
    extra = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(
        [(-1, None, "en"), (-2, "", "en"), (-3, "12 34 !!", "en"), (None, "the and of", "en"), (-4, "x" * 300_000, None)],
        "doc_id bigint, text string, lang string"))
    odd = {r["doc_id"]: r for r in langid.query(extra).where("doc_id IS NULL OR doc_id < 0").collect()}
    assert [odd[i]["lang_pred"] for i in (-1, -2, -3)] == ["und"] * 3 and not odd[-1]["accepted"]
    assert odd[None]["held_out"] and 0 <= odd[-4]["score"] <= 1
    assert langid.recognised(docs).columns == docs.columns
    unlabelled = langid.query(docs.limit(3).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert [r["lang_pred"] for r in unlabelled] == ["und"] * 3


def test_language_labels_are_no_input(spark):
    docs = read(spark, SF, "documents")
    swapped = docs.withColumn("lang", F.expr("IF(crc32(CAST(doc_id AS string)) % 5 = 0, 'en', lang)")).withColumn("source", F.lit("z"))
    assert sorted(langid.query(docs).collect()) == sorted(langid.query(swapped).collect())


def test_language_rejects_what_was_never_learned(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    rng = random.Random(8)
    noise = [(-1 - i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(300)), None) for i in range(40)]
    for unlearned in ("de", "en"):
        few = docs.where(F.expr(f"lang = '{unlearned}' OR doc_id % 12 = 0")) if unlearned == "en" else docs
        known = few.withColumn("lang", F.expr(f"nullif(lang, '{unlearned}')"))
        got = langid.query(known.union(spark.createDataFrame(noise, known.schema))).join(
            docs.withColumnRenamed("lang", "true"), "doc_id", "left").collect()
        own = [r["accepted"] for r in got if r["doc_id"] >= 0 and r["true"] != unlearned and r["held_out"]]
        other = [r["accepted"] for r in got if r["true"] == unlearned]
        wild = [r["accepted"] for r in got if r["doc_id"] < 0]
        assert sum(own) >= 0.98 * len(own) > 0 and sum(other) <= 0.05 * len(other) and not any(wild)


def test_every_labelled_language_is_learned(spark):
    rng = random.Random(9)
    names = [f"l{k:02}" for k in range(32)]
    vocabulary = {n: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for n in names}
    rows = [(i, " ".join(rng.choice(vocabulary[names[i % 32]]) for _ in range(30)), names[i % 32]) for i in range(32 * 30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in langid.query(docs).collect()}
    held = [i for i, r in got.items() if r["held_out"]]
    assert {got[i]["lang_pred"] for i in got} == set(names)
    assert sum(got[i]["lang_pred"] == rows[i][2] and got[i]["accepted"] for i in held) >= 0.95 * len(held) > 0


def test_backoff_edge_cases(spark):
    rows = odd_texts(random.Random(1))
    got = lm_score.scored(documents(spark, rows), buckets=3).collect()
    assert len(got) == len(rows)
    by = {r["id"]: r for r in got}
    assert by[4]["score"] == 0 and by[4]["per_word"] is None and by[8]["n_words"] == 30_000 and by[8]["score"] < 0
    assert lm_score.scored(documents(spark, rows).limit(0)).collect() == []


def test_backoff_frequent_contexts_change_nothing(spark, monkeypatch):
    import numpy as np

    docs = read(spark, SF, "documents")
    one = {r["doc_id"]: r["score"] for r in lm_score.query(docs).collect()}
    monkeypatch.setattr(lm_score, "frequent_words", lambda *a: np.zeros(0, np.uint64))
    assert {r["doc_id"]: r["score"] for r in lm_score.query(docs).collect()} == pytest.approx(one, abs=2e-4)


def test_base_spans():
    t = "mail a.b+c@x-y.example.org, c@d, @e.f 1.2.3.4 1.2.3.256 001.2.3.4.5, 4111 1111 1111 1111 and +1 (212) 555-0100 x +12"
    assert [(k, t[s:e]) for k, s, e in pii.base_spans(t)] == [
        (0, "a.b+c@x-y.example.org"), (1, "1.2.3.4"), (1, "001.2.3.4"), (2, "4111 1111 1111 1111"), (3, "+1 (212) 555-0100")]
    assert pii.base_spans("x" * 100_000 + "@" + "9" * 100_000) == []
    assert [t2[1:] for t2 in pii.base_spans("a@b.c@d.e")] == [(0, 5)]


def test_bootstrapped_patterns_find_unseen(spark):
    rng = random.Random(6)
    rows = [(i, f"{sentence(rng, 9)} call me +1 (212) 555-{1000 + i} {sentence(rng, 3)}", "s") for i in range(30)]
    rows += [(100 + i, f"so please call me 212.555.{2000 + i}, {sentence(rng, 4)}", "s") for i in range(5)]
    rows += [(200, "order number 2125552000 shipped", "s"), (201, None, "s"), (202, "", "s")]
    got = {r["doc_id"]: r for r in pii.query(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i in range(5):
        kind, s, e = got[100 + i]["spans"].split(":")
        assert kind == "phone" and rows[30 + i][1][int(s):int(e)] == f"212.555.{2000 + i}" and got[100 + i]["n_phone"] == 0
    assert all(got[i]["n_phone"] == 1 and got[i]["n_found"] == 0 for i in range(30))
    assert got[200]["spans"] == got[201]["spans"] == got[202]["spans"] == ""


def test_bootstrapped_patterns_find_spaced_numbers(spark):
    rng = random.Random(7)
    rows = [(i, f"{sentence(rng, 9)} call me +1 (212) 555-{1000 + i} {sentence(rng, 3)}", "s") for i in range(30)]
    rows += [(30 + i, f"{sentence(rng, 9)} my card 4111 1111 1111 1111 or mine card 4111111111111111", "s") for i in range(5)]
    luhn = [n for n in range(1000, 2000) if pii.luhn(f"411111111111{n}")][:30]
    rows += [(50 + k, f"{sentence(rng, 5)} with card 4111 1111 1111 {n} {sentence(rng, 3)}", "s") for k, n in enumerate(luhn)]
    planted = {100: "020 7946 0958", 101: "(212) 555-0100", 102: "212.555.2000", 103: "(212)555-0101", 104: "01 23 45 67 89"}
    rows += [(i, f"é so call me {n}, {sentence(rng, 4)}", "s") for i, n in planted.items()]
    rows += [(110, "she paid with card 4111 1111 1111 1112 today", "s"), (111, "call me 3 times", "s")]
    got = {r["doc_id"]: r for r in pii.query(documents(spark, rows)).collect()}
    text = {r[0]: r[1] for r in rows}
    for i, n in planted.items() | {(110, "4111 1111 1111 1112")}:
        kind, s, e = got[i]["spans"].split(":")
        assert (kind, text[i][int(s):int(e)]) == ("card" if i == 110 else "phone", n)
    assert got[111]["n_found"] == 0


def test_copied_words_count_once_against_a_context(spark):
    rng = random.Random(7)
    rows = [(i, f"{sentence(rng, 9)} call me +1 (212) 555-{1000 + i}", "s") for i in range(30)]
    rows += [(100, "so call me 2125552000 soon", "s")] + [(200 + i, f"please call me later {i}", "s") for i in range(300)]
    got = {r["doc_id"]: r["spans"] for r in pii.query(documents(spark, rows)).collect()}
    assert got[100] == "phone:11:21"
