from collections import Counter

from pyspark.sql import functions as F

from skyledger.llm import langid
from skyledger.llm.common import documents
from skyledger.llm.queries import language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = language_id(spark, SF).join(documents(spark, SF).select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out")
    assert held.count() > 100
    assert held.filter("lang = lang_pred").count() >= 0.98 * held.count()
    assert got.filter("score < 0 or score > 1").count() == 0


def test_the_fold(spark):
    import zlib

    got = spark.range(200).select("id", langid.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def test_odd_texts(odd, none):
    learned = odd.filter("lang is not null").select("lang", "text")
    filters = langid.fit(learned)
    got = {r.doc_id: r for r in langid.predict(odd, filters).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and got[0].score == 0
    assert got[119].lang_pred == "de" and got[118].lang_pred in filters.languages
    assert langid.predict(none, filters).count() == 0


def test_nothing_to_learn_from(odd, none):
    filters = langid.fit(none.select("lang", "text"))
    assert {r.lang_pred for r in langid.predict(odd, filters).collect()} == {"und"}


def test_filters_hold_all_their_trigrams():
    gram, doc = langid.trigrams(["Straße", "", "a b"])
    assert len(gram) == 8 and doc.tolist() == [0] * 6 + [2] * 2


def plain_trigrams(text):
    text = f" {text.lower()} "
    clean = "".join(c if c.isalpha() else " " for c in text)
    return [clean[i - 1 : i + 2] for i in range(1, len(clean) - 1) if clean[i] != " "]


def test_filters_decide_like_exact_sets(spark):
    """Corrected counts of the Bloom filters against sets of trigrams without false positives."""
    docs = documents(spark, SF).filter("lang is not null").select("doc_id", "lang", "text")
    rows = docs.collect()
    grams = {}
    for r in rows:
        grams.setdefault(r.lang, Counter()).update(plain_trigrams(r.text or ""))
    sets = {k: {g for g, n in c.items() if n >= langid.MIN_SHARE * sum(c.values())} for k, c in grams.items()}
    filters = langid.fit(docs.select("lang", "text"))
    got = {r.doc_id: r for r in langid.predict(docs, filters).collect()}
    same = 0
    for r in rows:
        found = plain_trigrams(r.text or "")
        counts = sorted(((sum(g in s for g in found), k) for k, s in sets.items()), reverse=True)
        total, exact = filters.corrected([r.text or ""])
        for i, name in enumerate(filters.languages):
            assert abs(exact[0][i] - sum(g in sets[name] for g in found)) <= 0.05 * max(20, total[0])
        clear = found and counts[0][0] - counts[1][0] > 0.1 * len(found)
        assert not clear or got[r.doc_id].lang_pred == counts[0][1]
        same += bool(clear)
    assert same > 0.8 * len(rows)


def test_rare_trigrams_left_out_do_not_decide(spark):
    """Held-out accuracy with the cut of rare trigrams and without."""
    docs = documents(spark, SF)
    learned = docs.filter(F.col("lang").isNotNull() & ~langid.held_out(F.col("doc_id"))).select("lang", "text")
    held = docs.filter(F.col("lang").isNotNull() & langid.held_out(F.col("doc_id")))
    right = []
    for share in (langid.MIN_SHARE, 0.0):
        got = langid.predict(held, langid.fit(learned, share)).join(held.select("doc_id", "lang"), "doc_id")
        right.append(got.filter("lang = lang_pred").count() / held.count())
    assert min(right) > 0.98 and abs(right[0] - right[1]) < 0.01


def test_repeated_rows_and_clashing_columns(spark, twice):
    filters = langid.fit(twice.filter("lang is not null").select("lang", "text"))
    clash = twice.withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit(7))
    got = langid.predict(clash, filters)
    assert got.columns == ["doc_id", "lang_pred", "score"] and got.count() == 141
