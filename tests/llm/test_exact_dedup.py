from collections import Counter

import reference
from pyspark.sql import functions as F

from skyledger.llm import exact_dedup


def test_groups_against_brute_force(odd, odd_rows):
    want = reference.exact_groups([(r[0], r[1]) for r in odd_rows])
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(odd, capacity=3).collect()}
    assert len(got) == len(odd_rows)
    for i, row in enumerate(odd_rows):
        r = got[row[0]]
        assert (r.keep_id, r.group_size) == want[i]
        assert r.kept == (r.doc_id == r.keep_id)
        assert r.text_sha256 == reference.sha(reference.SPACE.sub("", row[1] or ""))


def test_repeated_rows_null_ids_and_clashing_columns(twice):
    got = exact_dedup.exact_dedup(twice).collect()
    assert len(got) == 141
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and set(kept) == {r.text_sha256 for r in got}
    stay = exact_dedup.keep_one(twice)
    assert stay.columns == twice.columns and stay.count() == len(kept)


def test_empty_table(none):
    assert exact_dedup.exact_dedup(none).count() == 0
    assert exact_dedup.keep_one(none).columns == none.columns


def test_directory_splits_only_overfull_buckets():
    counts = {0: 10, 1: 10, 8: 1, 15: 1}
    depth, slots = exact_dedup.directory(counts, 12, 4)
    assert depth == 4 and [s for s, _, _ in slots] == list(range(16))
    assert len({b for _, b, _ in slots}) < 16
    held = Counter()
    for slot, bucket, _ in slots:
        held[bucket] += counts.get(slot, 0)
    assert max(held.values()) <= 12


def test_texts_of_one_hash_form_a_chain(odd, odd_rows, twice, monkeypatch):
    """A hash of three values: buckets can't split, and bytes tell texts apart."""
    monkeypatch.setattr(exact_dedup, "_hash", lambda clean: F.shiftleft((F.length(clean) % 3).cast("long"), 61))
    want = reference.exact_groups([(r[0], r[1]) for r in odd_rows])
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(odd, capacity=3).collect()}
    assert got == {odd_rows[i][0]: w for i, w in want.items()}
    stay = sorted(r.doc_id for r in exact_dedup.keep_one(odd).collect())
    assert stay == sorted({w[0] for w in want.values()})
    assert exact_dedup.keep_one(twice).count() == len({reference.SPACE.sub("", r[1] or "") for r in odd_rows[:70]})


def test_buckets_are_what_rows_are_probed_by(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 1500).cast("string").alias("text"))
    hashes = docs.select(exact_dedup._hash(F.col("text")).alias("h")).distinct()
    found = exact_dedup.build_directory(hashes, 100)
    index = exact_dedup.build_index(docs, found)
    held = index.groupBy("bucket").count().collect()
    assert len(held) > 15 and max(r["count"] for r in held) <= 100 and index.count() == 1500
    files = index.select("bucket", F.col("_metadata.file_name").alias("file")).distinct()
    assert files.groupBy("bucket").count().where("count > 1").isEmpty()
    keys = docs.select("doc_id", exact_dedup._hash(F.col("text")).alias("h"), F.sha2("text", 256).alias("text_sha256"))
    plan = exact_dedup._probed(exact_dedup._in_buckets(keys, found), index, 4000)._jdf.queryExecution().optimizedPlan().toString()
    assert "(bucket#" in plan.split("Join Inner")[1]


def test_one_bucket_beyond_the_largest_depth_is_chained():
    assert exact_dedup.directory({3: 100}, 10, 2)[0] == 2


def test_no_python_on_the_main_path(odd):
    plan = exact_dedup.exact_dedup(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
