import itertools
import random

import numpy as np
import pyarrow as pa
import reference

from skyledger.llm import ngram_join


def test_components_against_all_pairs(odd, odd_rows):
    want = reference.components([(r[0], r[1]) for r in odd_rows])
    got = {r.doc_id: r for r in ngram_join.jaccard_components(odd).collect()}
    for row in odd_rows:
        assert got[row[0]].n_shingles == len(reference.shingles(row[1]))
        assert got[row[0]].component_id == want[row[0]]
    assert len(set(want.values())) < len(want) - 20


def test_borderline_pairs(spark):
    """Sets of every small size, with neighbours just at and just below the limit."""
    draw, rows, i = random.Random(4), [], 0
    for n in [4, 5, 6, 7, 8, 9, 10, 12, 15, 19, 20, 25, 37, 50, 64, 81, 100, 150]:
        base = [f"w{n}_{k}" for k in range(n + 4)]
        rows.append((i, " ".join(base)))
        for drop in range(1, max(3, n // 3)):
            cut = base[drop:] if draw.random() < 0.5 else base[: len(base) - drop]
            rows.append((i + 1, " ".join(cut)))
            i += 1
        i += 1
    want = reference.components(rows)
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_every_linked_pair_agrees_on_a_segment_both_look_up():
    """The pigeonhole of each scheme, with any order of costs."""
    draw = np.random.default_rng(3)
    starts = ngram_join.band_starts()
    for n in [4, 7, 9, 16, 23, 40, 63, 64, 120, 122, 300]:
        for _ in range(30):
            r = np.unique(draw.integers(0, 1 << 62, n, dtype=np.uint64))
            larger = int(draw.integers(n, 100 * n // 80 + 1))
            differ = ngram_join.differing(n + larger, 80)
            removed = max(0, (differ - (larger - n)) // 2)
            s = np.unique(np.concatenate((r[removed:], draw.integers(0, 1 << 62, larger - n + removed, dtype=np.uint64))))
            common = len(np.intersect1d(r, s))
            if common * 100 < (len(r) + len(s) - common) * 80:
                continue
            band = int(np.searchsorted(starts, min(len(r), len(s)), "right")) - 1
            looked = []
            for own in (r, s):
                lower = int(np.searchsorted(starts, len(own), "right")) - 1 - band
                most = len(own) + (starts[band + 1] - 1 if lower else 100 * len(own) // 80)
                slack = ngram_join.scheme(band)[2] - ngram_join.differing(int(most), 80) - 1
                sig, kind = ngram_join.signatures(own, band, 80)
                costly = sorted(sig[kind == ngram_join.EXACT], key=lambda x: (hash(int(x)), x))
                skipped = set(costly[:slack])
                looked.append({(x, k) for x, k in zip(sig.tolist(), kind.tolist(), strict=True) if x not in skipped})
            assert any(a == x and not k == kx == ngram_join.DELETED
                       for (a, k), (x, kx) in itertools.product(*looked)), (n, len(r), len(s))


def test_sketches_never_exceed_the_difference():
    draw = np.random.default_rng(1)
    for n, m in itertools.product([1, 3, 60, 70, 300], repeat=2):
        a, b = (np.unique(draw.integers(0, 500, k, dtype=np.uint64)) for k in (n, m))
        assert ngram_join.parity_distance(ngram_join.sketch(a), ngram_join.sketch(b)) <= len(np.setxor1d(a, b))


def test_shingles_of_long_and_short_texts(odd_rows):
    texts = [r[1] for r in odd_rows]
    for h, t in zip(ngram_join.sets_of(pa.array(texts, pa.string()), 5), texts, strict=True):
        assert len(h) == len(reference.shingles(t))


def near_copies(draw, base, n):
    """Texts of which any two are similar: one word differs from the base in each."""
    out = []
    for _ in range(n):
        words = base.split()
        words[draw.randrange(5, 95)] = reference.prose(draw, 1) + "x"
        out.append(" ".join(words))
    return out


def test_null_and_reused_ids_keep_their_links(spark):
    draw = random.Random(8)
    one, two, three = (reference.prose(draw, 100) for _ in range(3))
    a, b, c = near_copies(draw, one, 3)
    d, e = near_copies(draw, two, 2)
    f, g = near_copies(draw, three, 2)
    rows = [(5, a), (None, b), (7, c), (7, d), (8, e), (None, f), (None, g), (None, ""), (9, None)]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None) == [
        (5, 5, True), (7, 5, False), (7, 7, True), (8, 7, False), (9, 9, True)]
    assert sorted(((r.component_id, r.n_shingles > 0) for r in got if r.doc_id is None), key=str) == [
        (5, True), (None, False), (None, True), (None, True)]
    stay = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in stay if r.doc_id is not None) == [5, 7, 9]
    assert sum(r.doc_id is None for r in stay) == 2


def test_a_passage_in_thousands_of_different_documents(spark):
    """Members of one long list that do not link are never paired."""
    draw = random.Random(12)
    passage = reference.prose(draw, 60)
    rows = [(i, f"{passage} {reference.prose(draw, 50)}") for i in range(4000)]
    rows += [(4000 + i, t) for i, t in enumerate(near_copies(draw, rows[17][1], 3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    met = []
    plain = ngram_join._meeting
    ngram_join._meeting = lambda *a: met.append(plain(*a).count()) or plain(*a)
    try:
        got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect()}
    finally:
        ngram_join._meeting = plain
    assert {i: c for i, c in got.items() if i != c} == {4000: 17, 4001: 17, 4002: 17}
    assert met[0] < 100


def test_prefixes_bring_linked_sets_together():
    """The rarest shingle that two linked sets share is in the prefix of both, for any counts."""
    draw = random.Random(4)
    for _ in range(300):
        n = draw.randint(1, 60)
        x = set(range(n))
        y = set(draw.sample(sorted(x), draw.randint(0, n))) | {1000 + i for i in range(draw.randint(0, 8))}
        if 100 * len(x & y) < 80 * len(x | y):
            continue
        rank = {h: (draw.randint(1, 5), h) for h in x | y}
        prefix = [set(sorted(s, key=rank.get)[: len(s) - -(-80 * len(s) // 100) + 1]) for s in (x, y)]
        assert prefix[0] & prefix[1]


def test_repeated_rows_and_empty_tables(twice, none):
    got = ngram_join.jaccard_components(twice).collect()
    assert len(got) == 141
    stay = ngram_join.keep_one(twice)
    assert stay.columns == twice.columns
    assert ngram_join.jaccard_components(none).count() == 0
    assert ngram_join.keep_one(none).count() == 0


def test_only_wanted_texts_are_shuffled_for_their_sets(spark):
    """The exact join drops few texts: others leave before, whatever is broadcast. No wanted one is lost."""
    rows = [(i, f"one two three four five six {i}") for i in range(5000)] + [(None, "a null id"), (7, "another text"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = docs.select(ngram_join._id("doc_id").alias("rep"), ngram_join._fp("text").alias("fp"), "text")
    for chosen in ("rep % 100 = 7", "rep > 4999 or text is null", "true", "false"):
        wanted = keyed.filter(chosen).select("rep", "fp")
        left = ngram_join._likely_wanted(keyed, wanted)
        want = {(r.rep, r.fp) for r in wanted.collect()}
        got = {(r.rep, r.fp) for r in left.collect()}
        assert want <= got and len(got) <= len(want) + 600
        found = ngram_join._sets(docs, wanted, "doc_id", "text", 5)
        joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
        assert len(joins) == 2 and "word" in joins[1]  # the exact join is above the filter
        sets = found.collect()
        assert sorted((r.rep, r.fp) for r in sets) == sorted(want)
        assert all(len(r.h) == 3 for r in sets if r.rep < 5000 and r.rep not in (7, 9))
