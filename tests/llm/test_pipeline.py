import reference

import corpus_pipeline
from skyledger.llm import quality
from skyledger.llm.common import documents

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = documents(spark, SF)
    stages = dict(corpus_pipeline.STAGES)
    judged = {r.doc_id: r.quality for r in quality.with_quality(docs).collect()}
    out = stages["quality_rules"](spark, docs, SF).collect()
    assert {r.doc_id for r in out} == {i for i, q in judged.items() if q.kept}
    assert all(r.n_chars == len(r.text) for r in out)

    df = spark.createDataFrame(out, docs.schema)
    rows = [(r.doc_id, r.text) for r in out]
    want = {keep for keep, _ in reference.exact_groups(rows).values()}
    df = stages["exact_dedup"](spark, df, SF)
    assert {r.doc_id for r in df.collect()} == want and df.columns == docs.columns

    rows = [r for r in rows if r[0] in want]
    want = set(reference.components(rows).values())
    df = spark.createDataFrame(stages["near_dedup"](spark, df, SF).collect(), docs.schema)
    assert {r.doc_id for r in df.collect()} == want and df.columns == docs.columns

    mixed = stages["mix_sources"](spark, df, SF)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= want

    tokens = stages["bpe_tokens"](spark, mixed, SF).collect()
    text = dict(rows)
    assert tokens and all(r.decoded == text[r.doc_id] for r in tokens)


def test_odd_tables(spark, odd, twice, none):
    for docs in (odd, twice, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == docs.columns, name
            docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()
