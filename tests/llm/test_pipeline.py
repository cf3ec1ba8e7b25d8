import collections

import corpus_pipeline as pipeline

from inkfall.llm import mixing, quality


def test_every_stage_takes_effect(spark, small):
    from test_operators import brute_classes

    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = pipeline.quality(spark, docs, small)
    model = quality.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    want = {r.doc_id for r in quality.score_documents(docs, model).collect() if r.predicted}
    rows = kept.collect()
    assert kept.columns == docs.columns and {r.doc_id for r in rows} == want
    one = pipeline.near_duplicates(spark, kept, small)
    classes = brute_classes({r.doc_id: r.text for r in rows})
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(set(classes.values()))
    mixed = pipeline.mixing(spark, one, small)
    copies = collections.Counter({r.doc_id: r.copies for r in mixing.mix_sources(one).collect()})
    assert mixed.columns == docs.columns and collections.Counter(r.doc_id for r in mixed.collect()) == +copies
    tokens = pipeline.tokens(spark, mixed, small)
    assert collections.Counter(r.doc_id for r in tokens.collect()) == +copies
    got = collections.Counter((r.doc_id, r.n_tokens, len(r.ids)) for r in pipeline.run(spark, small).collect())
    assert got == collections.Counter((r.doc_id, r.n_tokens, len(r.ids)) for r in tokens.collect())


def test_empty_corpus(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("false")
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0, name


def test_odd_rows_through_all_stages(spark, small, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and columns with clashing names, against each stage's own rule."""
    import hashlib
    import random

    from test_operators import DOCS

    from inkfall.llm.bpe import Codec, vocabulary

    rng = random.Random(5)
    words = [w for (t,) in [(r.text,) for r in spark.read.parquet(f"{small}/documents.parquet").limit(40).collect()] for w in t.split()]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long, twice = prose(40_000), prose(80)
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n ", None), (4, long, "b"), (5, long, "b"), (6, twice, None), (6, twice, None), (7, twice + " end", "a"), (None, prose(30), "c"), (None, prose(30), None), (8, "x" * 9000, "a"), (9, "é̀ 中文   ß", None)]
    rows += [(i, prose(60), rng.choice(["a", "b", None])) for i in range(20, 50)]
    docs = spark.createDataFrame([(i, t, s, None, None, "x", "y", None, 1) for i, t, s in rows], DOCS)
    first = pipeline.quality(spark, docs, small)
    model = quality.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    want = collections.Counter(t for (_, t, _), score in zip(rows, quality.scores(model, [t for _, t, _ in rows]), strict=True) if score >= quality.THRESHOLD)
    assert first.columns == docs.columns and collections.Counter(r.text for r in first.select("text").collect()) == want
    # all rows go through the rest, whatever the classifier says of them
    one = pipeline.near_duplicates(spark, docs, small)
    assert one.columns == docs.columns
    kept = collections.Counter(r[0] for r in one.collect())
    assert kept == collections.Counter([1, 2, 3, 4, 6, None, None, 8, 9, *range(20, 50)])
    mixed = pipeline.mixing(spark, docs, small)
    copies = collections.Counter()
    for r in mixing.mix_sources(docs).collect():
        copies[r.doc_id] += r.copies
    assert mixed.columns == docs.columns and collections.Counter(r[0] for r in mixed.collect()) == +copies
    codec = Codec(vocabulary())
    told = {t: codec.tokenizer.encode(t or "", add_special_tokens=False).ids for _, t, _ in rows}
    digest = lambda ids: hashlib.sha256(codec.tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    got = collections.Counter((r.doc_id, tuple(r.ids), r.decoded_sha256) for r in pipeline.tokens(spark, docs, small).collect())
    assert got == collections.Counter((i, tuple(told[t]), digest(told[t])) for i, t, _ in rows)
