"""The pipeline's stages against brute force on the smallest table, one after the other."""

import hashlib

import corpus_pipeline
import numpy as np
import tiktoken
from test_operators import TINY, brute_components, brute_contamination, lower

from millrace.llm import bpe
from millrace.llm.queries import PATTERN, RANKS


def test_stages(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{TINY}/benchmark.parquet").select("item_id", "text").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{TINY}/labels.parquet").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    (_, classify), (_, exact), (_, near), (_, decontaminate), (_, encode) = corpus_pipeline.STAGES
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())

    good = classify(spark, docs, TINY)
    assert good.columns == docs.columns
    kept = ids(good)
    wrong = [i for i, q in labels.items() if (i in kept) != (q == 1)]
    assert len(wrong) <= 0.05 * len(labels) and not any(labels[i] == 1 for i in wrong)

    unique = exact(spark, good, TINY)
    best = {}
    for i in kept:
        best[lower(texts[i])] = i
    assert unique.columns == docs.columns and ids(unique) == sorted(best.values())

    apart = near(spark, unique, TINY)
    kept = ids(unique)
    _, part = brute_components([texts[i] for i in kept])
    want = [i for k, i in enumerate(kept) if part[k] == k]
    assert apart.columns == docs.columns and ids(apart) == want

    clean = decontaminate(spark, apart, TINY)
    want = [i for i in want if not brute_contamination(texts[i], items)[2]]  # one item is enough
    assert clean.columns == docs.columns and ids(clean) == want

    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    rows = encode(spark, clean, TINY).collect()
    assert sorted(r["doc_id"] for r in rows) == want
    for r in rows:
        encoded = library.encode_ordinary(texts[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(np.array(encoded, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert ids(corpus_pipeline.run(spark, TINY)) == want


def test_stages_take_empty_null_and_clashing_tables(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, kept int, items int, _id int"
    nothing = [(None,) * 9] * 2 + [(5, None, "en", "s", 0, 1, 1, 1, 1)]
    for rows in ([], nothing):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            left = stage(spark, docs, TINY).count()
            assert left <= len(rows)


def test_a_document_that_copies_one_item_goes(spark):
    item = spark.read.parquet(f"{TINY}/benchmark.parquet").orderBy("item_id").first()["text"]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(1, f"Before it. {item} After it.", "en", "s", 0), (2, "nothing of any benchmark stands in here at all", "en", "s", 0)], schema)
    assert [r["doc_id"] for r in corpus_pipeline.decontaminate(spark, docs, TINY).collect()] == [2]
