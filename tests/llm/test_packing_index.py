"""Scores of a shard's index against BM25 term by term; what packing holds at once and how many files it leaves."""

import numpy as np


def test_frequent_terms_need_no_postings_and_scores_stay_bm25():
    from loomfuse.llm.packing import K1, B, Index

    r = np.random.default_rng(3)
    n, n_docs = 300, 5000
    chance = 1 / np.arange(1, 2001) ** 0.7
    terms = [np.sort(r.choice(2000, 60, replace=False, p=chance / chance.sum())).astype(np.uint16) for _ in range(n)]
    tfs = [r.integers(1, 9, 60).astype(np.uint32) for _ in range(n)]
    lengths = np.array([int(x.sum()) for x in tfs])
    df = r.integers(1, n_docs, 1 << 16).astype(float)
    index = Index(terms, tfs, lengths, df, n_docs, lengths.mean())
    local = np.bincount(np.concatenate(terms), minlength=2000)
    assert len(index.doc) == local[local <= n // 32].sum() < local.sum() / 2
    for seed in (0, 7, 299):
        want = np.zeros(n)
        for d in range(n):
            for t, tf in zip(terms[d].tolist(), tfs[d].tolist()):
                if t in terms[seed]:
                    want[d] += np.log1p((n_docs - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[d] / lengths.mean()))
        assert np.allclose(index.neighbours(seed), want, rtol=1e-5)


def test_telling_terms_are_drawn_a_few_rows_at_a_time():
    """A task's digests come in batches of up to 10,000 rows; what a worker holds must not grow with them."""
    import tracemalloc

    import pyarrow as pa

    from loomfuse.llm.packing import telling_terms, with_terms

    r = np.random.default_rng(4)
    n, each = 10_000, 100
    terms = np.sort(r.integers(0, 5000, (n, each)), axis=1).astype(np.uint16)
    tfs = r.integers(1, 9, (n, each)).astype(np.uint32)
    df = np.bincount(terms.ravel(), minlength=1 << 16).astype(float)
    raw = [pa.array([x.tobytes() for x in col], pa.binary()) for col in (terms, tfs)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(tfs.sum(1).astype(np.int64)), raw[0], *raw], ["doc_id", "n", "crcs", "terms", "tfs"])
    most, got = 0, []
    tracemalloc.start()
    try:
        for b in with_terms([batch], df, n):
            most = max(most, tracemalloc.get_traced_memory()[1])
            got.append(np.array([b.column(5), b.column(6)]).T)
    finally:
        tracemalloc.stop()
    assert most < 24 << 20
    assert (np.concatenate(got) == telling_terms(terms.ravel(), tfs.ravel(), np.repeat(np.arange(n), each), n, df, n)).all()


def test_pieces_of_many_shards_share_a_file_and_sequences_stay_whole(spark):
    from pyspark.sql import functions as F

    from loomfuse.llm.packing import pack
    from tests.llm.fixtures import frame

    rows = [(i, f"word{i % 7} some text {i % 11} " * (1 + i % 30), "en", "s", 1, 0.0, None) for i in range(300)]
    out = pack(frame(spark, rows), shard_rows=10)
    assert out.rdd.getNumPartitions() == 2  # 30 shards
    at = out.withColumn("file", F.spark_partition_id()).groupBy("sequence_id").agg(F.countDistinct("file").alias("files"))
    assert at.agg(F.max("files"), F.count("*") > 29).first() == (1, True)
