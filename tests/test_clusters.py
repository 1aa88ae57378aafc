"""The clustered index against exact search."""

import numpy as np
import pytest

from citeflow.operators import clusters, retrieval


@pytest.fixture(scope="module")
def data(spark):
    """Vectors around thirty directions, a third of them one and the same."""
    rng = np.random.default_rng(4)
    directions = rng.normal(size=(30, 16))
    rows = directions[rng.integers(0, 30, 900)] + 0.3 * rng.normal(size=(900, 16))
    rows[600:] = rows[600]
    vectors = [(i, v.tolist()) for i, v in enumerate(rows.astype(np.float32))]
    corpus = spark.createDataFrame(vectors, "cand_id long, vec array<float>")
    asked = [(i, (rows[i] + 0.1 * rng.normal(size=16)).tolist()) for i in range(0, 900, 9)]
    return corpus.cache(), spark.createDataFrame(asked, "query_id long, vec array<float>").cache()


def neighbours(df):
    return {(r.query_id, r["rank"]): (r.cand_id, r.score) for r in df.collect()}


def test_every_cluster_visited_is_exact(data):
    corpus, asked = data
    index = clusters.build_index(corpus, slice_rows=50)
    assert index.rows.count() == 900 and max(index.slices.values()) > 1
    assert index.rows.groupBy("cluster", "slice").count().agg({"count": "max"}).first()[0] < 300
    exact = neighbours(retrieval.blocked_topk(asked, corpus, 5))
    assert neighbours(clusters.search_index(index, asked, 5, len(index.centres), block_rows=30)) == exact


def test_recall_is_what_was_measured(data):
    corpus, asked = data
    index = clusters.build_index(corpus)
    recalls = clusters.recall_by_probes(index, asked, corpus, 5)
    assert recalls == sorted(recalls) and recalls[-1] == 1.0 and len(recalls) == len(index.centres) > 10
    exact = {(r.query_id, r.cand_id) for r in retrieval.blocked_topk(asked, corpus, 5).collect()}
    for probes in (1, 3):
        found = {(r.query_id, r.cand_id) for r in clusters.search_index(index, asked, 5, probes).collect()}
        assert len(found & exact) / len(exact) == pytest.approx(recalls[probes - 1])
    found, probes = clusters.approximate_topk(asked, corpus, 5, target=0.9)
    assert probes == clusters.probes_for(recalls, 0.9) < len(index.centres) / 2
    assert len({(r.query_id, r.cand_id) for r in found.collect()} & exact) >= 0.9 * len(exact)
    assert clusters.probes_for([0.2, 0.5], 0.9) == 2


def test_empty_corpus_and_queries(data):
    corpus, asked = data
    index = clusters.build_index(corpus.limit(0))
    assert clusters.search_index(index, asked, 5, 1).count() == 0
    assert clusters.search_index(clusters.build_index(corpus), asked.limit(0), 5, 1).count() == 0


@pytest.mark.parametrize("probes", [3, 10**6])
def test_small_slices_do_not_square(data, probes, monkeypatch):
    """Slices of one row and blocks of one query: few tasks all the same, and the same neighbours."""
    corpus, asked = data
    index = clusters.build_index(corpus, slice_rows=1)
    wide = clusters.build_index(corpus)
    found = neighbours(clusters.search_index(index, asked, 5, probes, block_rows=1))
    assert found == neighbours(clusters.search_index(wide, asked, 5, probes))

    def one_row(k, digits, id_type, query_type):
        import pyarrow as pa

        top = pa.list_(pa.struct([("cand_id", id_type), ("score", pa.float64()), ("raw", pa.float64())]))

        def scan(queries, corpus):
            asked = queries["query_id"].to_pylist()[:1]
            lists = pa.array([[{"cand_id": 1, "score": 0.0, "raw": 0.0}]] * len(asked), top)
            return pa.table({"query_id": pa.array(asked, query_type), "top": lists})

        return scan

    monkeypatch.setattr(clusters, "_visitor", one_row)
    assert clusters.search_index(index, asked, 10**6, probes, block_rows=1).count() <= 256


def test_a_block_is_widened_once():
    """A block of vectors takes little more than its widened rows."""
    import tracemalloc

    import pyarrow as pa

    rows = pa.chunked_array([pa.FixedSizeListArray.from_arrays(pa.array(np.ones(64 * 20_000, dtype=np.float32)), 64).cast(pa.list_(pa.float32()))])
    tracemalloc.start()
    made = retrieval.matrix(rows)
    assert tracemalloc.get_traced_memory()[1] < 1.3 * made.nbytes
    tracemalloc.stop()
    assert made.shape == (20_000, 64) and made[0, 0] == pytest.approx(1 / 8)
