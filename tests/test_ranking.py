import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeflow.operators import metrics, ranking, retrieval
from citeflow.operators.bayes import nb_fit, nb_topk
from citeflow.operators.embedding import embed, hashing_encoder
from citeflow.operators.postings import Index, undominated

SCORES = [("q1", "a", 0.9), ("q1", "b", 0.9), ("q1", "c", 0.1), ("q2", "a", 0.5), ("q3", "b", 1.0)]


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame(SCORES, "query_id string, cand_id string, score double").cache()


def test_topk_and_ties(scores):
    got = {(r.query_id, r.cand_id, r["rank"]) for r in ranking.topk_per_group(scores, 2).collect()}
    assert got == {("q1", "a", 1), ("q1", "b", 2), ("q2", "a", 1), ("q3", "b", 1)}
    assert {(r.query_id, r.cand_id) for r in ranking.argmax_per_group(scores).collect()} == {("q1", "a"), ("q2", "a"), ("q3", "b")}


@pytest.mark.parametrize("hot_rows", [1, 1000])
def test_rank_of_truth_is_the_row_number(spark, scores, hot_rows):
    truth = spark.createDataFrame([("q1", "b"), ("q2", "z"), ("q3", "b"), ("q4", "a")], "query_id string, truth_id string")
    got = {r.query_id: r["rank"] for r in ranking.rank_of_truth(scores, truth, hot_rows).collect()}
    assert got == {"q1": 2, "q2": -1, "q3": 1, "q4": -1}
    summary = metrics.topk_accuracy(ranking.rank_of_truth(scores, truth), (1, 2, 5)).first()
    assert (summary.top_1_accuracy, summary.top_2_accuracy, summary.top_5_accuracy, summary.evaluated) == (0.25, 0.5, 0.5, 4)


def test_softmax_over_candidates(spark, scores):
    kept = spark.createDataFrame([("a",), ("b",)], "cand_id string")
    got = ranking.restricted_softmax(scores, kept)
    assert "c" not in {r.cand_id for r in got.collect()}
    assert all(math.isclose(r.s, 1.0) for r in got.groupBy("query_id").agg(F.sum("prob").alias("s")).collect())


def test_metrics_by_hand(spark):
    ranks = spark.createDataFrame([(1,), (4,), (20,), (-1,)], "rank long")
    row = metrics.ir_metrics(ranks).first()
    assert row.accuracy_at_5 == row.recall_at_5 == 0.5
    assert row.precision_at_5 == pytest.approx(0.1)
    assert row.mrr_at_10 == pytest.approx((1 + 0.25) / 4)
    assert row.ndcg_at_10 == pytest.approx((1 + 1 / math.log2(5)) / 4)
    assert row.map_at_100 == pytest.approx((1 + 0.25 + 0.05) / 4)
    none = metrics.topk_accuracy(ranks.where("rank = 99")).first()
    assert none.top_1_accuracy is None and none.evaluated == 0


def test_ground_truth(spark):
    pairs = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x")], "pair_id long, answer string")
    assert {tuple(r) for r in ranking.ground_truth(pairs, "row").collect()} == {(0, 0), (1, 1), (2, 2)}
    for hot_rows in (1, 100):
        assert {tuple(r) for r in ranking.ground_truth(pairs, hot_rows=hot_rows).collect()} == {(0, 0), (1, 1), (2, 0)}
    assert {tuple(r) for r in ranking.distinct_answers(pairs).collect()} == {(0, "x"), (1, "y")}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    q, c = rng.normal(size=(37, 6)), rng.normal(size=(53, 6))
    c[7] = c[3]  # equal scores
    c[11] = 0.0  # zero vector
    frame = lambda m, name: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{name} long, vec array<double>")
    return q, c, frame(q, "query_id").cache(), frame(c, "cand_id").cache()


def similarities(q, c):
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    return np.round(unit(q) @ unit(c).T, 6)


@pytest.mark.parametrize("block_rows", [5, 20, None])
@pytest.mark.parametrize("k", [1, 10, 100])
def test_blocked_topk_is_exact(vectors, block_rows, k):
    q, c, queries, corpus = vectors
    got = {}
    for r in retrieval.blocked_topk(queries, corpus, k, block_rows=block_rows).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.cand_id, r.score))
    sims = similarities(q, c)
    for i in range(len(q)):
        order = sorted(range(len(c)), key=lambda j: (-sims[i, j], j))[:k]
        assert [j for j, _ in got[i]] == order
        assert [s for _, s in got[i]] == pytest.approx([sims[i, j] for j in order])


@pytest.mark.parametrize("block_rows", [5, None])
def test_ranks_are_exact(spark, vectors, block_rows):
    q, c, queries, corpus = vectors
    truths = {i: (i * 7) % 60 for i in range(len(q) - 1)}  # some not in the corpus, one query without any
    truth = spark.createDataFrame(list(truths.items()), "query_id long, truth_id long")
    got = {r.query_id: r["rank"] for r in retrieval.retrieval_ranks(queries, corpus, truth, block_rows=block_rows).collect()}
    sims = similarities(q, c)
    for i in range(len(q)):
        t = truths.get(i)
        order = sorted(range(len(c)), key=lambda j: (-sims[i, j], j))
        assert got[i] == (order.index(t) + 1 if t is not None and t < len(c) else -1)


def test_block_counts(vectors, monkeypatch):
    _, _, queries, corpus = vectors
    assert retrieval._block_counts(queries, corpus, 10) == (4, 6)
    assert retrieval._block_counts(queries, corpus, None) == (1, 1)
    monkeypatch.setattr(retrieval, "FEW_QUERIES", 10)
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 8 * 6 * 20)
    assert retrieval._block_counts(queries, corpus, None) == (2, 3)


def test_softmax_over_blocks(vectors):
    q, c, queries, corpus = vectors
    got = retrieval.blocked_softmax(queries, corpus, 100, block_rows=9)
    assert all(math.isclose(r.s, 1.0) for r in got.groupBy("query_id").agg(F.sum("prob").alias("s")).collect())


def test_text_ids_and_empty_corpus(vectors):
    _, _, queries, corpus = vectors
    named = corpus.select(F.concat(F.lit("c"), "cand_id").alias("cand_id"), "vec")
    asked = queries.select(F.concat(F.lit("q"), "query_id").alias("query_id"), "vec")
    truth = asked.select("query_id", F.lit("c3").alias("truth_id"))
    a = retrieval.retrieval_ranks(asked, named, truth, block_rows=10)
    b = retrieval.retrieval_ranks(asked, named, truth)
    assert a.exceptAll(b).isEmpty() and a.count() == 37
    assert {r["rank"] for r in retrieval.retrieval_ranks(asked, named.limit(0), truth).collect()} == {-1}
    assert retrieval.blocked_topk(asked, named.limit(0), 3).count() == 0


def test_bayes_by_hand(spark):
    train = spark.createDataFrame([(1, "x", "a a b"), (2, "x", "a"), (3, "y", "b c")], "row_id long, label string, text string")
    held = spark.createDataFrame([(9, "a b z"), (10, ""), (11, None)], "row_id long, text string")
    for hot_rows in (1, 1000):
        scored = nb_topk(nb_fit(train, "label", "text"), held, "text", 2, hot_rows=hot_rows, digits=12)
        got = {(r.query_id, r.cand_id): r.score for r in scored.collect()}
        assert got[(9, "x")] == pytest.approx(math.log(2 / 3) + math.log(4 / 7) + math.log(2 / 7))
        assert got[(9, "y")] == pytest.approx(math.log(1 / 3) + math.log(1 / 5) + math.log(2 / 5))
        assert got[(10, "x")] == got[(11, "x")] == pytest.approx(math.log(2 / 3)) and len(got) == 6
    pruned = nb_fit(train, "label", "text", df_min=2, df_max=2)
    assert {r.word for r in pruned.vocabulary.collect()} == {"a", "b"}
    assert nb_topk(nb_fit(train.limit(0), "label", "text"), held, "text", 2).collect() == []
    assert nb_topk(nb_fit(train, "label", "text"), held.limit(0), "text", 2).collect() == []


def bayes_plain(train, text, digits=6):
    """Every class scored in full."""
    seen, sizes, docs = {}, {}, {}
    for label, said in train:
        docs[label] = docs.get(label, 0) + 1
        for w in said.split():
            seen[label, w] = seen.get((label, w), 0) + 1
            sizes[label] = sizes.get(label, 0) + 1
    vocabulary = {w for _, w in seen}
    known = [w for w in text.split() if w in vocabulary]
    scores = {}
    for label, n in docs.items():
        size = sizes.get(label, 0) + len(vocabulary)
        scores[label] = round(math.log(n / len(train)) + sum(math.log((1 + seen.get((label, w), 0)) / size) for w in known), digits)
    return sorted(scores.items(), key=lambda s: (-s[1], s[0]))


@pytest.mark.parametrize("block_postings, block_words", [(10**6, 10**6), (150, 90)])
def test_bayes_leaves_out_only_what_cannot_win(spark, block_postings, block_words):
    rng = random.Random(2)
    common = [f"w{i}" for i in range(6)]
    train = []
    for c in range(60):
        own = [f"c{c}_{i}" for i in range(3)] + [f"s{c % 7}_{i}" for i in range(4)]
        for _ in range(rng.choice([1, 1, 2, 9])):
            train.append((f"p{c:02d}", " ".join(rng.choices(common, k=rng.randint(0, 30)) + rng.choices(own, k=rng.randint(0, 9)))))
    words_ = sorted({w for _, said in train for w in said.split()}) + ["new"]
    held = [" ".join(rng.choices(words_, k=rng.choice([0, 1, 3, 20])) + rng.choices(common, k=rng.choice([0, 5, 40]))) for _ in range(80)]
    model = nb_fit(spark.createDataFrame([(i, *r) for i, r in enumerate(train)], "row_id long, label string, text string"), "label", "text")
    asked = spark.createDataFrame(list(enumerate(held)), "row_id long, text string")
    rows = nb_topk(model, asked, "text", 4, block_postings=block_postings, block_words=block_words, hot_rows=100).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.cand_id, r.score))
    for i, said in enumerate(held):
        expected = bayes_plain(train, said)[:4]
        assert [c for c, _ in got[i]] == [c for c, _ in expected]
        assert [s for _, s in got[i]] == pytest.approx([s for _, s in expected], abs=2e-6)


def test_bayes_visits_few_classes(monkeypatch):
    """A text with telling words never sees the classes that share only common ones."""
    import pyarrow as pa

    n = 5000
    classes = pa.table({"label": list(range(n)), "prior": [math.log(1 / n)] * n, "base": [-math.log(1000.0)] * n})
    told = [(c, f"own{c}", 50) for c in range(n)] + [(c, "the", 40 + c % 3) for c in range(n)]
    postings = pa.table({"label": [t[0] for t in told], "word": [t[1] for t in told], "n": [t[2] for t in told]})
    index = Index(classes, postings, 1, 6)
    visited = []
    unique = np.unique
    monkeypatch.setattr(np, "unique", lambda a, **kw: visited.append(len(a)) or unique(a, **kw))
    monkeypatch.setattr("citeflow.operators.postings.FIRST_WORDS", 1)
    bags = pa.table({"query_id": [1], "words": [["the", "own7"]], "tf": pa.array([[3, 2]], pa.list_(pa.int64())), "known": [5]})
    texts, found, _ = index.search(bags)
    assert (texts.tolist(), found.tolist()) == ([0], [7]) and sum(visited) < 10


def test_undominated_classes():
    rng = np.random.default_rng(1)
    prior, base = rng.integers(0, 12, 300) / 4.0, rng.integers(0, 12, 300) / 4.0
    for k in (1, 3):
        kept = set(undominated(prior, base, k).tolist())
        for known in (0.5, 1, 3, 100):
            line = prior + known * base
            assert set(np.lexsort((np.arange(300), -line))[:k].tolist()) <= kept


def test_embedding_runs_once(spark):
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "i int, t string")
    made = embed(df, "t", hashing_encoder(8), 8)
    rows = {r.i: r.vec for r in made.collect()}
    assert np.linalg.norm(rows[1]) == pytest.approx(1, abs=1e-6) and sum(rows[2]) == sum(rows[3]) == 0
    plan = made.select(F.explode("vec"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_small_blocks_do_not_square(spark):
    """Pairs of blocks, and so the copies of each vector, stay bounded however few rows a block is wanted to have."""
    queries, corpus = (spark.range(6400).select(F.col("id").alias(name), F.array(F.lit(1.0), F.lit(2.0)).alias("vec")) for name in ("query_id", "cand_id"))
    assert retrieval._block_counts(queries, corpus, 64) == (16, 16)
    assert retrieval._block_counts(queries, corpus, 640) == (10, 10)
    assert retrieval.blocks_of(10_000_000, 64, 65_536) == 153


@pytest.mark.parametrize("digits", [6, None])
def test_ranks_in_single_precision_are_exact(digits):
    """Scores closer than single precision tells, copies and the right row's own copies; and memory that stays small."""
    import tracemalloc

    rng = np.random.default_rng(3)
    right = rng.normal(size=(3000, 8))
    right[1000:1500] = right[7] * (1 + 1e-9 * rng.normal(size=(500, 1)))
    right[2000:2300] = right[8] + 1e-7 * rng.normal(size=(300, 8))
    left = np.concatenate([right[:600], rng.normal(size=(600, 8))])
    left, right = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (left, right))
    truth = np.concatenate([rng.integers(0, 3000, 1100), rng.integers(1000, 2300, 100)])
    sims = np.einsum("qd,cd->qc", left, right)
    sims = sims if digits is None else np.round(sims, digits)
    limit, slack = sims[np.arange(1200), truth], retrieval.TIE if digits is None else 0.0
    before = np.arange(3000) < truth[:, None]
    ahead = ((sims > limit[:, None] + slack) | ((abs(sims - limit[:, None]) <= slack) & before)).sum(axis=1)
    tracemalloc.start()
    got = retrieval.count_ahead(left, right, limit, truth, truth + 1, digits)
    assert tracemalloc.get_traced_memory()[1] < 40e6
    tracemalloc.stop()
    assert (got == ahead).all()
    best = retrieval.search_block(left, right, 4, digits)
    top = np.argsort(-sims, axis=1, kind="stable")[:, :4]
    assert (np.take_along_axis(sims, best.at, 1) == np.take_along_axis(sims, top, 1)).all()
    assert digits is None or (best.at == top).all()


def test_pairs_of_blocks_even_out(spark):
    """Several pairs of blocks for each core, not one."""
    queries, corpus = (spark.range(n).select(F.col("id").alias(name), F.array(F.lit(1.0), F.lit(2.0)).alias("vec")) for n, name in ((60_000, "query_id"), (180_000, "cand_id")))
    made = retrieval._block_counts(queries, corpus, None)
    assert made[0] * made[1] >= 8 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("digits", [6, None])
def test_copies_are_multiplied_once(monkeypatch, digits):
    """Equal rows, some with many copies, and right candidates of none, one or several rows: ranks as by all cells."""
    rng = np.random.default_rng(7)
    made = rng.normal(size=(150, 8))
    made[7] = made[8] * (1 + 1e-9)
    right = made[np.concatenate([np.repeat(np.arange(150), 3), np.full(200, 5), np.arange(20, 33)])]
    right = right[rng.permutation(len(right))]
    left = np.concatenate([made, rng.normal(size=(40, 8))])
    left, right = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (left, right))
    start = rng.integers(0, len(right) - 3, len(left))
    end = start + rng.integers(0, 4, len(left))
    sims = np.einsum("qd,cd->qc", left, right)
    sims = sims if digits is None else np.round(sims, digits)
    limit, slack = sims[np.arange(len(left)), start], retrieval.TIE if digits is None else 0.0
    limit[3] = np.nan
    at = np.arange(len(right))
    front = (sims > limit[:, None] + slack) | ((abs(sims - limit[:, None]) <= slack) & (at < start[:, None]))
    ahead = (front & ~((at >= start[:, None]) & (at < end[:, None]))).sum(axis=1)
    cells, tiles = [], retrieval._tiles
    monkeypatch.setattr(retrieval, "_tiles", lambda *sides: (cells.append(t[2].size) or t for t in tiles(*sides)))
    assert (retrieval.count_ahead(left, right, limit, start, end, digits) == ahead).all()
    assert sum(cells) == len(left) * 150


def test_copies_meet_in_one_block(spark, monkeypatch):
    """A vector's copies lie in one block, those of a very common one in several."""
    monkeypatch.setattr(retrieval, "COPIES", 100)
    rows = [(i, [float(i % 50), 1.0]) for i in range(150)] + [(i, [-1.0, 2.0]) for i in range(150, 1150)]
    dealt = retrieval._dealt(spark.createDataFrame(rows, "cand_id long, vec array<double>"), 8)
    assert dealt.columns == ["cand_id", "vec", "_bc"]
    blocks = {tuple(r.vec): (r.blocks, r.n) for r in dealt.groupBy("vec").agg(F.count_distinct("_bc").alias("blocks"), F.count("*").alias("n")).collect()}
    assert blocks.pop((-1.0, 2.0))[0] > 3
    assert set(blocks.values()) == {(1, 3)}


@pytest.mark.parametrize("copies", [4096, 2])
def test_ranks_among_copies(spark, vectors, monkeypatch, copies):
    monkeypatch.setattr(retrieval, "COPIES", copies)
    q, c, queries, corpus = vectors
    many = corpus.select("vec", F.explode(F.array(*[F.col("cand_id") * 3 + k for k in range(3)])).alias("cand_id"))
    truth = spark.createDataFrame([(i, (i * 7) % len(c) * 3 + 1) for i in range(len(q))], "query_id long, truth_id long")
    sims = np.repeat(similarities(q, c), 3, axis=1)
    for digits in (6, None):
        got = {r.query_id: r["rank"] for r in retrieval.retrieval_ranks(queries, many, truth, digits, block_rows=20).collect()}
        for i in range(len(q)):
            t = (i * 7) % len(c) * 3 + 1
            assert got[i] == (sims[i] > sims[i, t]).sum() + (sims[i, :t] == sims[i, t]).sum() + 1


def test_bayes_few_classes_need_no_index(spark, monkeypatch):
    """One class may hold nearly all postings, which no task gathers; rows that share an id are scored each for itself."""
    from citeflow.operators import bayes

    monkeypatch.setattr(bayes, "_kernel", lambda *_: pytest.fail("gathers a class's postings in one task"))
    monkeypatch.setattr(bayes, "MAX_FREQUENT", 40)
    rng = random.Random(5)
    say = lambda n: " ".join(f"w{min(int(rng.expovariate(0.05)), 200)}" for _ in range(n))
    train = [(rng.choice("aaaaaaab"), say(30)) for _ in range(60)] + [("c", "w1")]
    model = nb_fit(spark.createDataFrame([(i, *r) for i, r in enumerate(train)], "row_id long, label string, text string"), "label", "text")
    held = [(i, say(25)) for i in range(20)] + [(3, "w1 w2 w2"), (4, None), (5, "unheard"), (None, "w5 w1")]
    held += held[:2]
    rows = nb_topk(model, spark.createDataFrame(held, "row_id long, text string"), "text", 2, digits=9).collect()
    expected = {}
    for i, said in held:
        expected.setdefault(i, []).extend(bayes_plain(train, said or "", 9))
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.cand_id, r.score))
    assert got.keys() == expected.keys()
    for i, scores in expected.items():
        best = sorted(scores, key=lambda s: (-s[1], s[0]))[:2]
        assert [c for c, _ in got[i]] == [c for c, _ in best] and [s for _, s in got[i]] == pytest.approx([s for _, s in best], abs=2e-9)
