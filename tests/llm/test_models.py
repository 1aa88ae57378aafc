"""Quality rules, language identification, toxicity, search and the Jaccard join against plain versions."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeflow.llm import jaccard, langid, quality, topk, toxic
from citeflow.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_exact_binomial(spark):
    cases = [(k, n) for n in (1, 20, 300, 5000) for k in (0, 1, 3, 14, 24) if k < n * 0.005 or k == 0]
    df = spark.createDataFrame(cases, "k long, n long")
    for r in df.withColumn("p", quality.binomial_at_most(F.col("k"), F.col("n"), 0.005)).collect():
        exact = sum(math.comb(r.n, i) * 0.005**i * 0.995 ** (r.n - i) for i in range(r.k + 1))
        assert r.p == pytest.approx(exact if r.k < r.n * 0.005 else 1.0, rel=1e-8)


def counts(text):
    words = WORD.findall(text or "")
    places: dict = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {j for found in places.values() if len(found) > 1 for i in found for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def test_quality_counts_and_cutoffs(spark):
    rng = random.Random(0)
    docs = [None, "", " \t\n\x0b", "a", "a b c", "a b c a b c", "x\nx\n\ny\n \n", "é# É*🎉|\x85\xa0w", "a a a a a a"]
    docs += ["".join(rng.choice(["a", "b", "c", " ", " ", "\n", "#", "\t"]) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    good = " ".join(f"w{i}" for i in range(60))
    docs += [good] * 2500 + [good.upper()] * 50
    rows = [(i, t, "en" if i % 9 else None, "x") for i, t in enumerate(docs)]
    labels = [(i, 0 if t == good.upper() else 1) for i, t, *_ in rows if t and t.lower() == good] + [(10**6, 1), (None, 1), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string").repartition(4)
    got = quality.judge_quality(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = docs[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        if text == good:
            assert r.kept
        if text == good.upper() and rows[r.doc_id][2] == "en":
            assert not r.kept  # the null stratum has too few labels to prove a cutoff
    none = quality.judge_quality(df.limit(20), spark.createDataFrame([], "doc_id long, quality int"))
    assert all(r.kept != r.base_failed for r in none.collect())


def test_languages(spark):
    rng = random.Random(1)
    syllables = {"aa": ["the", "ing", "sh"], "bb": ["ung", "sch", "ß"], "cc": ["ción", "ñ", "os"]}
    rows = [(i, " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(15)), lang) for i, lang in enumerate(list(syllables) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs.where("doc_id < 150"))
    extra = [(1000, None, None), (1001, "", "aa"), (1002, "12 -- 3", "aa"), (1003, "Thesh " * 20000, None)]
    odd = docs.where("doc_id >= 150").unionByName(spark.createDataFrame(extra, docs.schema)).withColumn("score", F.lit("x"))
    got = {r.doc_id: r for r in langid.add_language(odd, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[150:])
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in got.values()) and (model.weights == 0).mean() > 0.5
    nothing = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.add_language(odd, nothing).collect()} == {"und"}


def test_marginals_are_sums_over_all_paths():
    rng = np.random.default_rng(2)
    chain = np.array([0.0, 0.7, -0.4, 1.1, -0.3])
    emission, begins = rng.normal(size=9), np.array([0, 4, 4, 5, 9])
    got = toxic.chain_marginals(emission, begins, chain)
    for a, b in itertools.pairwise(begins):
        total, each = 0.0, np.zeros(b - a)
        for path in itertools.product((0, 1), repeat=b - a):
            score = sum(e for e, y in zip(emission[a:b], path) if y) + (chain[4] if path and path[0] else 0)
            score += sum({(0, 0): 0.0, (0, 1): chain[1], (1, 0): chain[2], (1, 1): chain[3]}[p] for p in itertools.pairwise(path))
            total += math.exp(score)
            each += math.exp(score) * np.array(path)
        assert got[a:b] == pytest.approx(each / total) if b > a else True


def test_toxic_words_are_found(spark):
    rng = random.Random(3)
    plain = ["the", "of", "été", "über", "and", "river", "stone"]
    rows, labels = [], []
    for i in range(300):
        words = [rng.choice(plain) + str(rng.randint(0, 3)) * 0 + "abcd"[rng.randint(0, 3)] for _ in range(40)]
        if i % 3 == 0:
            for _ in range(3):
                words[rng.randrange(40)] = "Blargh" + rng.choice(["", "ed", "ing", "s", "ful"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*labels, (5, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    model = toxic.train(docs.where("doc_id < 240"), labels)
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1002, "é blargher, BLARGHING blarghs"), (1003, "stone " * 30000)], docs.schema)
    got = {r.doc_id: r for r in toxic.score_toxicity(docs.where("doc_id >= 240").unionByName(odd).withColumn("spans", F.lit(1)), model).collect()}
    assert all((got[i].score >= 0.5) == (i % 3 == 0) for i in range(240, 300))
    for r in (got[i] for i in range(240, 300, 3)):
        text = rows[r.doc_id][1]
        assert all(part.startswith("Blargh") for s in r.spans for part in text[s.start : s.end].split())
    assert [(s.start, s.end) for s in got[1002].spans] == [(2, 29)] and all(got[i].score < 0.5 for i in (1000, 1001, 1003))
    assert {r.score < 0.5 for r in toxic.score_toxicity(odd, toxic.train(docs.limit(0), labels)).collect()} == {True}


def base_marked(rows):
    """Features that mark toxic tokens, over sets of plain Python."""
    seen, groups = {True: {}, False: {}}, {True: {}, False: {}}
    for text, label in rows:
        data = text.encode()
        words = toxic.tokens(np.array([0, len(data)]), np.frombuffer(data, dtype=np.uint8))
        group = int(toxic.copies(words.hashes(), words.begins)[0])
        if group not in groups[label] or text < groups[label][group][0]:
            groups[label][group] = (text, words)
    for label, texts in groups.items():
        for group, (_, words) in texts.items():
            for f in {f for b in toxic.BEGINNINGS for f in toxic.feature(words, b).tolist()} - {0}:
                seen[label].setdefault(f, set()).add(group)
    n_bad, n_good = len(groups[True]), len(groups[False])
    marked = []
    for f, of in seen[True].items():
        bad, good = len(of), len(seen[False].get(f, ()))
        odds = ((bad + 0.5) / (n_bad + 1)) / ((good + 0.5) / (n_good + 1))
        expected = (bad + good) * n_bad / (n_bad + n_good)
        z = (bad - expected) / math.sqrt(expected * n_good / (n_bad + n_good))
        if bad >= 5 and odds >= 4 and z >= 5:
            marked.append(f)
    return sorted(marked)


def test_toxic_words_are_counted_over_all_rows(spark):
    rng = random.Random(11)
    rows = []
    for i in range(1200):
        words = [rng.choice("abcdefgh") + rng.choice("klmnop") * 3 for _ in range(12)]
        if i % 3 == 0:
            words[rng.randrange(12)] = "rarely" if i % 30 == 0 else "Blargh"
        rows.append((i, " ".join(words)))
    rows += [(1200 + 3 * i, "one text of many copies sneaky " + "end" * (i % 2)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    told = docs.join(labels, "doc_id").select("text", (F.col("toxic") == 1).alias("toxic")).repartition(5)
    marked = toxic.marked_features(told).tolist()
    assert marked == base_marked([(r.text, r.toxic) for r in told.collect()]) and marked
    # in a sample of 100 documents a label the rare word is in 10 or so: too few to mark it
    model = toxic.train(docs, labels, per_label=100)
    spans = toxic.score_toxicity(spark.createDataFrame([(1, "akkk bkkk rarely ckkk")], docs.schema), model).head().spans
    assert [(s.start, s.end) for s in spans] == [(10, 16)]


def test_unlike_texts_with_a_common_phrase_are_no_copies():
    rng = random.Random(8)
    phrase = "it is the opinion of the court that".split()

    def group(words):
        data = " ".join(words).encode()
        found = toxic.tokens(np.array([0, len(data)]), np.frombuffer(data, dtype=np.uint8))
        return int(toxic.copies(found.hashes(), found.begins)[0])

    letters = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(4000)]
    unlike = []
    for _ in range(3000):
        own = rng.choices(letters, k=60)
        unlike.append(own[:30] + phrase + own[30:])
    assert len({group(w) for w in unlike}) > 2990
    near = 0
    for words in unlike[:300]:
        copy = [*words, *rng.choices(letters, k=3)]
        near += group(words) == group(copy)
    assert near > 200 and group(unlike[0]) == group([w.upper() for w in unlike[0]])


def test_chain_is_fitted_by_the_likelihoods_gradient(monkeypatch):
    rng = np.random.default_rng(5)
    begins = np.array([0, 3, 3, 7, 12])
    labels = rng.random(12) < 0.4
    hit_token, hit_row = rng.integers(0, 12, 15), rng.integers(0, 4, 15)
    theta = rng.normal(size=9)

    def likelihood(theta):
        emission = theta[4] + np.bincount(hit_token, weights=theta[:4][hit_row], minlength=12)
        total = 0.0
        for a, b in itertools.pairwise(begins):
            scores = {}
            for path in itertools.product((0, 1), repeat=b - a):
                score = float(emission[a:b] @ np.array(path)) + (theta[8] if path and path[0] else 0)
                scores[path] = score + sum({(0, 0): 0.0, (0, 1): theta[5], (1, 0): theta[6], (1, 1): theta[7]}[p] for p in itertools.pairwise(path))
            total += scores[tuple(labels[a:b].astype(int))] - math.log(sum(map(math.exp, scores.values())))
        return total

    n = np.diff(begins)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    by = np.argsort(hit_token, kind="stable")
    parts = [toxic._Part(begins, order[i : i + 2], labels, hit_token[by], hit_row[by], 4) for i in (0, 2)]
    gradient = sum(p.seen - p.expected(theta) for p in parts)
    for j in range(9):
        step = np.zeros(9)
        step[j] = 1e-5
        assert gradient[j] == pytest.approx((likelihood(theta + step) - likelihood(theta - step)) / 2e-5, abs=1e-6)
    whole = toxic.fit_chain(hit_token, hit_row, labels, begins, 4)
    monkeypatch.setattr(toxic, "CHAINS", 1)
    for a, b in zip(whole, toxic.fit_chain(hit_token, hit_row, labels, begins, 4)):
        assert a == pytest.approx(b)


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_top_k(spark, spread):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(6, 8))
    vectors = [(centre[i % 6] + spread * rng.normal(size=8)) * math.exp(rng.normal()) for i in range(400)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    rows += [(i, rows[0][1]) for i in range(400, 440)] + [(440, None), (460, [1.0, None]), (480, [float("nan")] * 8), (500, [float("inf")] * 8), (520, [0.0] * 8), (520, [0.0] * 8), (540, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), k=7, block_vectors=60, part_queries=8).collect()
    whole = {}
    usable = [(i, np.pad(np.floor(64 * np.array(v, dtype=np.float64)), (0, 8 - len(v)))) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    for q, v in usable:
        if q % 20 == 0:
            ranked = sorted((-int(v @ w), i) for i, w in usable if i != q)[:7]
            whole[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(ranked)]
    found = {q: sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q) for q in {r.query_id for r in got}}
    assert found == whole
    assert topk.top_k(df.limit(0), df, k=3).count() == 0


def test_coordinate_bounds_keep_all_that_reach_the_bound():
    rng = np.random.default_rng(5)
    v = np.floor(64 * (np.array([1.0, 2, -1, 0.5]) + 0.05 * rng.normal(size=(300, 4))))
    q = v[:10].copy()
    import pandas as pd

    products = v @ q.T
    bounds = [int(np.sort(products[:, j])[-8]) for j in range(10)]
    got = topk.search_block(pd.DataFrame({"query_id": range(10), "bound": bounds}), q, np.arange(300), v, 300)
    want = {(j, i, int(products[i, j])) for j in range(10) for i in range(300) if i != j and products[i, j] >= bounds[j]}
    assert set(got) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 202), (300, 300), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component for r in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200, 202: 200}
    assert connected_components(df.limit(0)).count() == 0


def shingle_sets(rows, n):
    out = {}
    for i, t in rows:
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(t or "")]
        out[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())
    return out


def classes(rows, n, num, den):
    sets = shingle_sets([r for r in rows if r[0] is not None], n)
    low = {i: i for i in sets}
    changed = True
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return {i: (len(sets[i]), low[i]) for i in sets}


@pytest.mark.parametrize("n, num", [(3, 90), (5, 80)])
def test_jaccard_classes(spark, n, num):
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(50)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One"), (4, "one"), (5, "one two"), (6, "ONE Two"), (None, "one"), (None, None)]
    base = [[rng.choice(vocabulary) for _ in range(size)] for size in (8, 12, 20, 45, 90, 300)]
    for i in range(150):
        words = list(base[i % 6])
        for _ in range(rng.randint(0, 1 + len(words) // 45)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((1000 - i, " ".join(words)))
    rows += rows[20:30]
    df = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, component_id string").repartition(3)
    got = jaccard.jaccard_components(df, n=n, num=num, den=100).collect()
    want = classes(rows, n, num, 100)
    assert len(got) == len(rows) and {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None for r in got if r.doc_id is None)
    kept = sorted(r.doc_id for r in jaccard.keep_one_of_each_class(df, n=n, num=num).where("doc_id is not null").collect())
    assert kept == sorted(i for i, (_, low) in want.items() if low == i)


def test_repeated_ids_lose_no_unlike_text(spark):
    rng = random.Random(12)
    text = lambda: " ".join(rng.choices([f"w{i}" for i in range(300)], k=80))
    a, b, c, d = (text() for _ in range(4))
    rows = [(1, a), (1, b), (2, c), (3, d), (5, d + " more"), (5, text()), (6, a), (7, "x y z"), (7, "x y z"), (7, ""), (7, None), (None, a)]
    rows += [(8, d + " again"), (8, " \n"), (3, d), (3, d + " and"), (9, None), (9, None)]
    df = spark.createDataFrame([(*r, 0, "h") for r in rows], "doc_id long, text string, _hash int, id string").repartition(4)
    got = jaccard.keep_one_of_each_class(df, n=3, num=80)
    assert got.columns == df.columns
    order = lambda r: tuple((x is not None, x) for x in r)
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=order)
    stays = [(1, a), (1, b), (2, c), (5, rows[5][1]), (7, "x y z"), (7, ""), (7, None), (None, a), (8, " \n"), (9, None), (9, None)]
    of_three = [r for r in kept if r[0] == 3]
    assert len(of_three) == 1 and of_three[0][1] in (d, d + " and")
    assert [r for r in kept if r[0] != 3] == sorted(stays, key=order)
    none = spark.createDataFrame([], df.schema)
    assert jaccard.keep_one_of_each_class(none, n=3, num=80).collect() == jaccard.jaccard_components(none).collect() == []


def test_many_small_sets_are_compared_in_blocks(spark, monkeypatch):
    members = spark.range(2000).select(F.lit(1).alias("group"), F.col("id").alias("member"), F.lit(10).cast("long").alias("n"))
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 500)
    tasks = jaccard._tasks(members, "member", 10**9)
    sizes = tasks.groupBy("group", "i", "j").count().collect()
    assert len(sizes) == 10 and max(r["count"] for r in sizes) < 1300
    assert "REPARTITION_BY_COL" in tasks._jdf.queryExecution().executedPlan().toString()


def test_common_phrases_do_not_chain_unlike_texts(spark, monkeypatch):
    rng = random.Random(8)
    phrases = [" ".join(f"p{i}x{j}" for j in range(7)) for i in range(12)]
    base = [[rng.choice(phrases) if rng.random() < 0.2 else " ".join(f"u{rng.randrange(10**6)}" for _ in range(9)) for _ in range(20)] for _ in range(200)]
    rows = [(i, " ".join(parts)) for i, parts in enumerate(base)]
    rows += [(1000 + i, " ".join([*base[i][:-1], "an other end of the text"])) for i in range(0, 200, 9)]
    sizes, tasks = [], jaccard._tasks

    def counted(members, *rest):
        sizes.append(members.groupBy("group").count().agg(F.max("count")).first()[0])
        return tasks(members, *rest)

    monkeypatch.setattr(jaccard, "_tasks", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, n=5, num=80, den=100).collect()}
    assert got == classes(rows, 5, 80, 100) and len({c for _, c in got.values()}) < len(rows)
    assert sizes[0] <= 10  # groups of candidates


def test_keys_left_out_lose_no_link(spark):
    rng = random.Random(9)
    for spare in (0, 1, 3):
        # pairs of sets agree on spare + 1 keys, common ones first; all the others are common keys of one side only
        agreed = [rng.sample(range(40), spare + 1) for _ in range(60)]
        rows = [(k, 2 * i + side, 1, 1, spare) for i, keys in enumerate(agreed) for side in (0, 1) for k in {*keys, *range(40 * side, 40 * side + 8)}]
        found = spark.createDataFrame(rows, "key long, node long, band int, credit byte, left byte").repartition(3)
        kept = {}
        for r in jaccard.rarest(found).collect():
            kept.setdefault(r.node, set()).add(r.key)
        assert all(kept[2 * i] & kept[2 * i + 1] for i in range(60))
        assert all(len([r for r in rows if r[1] == node]) - len(keys) == spare for node, keys in kept.items())


def test_signatures_cover_every_link():
    rng = random.Random(6)
    for num, n in ((90, 400), (80, 60), (90, 25)):
        for _ in range(40):
            whole = [rng.getrandbits(64) for _ in range(n)]
            a = np.unique(np.array(whole[: rng.randint(int(n * 0.92), n)], dtype=np.uint64))
            b = np.unique(np.array(whole[rng.randint(0, n // 14) :], dtype=np.uint64))
            common = len(np.intersect1d(a, b))
            if 100 * common < num * (len(a) + len(b) - common):
                continue
            shared = [x for x in jaccard.bands_up_to(2 * n, num, 100) if x.low <= min(len(a), len(b)) and max(len(a), len(b)) <= x.high]
            assert shared or set(a) == set(b)
            for band in shared:
                credits = jaccard.allocate(band.differ, band.spare, [(rng.random(), rng.random() if band.high <= jaccard.DELETION_SIZE else math.inf) for _ in range(band.segments)])
                assert sum(credits) == band.differ + 1 + band.spare
                keys = []
                for some in (a, b):
                    own, of, less = jaccard.signatures(some, band)
                    keys.append({(i, k) for i, k in enumerate(own.tolist()) if credits[i]} | {(i, k) for i, k in zip(of.tolist(), less.tolist()) if credits[i] == 2})
                assert keys[0] & keys[1]
