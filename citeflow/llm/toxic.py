"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Documents are labelled as wholes, so the tokens are labelled first: in a toxic document, those whose word or beginning
of a word is seen in toxic documents far more often than chance. On these a two-state chain is trained. Forward-backward
gives every token of a text its chance of being toxic; their sum and their maximum make the document's score through a
small logistic regression, and the runs of likely tokens are the offending spans.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeflow.llm.arrays import Words, mix, shingle_hashes, text_slices
from citeflow.llm.frames import by_batch, col, free_name, give_back, stored
from citeflow.llm.jaccard import bit_filter

#: Bound of the sample that the chain and the score are fitted on: documents of each label, chosen by a hash. Three
#: quarters train the chain, the rest fits the document score. Which features mark toxic tokens is counted over all rows.
SAMPLE_PER_LABEL = 2000
#: Bytes of a word's beginning that are features beside the whole word (0).
BEGINNINGS = (0, 4, 5, 6, 7, 8, 10)
#: A feature marks toxic tokens when it is in this many toxic documents (copies of one text count once), its odds there
#: are higher by this factor, and there are this many standard deviations more of them than the labels' shares give.
LEAST_DOCUMENTS, LEAST_ODDS, LEAST_Z = 5, 4.0, 5.0
CHAIN, STEPS, RATE = 128, 150, 0.15
#: Chains whose messages are held at a time while the chain is fitted.
CHAINS = 2048
#: Orders of the shingles whose least ones tell copies.
SKETCH = (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47, 0xD6E8FEB86659FD93)


def tokens(offsets: np.ndarray, data: np.ndarray) -> Words:
    """Runs of letters (any byte above 127 counts as one), lower-cased also for the Latin-1 capitals."""
    data = data.copy()
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data[1:][capital] += 0x20
    return Words(offsets, data, letters=True)


def feature(words: Words, beginning: int) -> np.ndarray:
    """A 64-bit feature per token: the whole word (0), or its beginning; zero where that is the whole word again."""
    if not beginning:
        return words.hashes()
    found = words.hashes(beginning) + np.uint64(beginning)
    return np.where(words.stops - words.starts > beginning, found, np.uint64(0))


@dataclass
class ToxicModel:
    """Marked features with their weights, the chain's bias, transitions and start, and the document score's weights."""

    marked: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    chain: np.ndarray = field(default_factory=lambda: np.array([-8.0, 0.0, 0.0, 0.0, 0.0]))
    score: np.ndarray = field(default_factory=lambda: np.array([-8.0, 0.0, 0.0, 0.0]))

    def rows(self, found: np.ndarray) -> np.ndarray:
        """Index of each feature among the marked ones, their number for the others."""
        if not len(self.marked):
            return np.zeros(found.shape, dtype=np.int32)
        at = np.minimum(np.searchsorted(self.marked, found), len(self.marked) - 1)
        return np.where(self.marked[at] == found, at, len(self.marked)).astype(np.int32)

    def marginals(self, words: Words) -> np.ndarray:
        """The chance of each token to be toxic; every text is one chain over all its tokens."""
        weights = np.append(self.weights, 0.0)
        emission = np.full(len(words.starts), self.chain[0])
        for beginning in BEGINNINGS if len(self.marked) else ():
            emission += weights[self.rows(feature(words, beginning))]
        return chain_marginals(emission, words.begins, self.chain)

    def document_features(self, chances: np.ndarray, begins: np.ndarray) -> np.ndarray:
        n = np.diff(begins)
        sums = np.concatenate([[0.0], np.cumsum(chances)])
        expected = sums[begins[1:]] - sums[begins[:-1]]
        highest = np.zeros(len(n))
        if len(chances):
            highest[n > 0] = np.maximum.reduceat(chances, begins[:-1][n > 0])
        return np.stack([np.ones(len(n)), np.log1p(10 * expected), highest, np.log1p(1000 * expected / np.maximum(n, 1))], axis=1)

    def scores(self, chances: np.ndarray, begins: np.ndarray) -> np.ndarray:
        return sigmoid(self.document_features(chances, begins) @ self.score)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _messages(odds: np.ndarray, step: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward odds (the token included) and backward odds (without it) of state 1; ``odds`` is position by chain, the
    longest chains first, ``lengths`` their tokens; ``step`` is the transitions' weights, then the start's."""
    a00, a01, a10, a11, start = step
    forward, backward = np.ones_like(odds), np.ones_like(odds)
    active = np.searchsorted(-lengths, -np.arange(1, len(odds) + 1), "right")
    forward[0] = odds[0] * start
    for t in range(1, len(odds)):
        k = active[t]
        before = forward[t - 1, :k]
        forward[t, :k] = np.clip(odds[t, :k] * (a01 + a11 * before) / (a00 + a10 * before), 1e-150, 1e150)
    for t in range(len(odds) - 2, -1, -1):
        k = active[t + 1]
        after = odds[t + 1, :k] * backward[t + 1, :k]
        backward[t, :k] = (a10 + a11 * after) / (a00 + a01 * after)
    return forward, backward


def chain_marginals(emission: np.ndarray, begins: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """Forward-backward over all texts at once, position by position."""
    n = np.diff(begins)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    out = np.zeros(len(emission))
    step = np.exp([0.0, chain[1], chain[2], chain[3], chain[4]])
    odds = np.exp(np.clip(emission, -40, 40))
    at = 0
    while at < len(order):  # a few texts of similar length at a time, so that the table stays small
        size = max(1, 2_000_000 // int(n[order[at]]))
        some = order[at : at + size]
        lengths = n[some]
        column = np.repeat(np.arange(len(some)), lengths)
        place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        source = np.repeat(begins[some], lengths) + place
        table = np.ones((int(lengths[0]), len(some)))
        table[place, column] = odds[source]
        forward, backward = _messages(table, step, lengths)
        ratio = forward[place, column] * backward[place, column]
        out[source] = ratio / (1 + ratio)
        at += size
    return out


def copies(words: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A number for each text that near copies share: the least of its 3-word shingles in each of several orders, taken
    together. One least shingle alone is common to unlike texts, the more of them the larger the table is."""
    shingles, at = shingle_hashes(words, begins, 3)
    some = at[1:] > at[:-1]
    out = np.zeros(len(begins) - 1, dtype=np.uint64)
    for salt in SKETCH if len(shingles) else ():
        least = np.minimum.reduceat(mix(shingles ^ np.uint64(salt)), at[:-1][some])
        out[some] = mix(out[some] * np.uint64(0x9E3779B97F4A7C15) + least)
    return out


def _group(text: Column) -> Column:
    """``copies`` of each text as a column."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            each = [tokens(offsets, data) for _, offsets, data in text_slices(texts)]
            group = [copies(words.hashes(), words.begins).view(np.int64) for words in each]
            yield pa.array(np.concatenate([*group, np.zeros(0, dtype=np.int64)]))

    return by_batch(run, "bigint", text)


def _counted(docs: DataFrame) -> DataFrame:
    """In how many documents a feature is: ``toxic``, ``found`` and ``n``, added up over a slice of texts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            for row, offsets, data in text_slices(batch.column("text")):
                words, label = tokens(offsets, data), toxic[row : row + len(offsets) - 1]
                document = np.repeat(np.arange(len(label)), np.diff(words.begins))
                for beginning in BEGINNINGS:
                    found = feature(words, beginning)
                    order = np.lexsort((document, found))
                    found, owner = found[order], document[order]
                    first = found != 0  # once a document
                    first[1:] &= (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
                    found, owner = found[first], owner[first]
                    for kind in (True, False):
                        values, n = np.unique(found[label[owner] == kind], return_counts=True)
                        for k in range(0, len(values), 100_000):
                            v = pa.array(values[k : k + 100_000].view(np.int64))
                            columns = [pa.repeat(pa.scalar(kind), len(v)), v, pa.array(n[k : k + 100_000].astype(np.int64))]
                            yield pa.RecordBatch.from_arrays(columns, ["toxic", "found", "n"])
        give_back()

    return docs.select("toxic", "text").mapInArrow(run, "toxic boolean, found bigint, n bigint")


def marked_features(rows: DataFrame) -> np.ndarray:
    """The features that mark toxic tokens, ascending, counted over all of ``rows`` (``toxic`` and ``text``); of near
    copies with one label the least text counts. Only the features that pass reach the driver."""
    docs = rows.select("toxic", "text", _group(F.col("text")).alias("grp"))
    docs = stored(docs.groupBy("toxic", "grp").agg(F.min("text").alias("text")), "toxic-texts")
    n = {r["toxic"]: r["n"] for r in docs.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_bad, n_good = max(n.get(True, 0), 1), max(n.get(False, 0), 1)
    counts = _counted(docs).groupBy("found").agg(
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(~F.col("toxic"), F.col("n")).otherwise(0)).alias("good")
    )
    bad, good = F.col("bad"), F.col("good")
    log_odds = F.log((bad + 0.5) / (n_bad + 1)) - F.log((good + 0.5) / (n_good + 1))
    expected = (bad + good) * (n_bad / (n_bad + n_good))
    z = (bad - expected) / F.sqrt(F.greatest(expected * (n_good / (n_bad + n_good)), F.lit(1e-9)))
    marked = counts.where((bad >= LEAST_DOCUMENTS) & (log_odds >= float(np.log(LEAST_ODDS))) & (z >= LEAST_Z)).select("found").toArrow()
    return np.sort(marked["found"].to_numpy().astype(np.int64).view(np.uint64))


def marked_tokens(rows: DataFrame, model: ToxicModel) -> pa.Table:
    """(``place``, ``key``, ``toxic``, ``n``, ``token``, ``row``) of the sample: each text's length and which of its
    tokens have which marked feature. The texts themselves stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, hits, at_row = [], [], []
            for _, offsets, data in text_slices(batch.column("text")):
                words = tokens(offsets, data)
                found = [model.rows(feature(words, b)) for b in BEGINNINGS]
                at = [np.flatnonzero(f < len(model.marked)) for f in found]
                row = np.concatenate([f[a] for f, a in zip(found, at, strict=True)])
                at = np.concatenate(at)
                order = np.argsort(at, kind="stable")
                at, row = at[order], row[order]
                cuts = np.searchsorted(at, words.begins)
                lengths += np.diff(words.begins).tolist()
                hits += [at[i:j] - b for i, j, b in zip(cuts[:-1], cuts[1:], words.begins[:-1], strict=True)]
                at_row += [row[i:j] for i, j in itertools.pairwise(cuts)]
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (hits, at_row)]
            columns = [batch.column(c) for c in ("place", "key", "toxic")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lengths, pa.int64()), *lists], ["place", "key", "toxic", "n", "token", "row"])

    kind = rows.schema["key"].dataType.simpleString()
    schema = f"place bigint, key {kind}, toxic boolean, n bigint, token array<int>, row array<int>"
    return rows.select("place", "key", "toxic", "text").mapInArrow(run, schema).toArrow()


def fit_chain(
    hit_token: np.ndarray, hit_row: np.ndarray, labels: np.ndarray, begins: np.ndarray, n_marked: int
) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the marked features and the chain's five parameters, by Adam on the penalised likelihood.

    ``hit_token`` and ``hit_row`` say which token has which marked feature. The likelihood's gradient is what is observed
    less what forward-backward expects, for states and for transitions. Texts are cut into chains of ``CHAIN`` tokens.
    """
    cuts = np.unique(np.concatenate([begins, np.arange(0, len(labels) + 1, CHAIN)]))
    n = np.diff(cuts)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    by_token = np.argsort(hit_token, kind="stable")
    hit_token, hit_row = hit_token[by_token], hit_row[by_token].astype(np.int32)
    parts = [_Part(cuts, order[at : at + CHAINS], labels, hit_token, hit_row, n_marked) for at in range(0, len(order), CHAINS)]
    seen = sum((part.seen for part in parts), np.zeros(n_marked + 5))
    theta = np.concatenate([np.full(n_marked, 1.0), [-4.0, 0.0, 0.0, 0.0, 0.0]])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, STEPS + 1):
        gradient = sum((-part.expected(theta) for part in parts), seen - 0.05 * theta)
        if n_marked:  # a marked feature that the sample hardly has weighs as the others do, not nothing
            gradient[:n_marked] += 0.05 * theta[:n_marked].mean()
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        theta = theta + RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return theta[:n_marked], theta[n_marked:]


class _Part:
    """Some chains of the sample, longest first, with what is observed in them: every marked feature on toxic tokens,
    toxic tokens, the three transitions and toxic starts."""

    def __init__(self, cuts, chains, labels, hit_token, hit_row, n_marked):
        self.n_marked, self.lengths = n_marked, np.diff(cuts)[chains]
        self.column = np.repeat(np.arange(len(chains), dtype=np.int32), self.lengths)
        self.place = (np.arange(self.lengths.sum()) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)).astype(np.int32)
        source = np.repeat(cuts[chains], self.lengths) + self.place
        self.after = self.place > 0
        y = labels[source].astype(float)
        previous = np.concatenate([[0.0], y[:-1]])
        after = self.after
        # the hits of these tokens, in their order here
        low, high = np.searchsorted(hit_token, source), np.searchsorted(hit_token, source, "right")
        times = high - low
        self.token = np.repeat(np.arange(len(source), dtype=np.int32), times)
        self.row = hit_row[np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())]
        self.seen = np.concatenate([
            np.bincount(self.row, weights=y[self.token], minlength=n_marked),
            [y.sum(), ((1 - previous) * y)[after].sum(), (previous * (1 - y))[after].sum(), (previous * y)[after].sum(), y[~after].sum()],
        ])

    def expected(self, theta: np.ndarray) -> np.ndarray:
        """What forward-backward expects of the same."""
        weights, chain = theta[: self.n_marked], theta[self.n_marked :]
        place, column, after = self.place, self.column, self.after
        emission = chain[0] + np.bincount(self.token, weights=weights[self.row], minlength=len(place))
        odds = np.exp(np.clip(emission, -40, 40))
        table = np.ones((int(self.lengths[0]), len(self.lengths)))
        table[place, column] = odds
        step = np.exp([0.0, *chain[1:5]])
        forward, backward = _messages(table, step, self.lengths)
        ratio = forward[place, column] * backward[place, column]
        p = ratio / (1 + ratio)
        f = forward[np.maximum(place - 1, 0), column][after]
        o = (odds * backward[place, column])[after]
        mass = step[0] + step[1] * o + step[2] * f + step[3] * f * o
        moves = [p.sum(), (step[1] * o / mass).sum(), (step[2] * f / mass).sum(), (step[3] * f * o / mass).sum(), p[~after].sum()]
        return np.concatenate([np.bincount(self.row, weights=p[self.token], minlength=self.n_marked), moves])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = sigmoid(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", per_label: int = SAMPLE_PER_LABEL) -> ToxicModel:
    """Fit on the rows of ``docs`` that ``labels`` (the key and ``toxic``, 1 or 0) labels; the toxic label wins when a
    document has several, null labels and texts teach nothing. Without a toxic and a clean document: a model that finds
    nothing toxic."""
    known = labels.where(F.col("toxic").isNotNull()).groupBy(col(key).alias("key")).agg((F.max("toxic") == 1).alias("toxic"))
    known = stored(known, "toxic-known")
    rows = docs.select(col(key).alias("key"), col(text).alias("text"), F.xxhash64(col(key)).alias("h")).where(F.col("text").isNotNull())
    labelled = bit_filter(known.select(F.xxhash64("key").alias("h")), "h")  # texts without a label are not shuffled for it
    rows = rows.where(labelled) if labelled is not None else rows
    # the same join at every size: labels grow with the documents
    rows = stored(rows.drop("h").join(known.hint("merge"), "key"), "toxic-labelled")
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts.get(True) or not counts.get(False):
        return ToxicModel()
    place = F.xxhash64(F.lit("toxic"), "key")
    share = F.when(F.col("toxic"), F.lit(min(1.0, per_label / counts[True]))).otherwise(F.lit(min(1.0, per_label / counts[False])))
    sample = rows.withColumn("place", place).where(F.pmod("place", F.lit(1 << 30)) < share * (1 << 30))
    judging = F.pmod(F.shiftright(F.col("place"), 30), F.lit(4)) == 0
    sides = {(r["toxic"], r["judges"]) for r in sample.select("toxic", judging.alias("judges")).distinct().collect()}
    apart = {(True, True), (True, False), (False, True)} <= sides
    learning = rows.withColumn("place", place).where(~judging) if apart else rows
    model = ToxicModel()
    model.marked = marked_features(learning)

    told = marked_tokens(sample, model).sort_by([("place", "ascending"), ("key", "ascending")])
    toxic = told["toxic"].to_numpy().astype(bool)
    scoring = (told["place"].to_numpy() // (1 << 30) % 4 == 0) & apart
    begins = np.concatenate([[0], np.cumsum(told["n"].to_numpy())])
    hit_row = pc.list_flatten(told["row"]).to_numpy().astype(np.int64)
    hit_token = pc.list_flatten(told["token"]).to_numpy().astype(np.int64)
    hit_token = hit_token + np.repeat(begins[:-1], pc.list_value_length(told["token"]).to_numpy())
    of = np.repeat(np.arange(len(toxic), dtype=np.int32), np.diff(begins))
    learn, mine = np.flatnonzero(~scoring), np.flatnonzero(~scoring[of])
    labelled = np.zeros(len(of), dtype=bool)
    labelled[hit_token] = True
    labelled = (labelled & toxic[of])[mine]
    learned = ~scoring[of[hit_token]]
    learn_begins = np.concatenate([[0], np.cumsum(np.diff(begins)[learn])])
    model.weights, model.chain = fit_chain(
        np.searchsorted(mine, hit_token[learned]), hit_row[learned], labelled, learn_begins, len(model.marked)
    )
    judged = np.flatnonzero(scoring) if scoring.any() else learn
    emission = model.chain[0] + np.bincount(hit_token, weights=model.weights[hit_row], minlength=len(of))
    chances = chain_marginals(emission, begins, model.chain)
    # weight the sample back to the labels' own shares, so that a score is a chance
    x = model.document_features(chances, begins)[judged]
    y = toxic[judged].astype(float)
    model.score = fit_logistic(x, y)
    kept = {label: min(1.0, per_label / counts[label]) for label in (True, False)}
    model.score[0] += np.log(kept[False] / kept[True])
    return model


def tag(text: Column, model: ToxicModel) -> Column:
    """``score`` of each whole text and its ``spans``: start and end in code points (end exclusive) of runs of tokens
    that are more likely toxic than not, with the run's highest chance. Null is as empty: no span."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("chance", pa.float64())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            scores, spans = [], []
            for _, offsets, data in text_slices(texts):
                words = tokens(offsets, data)
                chances = model.marginals(words)
                scores.append(model.scores(chances, words.begins))
                rows: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
                likely = np.flatnonzero(chances >= 0.5)
                if len(likely):
                    character = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    owner = np.searchsorted(words.begins, likely, "right") - 1
                    last = (-2, -1)
                    for k, row in zip(likely.tolist(), owner.tolist(), strict=True):
                        base = int(character[offsets[row]])
                        start, end = int(character[words.starts[k]]) - base, int(character[words.stops[k]]) - base
                        if (k - 1, row) == last:
                            rows[row][-1]["end"] = end
                            rows[row][-1]["chance"] = max(rows[row][-1]["chance"], float(chances[k]))
                        else:
                            rows[row].append({"start": start, "end": end, "chance": float(chances[k])})
                        last = (k, row)
                spans += rows
            yield pa.StructArray.from_arrays(
                [pa.array(np.concatenate([*scores, np.zeros(0)])), pa.array(spans, pa.list_(span))], names=["score", "spans"]
            )

    return by_batch(run, "struct<score:double,spans:array<struct<start:bigint,end:bigint,chance:double>>>", text)


def score_toxicity(docs: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``spans`` to every row, whole texts, no shuffle; existing columns of these names are
    replaced, repeated rows get equal answers."""
    name = free_name(docs, "_toxicity")
    kept = [col(c) for c in docs.columns if c.lower() not in ("score", "spans")]
    tagged = docs.select("*", tag(col(text), model).alias(name))
    return tagged.select(*kept, F.col(f"{name}.score").alias("score"), F.col(f"{name}.spans").alias("spans"))
