"""An inverted index of a block of classes, searched for the best classes of a text without visiting all of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of a text that are added before the bounds are looked at again, at first; doubled each time.
FIRST_WORDS = 4


def _whole(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def undominated(prior: np.ndarray, base: np.ndarray, k: int) -> np.ndarray:
    """Classes that fewer than ``k`` others match or beat in both numbers (equal in both: the earlier one first).

    Whatever the number of known words, but for none at all, the best ``k`` of the lines ``prior + known * base`` are
    among them.
    """
    order = np.lexsort((np.arange(len(prior)), -base, -prior))
    kept, bases = [], []
    for c in order.tolist():
        # all before it have at least its prior: count those with at least its base
        if len(bases) < k or bases[-k] < base[c]:
            kept.append(c)
        at = int(np.searchsorted(bases, base[c]))
        bases.insert(at, base[c])
        if len(bases) > k:
            del bases[0]
    return np.array(sorted(kept), dtype=np.int64)


class Index:
    """Classes by ascending label with ``prior`` and ``base``; postings sorted by word and class."""

    def __init__(self, classes: pa.Table, postings: pa.Table, k: int, digits: int):
        self.k, self.digits = k, digits
        self.prior, self.base = classes["prior"].to_numpy(), classes["base"].to_numpy()
        self.size = len(self.prior)
        encoded = _whole(_whole(postings["word"]).dictionary_encode())
        self.words = encoded.dictionary
        word = encoded.indices.to_numpy().astype(np.int64)
        label = pc.index_in(postings["label"], value_set=_whole(classes["label"])).to_numpy().astype(np.int64)
        keys = word * self.size + label
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.label = label[order]
        self.gain = np.log(postings["n"].to_numpy()[order] + 1.0)
        self.begins = np.searchsorted(self.keys, np.arange(len(self.words) + 1) * self.size)
        self.lengths = np.diff(self.begins)
        # what one occurrence of a word gives a class of the block at most and at least
        if len(self.words):
            given = self.gain + self.base[self.label]
            self.high = np.maximum(np.maximum.reduceat(given, self.begins[:-1]), self.base.max())
            full = self.lengths == self.size
            self.low = np.where(full, np.minimum.reduceat(given, self.begins[:-1]), self.base.min())
        self.lone = undominated(self.prior, self.base, k)
        self.idle = np.sort(np.lexsort((np.arange(self.size), -self.prior))[:k])  # the best where no word is known

    def search(self, bags: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, class, score) of the best classes, texts and classes as row numbers.

        ``bags`` has each text's words of the vocabulary with their counts ``tf`` and their sum ``known``, or all its
        words, repeats included, and no counts: then the words of this index are the vocabulary.
        """
        flat = _whole(bags["words"])
        found = pc.index_in(flat.flatten(), value_set=self.words) if len(self.words) else pa.nulls(len(flat.flatten()), pa.int32())
        number = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(pc.list_value_length(flat).to_numpy(zero_copy_only=False))
        counted = bags["tf"].null_count == 0
        if counted:
            counts = _whole(bags["tf"]).flatten().to_numpy().astype(np.float64)
            known = bags["known"].to_numpy().astype(np.float64)
        texts, classes, scores = [], [], []
        for i, end in enumerate(ends.tolist()):
            start = int(ends[i - 1]) if i else 0
            here = number[start:end] >= 0
            word = number[start:end][here]
            if counted:
                tf, all_known = counts[start:end][here], known[i]
            else:
                word, tf = np.unique(word, return_counts=True)
                tf, all_known = tf.astype(np.float64), float(tf.sum())
            some, score = self.best(word, tf, all_known)
            texts.append(np.full(len(some), i))
            classes.append(some)
            scores.append(score)
        return np.concatenate(texts), np.concatenate(classes), np.concatenate(scores)

    def best(self, word: np.ndarray, tf: np.ndarray, known: float) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(self.lengths[word], kind="stable") if len(word) else word
        word, tf = word[order], tf[order]
        seen = known - tf.sum()  # occurrences whose share of every score is settled
        most = np.append(np.cumsum((tf * self.high[word])[::-1])[::-1], 0.0) if len(word) else np.zeros(1)
        least = np.append(np.cumsum((tf * self.low[word])[::-1])[::-1], 0.0) if len(word) else np.zeros(1)
        found, gained = np.zeros(0, dtype=np.int64), np.zeros(0)
        at, step, closed = 0, FIRST_WORDS, False
        while at < len(word):
            to = min(len(word), at + step)
            some, times = word[at:to], tf[at:to]
            if closed:
                keys = some[:, None] * self.size + found[None, :]
                place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                gained = gained + (np.where(self.keys[place] == keys, self.gain[place], 0.0) * times[:, None]).sum(axis=0)
            else:
                lengths = self.lengths[some]
                rows = np.repeat(self.begins[some] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
                merged, of = np.unique(np.concatenate([found, self.label[rows]]), return_inverse=True)
                gained = np.bincount(of, np.concatenate([gained, np.repeat(times, lengths) * self.gain[rows]]), len(merged))
                found = merged
            seen, at, step = seen + times.sum(), to, 2 * step
            if len(found) < self.k or at == len(word):
                continue
            part = self.prior[found] + seen * self.base[found] + gained
            limit = np.partition(part, len(part) - self.k)[len(part) - self.k] + least[at]
            limit -= 2 * 10.0**-self.digits + 1e-9 * abs(limit)
            if not closed:
                others = self.prior[self.lone] + seen * self.base[self.lone]
                closed = bool(others.max() + most[at] < limit)
            if closed:
                stay = part + most[at] >= limit
                found, gained = found[stay], gained[stay]
        if not closed:
            extra = np.setdiff1d(self.lone if known else self.idle, found, assume_unique=True)
            found, gained = np.concatenate([found, extra]), np.concatenate([gained, np.zeros(len(extra))])
        scores = np.round(self.prior[found] + known * self.base[found] + gained, self.digits)
        order = np.lexsort((found, -scores))[: self.k]
        return found[order], scores[order]
