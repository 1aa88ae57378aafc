"""A trainable baseline scorer: multinomial naive Bayes from texts to classes, over an inverted index.

``score(d, l) = ln(docs_l / docs) + sum over words w of d in the vocabulary of ln((1 + count(l, w)) / (words_l + |V|))``

A class that never saw a word still has a score for it, so the sum splits in two: a line ``prior_l + known_d * base_l``
that every class has, and gains ``ln(1 + count)`` for the classes in the word's posting list. Only gains are added up, and
only for classes that can still be among the best: the words of a text are taken by the length of their lists, the
shortest first, until no class outside the candidates found so far can reach them; from there on the candidates alone are
looked up in the longer lists, and leave as soon as their upper bound falls below the k-th lower bound. Classes that share
no word are represented by the few that are not dominated in prior and base.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from citeflow.functions.text import words
from citeflow.operators.joins import join_on_slices
from citeflow.operators.numbering import HOT_ROWS, hot_groups
from citeflow.operators.ranking import topk_per_group
from citeflow.session import stored

#: Postings of one block of classes, words of one block of texts: what a task holds.
BLOCK_POSTINGS = 2_000_000
BLOCK_WORDS = 500_000
#: Postings of a row of the packed index, at most about so many.
CHUNK_POSTINGS = 50_000
#: Fewest texts worth a block of their own.
FEW_TEXTS = 64
#: Up to so many classes, every word has its gain for each of them, and scores are sums.
FEW_CLASSES = 32
#: Words that occur more often than one in so many are looked up where the texts are: there are fewer than that.
MAX_FREQUENT = 65_536
#: A word with its space, to tell the words of a text by its length.
BYTES_A_WORD = 6


@dataclass(frozen=True)
class BayesModel:
    """``postings(word, label, n)`` and ``classes(label, prior, base)``, where ``base`` is the log-probability of a word
    the class never saw."""

    postings: DataFrame
    classes: DataFrame

    @property
    def vocabulary(self) -> DataFrame:
        """Every word with its occurrences ``n``."""
        return self.postings.groupBy("word").agg(F.sum("n").alias("n"))


def term_counts(df: DataFrame, text: str, key: str) -> DataFrame:
    """``tf`` per text and word. The texts are placed by their key, so their words are counted where they are."""
    placed = df.select(key, text).repartition(key)
    return _each_word(placed, words(F.col(text)), key).groupBy(key, "word").agg(F.count("*").alias("tf"))


def _each_word(df: DataFrame, found: Column, *keys: str) -> DataFrame:
    """A row per word. The outer form keeps the optimizer from splitting every text twice, once to look for empty ones."""
    return df.select(*keys, F.explode_outer(found).alias("word")).where(F.col("word").isNotNull())


def class_term_counts(df: DataFrame, label: str, text: str, count_texts: bool = True) -> DataFrame:
    """Per class and word: ``n`` occurrences and the number of texts ``_docs``; combined before the one shuffle."""
    found = words(F.col(text))
    if not count_texts:
        each = _each_word(df.select(F.col(label).alias("label"), text), found, "label")
        return each.groupBy("label", "word").agg(F.count("*").alias("n"))
    marked = F.array(
        F.struct(found.alias("words"), F.lit(1).alias("n"), F.lit(0).alias("d")),
        F.struct(F.array_distinct(found).alias("words"), F.lit(0).alias("n"), F.lit(1).alias("d")),
    )
    listed = df.select(F.col(label).alias("label"), F.inline_outer(marked))
    each = _each_word(listed, F.col("words"), "label", "n", "d")
    return each.groupBy("label", "word").agg(F.sum("n").alias("n"), F.sum("d").alias("_docs"))


def nb_fit(df: DataFrame, label: str, text: str, df_min: int = 1, df_max: int | None = None) -> BayesModel:
    """Count words per class. The vocabulary is every word in at least ``df_min`` (and at most ``df_max``) texts; by
    default no word is left out. The model is kept, since every scoring reads it. Rows without a class are left out."""
    df = df.where(F.col(label).isNotNull())
    limited = df_min > 1 or df_max is not None
    postings = stored(class_term_counts(df, label, text, limited), "postings")
    if limited:
        wanted = F.col("_docs") >= df_min
        if df_max is not None:
            wanted = wanted & (F.col("_docs") <= df_max)
        kept = postings.groupBy("word").agg(F.sum("_docs").alias("_docs")).where(wanted)
        postings = stored(postings.drop("_docs").join(kept, "word", "left_semi"), "postings")

    docs = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("_docs"))
    seen = postings.groupBy("label").agg(F.sum("n").alias("_words"))
    size = F.coalesce("_words", F.lit(0)) + postings.agg(F.count_distinct("word")).scalar()
    classes = docs.join(seen, "label", "left").select(
        "label",
        F.ln(F.col("_docs") / F.sum("_docs").over(Window.partitionBy())).alias("prior"),
        F.when(size > 0, -F.ln(size)).otherwise(0.0).alias("base"),
    )
    return BayesModel(postings, stored(classes, "classes"))


def _tokens(df: DataFrame, text: str, row_id: str) -> DataFrame:
    """A row per text with all its words; which of them are known and how often each occurs the one block finds out."""
    nothing = F.array().cast("array<string>")
    asked = df.select(F.col(row_id).alias("query_id"), F.coalesce(words(F.col(text)), nothing).alias("words"))
    return asked.select("*", F.lit(None).cast("array<bigint>").alias("tf"), F.lit(None).cast("bigint").alias("known"))


def _bags(model: BayesModel, df: DataFrame, text: str, row_id: str, hot_rows: int) -> DataFrame:
    """A row per text: the words of the vocabulary in it with their counts, and ``known``, their sum.

    A frequent word is in nearly every text. Which words are frequent the model knows, so no pass over the texts looks
    for them; their rows are spread over slices.
    """
    asked = df.select(F.col(row_id).alias("query_id"), F.col(text).alias("_text"))
    hot = hot_groups(model.vocabulary.withColumnRenamed("n", "_n"), hot_rows)
    hot = hot.select("word", "_slices") if hot is not None else None
    found = join_on_slices(term_counts(asked, "_text", "query_id"), model.vocabulary.select("word"), "word", "left_semi", hot)
    bags = found.groupBy("query_id").agg(F.collect_list("word").alias("words"), F.collect_list("tf").alias("tf"), F.sum("tf").alias("known"))
    nothing = [F.array().cast(f"array<{kind}>") for kind in ("string", "bigint")]
    every = asked.select("query_id").join(bags, "query_id", "left")
    filled = [F.coalesce(c, empty).alias(c) for c, empty in zip(("words", "tf"), nothing)]
    return every.select("query_id", *filled, F.coalesce("known", F.lit(0)).alias("known"))


def _sums(model: BayesModel, classes: list[Row], df: DataFrame, text: str, row_id: str, digits: int) -> DataFrame:
    """Every text with each of a few classes: ``query_id, cand_id, score``.

    A row per word holds its gains for all the classes, so a text's scores are sums over its words, in any order and in
    parts. Frequent words are most of a text and few: they are broadcast and summed up where the text is. Only the others
    are shuffled, and none of them is hot. Rows that share an id are scored each by its own text.
    """
    label_type, gain = model.classes.schema["label"].dataType, [f"_g{i}" for i in range(len(classes))]
    names = [F.lit(c["label"]).cast(label_type) for c in classes]
    of = [F.sum(F.when(F.col("label") == name, F.ln(F.col("n") + 1)).otherwise(0.0)).alias(g) for g, name in zip(gain, names)]
    gains = stored(model.postings.groupBy("word").agg(F.sum("n").alias("_n"), *of), "gains")
    often = F.col("_n") > (gains.agg(F.sum("_n")).first()[0] or 0) / MAX_FREQUENT
    frequent = F.broadcast(gains.where(often).drop("_n"))

    each = ["query_id", "_digest"]
    asked = df.select(F.col(row_id).alias("query_id"), F.col(text).alias("_text"), F.xxhash64(text).alias("_digest")).repartition(*each)
    terms = _each_word(asked, words(F.col("_text")), *each).groupBy(*each, "word").agg(F.count("*").alias("tf"))
    known = [terms.join(frequent, "word"), terms.join(frequent.select("word"), "word", "left_anti").join(gains.where(~often), "word")]
    parts = [found.groupBy(*each).agg(F.lit(0).cast("bigint").alias("_copies"), F.sum("tf").alias("_known"), *[F.sum(F.col("tf") * F.col(g)).alias(g) for g in gain]) for found in known]
    parts.append(asked.groupBy(*each).agg(F.count("*").alias("_copies"), F.lit(0).cast("bigint").alias("_known"), *[F.lit(0.0).alias(g) for g in gain]))
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*each).agg(*[F.sum(c).alias(c) for c in ("_copies", "_known", *gain)])
    # the words of equal rows were counted together
    score = [c["prior"] + (F.col("_known") * c["base"] + F.col(g)) / F.col("_copies") for c, g in zip(classes, gain)]
    scored = F.array(*[F.struct(name, F.round(s, digits)) for name, s in zip(names, score)])
    rows = whole.select("query_id", scored.alias("_scored"), F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return rows.select("query_id", F.inline("_scored").alias("cand_id", "score"))


def nb_topk(
    model: BayesModel,
    df: DataFrame,
    text: str,
    k: int,
    row_id: str = "row_id",
    digits: int = 6,
    candidates: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    block_postings: int = BLOCK_POSTINGS,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The ``k`` best classes of every text: ``(query_id, cand_id, score, rank)``, equal scores by ``cand_id``.

    Scores are rounded to ``digits`` before they are ranked. Exact: a class is left out only where it cannot be among
    the best. Classes are cut into blocks of about ``block_postings`` postings and texts into blocks of about
    ``block_words`` words; each pair of blocks meets in one task, which gives its best ``k`` per text. There is no row
    or cell per text and class. Where one block holds the whole index, texts go to it as they are; otherwise their words
    are counted first and looked up in the vocabulary. ``candidates`` (``cand_id``) restricts the classes, not the vocabulary. A text without a
    known word is ranked by the priors. Up to ``FEW_CLASSES`` classes are all scored, by joins and sums alone.
    """
    postings, classes = model.postings, model.classes
    few = classes if candidates is None else classes.join(candidates, F.col("label") == F.col("cand_id"), "left_semi")
    few = few.orderBy("label").limit(FEW_CLASSES + 1).collect()
    if 0 < len(few) <= FEW_CLASSES:
        return topk_per_group(_sums(model, few, df, text, row_id, digits), k)
    entries = postings.count()
    if candidates is None and entries <= block_postings:
        n_classes, bags = 1, _tokens(df, text, row_id)
        some = df.agg(F.count("*").alias("n"), F.sum(F.length(text) / BYTES_A_WORD).alias("words")).first()
    else:
        if candidates is not None:
            wanted = candidates.select(F.col("cand_id").alias("label")).distinct()
            postings, classes = postings.join(wanted, "label", "left_semi"), classes.join(wanted, "label", "left_semi")
        n_classes = max(1, -(-entries // block_postings))
        bags = stored(_bags(model, df, text, row_id, hot_rows), "bags")
        some = bags.agg(F.count("*").alias("n"), F.sum(F.size("words")).alias("words")).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    for_cores = min(-(-cores // n_classes), -(-some["n"] // FEW_TEXTS))
    n_texts = max(1, for_cores, -(-int(some["words"] or 0) // block_words))

    def block(key: str, blocks: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")

    def each(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    # a row per class and some thousand postings, so that copying a block to every block of texts moves few rows
    chunk = F.pmod(F.xxhash64("word"), F.lit(1 + entries // CHUNK_POSTINGS))
    packed = postings.groupBy("label", chunk.alias("_chunk")).agg(F.collect_list("word").alias("words"), F.collect_list("n").alias("n"))
    none = [F.lit(None).cast(kind).alias(c) for c, kind in (("words", "array<string>"), ("n", "array<bigint>"))]
    rows = packed.select("label", "words", "n", F.lit(0.0).alias("prior"), F.lit(0.0).alias("base"))
    rows = rows.unionByName(classes.select("label", *none, "prior", "base"))
    left = bags.select("*", block("query_id", n_texts).alias("_bq"), each(n_classes).alias("_bc"))
    right = rows.select("*", each(n_texts).alias("_bq"), block("label", n_classes).alias("_bc"))
    query_type, label_type = bags.schema["query_id"].dataType, classes.schema["label"].dataType
    schema = T.StructType().add("query_id", query_type).add("cand_id", label_type).add("score", "double")
    kernel = _kernel(k, digits, to_arrow_type(query_type), to_arrow_type(label_type))
    local = left.groupBy("_bq", "_bc").cogroup(right.groupBy("_bq", "_bc")).applyInArrow(kernel, schema)
    return topk_per_group(local, k)


def nb_score(model: BayesModel, df: DataFrame, text: str, candidates: DataFrame, row_id: str = "row_id", digits: int = 6) -> DataFrame:
    """Long rows ``(query_id, cand_id, score)`` of every text with the given few classes."""
    return nb_topk(model, df, text, max(1, candidates.distinct().count()), row_id, digits, candidates).drop("rank")


def _kernel(k: int, digits: int, query_type, label_type) -> Callable:
    def best(bags, rows):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        from citeflow.operators.postings import Index

        schema = pa.schema([("query_id", query_type), ("cand_id", label_type), ("score", pa.float64())])
        is_class = pc.is_null(rows["words"])
        classes = rows.filter(is_class)
        if not bags.num_rows or not classes.num_rows:
            return schema.empty_table()
        classes = classes.take(pc.sort_indices(classes, sort_keys=[("label", "ascending")]))
        lists = rows.filter(pc.invert(is_class))
        of = np.repeat(np.arange(lists.num_rows), pc.list_value_length(lists["words"]).to_numpy())
        postings = {"label": lists["label"].take(pa.array(of)), "word": pc.list_flatten(lists["words"]), "n": pc.list_flatten(lists["n"])}
        index = Index(classes, pa.table(postings), k, digits)
        texts, found, scores = index.search(bags)
        return pa.table([bags["query_id"].take(pa.array(texts)), classes["label"].take(pa.array(found)), pa.array(scores)], schema=schema)

    return best
