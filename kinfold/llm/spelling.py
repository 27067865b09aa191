"""Spelling variants grouped under the frequent word they differ from by one character.

**Asymmetric q-chunks.** Of two words the longer one (of equally long ones the first) contributes two
disjoint chunks, its halves; the other one contributes its positional grams, at every place and of every length that such a chunk can
have. One inserted, deleted or replaced character leaves one of the two chunks whole, moved by one place at most. Halves of words are
frequent, so the half that holds the edit is cut once more in the same way: one of its two chunks is whole too. A pair
meets in a join on the longer word's length, the half and the chunk of the other half; the places of the grams differ by
the words' difference in length, none or one. It is verified there by its edit distance. A pair that meets more than once is taken from the first meeting.

A word's form is its nearest word of largest count, if that is ``RATIO`` times the word's own or more; forms are followed to the
last by pointer doubling. A form is always more frequent than its word, so there are no cycles, and the number of
rounds is the logarithm of the longest chain.

Occurrences are counted before anything is shuffled by word. Null and empty texts have no words; a null id is the empty string in the
hash that picks deletions. Repeated rows count as often as they occur. An empty table gives an empty result. Columns other than ``doc_id``
and ``text`` are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.session import durable

#: Characters of a word at least, and its occurrences.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: How much more frequent a form must be.
RATIO = 10
#: One in so many occurrences loses a character.
DAMAGE = 31

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, least: int = LEAST_LENGTH, text: str = "text") -> DataFrame:
    """(doc_id, run): every maximal run of at least ``least`` letters of every text, A-Z lower-cased."""
    letters = F.regexp_extract_all(F.col(text), F.lit("([A-Za-zÀ-ÿ]{%d,})" % least), 1)
    found = docs.where(F.col(text).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(letters).alias("run"))
    return found.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _CAPITALS, _SMALL)).otherwise(F.col("run")))


def damaged(run: Column, doc_id: Column, every: int = DAMAGE) -> Column:
    """``run`` without one character where a hash of the id and the run says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(words: DataFrame, least: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)


def _kept(word: str, size: Column, which: int, shorter: int) -> tuple[Column, Column]:
    """What is left of a word, before and behind, when quarter ``which`` of a word of ``size`` characters is taken out; it has ``shorter`` characters less."""
    half = F.floor(size / 2)
    ends = [F.lit(0), F.floor(half / 2), half, half + F.floor((size - half) / 2), size]
    begin, end = (x.cast("int") for x in ends[which : which + 2])
    return F.substring(F.col(word), F.lit(1), begin), F.substring(F.col(word), end - shorter + 1, size)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n) of all words (word, n) that differ by one inserted, deleted or replaced character, each pair once; ``b`` is no longer than ``a``."""

    def keys(sizes: dict[int, Column]) -> Column:
        """A hash for each longer word's length and each quarter that may hold the edit."""
        return F.array(*[F.xxhash64(F.lit(q), size, *_kept("word", size, q, shorter)) for shorter, size in sizes.items() for q in range(4)])

    size = F.length("word")
    chunks = words.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.posexplode(keys({0: size})).alias("q", "key"))
    grams = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.explode(keys({0: size, 1: size + 1})).alias("key"))
    shorter, longer = F.length("a") - F.length("b"), F.length("a")

    def same(q: int) -> Column:
        whole, less = _kept("a", longer, q, 0), [F.when(shorter == 0, x).otherwise(y) for x, y in zip(_kept("b", longer, q, 0), _kept("b", longer, q, 1), strict=True)]
        return (whole[0] == less[0]) & (whole[1] == less[1])

    ordered = (shorter == 1) | ((shorter == 0) & (F.col("a") < F.col("b")))
    first = reduce(lambda out, q: F.when(same(q), F.lit(q)).otherwise(out), (3, 2, 1, 0), F.lit(-1))
    found = chunks.join(grams, "key").where(ordered & (F.levenshtein("a", "b", 1) == 1))
    return found.where(F.col("q") == first).select("a", "a_n", "b", "b_n")


def forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, form, n_near, form_n) of every word (word, n)."""
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("least"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    taken = -F.col("best.least") >= ratio * F.col("n")
    return joined.select("word", "n", F.when(taken, F.col("best.near")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, -F.col("best.least")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of every link (word, form): forms followed to the last, twice as far in each round."""
    reach = durable(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = reach.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = durable(reach.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        reach = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            return reach


def grouped(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word (word, n)."""
    known = durable(words)
    linked = durable(forms(known, near_pairs(known), ratio))
    root = roots(linked.where(F.col("form").isNotNull()))
    return linked.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, least: int = LEAST_LENGTH, count: int = LEAST_COUNT, ratio: int = RATIO, every: int = DAMAGE) -> DataFrame:
    """The groups of the words of ``docs``, occurrences damaged as :func:`damaged` tells."""
    words = runs(docs, least).select(damaged(F.col("run"), F.col("doc_id"), every).alias("word"))
    return grouped(vocabulary(words, least, count), ratio)
