"""Spelling variants: words that one inserted, deleted or replaced code point apart.

Of two words at distance one, the shorter (or either, if equally long) is cut into two disjoint
chunks. One edit leaves one of the chunks as it is, and the other word has it as a gram, at the same
place or, behind an insertion, one place on. So words meet that share a chunk and a gram within shift
one; a word posts those of its positional grams that can meet a chunk. What met is verified.

A chunk that many words share, such as a frequent beginning, would pair them all. Such a group is
split again: the part outside the shared chunk, which holds the edit, is cut into two chunks in
turn, and so on while a group is large. A group that cannot be split shares all but one code point,
so the alphabet bounds it. The parts of long
words are split in the same way until they are short. Every pair is found in exactly one group: the one whose open part holds the
first place where the words differ.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peergauge.llm.common import whole_text
from peergauge.session import write_shared

# What counts as a run of letters.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Of this many occurrences one loses a code point, by its hash.
THINNED = 97
# Words that share a chunk and are compared with each other; larger groups are split.
GROUP_WORDS = 32
# Code points of the parts that are compared, at most; parts of longer words are split.
COMPARED = 64


def corpus_words(docs: DataFrame, least_length: int = 5, least_n: int = 3) -> DataFrame:
    """(word, n): the words of all texts with at least so many code points and occurrences.

    Runs of letters, A-Z lower-cased. Where 97 divides the crc32 of "doc_id:run", the run loses the
    code point at crc32 modulo its length. A null text has no words; a null doc_id is written as
    nothing before the colon. Rows alike all count.
    """
    runs = F.regexp_extract_all(F.translate(whole_text(), UPPER, LOWER), F.lit(RUN), F.lit(0))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    found = docs.select(name.alias("name"), F.explode(runs).alias("run"))
    # A run only gets shorter.
    found = found.where(F.length("run") >= least_length)
    hashed = found.select("run", F.crc32(F.concat_ws(":", "name", "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    thinned = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % THINNED == 0, thinned).otherwise(F.col("run"))
    counted = hashed.groupBy(word.alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.length("word") >= least_length) & (F.col("n") >= least_n))


def _posted(open_parts: DataFrame) -> DataFrame:
    """Both halves of each open part, with the key of what lies outside the half.

    ``length`` is that of the chunked word; a word that posts grams is ``longer`` by 0 or 1.
    """
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.array(
        F.struct(F.col("low").alias("low"), middle.alias("high")),
        F.struct(middle.alias("low"), F.col("high").alias("high")),
    )
    rows = open_parts.select("word", "n", "length", "longer", F.explode(halves).alias("part"))
    rows = rows.select("word", "n", "length", "longer", "part.*")
    before = F.substring("word", F.lit(1), F.col("low"))
    behind = F.substring("word", F.col("high") + F.col("longer") + 1, F.length("word"))
    return rows.withColumn("key", F.xxhash64("length", "low", "high", before, behind))


def _verified(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) at distance one of the rows of each key, whose first difference is in the part."""
    chunks = rows.where("longer = 0").select(
        "key", "length", "low", "high", F.col("word").alias("a"), F.col("n").alias("a_n")
    )
    grams = rows.select("key", "longer", F.col("word").alias("b"), F.col("n").alias("b_n"))
    size = F.col("high") - F.col("low")
    part_a = F.substring("a", F.col("low") + 1, size)
    part_b = F.substring("b", F.col("low") + 1, size + F.col("longer"))
    same_behind = F.substring("a", F.col("high") + 1, F.length("a")) == F.substring(
        "b", F.col("high") + F.col("longer") + 1, F.length("b")
    )
    same_before = F.substring("a", F.lit(1), F.col("low")) == F.substring(
        "b", F.lit(1), F.col("low")
    )
    once = (F.col("longer") == 1) | (F.col("a") < F.col("b"))
    first_here = (F.col("high") == F.col("length")) | ~F.startswith(part_b, part_a)
    met = chunks.join(grams, "key").where(
        once
        & same_before
        & same_behind
        & first_here
        & (F.levenshtein(part_a, part_b, 1) == 1)
    )
    return met.select("a", "a_n", "b", "b_n")


def near_pairs(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """(a, a_n, b, b_n): every pair of distinct words at distance one, each once.

    ``words`` has distinct words with their n, and is read several times. Words of one code point
    have no two chunks; they are not for this.
    """
    both = F.explode(F.array(F.lit(0), F.lit(1)))
    open_parts = words.select("word", "n", both.alias("longer")).select(
        "word",
        "n",
        (F.length("word") - F.col("longer")).alias("length"),
        "longer",
        F.lit(0).alias("low"),
        (F.length("word") - F.col("longer")).alias("high"),
    )
    open_parts = open_parts.where("length > 1")
    found = []
    while True:
        posted = write_shared(_posted(open_parts), "chunks")
        sizes = posted.groupBy("key").agg(
            F.count(F.lit(1)).alias("members"), F.count_if(F.col("longer") == 0).alias("chunked")
        )
        met = posted.join(sizes.where("members > 1 and chunked > 0"), "key")
        size = F.col("high") - F.col("low")
        split = ((F.col("members") > group_words) & (size > 1)) | (size > COMPARED)
        met = write_shared(met.withColumn("split", split).drop("members", "chunked"), "met")
        found.append(write_shared(_verified(met.where("not split")), "pairs"))
        open_parts = met.where("split").drop("split", "key")
        if open_parts.isEmpty():
            return reduce(DataFrame.unionByName, found)


def _roots(formed: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, by doubling.

    A form occurs at least twice as often as its word, so chains are shorter than 64 and six rounds
    reach the end of each.
    """
    roots = write_shared(formed.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = roots.join(ahead, "root", "left")
        step = write_shared(step.select("word", "root", "next"), "roots")
        if step.where("next is not null").isEmpty():
            return step.select("word", "root")
        roots = step.select("word", F.coalesce("next", "root").alias("root"))


def group_variants(docs: DataFrame, least_length: int = 5, least_n: int = 3) -> DataFrame:
    """Per word of the corpus: word, form, root, n, n_near, form_n.

    A word's form is the most frequent word one edit away (ties: the smallest in code-point order), if
    that is at least twice as frequent as the word; its root is where forms lead. Words with no such
    neighbour have no form, n_near counts neighbours, and the root of a word without form is itself.
    Null and empty texts have no words, and an empty table gives no rows. Only doc_id and text are
    read.
    """
    words = write_shared(corpus_words(docs, least_length, least_n), "words")
    pairs = near_pairs(words)
    sides = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("m")),
    )
    # A word has at most as many neighbours as the alphabet allows edits.
    near = (
        pairs.select(F.inline(sides))
        .groupBy("word")
        .agg(
            F.count(F.lit(1)).alias("n_near"),
            F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("other"))).alias("best"),
        )
    )
    joined = words.join(near, "word", "left")
    formed = -F.col("best.m") >= 2 * F.col("n")
    shaped = write_shared(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(formed, F.col("best.other")).alias("form"),
            F.when(formed, -F.col("best.m")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(shaped.where("form is not null"))
    return shaped.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
