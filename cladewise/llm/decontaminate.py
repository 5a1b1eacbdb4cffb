"""Benchmark decontamination by a positional inverted index, in DataFrame functions only.

The index is a stored table of postings: term, document and position, for the
rarest few words of every benchmark window (rarest in the training documents,
counted over all of them). A window is looked up by its rarest term; the lists
of its next rarest terms, moved by their offsets, are intersected with that
term's positions in the document. What is left is compared with the words that
the rarest term's posting carries from its neighbourhood, which decides between
an exact phrase, a proximity match (all words within a few more places, in any
order) and nothing.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ._shared import written

#: The word rule after lower-casing A-Z.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Posting lists that are intersected for a window: its rarest terms.
LISTS = 3
#: Windows of one rarest term in a row of the lookup table.
LOOKUPS = 64
#: Most bits of the table by which words that are no term are passed over; it is broadcast, and no larger for more terms.
MARK_BITS = 1 << 20
#: A table of terms is broadcast only below this many bytes, as counted.
BROADCAST_BYTES = 4 << 20


def words(text: Column) -> Column:
    """Words of a text; null has none."""
    split = F.split(F.translate(text.cast("string"), UPPER, LOWER), SEPARATORS)
    return F.coalesce(F.array_remove(split, ""), F.array().cast("array<string>"))


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(item_id, window): every ``width`` consecutive words; all words of a shorter item; none of an item without words."""
    w = benchmark.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - width, F.lit(0))
    starts = w.select("item_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    return starts.select("item_id", F.slice("words", F.col("at") + 1, width).alias("window")).distinct()


def frequencies(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, n): number of postings of each word of the vocabulary (column word)."""
    size = vocabulary.agg(F.sum(F.octet_length("word") + 32)).first()[0] or 0
    small = F.broadcast(vocabulary) if size <= BROADCAST_BYTES else vocabulary
    return docs.select(F.explode(words(F.col("text"))).alias("word")).join(small, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def rarest_terms(windows: DataFrame, frequency: DataFrame, lists: int = LISTS) -> DataFrame:
    """(item_id, window, lists): for each window whose words all occur, its rarest words with the first offset of each, rarest first."""
    each = windows.select("item_id", "window", F.posexplode("window").alias("offset", "word")).groupBy("item_id", "window", "word").agg(F.min("offset").alias("offset"))
    known = each.join(frequency, "word").groupBy("item_id", "window").agg(F.array_sort(F.collect_list(F.struct("n", "word", "offset"))).alias("lists"))
    return known.where(F.size("lists") == F.size(F.array_distinct("window"))).withColumn("lists", F.slice("lists", 1, lists))


def lookup_table(ranked: DataFrame) -> DataFrame:
    """(term, lookups): windows by their rarest term, at most about ``LOOKUPS`` in a row; a lookup holds offset, item_id, window and the other lists."""
    term = ranked.withColumn("term", F.col("lists")[0]["word"])
    rows = term.groupBy("term").agg(F.ceil(F.count(F.lit(1)) / LOOKUPS).alias("parts"))
    term = term.join(rows, "term").withColumn("part", F.pmod(F.xxhash64("item_id", "window"), F.col("parts")))
    lookup = F.struct(F.col("lists")[0]["offset"].alias("offset"), "item_id", "window", F.slice("lists", 2, LISTS).alias("others"))
    return term.groupBy("term", "part").agg(F.collect_list(lookup).alias("lookups")).drop("part")


def terms_of(ranked: DataFrame) -> DataFrame:
    """(term, first): words of the lists of ``rarest_terms``; first if one is the rarest of a window."""
    return ranked.select(F.posexplode("lists.word").alias("place", "term")).groupBy("term").agg((F.min("place") == 0).alias("first"))


def marks(terms: DataFrame) -> tuple[DataFrame, int]:
    """One row of two bit tables, ``any`` and ``first``, in which the hashes of terms are set, and their number of bits."""
    bits = 64
    while bits < min(32 * terms.count(), MARK_BITS):
        bits *= 2
    place = F.pmod(F.xxhash64("term"), F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    held = terms.groupBy(F.floor(place / 64).alias("id")).agg(F.bit_or(one).alias("any"), F.bit_or(F.when(F.col("first"), one).otherwise(0)).alias("first"))
    every = terms.sparkSession.range(bits // 64).join(held, "id", "left").fillna(0).agg(F.array_sort(F.collect_list(F.struct("id", "any", "first"))).alias("t"))
    return every.select(F.col("t.any").alias("any"), F.col("t.first").alias("first")), bits


def postings(docs: DataFrame, terms: DataFrame, reach: int) -> DataFrame:
    """(doc_id, text_hash, row, term, at, before, around): each position of a term; those of first ones with ``reach`` words on both sides.

    ``row`` tells apart the rows of ``docs``, equal ones too. A table of bits
    passes over nearly all other words where they stand; the terms themselves
    are then joined.
    """
    table, bits = marks(terms)
    # explode(array(...)) keeps the split from being inlined into the lambda, where it would run once a word
    w = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("row"), F.explode(F.array(words(F.col("text")))).alias("words")).join(F.broadcast(table))

    def marked(word: Column, kind: str) -> Column:
        place = F.pmod(F.xxhash64(word), F.lit(bits))
        return F.getbit(F.get(kind, F.floor(place / 64).cast("int")), F.pmod(place, F.lit(64)).cast("int")) == 1

    def hit(i: Column) -> Column:
        before, word = F.least(i, F.lit(reach)), F.get("words", i)
        return F.struct(word.alias("term"), i.alias("at"), before.alias("before"), F.when(marked(word, "first"), F.slice("words", i - before + 1, before + 1 + reach)).alias("around"))

    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: marked(F.get("words", i), "any"))
    hits = w.where(F.size("words") > 0).select("doc_id", "text_hash", "row", F.explode(F.transform(at, hit)).alias("hit")).select("doc_id", "text_hash", "row", "hit.*")
    size = terms.agg(F.sum(F.octet_length("term") + 32)).first()[0] or 0
    own = terms.select("term")
    return hits.join(F.broadcast(own) if size <= BROADCAST_BYTES else own, "term", "left_semi")


def matches(docs: DataFrame, benchmark: DataFrame, width: int = 13, slack: int = 0) -> DataFrame:
    """(doc_id, text_hash, item_id, start, length, exact): occurrences of benchmark windows in documents.

    ``exact``: the window's words in order from word ``start``. With ``slack``
    above 0, also proximity matches: all words of the window, in any order and
    counted once each, within ``length`` = window + slack words that hold the
    rarest one. ``text_hash`` tells rows of one doc_id apart.
    """
    docs = docs.select(F.col("doc_id"), F.col("text"))
    windows = item_windows(benchmark, width)
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    ranked = written(rarest_terms(windows, frequencies(docs, vocabulary)))
    stored = written(postings(docs, written(terms_of(ranked)), width - 1 + slack))
    # the part of a row's lists that offsets can reach from a posting: term and position in one number (a filter
    # only: what passes is compared word by word)
    reach = Window.partitionBy("row").orderBy("at").rangeBetween(1 - width, width - 1)
    rarest = stored.withColumn("held", F.collect_list(F.xxhash64("term", "at")).over(reach)).where("around is not null")
    found = rarest.join(lookup_table(ranked), "term")

    def hit(x: Column) -> Column:
        from_, start = F.col("before") - x["offset"], F.col("at") - x["offset"]
        met = F.forall(x["others"], lambda o: F.array_contains("held", F.xxhash64(o["word"], start + o["offset"])))
        return (from_ >= 0) & met & (F.slice("around", F.greatest(from_, F.lit(0)) + 1, F.size(x["window"])) == x["window"])

    exact = F.transform(F.filter("lookups", hit), lambda x: F.struct(x["item_id"].alias("item_id"), (F.col("at") - x["offset"]).alias("start"), F.size(x["window"]).alias("length"), F.lit(True).alias("exact")))
    if slack:

        def near(x: Column) -> Column:
            span = F.size(x["window"]) + slack
            first = F.sequence(F.greatest(F.col("before") - span + 1, F.lit(0)), F.col("before"))
            return F.exists(first, lambda s: F.size(F.array_except(x["window"], F.slice("around", s + 1, span))) == 0) & ~hit(x)

        loose = F.transform(F.filter("lookups", near), lambda x: F.struct(x["item_id"].alias("item_id"), F.greatest(F.col("at") - F.size(x["window"]) - slack + 1, F.lit(0)).alias("start"), (F.size(x["window"]) + slack).alias("length"), F.lit(False).alias("exact")))
        exact = F.concat(exact, loose)
    joined = found.select("doc_id", "text_hash", exact.alias("m")).where(F.size("m") > 0)
    return joined.select("doc_id", "text_hash", F.explode("m").alias("m")).select("doc_id", "text_hash", "m.*").distinct()  # equal rows have equal ones


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: float = 0.05) -> DataFrame:
    """Per row of ``docs``: n_words, n_hit (words inside any exact window), items (sorted strings) and contaminated.

    Contaminated: n_hit > 0 and n_hit >= share * n_words. Extra columns of
    either table are left out. Null and empty texts have no words and are
    clean; repeated rows each get the same result; rows of one doc_id with
    different texts are judged apart; a null doc_id is kept; items without
    words match nothing; empty tables give no rows or no hits.
    """
    hits = matches(docs, benchmark, width).groupBy("doc_id", "text_hash").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence("start", F.col("start") + F.col("length") - 1))))).cast("long").alias("n_hit"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    hits = hits.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "n_hit", "items")
    every = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = every.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    part = Fraction(str(share))  # n_hit / n_words >= share in whole numbers
    return out.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (n_hit * part.denominator >= F.col("n_words") * part.numerator)).alias("contaminated"))
