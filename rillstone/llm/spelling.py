"""Grouping of spelling variants: words one edit apart, found through asymmetric q-chunks (operator 11).

Two words are *near* if they differ by one inserted, deleted or replaced code point. Of the two, the shorter one (of equal
length: either) contributes two disjoint *chunks*, its first and its last ``q = length // 2`` code points; the other one
contributes positional *grams* of that length. One edit touches at most one chunk, so the other chunk is a gram of the
longer word, at the same place or one to the right. Grams that stand further from both chunks cannot pass that test and are
not made: a word has a handful of rows, however long it is.

Chunks and grams meet in an equi-join on a hash of lengths, side and gram, and pairs are verified by edit distance. A bucket
with more than ``BUCKET`` chunks and as many grams is not paired, as its pairs grow with the square. Its words agree in a chunk
and have their one edit in the code points that are left, so the scheme is applied to these again: chunks are halves of
the rest, and the new key has the old one in it. Each round halves the rest, so it takes as many rounds as the longest
word's length has binary digits at most, and in the end a bucket holds true pairs only.

The *form* of a word is its most frequent near word (ties: the smallest), if that is ``RATIO`` times as frequent; *root* follows
forms to their end. Frequencies grow by ``RATIO`` at each step, so a bounded number of pointer doublings reaches every root.

Cases: null texts have no words; a null id reads as an empty one; repeated rows count each time; an empty table gives no
rows; a run of any length is one word; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.llm import shared

LETTERS = "A-Za-zÀ-ÿ"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
DAMAGED = 31
BUCKET = 32


def runs(docs: DataFrame) -> DataFrame:
    """``doc_id, run``: maximal runs of letters with A-Z in lower case, one row for each place."""
    run = F.explode(F.split(F.col("text"), f"[^{LETTERS}]+")).alias("run")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), run)
    # Short runs are most of the text and give no words: they go before anything is computed on them.
    return rows.filter(F.length("run") >= LEAST_LENGTH).withColumn("run", F.translate("run", CAPITALS, CAPITALS.lower()))


def damaged(rows: DataFrame, one_in: int = DAMAGED) -> DataFrame:
    """``word`` of each run: one code point is missing where a hash of document and run is divisible by ``one_in``."""
    h = F.crc32(F.concat("doc_id", F.lit(":"), "run"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return rows.withColumn("h", h).select(F.when(F.col("h") % one_in == 0, short).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of rows ``word``; summed inside the tasks first, so a frequent word is no hot key."""
    long = words.filter(F.length("word") >= least_length)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _part(start: Column | int, length: Column | int) -> Column:
    """``length`` code points of the word from ``start`` (0 is the first)."""
    return F.substring("word", F.lit(start) + 1, F.lit(length))


def _entry(chunk: bool, more: int, side: str, place: Column | int, q: Column, start: Column, rest: Column, aligned: bool = True) -> Column:
    """A row of the join: ``rest`` code points of the word from ``start`` are not covered by the key.

    ``more`` is how much longer the gram's word is. ``aligned`` rows have all code points but ``rest`` in the right places.
    """
    chunk_length = F.length("word") - (0 if chunk else more)
    key = F.xxhash64(chunk_length, F.lit(more), F.lit(side), _part(place, q))
    return F.struct(key.alias("key"), F.lit(chunk).alias("chunk"), F.lit(more).alias("more"), start.cast("int").alias("start"),
                    rest.cast("int").alias("rest"), F.lit(aligned).alias("aligned"))


def entries(words: DataFrame) -> DataFrame:
    """Chunks and grams of ``words`` (``word, n``), with the word."""
    size, zero = F.length("word"), F.lit(0)
    out = []
    for more in (0, 1):
        q = F.floor(size / 2).cast("int")
        out += [_entry(True, more, "first", 0, q, q, size - q), _entry(True, more, "last", size - q, q, zero, size - q)]
        q = F.floor((size - more) / 2).cast("int")
        out += [_entry(False, more, "first", 0, q, q, size - q), _entry(False, more, "last", size - q, q, zero, size - q)]
        if more:
            out += [_entry(False, 1, "first", 1, q, zero, size, False), _entry(False, 1, "last", size - 1 - q, q, zero, size, False)]
    return words.select("word", "n", F.inline(F.array(*out)))


def refined(rows: DataFrame) -> DataFrame:
    """Entries of crowded buckets with a longer key: of the code points that are left, the first or the last half too.

    ``more`` code points are inserted into the chunk's rest. A rest of one code point that may have one inserted is a half on
    both sides.
    """
    of_chunk = F.when(F.col("chunk"), F.col("rest")).otherwise(F.col("rest") - F.col("more"))
    head = F.when(of_chunk == 1, 1).otherwise(F.floor(of_chunk / 2)).cast("int")
    tail = F.when(of_chunk == 1, 1).otherwise(of_chunk - F.floor(of_chunk / 2)).cast("int")
    end = F.col("start") + F.col("rest")

    def half(side: str, place: Column, q: Column, start: Column) -> Column:
        key = F.xxhash64("key", F.lit(side), _part(place, q))
        return F.struct(key.alias("key"), "chunk", "more", start.cast("int").alias("start"), (F.col("rest") - q).cast("int").alias("rest"), "aligned")

    both = F.array(half("first", F.col("start"), head, F.col("start") + head), half("last", end - tail, tail, F.col("start")))
    return rows.select("word", "n", F.inline(both))


def near_pairs(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``a, n_a, b, n_b``: each pair of near words of ``words`` (``word, n``) once."""
    level, found = entries(words), []
    while True:
        level = shared.written(level)
        sizes = level.groupBy("key").agg(F.count_if("chunk").alias("chunks"), F.count_if(~F.col("chunk")).alias("grams"))
        crowded = F.least("chunks", "grams") > bucket
        sizes = sizes.filter("chunks > 0 AND grams > 0").select("key", crowded.alias("crowded"))
        # Without an uncovered code point, or with one that is replaced, all words of a bucket are near to each other.
        open_ = F.when(F.col("chunk"), F.col("rest") + F.col("more")).otherwise(F.col("rest")) > 1
        met = shared.written(level.join(sizes, "key").withColumn("crowded", F.col("crowded") & open_))
        few = met.filter("NOT crowded")
        a = few.filter("chunk").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
        b = few.filter("NOT chunk").select("key", F.col("word").alias("b"), F.col("n").alias("n_b"))
        one = a.join(b, "key").filter("(length(a) < length(b) OR a < b) AND levenshtein(a, b, 1) = 1")
        found.append(shared.written(one.select("a", "n_a", "b", "n_b").distinct()))
        many = met.filter("crowded AND aligned")
        if many.isEmpty():
            break
        level = refined(many.select("word", "n", "key", "chunk", "more", "start", "rest", "aligned"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def roots(forms: DataFrame, doublings: int) -> DataFrame:
    """``word, root`` of rows ``word, form``: after each doubling a pointer reaches twice as far."""
    ahead = shared.written(forms.select("word", F.col("form").alias("root")))
    for _ in range(doublings):
        beyond = ahead.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        ahead = shared.written(ahead.join(beyond, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")))
    return ahead


def grouped(words: DataFrame, ratio: int = RATIO, bucket: int = BUCKET) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of ``words`` (``word`` unique, ``n``)."""
    words = shared.written(words.select("word", F.col("n").cast("long").alias("n")))
    pairs = near_pairs(words, bucket)
    ways = [F.struct(F.col(x).alias("word"), F.col(f"n_{y}").alias("form_n"), F.col(y).alias("form")) for x, y in (("a", "b"), ("b", "a"))]
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form")))
    near = pairs.select(F.inline(F.array(*ways))).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    known = words.join(near, "word", "left")
    fits = -F.col("best.less") >= ratio * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                         F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))
    known = shared.written(known)
    top, steps = known.agg(F.max("n")).first()[0] or 0, 0
    while top >= ratio:
        top, steps = top // ratio, steps + 1
    ends = roots(known.filter("form IS NOT NULL"), steps.bit_length())
    out = known.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, one_in: int = DAMAGED) -> DataFrame:
    """The words of ``docs`` after the damage, grouped."""
    return grouped(counted(damaged(runs(docs), one_in)))
