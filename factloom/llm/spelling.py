"""Groups of spelling variants: words one edit apart, found with a positional q-gram inverted index and a count filter.

A word of m letters, padded at both ends, has m + Q - 1 grams of Q letters at their places. One edit spoils at most Q of them and moves
the others by one place at most, so two near words share at least (length of the longer) - 1 grams at places that differ by 0 (equal
lengths) or by 0 or 1 (the longer word's ahead). The one of these shared grams that is rarest over the vocabulary is among the Q + 1
rarest of both words (the Q rarest of the shorter of unequal words), so near words meet in a group: a gram, its place in the longer
word, and the longer word's length. Words stand in the groups of their own length as the index and ask in those of the next.

A group is one row. In it the words get an inverted index of their grams by place; each asking word merges the postings of its grams
with a heap and keeps the words that come up often enough; comparing the letters decides. A group of more than BLOCK words is dealt into
blocks of its index, each of which all its asking words meet, so a task holds two blocks' words at most and loses none. All counts are over
the whole table; a gram has Q of 92 signs, so the table of their counts has a proven bound and is sent to all tasks.

Defined results: a null or empty text has no words; rows are keyed by nothing, so repeated rows count again (the deletion depends on
doc_id and word, and rows without doc_id delete nothing); texts are read whole and words may have any length; of near words with the same
count the smallest in code-point order is the form; extra columns, whatever their names, are ignored; a table without frequent words, or
without rows, gives no rows.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import written

# Letters of words (before A-Z are lower-cased), least length and count of a word.
RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 5, 3
Q = 3
#: Index words of a block.
BLOCK = 2000
START, END = "\x01", "\x02"


def _lowered(word: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, upper, upper.lower()))


def vocabulary(docs: DataFrame, every: int = 97) -> DataFrame:
    """word, n: the words of all texts with LEAST_LENGTH letters and LEAST_COUNT places, after one letter in `every` (doc_id, word) is deleted."""
    runs = docs.select(F.col("doc_id").cast("string").alias("doc"), F.explode_outer(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("w"))
    words = runs.where(F.char_length("w") >= LEAST_LENGTH).select("doc", _lowered(F.col("w")).alias("w"))
    h = F.crc32(F.concat("doc", F.lit(":"), "w").cast("binary"))
    hashed = words.select("w", h.alias("h")).withColumn("at", F.when(F.col("h") % every == 0, (F.col("h") % F.char_length("w")).cast("int")))
    kept = F.when(F.col("at").isNull(), F.col("w")).otherwise(F.concat(F.substr("w", F.lit(1), F.col("at")), F.substr("w", F.col("at") + 2)))
    counts = hashed.select(kept.alias("word")).where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


def grams(word: str) -> list[str]:
    """The word's grams in order of their places, with pads of Q - 1 signs."""
    padded = START * (Q - 1) + word + END * (Q - 1)
    return [padded[k : k + Q] for k in range(len(word) + Q - 1)]


def gram_counts(words: DataFrame) -> dict[str, int]:
    """Of each gram, in how many places of the vocabulary it stands: Q of 92 signs, so at most 92 ** Q rows."""
    padded = F.concat(F.lit(START * (Q - 1)), "word", F.lit(END * (Q - 1)))
    own = F.transform(F.sequence(F.lit(1), F.char_length("word") + Q - 1), lambda k: F.substr(padded, k, F.lit(Q)))
    return {r.g: r.n for r in words.select(F.explode_outer(own).alias("g")).groupBy("g").agg(F.count("*").alias("n")).collect()}


def placed(words: DataFrame) -> DataFrame:
    """gram, place, size, asks, word, n: the groups of each word (gram, place and length of the longer word), as index or as what asks."""
    sent = words.sparkSession.sparkContext.broadcast(gram_counts(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                size = len(word)
                rare = heapq.nsmallest(Q + 1, ((counts[g], g, p) for p, g in enumerate(grams(word))))
                rows = [(g, p, size, False, word, n) for _, g, p in rare]
                rows += [(g, p + d, size + 1, True, word, n) for _, g, p in rare[:Q] for d in (0, 1)]
                for row in rows:
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["gram", "place", "size", "asks", "word", "n"])

    return words.mapInArrow(run, "gram string, place int, size int, asks boolean, word string, n long")


def groups(rows: DataFrame, block: int) -> DataFrame:
    """size, words, counts, n_own: each block of a group in one row; of its words the first n_own are the index, the others ask.

    rows is a written table. A group of up to `block` index words is one block; of a larger one each word is dealt to one block and asks in
    all of them, so that pairs across blocks are met too."""
    key = ["gram", "place", "size"]
    large = rows.where(~F.col("asks")).groupBy(*key).agg(F.count("*").alias("own")).where(F.col("own") > block)
    large = written(large.select(*key, F.ceil(F.col("own") / block).cast("int").alias("blocks")), "large-groups")
    dealt = rows.join(large, key, "left")
    mine = F.pmod(F.xxhash64("word"), F.coalesce("blocks", F.lit(1))).cast("int")
    every = F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)
    index = dealt.where(~F.col("asks")).select(*key, mine.alias("block"), F.lit(False).alias("asks"), "word", "n")
    asking = dealt.where(F.col("asks") | F.col("blocks").isNotNull()).select(*key, F.explode_outer(every).alias("block"), F.lit(True).alias("asks"), "word", "n")
    entry = F.struct("word", "n")
    met = index.unionByName(asking).groupBy(*key, "block").agg(F.collect_list(F.when(~F.col("asks"), entry)).alias("own"), F.collect_list(F.when(F.col("asks"), entry)).alias("asking"))
    met = met.where((F.size("own") > 0) & (F.size("own") + F.size("asking") > 1)).select("size", F.size("own").alias("n_own"), F.concat("own", "asking").alias("all"))
    return met.select("size", F.transform("all", lambda x: x["word"]).alias("words"), F.transform("all", lambda x: x["n"]).alias("counts"), "n_own")


def one_edit(a: str, b: str) -> bool:
    """Whether b is a with exactly one letter inserted or replaced (a is not the longer)."""
    if a == b:
        return False
    k = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else len(b) == len(a) + 1 and a[k:] == b[k + 1 :]


def near_in_group(size: int, words: list[str], n_own: int) -> Iterator[tuple[int, int]]:
    """Pairs of places in words, the second among the first n_own, of near words: those have `size` letters, the others as many or one fewer.

    Pairs of the first n_own come once; another word that is as long is paired with those that are not itself."""
    if len(words) == 2:  # two words need no index
        a, b = (words[1], words[0])
        if one_edit(a, b):
            yield 1, 0
        return
    most = size - 1
    spelled = [grams(w) for w in words]
    postings: dict[tuple[str, int], list[int]] = {}
    for k in range(n_own):
        for p, g in enumerate(spelled[k]):
            postings.setdefault((g, p), []).append(k)
    for k, word in enumerate(words):
        if len(word) == size:
            lists = [own for p, g in enumerate(spelled[k]) if (own := postings.get((g, p)))]
        else:
            lists = []
            for p, g in enumerate(spelled[k]):
                here, ahead = postings.get((g, p)), postings.get((g, p + 1))
                if here or ahead:
                    lists.append(list(heapq.merge(here, ahead)) if here and ahead else here or ahead)
        if len(lists) >= most:
            yield from ((k, j) for j in _shared(lists, most, k) if one_edit(word, words[j]))


def _shared(lists: list[list[int]], most: int, below: int) -> Iterator[int]:
    """The numbers under `below` that stand in `most` of the sorted lists at least. Such a number is in one of the len(lists) - most + 1 shortest
    lists: these are merged with a heap, the others are looked into for what comes up."""
    lists = sorted(lists, key=len)
    few = len(lists) - most + 1
    short, long = lists[:few], lists[few:]
    for j, same in groupby(short[0] if few == 1 else heapq.merge(*short)):
        if j >= below:
            return
        n, left = sum(1 for _ in same), len(long)
        for own in long:
            if n >= most or n + left < most:
                break
            left -= 1
            at = bisect_left(own, j)
            n += at < len(own) and own[at] == j
        if n >= most:
            yield j


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, near, near_n: both directions of each pair; a pair that meets in several groups comes several times."""
    rows = written(placed(words), "placed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                word, near, n = [], [], []
                for size, spelled, counts, n_own in zip(*[part.column(c).to_pylist() for c in ("size", "words", "counts", "n_own")], strict=True):
                    for a, b in near_in_group(size, spelled, n_own):
                        word += spelled[a], spelled[b]
                        near += spelled[b], spelled[a]
                        n += counts[b], counts[a]
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near, pa.string()), pa.array(n, pa.int64())], ["word", "near", "near_n"])

    return groups(rows, block).mapInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of a written table (word, form): forms followed to the last, by doubling. A form is at least twice as frequent as its word, so
    the longest way has as many steps as the largest count has bits and there are few rounds; a form of many words is a join Spark can split."""
    links = forms.select("word", F.col("form").alias("root"))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = written(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not links.where("moved").head(1):
            return links.select("word", "root")
        links = links.drop("moved")


def variants(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    words = written(vocabulary(docs), "words")
    found = near_words(words, block).groupBy("word").agg(F.collect_set(F.struct((-F.col("near_n")).alias("m"), "near")).alias("near"))  # a word's neighbours are bounded by its letters
    best = F.array_min("near")
    joined = words.join(found, "word", "left").select("word", "n", F.when(-best["m"] >= 2 * F.col("n"), best).alias("best"), F.coalesce(F.size("near"), F.lit(0)).cast("long").alias("n_near"))
    named = written(joined.select("word", F.col("best.near").alias("form"), "n", "n_near", (-F.col("best.m")).alias("form_n")), "forms")
    last = roots(named.where(F.col("form").isNotNull()))
    return named.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
