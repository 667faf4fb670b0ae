"""Evaluation texts inside a corpus: a prefix-filtered set join with positional bounds and exact verification.

A text is the set of its shingles of ``SHINGLE`` words with their places. A leak is a *window* of ``words`` consecutive
words of an item: it matches only if all its shingles do, so one of them suffices as its necessary prefix.

1. One pass over the corpus. A Bloom filter of the items' shingles, of bounded size, tells which shingles of a document may
   be of an item. The pass counts in how many documents each of these stands, and, by length and position, keeps the
   *stretches* in which so many follow each other without a break as a window has: a window of an item lies in one.
   Counts are combined before they are sent, and stretches are the leaked passages and little else.
2. The shingles of an item are ordered by the rarity that was counted, and each window's prefix is its rarest shingle.
   Windows with a shingle that stands in no document need none. Neighbouring windows mostly share their prefix.
3. Each prefix shingle in a stretch gives a candidate: its place and as many words around it as a window holding it can
   have. Candidates meet the items' prefixes in an equi-join by hash.
4. In the window of words around the prefix, at most ``words - SHINGLE`` to each side, the two texts are compared word by
   word: the hashes only propose.

The corpus is read once, whatever the number of items. Items of one text are one until the end: copies of an item, however
many, are joined and compared once. The driver sees the two filters and nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtree.checkpoints import checkpointed
from loomtree.functions import bloom
from loomtree.llm.arrow import emit, schema
from loomtree.llm.canonical import canonical
from loomtree.session import ship

#: Consecutive words that make a leak.
WORDS = 12
#: Words of a shingle.
SHINGLE = 5
#: Rows of a filter at most (64 MB, for 44 million shingles): with more it lets more through, and loses none.
FILTER_ROWS = 8192
#: Words whose hashes a worker keeps, and shingles it counts, before it starts anew.
KEPT = 500_000

_WORD = re.compile(r"[^\W_]+")

LEAKS = "doc_id bigint,item_id bigint,shingles int,longest_words int,first_word int"


def words_of(text: str) -> list[str]:
    """Longest runs of letters or digits of the consistent form, without case."""
    return _WORD.findall(canonical(text).lower())


class WordHashes(dict):
    """64-bit hashes of words, each computed once while it is kept."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


def shingle_hashes(words: list[str], size: int, hashes: WordHashes) -> np.ndarray:
    """A well mixed 64-bit hash of every shingle of ``size`` words, by place."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    mixed = np.zeros(n, np.uint64)
    for k in range(size):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + each[k : k + n]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29))


def _context(words: list[str], at: int, before: int, after: int) -> tuple[int, str]:
    """How many words stand before ``at`` in the context, and the context of at most so many words around it."""
    first = max(0, at - before)
    return at - first, " ".join(words[first : at + after])


def _distinct_shingles(items: DataFrame, words: int, size: int) -> DataFrame:
    """(text_id, at, h) of all items of a window and more."""
    to = schema("text_id bigint,at int,h bigint")

    def run(batches):
        def rows():
            hashes = WordHashes()
            for b in batches:
                for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    seq = words_of(text)
                    if len(seq) >= words:
                        yield from ((item, at, h) for at, h in enumerate(shingle_hashes(seq, size, hashes).view(np.int64).tolist()))

        yield from emit(rows(), to)

    return items.mapInArrow(run, "text_id bigint,at int,h bigint")


def _filter(keys: DataFrame):
    """A broadcast filter of (h) and the number of distinct keys."""
    some = keys.select("h").distinct()
    n = some.count()
    rows = min(FILTER_ROWS, bloom.n_rows(n))
    table = bloom.bloom_table(some, F.col("h"), rows)
    return (keys.sparkSession.sparkContext.broadcast(bloom.bloom_array(table, rows)) if n else None), n


SCANNED = "h bigint,n bigint,doc_id bigint,at int,words string"


def stretches(found: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The first and last of every run of ``least`` and more numbers that follow each other, in rising numbers."""
    if len(found) < least:
        return []
    ends = np.flatnonzero(np.diff(found) > 1)
    first, last = np.concatenate([[0], ends + 1]), np.concatenate([ends, [len(found) - 1]])
    return [(int(found[a]), int(found[z])) for a, z in zip(first, last) if z - a + 1 >= least]


def _scanned(docs: DataFrame, sent, words: int, size: int) -> DataFrame:
    """(h, n): in how many documents of a task each shingle stands that the filter lets through; and, with h null,
    (doc_id, at, words): the stretches of documents that may hold a window."""
    to, span = schema(SCANNED), words - size + 1

    def run(batches):
        held: list[np.ndarray] = []
        hashes, known, most = WordHashes(), sent.value, 0

        def counted():
            values, n = np.unique(np.concatenate(held), return_counts=True)
            return emit(((h, k, None, None, None) for h, k in zip(values.view(np.int64).tolist(), n.tolist())), to)

        for b in batches:
            kept = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seq = words_of(text)
                if len(seq) < words:
                    continue
                each = shingle_hashes(seq, size, hashes)
                places = bloom.hits(each, known)
                if not len(places):
                    continue
                kept += [(None, None, doc, a, " ".join(seq[a : z + size])) for a, z in stretches(places, span)]
                held.append(np.unique(each[places]))
                most += len(held[-1])
            if kept:
                yield from emit(kept, to, 2_000)
            if most > KEPT:
                yield from counted()
                held, most = [], 0
        if held:
            yield from counted()

    return docs.select("doc_id", "text").where(F.col("text").isNotNull()).mapInArrow(run, SCANNED)


PREFIX = "h bigint,text_id bigint,i_before int,i_words string"


def prefix_places(rarity: list[tuple[int, int] | None], windows: int, span: int) -> set[int]:
    """The places of the rarest shingle of every window, windows with an absent shingle (None) left out."""
    return {
        min(range(w, w + span), key=lambda k: (rarity[k], k)) for w in range(windows) if all(rarity[k] is not None for k in range(w, w + span))
    }


def _prefixes(items: DataFrame, shingles: DataFrame, frequency: DataFrame, words: int, size: int) -> DataFrame:
    """(h, text_id, i_before, i_words): the prefix shingles of the items' windows with the words around them."""
    counts = F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n")))), lambda x: x["n"])  # as many as the item has words
    rated = shingles.join(frequency, "h", "left").groupBy("text_id").agg(counts.alias("counts"))
    to, reach = schema(PREFIX), words - size

    def run(batches):
        def rows():
            hashes = WordHashes()
            for b in batches:
                for item, text, found in zip(*(b.column(i).to_pylist() for i in range(3))):
                    seq = words_of(text)
                    own = shingle_hashes(seq, size, hashes).view(np.int64).tolist()
                    rarity = [(n, h) if n else None for n, h in zip(found, own)]
                    for k in sorted(prefix_places(rarity, len(seq) - words + 1, reach + 1)):
                        yield own[k], item, *_context(seq, k, reach, words)

        yield from emit(rows(), to)

    return items.join(rated, "text_id").select("text_id", "text", "counts").mapInArrow(run, PREFIX)


CANDIDATES = "h bigint,doc_id bigint,at int,d_before int,d_words string"


def _candidates(found: DataFrame, sent, words: int, size: int) -> DataFrame:
    """(h, doc_id, at, d_before, d_words): the places of prefix shingles in stretches with the words around them."""
    to, reach = schema(CANDIDATES), words - size

    def run(batches):
        def rows():
            hashes, known = WordHashes(), sent.value
            for b in batches:
                for doc, start, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                    seq = text.split(" ")
                    each = shingle_hashes(seq, size, hashes)
                    own = each.view(np.int64)
                    for at in bloom.hits(each, known).tolist():
                        yield int(own[at]), doc, start + at, *_context(seq, at, reach, words)

        yield from emit(rows(), to)

    return found.select("doc_id", "at", "words").mapInArrow(run, CANDIDATES)


def common_run(a: list[str], a_at: int, b: list[str], b_at: int, size: int) -> tuple[int, int]:
    """Equal words before and from two places on; (0, 0) if the ``size`` words from there are not equal."""
    if a[a_at : a_at + size] != b[b_at : b_at + size]:
        return 0, 0
    left = 0
    while left < min(a_at, b_at) and a[a_at - left - 1] == b[b_at - left - 1]:
        left += 1
    right, most = size, min(len(a) - a_at, len(b) - b_at)
    while right < most and a[a_at + right] == b[b_at + right]:
        right += 1
    return left, right


def _verified(met: DataFrame, words: int, size: int) -> DataFrame:
    """(doc_id, text_id, start): the windows that are equal word by word."""
    to = schema("doc_id bigint,text_id bigint,start int")

    def run(batches):
        def rows() -> Iterator[tuple]:
            for b in batches:
                for doc, item, at, d, d_words, i, i_words in zip(*(b.column(k).to_pylist() for k in range(7))):
                    left, right = common_run(d_words.split(" "), d, i_words.split(" "), i, size)
                    for start in range(at - left, at + right - words + 1):
                        yield doc, item, start

        yield from emit(rows(), to)

    picked = met.select("doc_id", "text_id", "at", "d_before", "d_words", "i_before", "i_words")
    return picked.mapInArrow(run, "doc_id bigint,text_id bigint,start int")


def leaked_windows(docs: DataFrame, items: DataFrame, *, words: int = WORDS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, starts) for every document that holds a window of an item: the places at which one begins, in order."""
    spark, size = ship(docs.sparkSession), min(shingle, words)
    none = spark.createDataFrame([], "doc_id bigint, item_id bigint, starts array<int>")
    known = items.select("item_id", "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).distinct()
    texts = checkpointed(known.select("text").distinct().withColumn("text_id", F.monotonically_increasing_id()).select("text_id", "text"))
    shingles = checkpointed(_distinct_shingles(texts, words, size))
    sent, n = _filter(shingles)
    if not n:
        return none
    scanned = checkpointed(_scanned(docs, sent, words, size))
    frequency = scanned.where("h IS NOT NULL").groupBy("h").agg(F.sum("n").alias("n"))
    prefixes = checkpointed(_prefixes(texts, shingles, frequency, words, size))
    sent, n = _filter(prefixes)
    if not n:
        return none
    windows = _verified(_candidates(scanned.where("words IS NOT NULL"), sent, words, size).join(prefixes, "h"), words, size)
    # a document has no more windows than words
    per_text = windows.groupBy("doc_id", "text_id").agg(F.collect_set("start").alias("s"))
    holders = known.join(texts, "text").select("text_id", "item_id")
    starts = F.array_sort(F.array_distinct(F.flatten(F.collect_list("s"))))
    return per_text.join(holders, "text_id").groupBy("doc_id", "item_id").agg(starts.alias("starts"))


def leaked_passages(docs: DataFrame, items: DataFrame, *, words: int = WORDS) -> DataFrame:
    """(doc_id, item_id, shingles, longest_words, first_word) for every document that holds a window of an item.

    shingles counts places of the document at which one begins; longest_words is the longest run of words covered by
    windows that follow each other; first_word is the place of the first.

    Defined results: null texts, and items or documents of fewer words, leak nothing; repeated rows of documents or
    items count once; an item that holds a window twice counts it once; empty tables give no rows; other columns are
    ignored. Reads the documents once, when this is called.
    """
    found = leaked_windows(docs, items, words=words)
    begin = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(state, x):
        run = F.when(x == state["last"] + 1, state["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(state["best"], run).alias("best"))

    longest = F.aggregate("starts", begin, step, lambda state: state["best"] + (words - 1))
    return found.select("doc_id", "item_id", F.size("starts").alias("shingles"), longest.alias("longest_words"), F.array_min("starts").alias("first_word"))


def leak_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per test item how many documents hold passages of it, and the longest; items that leaked nowhere have 0."""
    per = leaked_passages(docs, items).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n_documents"), F.max("longest_words").alias("longest_words")
    )
    known = items.select("item_id").distinct()
    return known.join(per, "item_id", "left").select(
        "item_id", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("longest_words", F.lit(0)).alias("longest_words")
    )
