"""Spelling variants: words one edit apart, by intersecting their Levenshtein automata with broadcast shards of a trie."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import parts
from .storage import settled

#: Code points and occurrences of a word; a form has at least so many times the occurrences of its variant.
LETTERS, OCCURRENCES, FACTOR = 6, 5, 5
#: One occurrence in about so many loses a code point.
SPOILT = 199
#: Words that a task counts before it sends them on.
HELD = 200_000
#: Code points of the words of one shard (a longer word is a shard by itself), and bytes of shards that are broadcast at once.
SHARD_LETTERS, BROADCAST_BYTES = 400_000, 32 << 20


def _spoilt_words(doc: str, text: str, letters: int, run: re.Pattern[str]) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of a text, one code point taken from each run whose hash SPOILT divides."""
    prefix = zlib.crc32(f"{doc}:".encode())
    for word, n in Counter(run.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
        h = zlib.crc32(word.encode(), prefix)
        if h % SPOILT == 0:
            k = h % len(word)
            word = word[:k] + word[k + 1 :]
            if len(word) < letters:
                continue
        yield word, n


def word_counts(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of all texts, A-Z in lower case, of `letters` code points or more that occur `occurrences` times or more.

    A word is a maximal run of `[A-Za-z\\u00C0-\\u00FF]`, of which one in SPOILT loses a code point by the CRC-32 of `<doc_id>:<run>`.
    Null texts have no words; a null id is the empty string; equal rows count each. Tasks count at most HELD words before they send
    partial sums, so a word that is in every document is a row a task."""
    run = "[a-zÀ-ÿ]{%d,}" % letters  # shorter runs cannot become words

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        pattern = re.compile(run)
        send = lambda: pa.record_batch([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for docs_of, texts in parts(batch):
                for doc, text in zip(docs_of, texts, strict=True):
                    for word, n in _spoilt_words("" if doc is None else str(doc), text or "", letters, pattern):
                        held[word] += n
                if len(held) >= HELD:
                    yield send()
                    held.clear()
        yield send()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


class Trie:
    """A trie of sorted distinct words in three flat arrays. Nodes are numbered level by level, so the children of a node are
    neighbours: `first[k]` to `first[k + 1]` of `labels`, which holds the code point that leads to each node. counts: what
    belongs to the word that ends in a node, or 0."""

    def __init__(self, labels: str, first: np.ndarray, counts: np.ndarray) -> None:
        self.labels, self.first, self.counts = labels, first.tolist(), counts

    @staticmethod
    def arrays(words: list[str], counts: list[int]) -> tuple[str, np.ndarray, np.ndarray]:
        labels, first, found = ["\0"], [], []
        level, depth = [(0, len(words))], 0
        while level:
            below = []
            for low, high in level:
                ends = low < high and len(words[low]) == depth
                found.append(counts[low] if ends else 0)
                first.append(len(labels))
                for letter, group in groupby(range(low + ends, high), lambda k: words[k][depth]):  # noqa: B023
                    members = list(group)
                    labels.append(letter)
                    below.append((members[0], members[-1] + 1))
            level, depth = below, depth + 1
        return "".join(labels), np.array([*first, len(labels)], np.uint32), np.array(found, np.int64)

    def neighbours(self, word: str) -> Iterator[tuple[str, int]]:
        """(other, its count) for each word of the trie one inserted, deleted or replaced code point away, each once.

        Depth first through the trie and the automaton of distance one at once: a state is a place in the word and whether the
        edit is spent. While it is not, every child is a replacement or an insertion; once it is, only the child with
        the word's next letter goes on, and most branches end there. Of edits that give the same word (any letter of a run of equal
        ones deleted, a letter inserted beside its equal) only the last is taken."""
        labels, first, size = self.labels, self.first, len(word)
        find = labels.find
        todo = [(0, 0, "", 0, False)]  # node, place, what was read instead of the word's beginning, from where the word goes on, spent
        while todo:
            node, place, head, begin, spent = todo.pop()
            if spent:
                while place < size and node >= 0:
                    node = find(word[place], first[node], first[node + 1])
                    place += 1
                if node >= 0 and self.counts[node]:
                    yield head + word[begin:], int(self.counts[node])
                continue
            low, high = first[node], first[node + 1]
            letter = word[place] if place < size else ""
            if letter and (place + 1 == size or word[place + 1] != letter):
                todo.append((node, place + 1, word[:place], place + 1, True))
            for child in range(low, high):
                other = labels[child]
                if other != letter:
                    todo.append((child, place, word[:place] + other, place, True))
                    if letter:
                        todo.append((child, place + 1, word[:place] + other, place + 1, True))
                else:
                    todo.append((child, place + 1, "", 0, False))


def trie_shards(words: DataFrame, shards: int) -> DataFrame:
    """(labels, first, counts, size): the tries of ranges of (word, n), some a task, none of more than SHARD_LETTERS code points
    unless one word has more."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[str], list[int]] = ([], [])
        letters = 0

        def shard() -> pa.RecordBatch:
            labels, first, counts = Trie.arrays(*held)
            blobs = labels.encode(), first.tobytes(), counts.tobytes()
            return pa.record_batch([*(pa.array([b], pa.binary()) for b in blobs), pa.array([sum(map(len, blobs))], pa.int64())], names=["labels", "first", "counts", "size"])

        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held[0] and letters + len(word) > SHARD_LETTERS:
                    yield shard()
                    held, letters = ([], []), 0
                held[0].append(word)
                held[1].append(n)
                letters += len(word)
        if held[0]:
            yield shard()

    return words.select("word", "n").repartitionByRange(shards, "word").sortWithinPartitions("word").mapInArrow(build, "labels binary, first binary, counts binary, size long")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): each pair of distinct words of (word, n) one edit apart, from both sides.

    The trie is broadcast in blocks of whole shards, BROADCAST_BYTES each or one shard if that is larger, one block after the other, so
    a vocabulary of any size takes so much memory of a worker; every word meets every shard, and leaves those of other ranges
    after a letter or two. A word has no more links than its length and the alphabet allow, however often it occurs."""
    spark = words.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tries = settled(trie_shards(words, spread).withColumn("shard", F.monotonically_increasing_id()))
    blocks, size = [[]], 0
    for shard, n in tries.select("shard", "size").sort("shard").collect():  # a row for each SHARD_LETTERS code points
        if blocks[-1] and size + n > BROADCAST_BYTES:
            blocks.append([])
            size = 0
        blocks[-1].append(shard)
        size += n
    dealt = settled(words.select("word", "n").repartition(spread, "word"))
    found = None
    for block in blocks:
        held = spark.sparkContext.broadcast([(bytes(r.labels), bytes(r.first), bytes(r.counts)) for r in tries.where(F.col("shard").between(block[0], block[-1])).collect()] if block else [])
        links = settled(dealt.repartition(spread, "word").mapInArrow(_links(held), "word string, n long, other string, other_n long"))
        held.destroy()
        found = links if found is None else found.union(links)
    return found


def _links(held):  # noqa: ANN001, ANN202
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = [Trie(labels.decode(), np.frombuffer(first, np.uint32), np.frombuffer(counts, np.int64)) for labels, first, counts in held.value]
        out: list[list] = [[], [], [], []]
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for trie in tries:
                    for row in trie.neighbours(word):
                        for column, value in zip(out, (word, n, *row), strict=True):
                            column.append(value)
                if len(out[0]) >= 10_000:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64()) * 2, strict=True)], names=["word", "n", "other", "other_n"])
                    out = [[], [], [], []]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64()) * 2, strict=True)], names=["word", "n", "other", "other_n"])

    return links


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that forms lead to, by pointer jumping. A form occurs FACTOR times as often
    as its word, so there are no rings and a chain is as long as the logarithm of the largest count."""
    at = settled(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("on"))
        jumped = settled(at.join(step, "root", "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")))
        at = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return at


def spelling_variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of distinct (word, n): how many words are one edit away, the one of them
    that occurs most (of several the first in code-point order) if that is `factor` times as often as the word or more,
    and the last word that forms lead to (the word itself without a form). No words, no rows."""
    words = settled(words.select("word", "n"))
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("best"))
    near = words.join(best, "word", "left").withColumn("is_form", -F.col("best.n") >= factor * F.col("n"))
    near = settled(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("is_form"), F.col("best.word")).alias("form"), F.when(F.col("is_form"), -F.col("best.n")).alias("form_n")))
    roots = _roots(near.where("form is not null").select("word", "form"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_query(docs: DataFrame) -> DataFrame:
    """The spelling variants of all words of documents, whole texts. Null, empty and wordless texts add none; very long texts
    and words are read whole; other columns are ignored."""
    return spelling_variants(word_counts(docs))
