"""Benchmark decontamination as a prefix-filtered containment join.

An item is cut into item-sized windows: every run of ``width`` consecutive words, or the whole item
if it is shorter. A document contains a window only if it contains all its words in order, so the
window's rarest word, by frequency in the corpus, is a sufficient prefix: documents are probed
with prefix words only. A probe fixes where the window would start (positional bound) and whether it
fits (length bound); what is left is verified word by word.

The benchmark is taken in blocks of bounded size. One block is the usual case: it is broadcast and the documents
are searched where they lie. With more, each block is a pass of its own that writes its hits by text and frees its
index before the next begins; the hits of all blocks then meet the documents in one join. An index holds the block's
words once as numbers and its windows as places in them: about 10 bytes of memory per byte of text.

Defined results: null texts have no words and are never hit; an item with no words has no windows; the windows of an
item with a null id hit, but it is not among the items; repeated documents are judged alike; repeated item ids count
once; an empty table on either side gives no hits; other columns pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.common import spill

#: Words in a window.
WIDTH = 10
#: UTF-8 bytes of benchmark text in a block: the bound on what is broadcast at once.
BLOCK_BYTES = 8 << 20

#: Per byte of UTF-8: A-Z lower-cased, other word bytes as they are, all else a space. Bytes of
#: characters beyond ASCII are word bytes throughout.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of letters, digits and everything beyond ASCII, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


class Index:
    """Prefix index of a block: rarest word and its neighbour -> windows that the two stand for.

    The words of all items are numbers into one vocabulary. A window is its first word's place in that list and its
    length; equal windows are one entry, with the items that have it.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], frequency: dict[bytes, int], width: int):
        vocabulary: dict[bytes, int] = {}
        places, lengths, owners, codes = [], [], [], []
        for owner, (_, text) in enumerate(items):
            words = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)]
            n = max(1, len(words) - width + 1) if words else 0
            places.append(np.arange(n, dtype=np.int32) + len(codes))
            lengths.append(np.full(n, min(width, len(words)), np.int16))
            owners.append(np.full(n, owner, np.int32))
            codes += words
        self.width, self.names = width, [name for name, _ in items]
        self.words = np.array(codes, np.int32)
        self.vocabulary = vocabulary
        count = np.array([frequency.get(w, 0) for w in vocabulary], np.int64)
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(len(count))
        place, length, owner = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (places, lengths, owners))
        place, length, entry = self._distinct(place, length)
        # the items of each window, one after another
        held = np.unique(np.stack([entry, owner], 1), axis=0) if len(entry) else np.zeros((0, 2), np.int64)
        self.owners, self.owners_from = held[:, 1].astype(np.int32), np.searchsorted(held[:, 0], np.arange(len(place) + 1))
        # the offset of each window's rarest word
        offset, least = np.zeros(len(place), np.int16), np.full(len(place), np.iinfo(np.int64).max)
        for k in range(width):
            inside = np.flatnonzero(length > k)
            r = rank[self.words[place[inside] + k]]
            better = inside[r < least[inside]]
            least[better], offset[better] = r[r < least[inside]], k
        prefix = self.words[place + offset] if len(place) else place
        # a window with a word that the corpus lacks can't be found there
        found = count[prefix] > 0 if len(place) else np.zeros(0, bool)
        # a window is asked for by its prefix word and the word after it, or before it at its end
        last = offset + 1 == length
        other = self.words[np.where(last, np.maximum(place + offset - 1, 0), place + offset + 1)] if len(place) else place
        side = np.where(length == 1, 0, np.where(last, -1, 1)).astype(np.int8)
        ranks = np.flatnonzero(found)
        ranks = ranks[np.lexsort((other[ranks], side[ranks], prefix[ranks]))]
        self.place, self.length, self.entry, self.offset = place[ranks], length[ranks], ranks, offset[ranks]
        keys = np.stack([prefix[ranks], np.where(side == 0, 0, other)[ranks], side[ranks]], 1) if len(ranks) else np.zeros((0, 3), np.int32)
        start = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else np.zeros(0, np.int64)
        named = list(vocabulary)
        self.probes: dict[bytes, list[dict[bytes, tuple[int, int]]]] = {}
        ends = np.append(start[1:], len(keys))[: len(start)]
        for (word, near, way), a, b in zip(keys[start].tolist(), start.tolist(), ends.tolist(), strict=True):
            self.probes.setdefault(named[word], [{}, {}, {}])[way][named[near] if way else b""] = (a, b)

    def _distinct(self, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and lengths of the different windows, and for each window the number of its own.

        Windows are sorted by a hash of their words; those of one hash are compared word by word with the first of them.
        """
        if not len(place):
            return place, length, np.zeros(0, np.int64)
        word = lambda at, k: self.words[np.minimum(place[at] + k, len(self.words) - 1)]
        every, mark = np.arange(len(place)), length.astype(np.uint64)
        for k in range(self.width):
            mark = np.where(length > k, mark * np.uint64(0x9E3779B97F4A7C15) + word(every, k).astype(np.uint64) + np.uint64(1), mark)
        order = np.argsort(mark, kind="stable")
        starts = np.r_[True, mark[order][1:] != mark[order][:-1]]
        first = order[np.flatnonzero(starts)[np.cumsum(starts) - 1]]
        same = length[order] == length[first]
        for k in range(self.width):
            same &= (length[order] <= k) | (word(order, k) == word(first, k))
        own = starts | ~same  # a window that only shares a hash stays by itself
        kept = order[own]
        number = np.empty(len(place), np.int64)
        number[order] = np.where(own, np.cumsum(own) - 1, (np.cumsum(own) - 1)[np.flatnonzero(starts)[np.cumsum(starts) - 1]])
        return place[kept], length[kept], number

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans [start, end) of window occurrences, and the named items concerned."""
        spans, found, seen = set(), set(), set()
        if self.probes.keys().isdisjoint(words):
            return [], found
        n, codes, get = len(words), None, self.probes.get
        for at, word in enumerate(words):
            probe = get(word)
            if probe is None:
                continue
            alone, after, before = probe
            ranges = [alone[b""]] if alone else []
            if after and at + 1 < n and words[at + 1] in after:
                ranges.append(after[words[at + 1]])
            if before and at and words[at - 1] in before:
                ranges.append(before[words[at - 1]])
            for a, b in ranges:
                if codes is None:
                    codes = np.fromiter((self.vocabulary.get(w, -1) for w in words), np.int32, n)
                start = at - self.offset[a:b].astype(np.int64)
                end = start + self.length[a:b]
                fits = np.flatnonzero((start >= 0) & (end <= n))  # positions and lengths
                start, end, place = start[fits], end[fits], self.place[a:b][fits]
                for k in range(self.width):  # whole windows, word by word until none is left
                    if not len(fits):
                        break
                    same = (start + k >= end) | (codes[np.minimum(start + k, n - 1)] == self.words[np.minimum(place + k, len(self.words) - 1)])
                    fits, start, end, place = fits[same], start[same], end[same], place[same]
                spans.update(zip(start.tolist(), end.tolist(), strict=True))
                for e in self.entry[a:b][fits].tolist():
                    if e not in seen:
                        seen.add(e)
                        found.update(self.owners[self.owners_from[e] : self.owners_from[e + 1]].tolist())
        return sorted(spans), {self.names[k] for k in found} - {None}


def covered(spans: list[tuple[int, int]]) -> int:
    total, reach = 0, -1
    for start, end in sorted(spans):
        total += max(0, end - max(start, reach))
        reach = max(reach, end)
    return total


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    """The items with a ``block`` number; blocks hold about ``block_bytes`` each."""
    size = items.agg(F.sum(F.octet_length(F.coalesce(F.col(text_col), F.lit("")))).alias("n")).first()["n"] or 0
    n_blocks = max(1, -(-size // block_bytes))
    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)).cast("int")), n_blocks


def corpus_frequency(docs: DataFrame, text_col: str, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often each word of ``vocabulary`` (that of one block) occurs in all documents."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                found = Counter(words_of(text.as_py()))
                total.update({w: found[w] for w in found.keys() & known.value})
        yield pa.RecordBatch.from_pydict(
            {"word": pa.array(list(total), pa.binary()), "n": pa.array(list(total.values()), pa.int64())}
        )

    counts = docs.select(F.col(text_col)).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counts.collect()}  # at most the block's vocabulary


def find_windows(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` as ``row`` with ``n_words``, ``spans`` (array of start/end) and sorted ``items``.

    Each block of the benchmark is a pass over the texts.
    """
    names = docs.columns
    blocks, n_blocks = item_blocks(items, item_id, item_text, block_bytes)
    result = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_col}`").alias("body"))
    if n_blocks == 1:
        found = _finder(_index(docs, blocks, 0, text_col, width))(F.col("body"))
        return result.withColumn("found", found).select("row", "body", "found.n_words", "found.spans", "found.items")
    keys = [F.xxhash64("body").alias("k1"), F.xxhash64(F.lit("text"), "body").alias("k2")]
    hits = None
    for block in range(n_blocks):
        index = _index(docs, blocks, block, text_col, width)
        found = result.select(*keys, _finder(index)(F.col("body")).alias("found")).filter(F.size("found.spans") > 0)
        # one row for all copies of a text
        found = spill(found.groupBy("k1", "k2").agg(F.first("found.spans").alias("spans"), F.first("found.items").alias("items")), "block-hits")
        index.unpersist()
        hits = found if hits is None else hits.unionByName(found)
    hits = hits.groupBy("k1", "k2").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),  # n_blocks rows at most
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return result.select("row", "body", *keys).join(hits, ["k1", "k2"], "left").select(
        "row",
        "body",
        n_words(F.col("body")).alias("n_words"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def _index(docs: DataFrame, blocks: DataFrame, block: int, text_col: str, width: int):
    """The broadcast index of one block: at most about BLOCK_BYTES of text pass the driver."""
    held = [(r["item"], r["text"]) for r in blocks.filter(F.col("block") == block).collect()]
    vocabulary = {w for _, text in held for w in words_of(text)}
    frequency = corpus_frequency(docs, f"`{text_col}`", vocabulary)
    return docs.sparkSession.sparkContext.broadcast(Index(held, frequency, width))


_FOUND = "struct<n_words:bigint,spans:array<struct<start:int,end:int>>,items:array<string>>"
_FOUND_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ("items", pa.list_(pa.string())),
    ]
)


def _finder(index):
    @F.arrow_udf(_FOUND)
    def find(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts:
            words = words_of(text.as_py())
            spans, ids = index.value.find(words)
            rows.append(
                {"n_words": len(words), "spans": [{"start": s, "end": e} for s, e in spans], "items": sorted(ids)}
            )
        return pa.array(rows, _FOUND_ARROW)

    return find


@F.arrow_udf(T.LongType())
def n_words(texts: pa.Array) -> pa.Array:
    return pa.array([len(words_of(t.as_py())) for t in texts], pa.int64())


@F.arrow_udf(T.LongType())
def covered_words(spans: pa.Array) -> pa.Array:
    return pa.array([covered([(x["start"], x["end"]) for x in s]) if s else 0 for s in spans.to_pylist()], pa.int64())


def contaminated_free(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no window of any item, with their input columns."""
    return find_windows(docs, items, text_col, **options).filter(F.size("spans") == 0).select("row.*")


def op6(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Contract digest."""
    found = find_windows(docs.select("doc_id", "text"), items)
    n_hit = covered_words(F.col("spans"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
