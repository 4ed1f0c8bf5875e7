"""Phrase collocations by Suffix-sigma.

Every word position of a piece of text stands for the suffix that begins there, cut to ``max_n`` words. Words are numbered in byte
order, some hundred thousand at a time, so equal suffixes are found and counted as numbers where they are read. They are shuffled by
language and first word, packed per bucket of these, and
sorted in reverse lexicographic order, so that a suffix follows those that extend it: one stack of at most ``max_n`` open prefixes then
counts every phrase in a single pass over the partition, whatever its size. Frequent phrases are joined with their own parts
afterwards.

A first word (or first two words, and so on) that holds more than 1 / ``HOT_SHARE`` of all words is split: its
suffixes are shuffled by one word more. The prefixes that this cuts are emitted whatever their partial count and summed in
the end. A pass of its own finds them: whatever holds that share of all words holds half of it in chunks that report it, so the list
is whole, and shorter than twice ``HOT_SHARE`` per length.

Defined results: a null text is empty and a null language ``und``, the same as a language of that name; repeated rows count each time;
texts without a word add nothing; an empty table gives an empty result; other columns are not read. Counts are exact up to
10^16 occurrences of a phrase (38 decimal digits for the score's numerator).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import spill

#: A group is split when it holds more than one in this many words.
HOT_SHARE = 512
#: Words whose suffixes a task counts before it packs them.
FLUSH = 400_000
#: Words in a chunk that reports its frequent prefixes.
CHUNK = 500_000
#: A chunk ends early where a word takes more than this on average.
WORD_BYTES = 32
#: Bytes of text that are split into words at once.
BLOCK = 1 << 20
#: Groups over which a language's best phrases are first sought.
TOP_SALTS = 64

_END = ord("\n")
_ENDS = re.compile(rb"[.,;:!?\x0A-\x0D]")
#: A-Z lower-cased; piece ends as line feeds; tabs as spaces.
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else _END if b in b".,;:!?" or 0x0A <= b <= 0x0D else 0x20 if b == 9 else b for b in range(256))
#: Between the words of a suffix: below every other byte, so that a prefix's suffixes lie together. A language is one character before the first word.
SEP = "\x00"
_SEP = SEP.encode()


def escaped(text: bytes) -> bytes:
    """A text in lower case with a line feed for each end of a piece; bytes 0 and 1 are escaped, since 0 parts words."""
    text = text.translate(_BYTES)
    if _SEP in text or b"\x01" in text:
        text = text.replace(b"\x01", b"\x01\x02").replace(_SEP, b"\x01\x01")
    return text


def words_of(text: bytes, max_n: int) -> tuple[pa.Array, np.ndarray]:
    """The words of a text, escaped, and for each the number of words from it to its piece's end, ``max_n`` at most."""
    data = np.frombuffer(escaped(text), np.uint8)
    inside = (data != 0x20) & (data != _END)
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begins, ends = edges[::2], edges[1::2]
    offsets = np.zeros(len(begins) + 1, np.int32)
    np.cumsum(ends - begins, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    # the number of words before each piece's end
    stops = np.append(np.searchsorted(begins, np.flatnonzero(data == _END)), len(begins))
    left = np.repeat(stops, np.diff(stops, prepend=0)) - np.arange(len(begins))
    return words, np.minimum(left, max_n).astype(np.int32)


def _blocks(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple[str, bytes]]:
    """(language, text): short texts of a language together; a text of more than ``most`` bytes is cut at ends of pieces."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text, start = body.as_py(), 0
            while len(text) - start > most and (end := _ENDS.search(text, start + most)):
                yield lang, text[start : end.end()]
                start = end.end()
            held.setdefault(lang, []).append(text[start:])
            size += len(text) - start
            if size >= most:
                yield from ((lang, b"\n".join(texts)) for lang, texts in held.items())
                held.clear()
                size = 0
    yield from ((lang, b"\n".join(texts)) for lang, texts in held.items())


class Chunk(NamedTuple):
    """Words of whole pieces: the place of each in ``words`` and of its language in ``langs``, and what :func:`words_of` says is left."""

    langs: list[str]
    words: pa.Array
    lang: np.ndarray
    ids: np.ndarray
    left: np.ndarray


def chunks_of(batches: Iterable[pa.RecordBatch], max_n: int, block: int, most: int) -> Iterator[Chunk]:
    """Chunks of ``most`` words or more, fewer where words are long, but for the last."""
    parts: list[tuple[str, pa.Array, np.ndarray]] = []

    def joined() -> Chunk:
        langs = sorted({lang for lang, *_ in parts})
        encoded = pa.concat_arrays([words for _, words, _ in parts]).dictionary_encode()
        place = {lang: k for k, lang in enumerate(langs)}
        lang = np.repeat(np.array([place[lang] for lang, *_ in parts], np.int32), [len(words) for _, words, _ in parts])
        ids, left = encoded.indices.to_numpy(), np.concatenate([left for *_, left in parts])
        parts.clear()
        return Chunk(langs, encoded.dictionary, lang, ids, left)

    size = 0
    for lang, text in _blocks(batches, block):
        words, left = words_of(text, max_n)
        if len(words):
            parts.append((lang, words, left))
            size += max(len(words), len(text) // WORD_BYTES)
        if size >= most:
            yield joined()
            size = 0
    if parts:
        yield joined()


def plain(phrase: Column) -> Column:
    """A phrase as text: its words joined by one space, escapes undone."""
    undone = F.replace(F.replace(F.translate(phrase, SEP, " "), F.lit("\x01\x01"), F.lit(SEP)), F.lit("\x01\x02"), F.lit("\x01"))
    return F.when(F.instr(phrase, "\x01") > 0, undone).otherwise(F.translate(phrase, SEP, " "))


def _sent(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    lang, body = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    return docs.select(lang.alias("lang"), body.alias("body"))


def code_of(number: int) -> str:
    """The character that stands for a language: no separator, no line feed, no surrogate."""
    place = 0x21 + number
    return chr(place if place < 0xD800 else place + 0x800)


def _often(keys: np.ndarray, bar: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys that occur more than ``bar`` times, in order, how often, and for each of ``keys`` its place among them or -1."""
    found, ns = np.unique(keys, return_counts=True)
    found, ns = found[ns > bar], ns[ns > bar]
    if not len(found):
        return found, ns, np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(found, keys), len(found) - 1)
    return found, ns, np.where(found[at] == keys, at, -1)


def _frequent(part: Chunk, max_n: int, hot_share: int) -> pa.RecordBatch:
    """(lang, prefix, n) of a chunk: its words per language, and each prefix of less than ``max_n`` words that holds over half the share."""
    bar = len(part.ids) // (2 * hot_share)
    rows = [(lang, None, n) for lang, n in zip(part.langs, np.bincount(part.lang).tolist(), strict=True)]
    size = len(part.words)
    found, ns, single = _often(part.lang.astype(np.int64) * size + part.ids, bar)
    langs = [part.langs[k] for k in (found // size).tolist()]
    words = [part.words[k].as_py() for k in (found % size).tolist()]
    heads = [(lang, word) for lang, word in zip(langs, words, strict=True)]
    rows += [(lang, head, n) for (lang, head), n in zip(heads, ns.tolist(), strict=True)]
    prefix = single
    for k in range(1, max_n - 1):
        # the parts of what is frequent are frequent
        at = np.flatnonzero((prefix >= 0) & (part.left > k))
        at = at[single[at + k] >= 0]
        found, ns, places = _often(prefix[at] * len(words) + single[at + k], bar)
        heads = [(heads[p // len(words)][0], heads[p // len(words)][1] + _SEP + words[p % len(words)]) for p in found.tolist()]
        rows += [(lang, head, n) for (lang, head), n in zip(heads, ns.tolist(), strict=True)]
        prefix = np.full(len(single), -1)
        prefix[at] = places
    names, prefixes, ns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(prefixes, pa.binary()), pa.array(ns, pa.int64())], ["lang", "prefix", "n"])


def frequent_prefixes(sent: DataFrame, max_n: int, hot_share: int = HOT_SHARE, chunk: int | None = None) -> tuple[list[tuple[str, str, int]], set[bytes]]:
    """(language, its code, number of its words), a row per language, and the prefixes to split."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks_of(batches, max_n, BLOCK, chunk or CHUNK):
            yield _frequent(part, max_n, hot_share)

    counts = spill(sent.mapInArrow(count, "lang string, prefix binary, n bigint").groupBy("lang", "prefix").agg(F.sum("n").alias("n")), "hot-words")
    langs = [(r["lang"], code_of(k), r["n"]) for k, r in enumerate(counts.filter("prefix IS NULL").orderBy("lang").collect())]
    bar = sum(n for *_, n in langs) // (2 * hot_share)
    # fewer than 2 * hot_share per length
    hot = counts.filter(F.col("prefix").isNotNull() & (F.col("n") > bar)).select("lang", "prefix").collect()
    codes = {lang: code.encode() for lang, code, _ in langs}
    return langs, {codes[r["lang"]] + bytes(r["prefix"]) for r in hot}


_PACKED = pa.schema([("bucket", pa.int32()), ("cut", pa.int32()), ("suffixes", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_MIX = np.uint64(0x9E3779B97F4A7C15)


def packs_of(part: Chunk, max_n: int, codes: dict[str, bytes], hot: list[tuple[bytes, list[bytes]]], buckets: int, most: int) -> Iterator[pa.RecordBatch]:
    """The counted suffixes of a chunk, of about ``most`` words at once; see :func:`packed_suffixes`. ``hot`` goes by length."""
    heads = sorted({codes.get(lang, b"") for lang in part.langs})
    head_at = {head: k for k, head in enumerate(heads)}
    lang = np.array([head_at[codes.get(lang, b"")] for lang in part.langs], np.int32)[part.lang]
    order = pc.array_sort_indices(part.words)
    words, base = part.words.take(order), len(part.words) + 1
    rank = np.empty(len(words), np.int32)
    rank[order.to_numpy()] = np.arange(1, base)  # 0 stands for no word
    ids = np.concatenate([rank[part.ids], np.zeros(max_n, np.int32)])
    sums = np.fromiter(map(zlib.crc32, [b"", *words.to_pylist()]), np.uint64, base)
    starts = np.fromiter(map(zlib.crc32, heads), np.uint64, len(heads))
    splits = []
    if hot:
        known = sorted({w for _, parts in hot for w in parts})
        places = dict(zip(known, pc.index_in(pa.array(known, pa.binary()), words).to_pylist(), strict=True))
        here = [(code, [places[w] for w in parts]) for code, parts in hot if code in head_at]
        splits = [(head_at[code], [p + 1 for p in at]) for code, at in here if None not in at]
    heads = pa.array(heads, pa.binary())

    def pack(start: int, stop: int) -> pa.RecordBatch:
        left = part.left[start:stop]
        columns = [lang[start:stop]] + [np.where(left > k, ids[start + k : stop + k], 0) for k in range(max_n)]
        key, room = columns[0].astype(np.int64), len(heads)
        for column in columns[1:]:
            if room * base >= 1 << 63:
                dense, key = np.unique(key, return_inverse=True)
                room = len(dense)
            key = key * base + column
            room *= base
        at = np.argsort(key)
        key = key[at]
        begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        counts = np.diff(begins, append=len(key))
        at = at[begins]
        columns = [column[at] for column in columns]
        del key, at
        # the number of first words that decide the bucket
        cut = np.ones(len(begins), np.int64)
        for code, prefix in splits:
            low, high = 0, len(begins)
            for column, value in zip(columns, [code, *prefix], strict=False):
                low, high = low + np.searchsorted(column[low:high], np.array([value, value + 1], column.dtype))
            if low < high and cut[low] == len(prefix):
                cut[low:high] += 1
        mixed = starts[columns[0]]
        for k, column in enumerate(columns[1:]):
            mixed = np.where((cut > k) & (column > 0), mixed * _MIX + sums[column], mixed)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
        group = (mixed >> np.uint64(33)).astype(np.int64) % buckets * (max_n + 2) + cut
        # by group, in each from the greatest suffix down: the sort afterwards merges ordered runs
        down = group[::-1].astype(np.uint16) if buckets * (max_n + 2) <= 1 << 16 else group[::-1]
        rows = len(begins) - 1 - np.argsort(down, kind="stable")
        group = group[rows]
        edges = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        new = np.append(True, (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]))
        firsts = pc.binary_join_element_wise(heads.take(pa.array(columns[0][new])), words.take(pa.array(columns[1][new] - 1)), b"")
        joined = [firsts.take(pa.array((np.cumsum(new) - 1)[rows]))]
        joined += [words.take(pa.array(column[rows] - 1, mask=column[rows] == 0)) for column in columns[2:]]
        suffixes = pc.binary_join_element_wise(*joined, _SEP, null_handling="skip").cast(pa.string())
        del joined
        ends = pa.array(np.append(edges, len(rows)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, suffixes), pa.ListArray.from_arrays(ends, pa.array(counts[rows]))]
        keys = group[edges]
        return pa.RecordBatch.from_arrays([pa.array(keys // (max_n + 2), pa.int32()), pa.array(keys % (max_n + 2), pa.int32()), *lists], schema=_PACKED)

    bounds = np.linspace(0, len(part.ids), max(1, len(part.ids) // most) + 1).astype(int).tolist()
    for start, stop in zip(bounds, bounds[1:], strict=False):
        yield pack(start, stop)


def packed_suffixes(sent: DataFrame, max_n: int, codes: dict[str, bytes], hot: set[bytes], buckets: int) -> DataFrame:
    """(bucket, cut, suffixes, counts): counted suffixes of at most ``max_n`` words, packed by the bucket of language and first words.

    ``cut`` is the number of first words that decide the bucket; it is one more than a suffix has if the whole suffix is a prefix that others extend elsewhere.
    Suffixes are counted some words at a time. A pack is one row of two lists, without a row's overhead for each suffix, in descending order.
    """
    split = sorted(((h[0].encode(), h[1:].encode().split(_SEP)) for h in map(bytes.decode, hot)), key=lambda h: len(h[1]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks_of(batches, max_n, BLOCK, FLUSH):
            yield from packs_of(part, max_n, codes, split, buckets, FLUSH)

    return sent.mapInArrow(count, "bucket int, cut int, suffixes array<string>, counts array<bigint>")


def unpacked(packed: DataFrame) -> DataFrame:
    """(suffix, n, cut), a row per counted suffix."""
    rows = F.arrays_zip(F.col("suffixes").alias("suffix"), F.col("counts").alias("n"))
    return packed.select("cut", F.explode(rows).alias("r")).select("r.suffix", "r.n", "cut")


def _size(phrase: Column) -> Column:
    return F.length(phrase) - F.length(F.translate(phrase, SEP, "")) + 1


def count_prefixes(packed: DataFrame, buckets: int, max_n: int, least: int) -> DataFrame:
    """(lang, phrase, n), lang as its code, for every prefix of the suffixes that occurs ``least`` times or more.

    The stack holds a batch's last open prefix of each length with what it has gathered; within a batch, runs of equal prefixes are summed at once.
    """
    schema = pa.schema([("prefix", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # by length less one: the last suffix's words, sum and cut; a prefix is open where it has words
        last: list[bytes] = []
        sums, cuts = [0] * max_n, [0] * max_n
        out: list[tuple[bytes, int]] = []

        def close(depth: int) -> None:
            """Emit the open prefixes of more than ``depth`` words."""
            for d in range(depth, len(last)):
                if sums[d] >= least or d + 1 < cuts[d]:
                    out.append((_SEP.join(last[: d + 1]), sums[d]))
                sums[d] = cuts[d] = 0

        for batch in batches:
            if not batch.num_rows:
                continue
            lists = pc.split_pattern(batch.column(0), SEP)
            words, starts = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
            starts = starts - starts[0]
            sizes, n, cut = np.diff(starts), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            first = [words[k].as_py().encode() for k in range(starts[1])]
            shared = 0
            while shared < min(len(first), len(last)) and first[shared] == last[shared]:
                shared += 1
            close(shared)
            final = [words[k].as_py().encode() for k in range(starts[-2], starts[-1])]
            same = np.ones(len(sizes) - 1, bool)
            for d in range(max_n):
                same &= _equal(words, starts, d)
                there = sizes > d
                new = there.copy()
                new[1:] &= ~same
                begins = np.flatnonzero(new)
                if not len(begins):
                    continue
                total = np.add.reduceat(np.where(there, n, 0), begins)
                most = np.maximum.reduceat(np.where(there, cut, 0), begins)
                if shared > d:  # the first run goes on with the open prefix of the batch before
                    total[0] += sums[d]
                    most[0] = max(most[0], cuts[d])
                stays = len(final) > d  # the last run is still open
                done = len(begins) - 1 if stays else len(begins)
                for k in np.flatnonzero((total[:done] >= least) | (d + 1 < most[:done])).tolist():
                    row = begins[k]
                    out.append((_SEP.join(words[w].as_py().encode() for w in range(starts[row], starts[row] + d + 1)), int(total[k])))
                sums[d], cuts[d] = (int(total[-1]), int(most[-1])) if stays else (0, 0)
            last = final
            if len(out) > 20_000:
                yield _batch(out, schema)
        close(0)
        if out:
            yield _batch(out, schema)

    ordered = unpacked(packed.repartitionById(buckets, F.col("bucket"))).sortWithinPartitions(F.desc("suffix"))
    counted = ordered.mapInArrow(count, "prefix string, n bigint").groupBy("prefix").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return counted.select(F.substring("prefix", 1, 1).alias("lang"), F.expr("substr(prefix, 2)").alias("phrase"), "n")


def _equal(words: pa.Array, starts: np.ndarray, k: int) -> np.ndarray:
    """Whether each suffix but the first has the same word at place ``k`` as the one before it."""
    there = np.diff(starts) > k
    at = pa.array(np.where(there, starts[:-1] + k, 0), mask=~there)
    column = words.take(at)
    return pc.fill_null(pc.equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)


def _batch(rows: list[tuple[bytes, int]], schema: pa.Schema) -> pa.RecordBatch:
    keys, ns = zip(*rows, strict=True)
    rows.clear()
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).cast(pa.string()), pa.array(ns, pa.int64())], schema=schema)


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_n: int = 3, least: int = 10, absorb_percent: int = 50, hot_share: int = HOT_SHARE
) -> DataFrame:
    """All collocations (lang, phrase, a, l, r, n, score) of 2 to ``max_n`` words, absorbed ones dropped.

    The phrase's words are joined by one space. The score is that of the weakest cut.
    """
    sent = _sent(docs, lang_col, text_col)
    langs, hot = frequent_prefixes(sent, max_n, hot_share)
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = packed_suffixes(sent, max_n, {lang: code.encode() for lang, code, _ in langs}, hot, buckets)
    counts = spill(count_prefixes(packed, buckets, max_n, least).withColumn("size", _size(F.col("phrase"))), "phrases")
    candidates = counts.filter("size > 1")
    cuts = candidates.select("lang", "phrase", F.col("n").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    parts = counts.filter(F.col("size") < max_n)
    cuts = cuts.withColumn("left", F.expr(f"substring_index(phrase, '{SEP}', k)")).withColumn("right", F.expr(f"substring_index(phrase, '{SEP}', k - size)"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    exact = F.expr("(cast(1000000 as decimal(7,0)) * cast(a as decimal(16,0)) * cast(a as decimal(16,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = cuts.withColumn("score", exact.cast("long")).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"), F.first("size").alias("size")
    )
    # what lies inside a longer candidate
    inner = []
    for size in range(3, max_n + 1):
        longer = candidates.filter(F.col("size") == size)
        for m in range(2, size):
            for start in range(size - m + 1):
                inside = F.substring_index(F.substring_index(F.col("phrase"), SEP, start + m), SEP, -m)
                inner.append(longer.select("lang", inside.alias("phrase"), F.col("n").alias("longer")))
    kept = scored
    if inner:
        union = inner[0]
        for more in inner[1:]:
            union = union.unionByName(more)
        kept = scored.join(union.groupBy("lang", "phrase").agg(F.max("longer").alias("longer")), ["lang", "phrase"], "left")
        kept = kept.filter(F.col("longer").isNull() | (100 * wide("longer") < absorb_percent * wide("a")))
    words = docs.sparkSession.createDataFrame(langs, "name string, lang string, n bigint")  # a row per language
    return kept.join(F.broadcast(words), "lang").select(
        F.col("name").alias("lang"), plain(F.col("phrase")).alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")
    )


def best(found: DataFrame, most: int = 2000) -> DataFrame:
    """Each language's first ``most`` collocations with their ``rank``: by score, count, then phrase in byte order.

    The best of each of ``TOP_SALTS`` groups are sought first, so no task sorts all phrases of a language.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(TOP_SALTS)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= most)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= most).drop("salt")


def op13(docs: DataFrame) -> DataFrame:
    """Contract digest."""
    return best(collocations(docs.select("lang", "text"))).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS id,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS MATERIALIZED (
  SELECT lang, unnest(range(1, len(ws) + 1)) AS i, ws
  FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces)),
words AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
grams AS (
  SELECT lang, ws[i:i] AS p FROM w
  UNION ALL SELECT lang, ws[i:i + 1] FROM w WHERE i + 1 <= len(ws)
  UNION ALL SELECT lang, ws[i:i + 2] FROM w WHERE i + 2 <= len(ws)),
f AS MATERIALIZED (SELECT lang, p, count(*) AS f FROM grams GROUP BY lang, p HAVING count(*) >= 10),
cuts AS (
  SELECT lang, p, f AS a, unnest(range(1, len(p))) AS k FROM f WHERE len(p) > 1),
scored AS (
  SELECT c.lang, c.p, c.a, c.k, x.f AS l, y.f AS r,
         CAST((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:c.k] JOIN f y ON y.lang = c.lang AND y.p = c.p[c.k + 1:]),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
longer AS (
  SELECT lang, p, max(f) AS f FROM (
    SELECT lang, p[1:2] AS p, f FROM f WHERE len(p) = 3 UNION ALL SELECT lang, p[2:3], f FROM f WHERE len(p) = 3)
  GROUP BY lang, p),
kept AS (
  SELECT s.lang, array_to_string(s.p, ' ') AS phrase, s.a, s.l, s.r, n, s.score
  FROM weakest s JOIN words USING (lang) LEFT JOIN longer g ON g.lang = s.lang AND g.p = s.p
  WHERE g.f IS NULL OR 100 * g.f < 50 * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""
