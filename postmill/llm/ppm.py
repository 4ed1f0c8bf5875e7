"""Language-model scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ``ORDER``. A symbol is coded in the longest known context;
if it is new there, an escape (method D: every distinct symbol gives half a count to it) leads to the next
shorter one, where the symbols of the longer context are excluded. Below order 0 all symbols that
are left are equally likely. The texts' words, lower-cased and joined by one space, and an end
symbol are coded, so the score is a probability of the same token sequence the base score is of.

The text of a document, for this operator, is its sequence of words: white space between them is one space.

:func:`tally` counts, per batch in numpy, the (context, symbol) pairs of the longest contexts and the words of all
texts, each as often as the texts to learn from hold it; Spark sums the counts over the corpus. No context is dropped. A
pair's code length is found once per distinct pair, in shards of contexts with the same last two bytes: such
a shard holds, or sums up, all longer orders, and the orders 0 and 1 (at most 255 * 255 pairs) are given to all. A suffix
with too many pairs is dealt by the last four bytes, and its contexts of three bytes (at most 255 * 255 pairs) are given
to each part, so a shard's size is bounded whatever the corpus.

The code lengths of the most frequent pairs (from a power-of-two count on that fits ``HEAD_PAIRS``), and the counts of the
most frequent words (``HEAD_WORDS``), are broadcast, so that most symbols are coded where the text lies. All others are joined
by shuffle to the whole tables and summed per document: the result does not depend on the two bounds.

Defined results: a null text is empty (the end token only); a null id is training data; repeated
rows are scored, and learnt from, each; an empty table gives an empty result; with no training
text all symbols are equally likely and the base is that of an empty corpus; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import spill

ORDER = 5
#: Bounds of what is broadcast: pairs, words, and the bytes such a word may have.
HEAD_PAIRS = 1 << 19
HEAD_WORDS = 1 << 16
HEAD_BYTES = 64
#: Pairs a shard should hold.
SHARD_PAIRS = 1 << 18
#: Bytes of the suffix that names a shard, and of the one by which a large shard is dealt.
SUFFIX, LONG_SUFFIX = 2, 4
#: Symbols: 256 bytes of which UTF-8 leaves some unused; these two never occur in it.
PAD, END = 0xFE, 0xFF
N_SYMBOLS = 255  # bytes but PAD
#: Bytes of text handled at once, and entries a task holds before it merges them.
STEP = 1 << 20
HOLD = 1 << 19


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def chunks(texts) -> Iterator[tuple[list[list[bytes]], list[bytes]]]:
    """Token lists and joined texts, in groups of about STEP bytes; a longer text is a group of its own."""
    words, joined, size = [], [], 0
    for text in texts:
        w = tokens_of(text)
        j = b" ".join(w)
        if size and size + len(j) > STEP:
            yield words, joined
            words, joined, size = [], [], 0
        words.append(w)
        joined.append(j)
        size += len(j) + 1
    if words:
        yield words, joined


def pair_keys(joined: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, symbol) of every symbol packed into uint64, and where each text starts."""
    pad = bytes([PAD]) * order
    data = np.frombuffer(b"".join(pad + j + b"\xff" for j in joined), np.uint8)
    keys = np.zeros(len(data) - order, np.uint64)
    for k in range(order + 1):
        keys = (keys << np.uint64(8)) | data[k : len(data) - order + k]
    keys = keys[data[order:] != PAD]
    lengths = np.fromiter((len(j) + 1 for j in joined), np.int64, len(joined))
    return keys, np.cumsum(lengths) - lengths


# --- counting -----------------------------------------------------------------------------------


def merge(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
    ranks = np.argsort(keys, kind="stable")
    keys, n = keys[ranks], n[ranks]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[start], np.add.reduceat(n, start) if len(keys) else n


def count_batches(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """Partial counts of batches (text, learn): rows of (pair, n) and of (word, n); the empty word is the end token."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    words: Counter = Counter()

    def pair_rows(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(keys.view(np.int64)), pa.nulls(len(keys), pa.binary()), pa.array(n, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["pair", "word", "n"])

    def word_rows() -> pa.RecordBatch:
        columns = [pa.nulls(len(words), pa.int64()), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["pair", "word", "n"])

    for batch in batches:
        done = 0
        for tokens, joined in chunks(t.as_py() for t in batch.column(0)):
            learn = batch.column(1).slice(done, len(tokens)).to_pylist()
            done += len(tokens)
            for kind in (True, False):
                part = [j for j, on in zip(joined, learn, strict=True) if on == kind]
                if part:
                    keys, n = np.unique(pair_keys(part, order)[0], return_counts=True)
                    held.append((keys, n if kind else np.zeros_like(n)))
            for t, on in zip(tokens, learn, strict=True):
                words.update(t if on else dict.fromkeys(t, 0))
                words[b""] += on
            if sum(len(k) for k, _ in held) > HOLD:
                held = [merge(held)]
                if len(held[0][0]) > HOLD // 2:
                    yield pair_rows(*held.pop())
            if len(words) > HOLD // 2:
                yield word_rows()
                words.clear()
    if held:
        yield pair_rows(*merge(held))
    if words:
        yield word_rows()


def tally(docs: DataFrame, text_col: str = "text", learn: Column | None = None, order: int = ORDER) -> DataFrame:
    """Counts (pair, n) and (word, n) of all that the texts hold, as often as those with ``learn`` hold it."""
    on = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), on.alias("learn"))
    raw = rows.mapInArrow(lambda batches: count_batches(batches, order), "pair long, word binary, n long")
    return spill(raw.groupBy("pair", "word").agg(F.sum("n").alias("n")), "ppm-counts")


def power_cut(levels: DataFrame, limit: int) -> int:
    """The least power of two from which on at most ``limit`` of the entries lie; ``levels``: (level, entries)."""
    total = 0
    for level, entries in sorted((tuple(r) for r in levels.collect()), reverse=True):  # at most 64 rows
        if total + entries > limit:
            return 1 << (level + 1)
        total += entries
    return 0


def level_of(n: Column) -> Column:
    """The power of two of a count; 0 counts like 1."""
    return F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int").alias("level")


class Trie:
    """Sorted context and pair arrays by order, with the logarithms that coding adds up."""

    def __init__(self, pairs: list[tuple[np.ndarray, np.ndarray]]):
        """``pairs``: per order from 0 the sorted keys (context << 8 | symbol) and their counts."""
        self.order = len(pairs) - 1
        self.keys = [k for k, _ in pairs]
        self.log_n = [np.log(n - 0.5) for _, n in pairs]
        self.contexts, self.first, self.escape, self.after, self.after_escape = [], [], [], [], []
        lower = None
        with np.errstate(divide="ignore", invalid="ignore"):
            for k, (keys, n) in enumerate(pairs):
                contexts, start = np.unique(keys >> np.uint64(8), return_index=True)
                if not len(keys):
                    total = distinct = np.zeros(0)
                else:
                    total = np.add.reduceat(n, start).astype(np.float64)
                    distinct = np.diff(np.append(start, len(keys))).astype(np.float64)
                self.contexts.append(contexts)
                self.first.append(np.log(total))
                self.escape.append(np.log(distinct / 2) - np.log(total))
                if k and len(keys):
                    mask = np.uint64((1 << (8 * k)) - 1)
                    low_keys, low_n, low_contexts, low_total, low_distinct = lower
                    seen_below = low_n[np.searchsorted(low_keys, keys & mask)].astype(np.float64)
                    parent = np.searchsorted(low_contexts, contexts & (mask >> np.uint64(8)))
                    new = low_distinct[parent] - distinct
                    rest = low_total[parent] - np.add.reduceat(seen_below, start)
                    self.after.append(np.log(rest))
                    # no new symbol below: the level is passed over at no cost
                    self.after_escape.append(np.where(new > 0, np.log(new / 2) - np.log(rest), 0.0))
                else:
                    left = N_SYMBOLS - distinct
                    self.after.append(np.log(np.maximum(left, 1)))
                    self.after_escape.append(np.zeros(len(contexts)))
                lower = (keys, n, contexts, total, distinct)

    @staticmethod
    def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(table, wanted)
        inside = np.minimum(at, len(table) - 1)
        return inside, (table[inside] == wanted) if len(table) else np.zeros(len(wanted), bool)

    def log_probability(self, keys: np.ndarray) -> np.ndarray:
        """Natural logarithm for each packed (context, symbol) of order ``self.order``."""
        out, open_ = np.zeros(len(keys)), np.arange(len(keys))
        child = np.full(len(keys), -1)  # index of the longer context the coder came from
        for k in range(self.order, -1, -1):
            if not len(open_) or not len(self.keys[k]):
                continue
            here = keys[open_] & np.uint64((1 << (8 * (k + 1))) - 1)
            context, known = self._find(self.contexts[k], here >> np.uint64(8))
            pair, coded = self._find(self.keys[k], here)
            fresh = child[open_] < 0
            came = np.maximum(child[open_], 0)
            if k < self.order and len(self.after[k + 1]):
                came = np.minimum(came, len(self.after[k + 1]) - 1)
                denominator = np.where(fresh, self.first[k][context], self.after[k + 1][came])
                escape = np.where(fresh, self.escape[k][context], self.after_escape[k + 1][came])
            else:
                denominator, escape = self.first[k][context], self.escape[k][context]
            out[open_] += np.where(coded, self.log_n[k][pair] - denominator, np.where(known, escape, 0.0))
            child[open_] = np.where(known, context, -1)
            open_ = open_[~coded]
        if len(open_):
            out[open_] -= self.after[0][0] if len(self.keys[0]) else np.log(N_SYMBOLS)
        return out


def shorter(keys: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of order ``k`` that longer ones sum up to."""
    return merge([(keys & np.uint64((1 << (8 * (k + 1))) - 1), n)])


class Model:
    """What :func:`train` returns: the tables (pair, n) and (word, n), and three numbers."""

    def __init__(self, counts: DataFrame, order: int):
        self.counts, self.order = counts, order
        self.words = counts.filter("word IS NOT NULL").select("word", "n")
        ends = F.sum(F.when(F.col("word") == F.lit(b""), F.col("n")))
        totals = self.words.agg(F.sum("n"), F.count_if(F.col("n") > 0), ends).first()
        self.n_tokens, self.n_distinct, self.ends = totals[0] or 0, totals[1], totals[2] or 0


def train(counts: DataFrame, order: int = ORDER) -> Model:
    """The model of the texts that ``counts``, a :func:`tally`, learns from."""
    return Model(counts, order)


# --- scoring ------------------------------------------------------------------------------------


def _low_bytes(value: Column, n: int) -> Column:
    return value.bitwiseAND(F.lit((1 << (8 * n)) - 1).cast("long")) if n < 8 else value


def code_lengths(model: Model, counts: DataFrame, shard_pairs: int = SHARD_PAIRS) -> DataFrame:
    """(pair, n, log) for each pair of the tally ``counts``: natural logarithms of the pairs' probabilities."""
    order = model.order
    if counts is model.counts:
        table = counts.filter("pair IS NOT NULL").select("pair", "n", F.lit(True).alias("asked"))
    else:
        mine = model.counts.filter("pair IS NOT NULL AND n > 0").select("pair", "n", F.lit(False).alias("asked"))
        theirs = counts.filter("pair IS NOT NULL").select("pair", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked"))
        table = spill(mine.unionByName(theirs).groupBy("pair").agg(F.sum("n").alias("n"), F.bool_or("asked").alias("asked")), "ppm-pairs")

    split = min(LONG_SUFFIX, order)  # contexts of this length are whole in each part
    context = F.shiftrightunsigned("pair", 8)
    suffix = _low_bytes(context, min(SUFFIX, order)).alias("suffix")
    low = table.filter("n > 0").groupBy(_low_bytes(F.col("pair"), 2).alias("pair")).agg(F.sum("n").alias("n")).toArrow()
    ones = low.column("pair").to_numpy().view(np.uint64), low.column("n").to_numpy()  # at most 255 * 255
    short = [shorter(*ones, k) for k in range(2)]
    sizes = table.groupBy(suffix).agg(F.count("*").alias("pairs"))
    n_pairs = sizes.agg(F.sum("pairs")).first()[0] or 0
    parts = F.ceil(F.col("pairs") / shard_pairs).cast("long").alias("parts")
    large = spill(sizes.filter(F.col("pairs") > shard_pairs).select("suffix", parts), "ppm-large")  # at most 255 * 255 rows
    n_shards = max(1, -(-n_pairs // shard_pairs))

    rows = table.withColumn("suffix", suffix).join(F.broadcast(large), "suffix", "left")
    part = F.pmod(F.xxhash64(_low_bytes(context, split)), F.col("parts"))
    shard = F.coalesce(n_shards + F.col("suffix") * (1 << 32) + part, F.pmod(F.xxhash64("suffix"), F.lit(n_shards)))
    rows = rows.select(shard.alias("shard"), "pair", "n", "asked", F.lit(False).alias("given"))
    # order split - 1 of the large suffixes, for each of their parts
    given = table.filter("n > 0").withColumn("suffix", suffix).join(F.broadcast(large), "suffix")
    given = given.groupBy("suffix", "parts", _low_bytes(F.col("pair"), split).alias("pair")).agg(F.sum("n").alias("n"))
    given = given.select(
        F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda i: n_shards + F.col("suffix") * (1 << 32) + i)).alias("shard"),
        "pair", "n", F.lit(False).alias("asked"), F.lit(True).alias("given"),
    )

    def code(group: pa.Table) -> pa.Table:
        keys, n = group.column("pair").to_numpy().view(np.uint64), group.column("n").to_numpy()
        given, asked = (group.column(c).to_numpy() for c in ("given", "asked"))
        known = (n > 0) & ~given
        by_order = {order: merge([(keys[known], n[known])])}
        for k in range(order - 1, SUFFIX - 1, -1):
            by_order[k] = merge([(keys[given], n[given])]) if k == split - 1 and given.any() else shorter(*by_order[k + 1], k)
        by_order |= {k: short[k] for k in range(min(SUFFIX, order))}
        wanted = keys[asked]
        logs = Trie([by_order[k] for k in range(order + 1)]).log_probability(wanted)
        return pa.table({"pair": pa.array(wanted.view(np.int64)), "n": pa.array(n[asked]), "log": pa.array(logs)})

    return spill(rows.unionByName(given).groupBy("shard").applyInArrow(code, "pair long, n long, log double"), "ppm-codes")


def score_documents(
    docs: DataFrame, model: Model, counts: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
    shard_pairs: int = SHARD_PAIRS, head_pairs: int = HEAD_PAIRS, head_words: int = HEAD_WORDS,
) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) for each row of ``docs``, in log10; ``counts`` is a tally of them."""
    order, spark = model.order, docs.sparkSession
    counts = tally(docs, text_col, F.lit(False), order) if counts is None else counts
    codes = code_lengths(model, counts, shard_pairs)
    pair_cut = power_cut(codes.groupBy(level_of(F.col("n"))).count(), head_pairs)
    head = codes.filter(F.col("n") >= pair_cut).select("pair", "log").toArrow()  # at most HEAD_PAIRS
    keys, logs = head.column("pair").to_numpy().view(np.uint64), head.column("log").to_numpy()
    ranks = np.argsort(keys)

    short = (F.octet_length("word") <= HEAD_BYTES) & (F.octet_length("word") > 0) & (F.col("n") > 0)
    word_cut = power_cut(model.words.filter(short).groupBy(level_of(F.col("n"))).count(), head_words)
    in_head = short & (F.col("n") >= word_cut)
    rows = model.words.filter(in_head).toArrow()  # at most HEAD_WORDS
    dictionary = dict(zip(rows.column("word").to_pylist(), np.log10(rows.column("n").to_numpy() + 1.0).tolist(), strict=True))
    shared = spark.sparkContext.broadcast((keys[ranks], logs[ranks] / np.log(10.0), dictionary, model.ends))
    del head, keys, logs, rows, dictionary

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs, head, ends = shared.value
        for batch in batches:
            done = 0
            for tokens, joined in chunks(t.as_py() for t in batch.column(1)):
                known, base, rare, rare_times, rare_ends = [], [], [], [], [0]
                for t in tokens:
                    hits, total = int(ends > 0), math.log10(ends + 1.0)
                    for word, times in Counter(t).items():
                        log = head.get(word)
                        if log is None:
                            rare.append(word)
                            rare_times.append(times)
                        else:
                            hits += times
                            total += times * log
                    known.append(hits)
                    base.append(total)
                    rare_ends.append(len(rare))
                found, starts = pair_keys(joined, order)
                at = np.minimum(np.searchsorted(keys, found), max(0, len(keys) - 1))
                coded = keys[at] == found if len(keys) else np.zeros(len(found), bool)
                sums = np.add.reduceat(np.where(coded, logs[at], 0.0) if len(keys) else np.zeros(len(found)), starts)
                away = np.add.reduceat((~coded).astype(np.int64), starts)
                tail = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(rare_times, pa.int32())], ["word", "n"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, len(tokens)),
                        pa.array([len(t) + 1 for t in tokens], pa.int64()),
                        pa.array(known, pa.int64()),
                        pa.array(base, pa.float64()),
                        pa.array(sums),
                        pa.ListArray.from_arrays(pa.array(rare_ends, pa.int32()), tail),
                        pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(away)), pa.int32()), pa.array(found[~coded].view(np.int64))),
                    ],
                    names=["id", "n_tokens", "known", "logs", "score", "tail", "away"],
                )
                done += len(tokens)

    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    scored = texts.mapInArrow(
        score,
        f"id {id_type}, n_tokens long, known long, logs double, score double, tail array<struct<word:binary,n:int>>, away array<bigint>",
    )
    # numbered when written, so the number names the row in every later read
    rows = spill(scored.withColumn("uid", F.monotonically_increasing_id()), "ppm-scores")
    words = rows.select("uid", F.explode("tail").alias("t")).select("uid", "t.word", F.col("t.n").alias("times"))
    of_words = words.join(model.words.filter("n > 0").filter(~in_head), "word").groupBy("uid").agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("more_logs")
    )
    pairs = rows.select("uid", F.explode("away").alias("pair")).join(codes.filter(F.col("n") < pair_cut).select("pair", "log"), "pair")
    of_pairs = pairs.groupBy("uid").agg((F.sum("log") / float(np.log(10.0))).alias("away"))
    norm = float(np.log10(model.n_tokens + model.n_distinct + 1.0))
    return rows.drop("tail", "away").join(of_words, "uid", "left").join(of_pairs, "uid", "left").select(
        "id",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("score") + F.coalesce("away", F.lit(0.0))).alias("score"),
    )


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 7 == 2, F.lit(False))


def op2(docs: DataFrame) -> DataFrame:
    """Contract digest: learns from all but the held-out documents, scores all."""
    docs = docs.select("doc_id", "text")
    counts = tally(docs, learn=~held_out(F.col("doc_id")))
    model = train(counts)
    return score_documents(docs, model, counts).select(
        F.col("id").alias("doc_id"),
        held_out(F.col("id")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
