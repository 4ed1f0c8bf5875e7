"""Target-distribution importance resampling over hashed n-gram features.

Each task runs DuckDB in its own process over the Arrow batches it is given: SQL cuts the texts into words, unnests them,
builds n-grams with a window, hashes them by zlib's CRC-32 (registered as an SQL function) and counts buckets per document.
The counts are spilled to Parquet by Spark's committed writer, with one histogram row per partition. Spark merges the
histograms of corpus and target, takes each bucket's gain, scores every document by the floored mean gain of its features and
draws the highest of weight plus Gumbel noise: sampling without replacement in proportion to the weights' exponentials.

The corpus is read and hashed once. Gains are ``buckets`` numbers whatever the corpus; they alone pass the driver. DuckDB sees
``CHUNK_BYTES`` of text at a time and has no temporary folder; a longer text is cut between words and each part is preceded by the words
that its first n-grams need. Ranks come from a range partitioning and one count per partition: no task sorts all scores.

Defined results: a null text has no words; a document without features weighs 0; a null id is hashed as the empty text; repeated rows are
documents of their own with equal scores, so that their ranks are adjacent; an empty corpus gives an empty result, an empty target gains by
``buckets`` pseudo-counts alone; columns named in ``keep`` pass through under ``row``.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.common import spill

BUCKETS, MAX_N = 10_000, 2
#: Bytes of text DuckDB works on at once.
CHUNK_BYTES = 1 << 19

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_OTHER = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")

#: Chunk -> (row, words, buckets, counts). An n-gram counts where its last word stands, and not within ``skip``, the words that
#: another part has counted.
_FEATURES = r"""
WITH words AS (
  SELECT row, part, skip, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos
  FROM (SELECT row, part, skip,
               regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
        FROM chunk)),
grams AS ({grams}),
counted AS (SELECT row, crc32(f) % {buckets} AS b, count(*) AS n, count(*) FILTER (WHERE one) AS words FROM grams GROUP BY row, b)
SELECT row, sum(words)::BIGINT AS n_words, list(b::INTEGER) AS buckets, list(n::INTEGER) AS counts FROM counted GROUP BY row ORDER BY row
"""


def _crc32(features: pa.Array) -> pa.Array:
    whole = features.combine_chunks() if isinstance(features, pa.ChunkedArray) else features
    found = whole.cast(pa.binary()).to_numpy(zero_copy_only=False)
    return pa.array(np.fromiter(map(zlib.crc32, found), np.int64, len(found)))


def features_sql(buckets: int, max_n: int) -> str:
    """The SQL of a chunk for n-grams of 1 to ``max_n`` words."""
    before = ", ".join(f"lag(w, {k}) OVER ordered AS w{k}" for k in range(1, max_n))
    grams = ["SELECT row, w AS f, TRUE AS one FROM words WHERE pos > skip"]
    for n in range(2, max_n + 1):
        joined = " || ' ' || ".join([*(f"w{k}" for k in range(n - 1, 0, -1)), "w"])
        grams.append(f"SELECT row, {joined}, FALSE FROM runs WHERE w{n - 1} IS NOT NULL AND pos > skip")
    runs = f"runs AS (SELECT row, w, pos, skip, {before} FROM words WINDOW ordered AS (PARTITION BY row, part ORDER BY pos))," if max_n > 1 else ""
    return _FEATURES.replace("grams AS ({grams})", runs + " grams AS ({grams})").format(grams=" UNION ALL ".join(grams), buckets=buckets)


def parts_of(text: str, most: int, max_n: int) -> Iterator[tuple[str, int]]:
    """(part, skip): a text in parts of about ``most`` characters, cut between words, each led by up to ``max_n`` - 1 words before it."""
    start, carry = 0, []
    while True:
        cut = _OTHER.search(text, start + most) if len(text) - start > most else None
        end = cut.start() if cut else len(text)
        part = text[start:end]
        yield " ".join([*carry, part]), len(carry)
        if not cut:
            return
        carry = [*carry, *_WORD.findall(part.lower() if part.isascii() else part.translate(_LOWER))][1 - max_n :] if max_n > 1 else []
        start = end


_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def bucket_counts(docs: DataFrame, keep: list[str], text_col: str, buckets: int = BUCKETS, max_n: int = MAX_N, chunk: int = CHUNK_BYTES) -> DataFrame:
    """Per document: ``row`` (the columns ``keep``), n_words, n_features, buckets and counts. Per partition, one row with ``histogram``."""
    row = F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(1).alias("__there"))
    sent = docs.select(row.alias("row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("body"))
    ints = T.ArrayType(T.IntegerType())
    fields = [
        T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()), T.StructField("buckets", ints), T.StructField("counts", ints),
        T.StructField("histogram", T.ArrayType(T.LongType())),
    ]
    sql = features_sql(buckets, max_n)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # no spills to a local folder: chunks are bounded
        con = duckdb.connect(config={"threads": 1, "temp_directory": "", "memory_limit": "150MB"})
        con.create_function("crc32", _crc32, ["VARCHAR"], "BIGINT", type="arrow")
        total, row_type = np.zeros(buckets, np.int64), None

        def run(rows: list[tuple[int, int, int, str]], found: dict) -> None:
            con.register("chunk", pa.table(dict(zip(("row", "part", "skip", "body"), map(list, zip(*rows, strict=True)), strict=True))))
            table = con.sql(sql).to_arrow_table().combine_chunks()
            con.unregister("chunk")
            for r in range(table.num_rows):
                row, words, b, n = (table.column(k).chunk(0)[r] for k in range(4))
                found.setdefault(row.as_py(), []).append((words.as_py(), b.values.to_numpy(), n.values.to_numpy()))

        def counted(texts: pa.Array) -> tuple[list, list, list]:
            """Buckets, their counts and the number of words of each text."""
            found: dict[int, list] = {}
            held, size = [], 0
            for k, text in enumerate(texts.to_pylist()):
                for p, (part, skip) in enumerate(parts_of(text, chunk, max_n)):
                    held.append((k, p, skip, part))
                    size += len(part)
                    if size >= chunk:
                        run(held, found)
                        held, size = [], 0
            if held:
                run(held, found)
            lists, counts = [], []
            for k in range(len(texts)):
                cells = found.get(k, [])
                b, n = (np.concatenate([c[x] for c in cells]) if cells else np.zeros(0, np.int32) for x in (1, 2))
                if len(cells) > 1:  # the parts of a long text
                    b, at = np.unique(b, return_inverse=True)
                    n = np.bincount(at, n)
                lists.append(b.astype(np.int32))
                counts.append(n.astype(np.int32))
            return lists, counts, [sum(c[0] for c in found.get(k, [])) for k in range(len(texts))]

        for batch in batches:
            row_type = batch.column(0).type
            sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy())
            start = 0
            while start < batch.num_rows:  # slices of whole documents of about ``chunk`` bytes
                end = int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + chunk, "right"))
                part = batch.slice(start, max(end, start + 1) - start)
                start += part.num_rows
                lists, counts, words = counted(part.column(1))
                flat_b, flat_n = np.concatenate(lists), np.concatenate(counts)
                total[:] += np.bincount(flat_b, flat_n, minlength=buckets).astype(np.int64)
                ends = pa.array(np.r_[0, np.cumsum([len(x) for x in lists])], pa.int32())
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": part.column(0),
                        "n_words": pa.array(words, pa.int64()),
                        "n_features": pa.array([int(n.sum()) for n in counts], pa.int64()),
                        "buckets": pa.ListArray.from_arrays(ends, pa.array(flat_b)),
                        "counts": pa.ListArray.from_arrays(ends, pa.array(flat_n)),
                        "histogram": pa.nulls(part.num_rows, pa.list_(pa.int64())),
                    }
                )
        con.close()
        if row_type is not None:
            none = pa.nulls(1, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(
                {"row": pa.nulls(1, row_type), "n_words": pa.nulls(1, pa.int64()), "n_features": pa.nulls(1, pa.int64()), "buckets": none, "counts": none,
                 "histogram": pa.array([total.tolist()], pa.list_(pa.int64()))}
            )

    return sent.mapInArrow(count, T.StructType([T.StructField("row", sent.schema["row"].dataType), *fields]))


def histogram(counted: DataFrame, buckets: int) -> np.ndarray:
    """Features per bucket over all partitions: ``buckets`` numbers, whatever the input."""
    cells = counted.filter("histogram IS NOT NULL").select(F.posexplode("histogram").alias("b", "n")).groupBy("b").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, object)
    for r in cells.collect():
        total[r["b"]] = r["n"]
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of smoothed target and source shares, per bucket."""
    k, s, t = len(source), int(source.sum()), int(target.sum())
    ratios = [float(y + 1) * float(s + k) / (float(x + 1) * float(t + k)) for x, y in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def mean_gain(gain: np.ndarray, buckets: Column, counts: Column) -> Column:
    """The floored mean gain of a document's features. The gains are one constant array of as many numbers as there are buckets."""
    table = F.from_json(F.lit(json.dumps(gain.tolist())), "array<bigint>")
    total = F.aggregate(F.zip_with(buckets, counts, lambda b, n: F.get(table, b) * n), F.lit(0).cast("long"), lambda x, y: x + y)
    size = F.greatest(F.aggregate(counts, F.lit(0).cast("long"), lambda x, y: x + y), F.lit(1).cast("long"))
    return F.call_function("div", total - F.pmod(total, size), size)  # towards lower numbers


def noise(id_col: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``name``, their place (from 1) in ``order``: range partitions, sorted, with the sizes of those before added."""
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = spill(spread, "ranked")
    part, at = F.shiftrightunsigned("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    # one row per partition
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, before = [], 0
    for p in sorted(sizes):
        starts.append((p, before))
        before += sizes[p]
    table = F.broadcast(rows.sparkSession.createDataFrame(starts, "__p bigint, __before bigint"))
    return placed.join(table, part == F.col("__p")).withColumn(name, F.col("__before") + at + 1).drop("__p", "__before", "__at")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
    keep: list[str] | None = None,
    buckets: int = BUCKETS,
    max_n: int = MAX_N,
    share: int = 25,
    min_words: int = 20,
    seed: int = 7,
    chunk: int = CHUNK_BYTES,
) -> DataFrame:
    """All documents: ``row`` (columns ``keep``, by default the id), n_words, n_features, weight, score and rank.

    Drawn are the ``share`` percent of highest score of the documents with at least ``min_words`` words; the others have a null rank.
    """
    keep = [id_col] if keep is None else keep
    if id_col not in keep:
        raise ValueError("keep must hold the id column")
    counted = spill(bucket_counts(docs, keep, text_col, buckets, max_n, chunk), "bucket-counts")
    wanted = spill(bucket_counts(target, [], target_text, buckets, max_n, chunk), "target-counts")
    gain = gains(histogram(counted, buckets), histogram(wanted, buckets))
    weight = mean_gain(gain, F.col("buckets"), F.col("counts"))
    scored = counted.filter("row IS NOT NULL").select("row", "n_words", "n_features", weight.alias("weight"))
    scored = spill(scored.withColumn("score", F.col("weight") + noise(F.col("row")[id_col], seed)), "scored")
    eligible = scored.filter(F.col("n_words") >= min_words)
    drawn = eligible.count() * share // 100
    placed = ranked(eligible.withColumn("__id", F.col("row")[id_col]), [F.desc("score"), F.asc_nulls_last("__id")], "rank").drop("__id")
    chosen = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(~(F.col("n_words") >= min_words)).withColumn("rank", F.lit(None).cast("long"))
    return chosen.unionByName(rest).withColumn("row", F.col("row").dropFields("__there"))


def op12(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contract digest."""
    found = resample(docs.select("doc_id", "text"), benchmark.select("text"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_features", "weight", "score", "rank", "n_words")


#: CRC-32 as SQL: a table of 256 entries, then one reduction over the bytes of each distinct feature.
OP12_SQL = r"""
WITH bits AS MATERIALIZED (
  SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS crc
  FROM range(0, 256) t(i)),
d AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
q AS MATERIALIZED (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
f AS MATERIALIZED (
  SELECT id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM d),
g AS MATERIALIZED (
  SELECT unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM q),
hashed AS MATERIALIZED (
  SELECT f, xor(4294967295, list_reduce(
              list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
              lambda c, b: xor(crc[xor(c, b) % 256 + 1], c >> 8), 4294967295)) % 10000 AS b
  FROM (SELECT f, hex(encode(f)) AS h, crc FROM (SELECT f FROM f UNION SELECT f FROM g), bits)),
s AS MATERIALIZED (SELECT b, count(*) AS s FROM f JOIN hashed USING (f) GROUP BY b),
t AS MATERIALIZED (SELECT b, count(*) AS t FROM g JOIN hashed USING (f) GROUP BY b),
gain AS MATERIALIZED (
  SELECT b, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (coalesce((SELECT sum(s) FROM s), 0) + 10000) AS DOUBLE)
                                / CAST((coalesce(s, 0) + 1) * (coalesce((SELECT sum(t) FROM t), 0) + 10000) AS DOUBLE))) AS BIGINT) AS g
  FROM s FULL JOIN t USING (b)),
w AS (SELECT id, count(*) AS n, sum(g) AS total FROM f JOIN hashed USING (f) JOIN gain USING (b) GROUP BY id),
scored AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_features,
         coalesce((total - (total % n + n) % n) // n, 0)::BIGINT AS weight,
         CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise
  FROM d LEFT JOIN w USING (id)),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY n_words < 20, weight + noise DESC, doc_id NULLS LAST) AS place FROM scored)
SELECT doc_id, n_features, weight, weight + noise AS score, n_words,
       CASE WHEN n_words >= 20 AND place <= 25 * (SELECT count(*) FROM d WHERE len(ws) >= 20) // 100 THEN place END AS rank
FROM ranked
"""
