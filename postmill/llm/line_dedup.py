"""Line deduplication across documents.

Normalised lines are exploded as 128-bit hashes, distinct documents are counted per hash, lines of
hashes above the threshold are dropped everywhere but in the largest document id, and each text is
reassembled by position.

Shuffles: the hashed lines once by (line, document) and, pre-aggregated, once by line; the dropped
positions by document; the texts once, for reassembly. A line that a third of all documents share
is pre-aggregated before its key meets in one task, and its join is a plain equi-join of two
written tables, which adaptive execution broadcasts or splits.

Defined results: a null text is one empty line; rows with a null id count as one document, which
never is the keeper while another holds the line; repeated rows are one document and get equal
results; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import let, spill

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does the same, faster, where all is ASCII."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _UPPER, _UPPER.lower())).otherwise(F.lower(text))


def _packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row as a struct, its id and text, and a 128-bit key of (id, text) that names the row."""
    row_id, body = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        row_id.alias("id"),
        body.alias("body"),
        F.xxhash64(row_id, body).alias("r1"),
        F.xxhash64(F.lit("row"), row_id, body).alias("r2"),
    )


def hashed_lines(packed: DataFrame, min_chars: int) -> DataFrame:
    """(id, r1, r2, pos, h1, h2) for each line whose key has ``min_chars`` code points or more."""
    keys = F.transform(F.split(ascii_lower(F.col("body")), "\n"), lambda x: F.trim(x, F.lit(" \t\n\x0b\f\r")))
    hashed = F.transform(
        keys,
        lambda k, i: F.when(
            F.length(k) >= min_chars,
            F.struct(i.alias("pos"), F.xxhash64(k).alias("h1"), F.xxhash64(F.lit("line"), k).alias("h2")),
        ),
    )
    lines = packed.select("id", "r1", "r2", F.explode(F.filter(hashed, lambda x: x.isNotNull())).alias("x"))
    return lines.select("id", "r1", "r2", "x.pos", "x.h1", "x.h2")


def repeated_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """Line hashes held by ``min_docs`` documents or more, with the largest id that holds them."""
    holders = lines.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
    counted = holders.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("id").alias("keeper"))
    return counted.filter(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """``row`` (the input row as a struct), ``n_lines``, ``n_dropped`` and ``kept``, the text that stays."""
    packed = _packed(docs, id_col, text_col)
    lines = spill(hashed_lines(packed, min_chars), "lines")
    repeated = spill(repeated_lines(lines, min_docs), "repeated-lines")
    dropped = (
        lines.join(repeated, ["h1", "h2"])
        .filter(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("r1", "r2")
        .agg(F.collect_set("pos").alias("dropped"))
    )
    joined = packed.join(dropped, ["r1", "r2"], "left")
    lines_of = F.split("body", "\n")
    rebuilt = let(
        lines_of,
        lambda ls: F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("dropped")), lambda i: F.get(ls, i)
            ),
            "\n",
        ),
    )
    return joined.select(
        "row",
        F.size(lines_of).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.col("body")).otherwise(rebuilt).alias("kept"),
    )


def op3(docs: DataFrame) -> DataFrame:
    """Contract digest."""
    return dedup_lines(docs.select("doc_id", "text")).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_lines",
        F.greatest("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP3_SQL = r"""
WITH raw AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
ln AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM raw),
keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM ln),
rep AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT y.doc_id, y.pos, y.line, rep.k IS NOT NULL AND y.doc_id <> rep.keeper AS gone
  FROM keyed y LEFT JOIN rep ON y.k = rep.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
