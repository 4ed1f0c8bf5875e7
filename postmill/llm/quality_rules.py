"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger stores one failure bit per rule in a
``bigint`` beside the measurements; policies are versioned bit masks applied to the stored bits,
and ablations are bitwise aggregates over the ledger. Adding or retiring a policy therefore never
reads the texts again. Everything is per row (no shuffle) but the ablation, which aggregates
a handful of counters map-side.

Defined results: a null or empty text has no words and fails ``few_words``; repeated rows are
judged independently; an empty table gives an empty ledger; other columns pass through and a
ledger column replaces an input column of the same name. Labels without an id or a verdict are skipped, of several
labels of one id the worst counts, and without labels the lexicon is the fixed list alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import SPACE, let, split_words

# Abusive English words that the `abusive` rule counts beside the fitted ones.
ABUSIVE = (
    "trash", "pathetic", "idiot", "disgusting", "worthless", "stupid", "clown", "loser", "scum", "moron",
    "idiots", "losers", "morons", "imbecile", "dumbass", "bastard", "asshole", "bitch", "retard", "retarded",
    "whore", "slut", "cunt", "vermin", "subhuman",
)

#: Labelled documents a lexicon is fitted on: the bound on what is broadcast, since each word must be in 4 of them or more.
SAMPLE_LABELS = 20_000
#: Punctuation that may follow a word.
AFTER_WORD = ".,;:!?\"')%*#$&"

#: Measurement columns of the ledger, in order.
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_abusive",
)


@dataclass(frozen=True)
class Rule:
    """A named failure condition over the measurement columns; its position is its bit."""

    name: str
    fails: str


#: Append only: a rule's index is its bit in every stored ledger.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule("upper_case", "100 * n_upper > 50 * word_chars"),
    Rule("abusive", "n_abusive >= 2 AND 1000 * n_abusive >= 2 * n_words"),
)

#: Versioned policies: the rules whose bits reject a document.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(r.name for r in RULES),
}


def mask_of(names: tuple[str, ...]) -> int:
    index = {r.name: k for k, r in enumerate(RULES)}
    return sum(1 << index[n] for n in names)


#: Bits of a packed window that hold its position; longer texts take the unpacked way.
_POSITION_BITS = 21


def _equal_neighbours(s: Column, key) -> Column:
    """Elements of a sorted array whose key equals that of the element before or after."""
    return F.filter(
        s,
        lambda x, i: (key(x) == key(F.get(s, i + 1))) | ((i > 0) & (key(x) == key(F.get(s, i - 1)))),
    )


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found at least twice in the text (first one included).

    Windows are compared by 64-bit hash within one document. A primitive ``bigint`` sort of
    (upper hash bits, position) brings candidates together; only those are compared by their full
    hash. The covered words are the union of the intervals [p, p + 2] of the repeated windows.
    """
    hashed = lambda ws, i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2))
    places = lambda ws: F.sequence(F.lit(0), F.size(ws) - 3)
    low = (1 << _POSITION_BITS) - 1
    packed = lambda ws: F.sort_array(
        F.transform(places(ws), lambda i: hashed(ws, i).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
    )
    candidates = lambda ws: F.transform(
        let(packed(ws), lambda s: _equal_neighbours(s, lambda x: F.shiftright(x, _POSITION_BITS))),
        lambda x: x.bitwiseAND(F.lit(low).cast("long")).cast("int"),
    )
    pairs = lambda ws, at: F.sort_array(
        F.transform(at, lambda i: F.struct(hashed(ws, i).alias("h"), i.alias("p")))
    )
    repeated = lambda s: F.sort_array(
        F.transform(_equal_neighbours(s, lambda x: x["h"]), lambda x: x["p"])
    )
    covered = lambda ps: F.aggregate(
        F.transform(ps, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(ps, i + 1) - p, F.lit(3)))),
        F.lit(0),
        lambda a, b: a + b,
    )
    at = lambda ws: F.when(F.size(ws) <= low, candidates(ws)).otherwise(places(ws))
    found = let(words, lambda ws: let(pairs(ws, at(ws)), lambda s: let(repeated(s), covered)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(found).cast("long")


def _plain(word: Column) -> Column:
    """A word in lower case without punctuation after it."""
    return F.lower(F.rtrim(word, F.lit(AFTER_WORD)))


def fit_lexicon(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_LABELS, id_col: str = "doc_id", text_col: str = "text"
) -> list[str]:
    """Words that tell documents labelled toxic from others, whatever their language.

    Fitted on at most ``sample`` labelled documents, those of the least hash. A word is taken that at least 4 and
    1 in 200 of the toxic documents hold, and 4 more for each other document that holds it.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(known), "doc_id")
    words = texts.select("toxic", F.explode(F.array_distinct(F.transform(split_words(F.col("text")), _plain))).alias("word"))
    counts = words.filter("word <> ''").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    n_toxic = known.agg(F.sum("toxic")).first()[0] or 0
    found = counts.filter("t >= 4 + 4 * c").filter(200 * F.col("t") >= n_toxic)
    return [r["word"] for r in found.select("word").collect()]


def measure(docs: DataFrame, text: str = "text", lexicon: tuple[str, ...] | list[str] = ABUSIVE) -> DataFrame:
    """Append the measurement columns (one projection pass over the text, no shuffle)."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in MEASURES]
    # columns under names that no input column has, so that inputs may be called anything; a struct would be taken apart and worked out for each use
    names, taken = [], {c.lower() for c in docs.columns}
    for name in ("__words", "__body", "__lines"):
        while name in taken:
            name += "_"
        names.append(name)
    words, text_of, lines = map(F.col, names)
    tokens = docs.select(*others, split_words(F.col(f"`{text}`")).alias(names[0]), body.alias(names[1]))
    tokens = tokens.select(*others, words, text_of, F.filter(F.split(text_of, "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias(names[2]))
    return tokens.select(
        *others,
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(text_of, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(words).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.length(F.regexp_replace(text_of, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.size(F.filter(words, lambda w: _plain(w).isin(*lexicon))).cast("long").alias("n_abusive"),
    )


def ledger(docs: DataFrame, text: str = "text", lexicon: tuple[str, ...] | list[str] = ABUSIVE) -> DataFrame:
    """Measurements plus ``failures``: bit k is set where rule k fails."""
    measured = measure(docs, text, lexicon)
    bits = [F.when(F.expr(r.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, r in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("failures", total)


def verdict(policy: str = "v1") -> Column:
    """True where a ledger row passes ``policy``: only stored bits are read."""
    return F.col("failures").bitwiseAND(F.lit(mask_of(POLICIES[policy])).cast("long")) == 0


def apply_policy(rows: DataFrame, policy: str = "v1") -> DataFrame:
    return rows.filter(verdict(policy))


def ablation(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of ``policy``: documents failing it, failing nothing else, and kept without it.

    One aggregate over the ledger with map-side partial sums; the per-rule rows are unpivoted
    from the single result row.
    """
    mask = mask_of(POLICIES[policy])
    bits = F.col("failures").bitwiseAND(F.lit(mask).cast("long"))
    names = POLICIES[policy]
    aggs = [F.count("*").alias("n"), F.count_if(bits == 0).alias("kept")]
    for name in names:
        bit = mask_of((name,))
        aggs += [
            F.count_if(bits.bitwiseAND(F.lit(bit).cast("long")) != 0).alias(f"f_{name}"),
            F.count_if(bits == bit).alias(f"o_{name}"),
        ]
    stack = ", ".join(f"'{n}', f_{n}, o_{n}" for n in names)
    return rows.agg(*aggs).selectExpr(
        "n", "kept", f"stack({len(names)}, {stack}) as (rule, n_failed, n_failed_only)"
    ).withColumn("kept_without_rule", F.col("kept") + F.col("n_failed_only"))


def lexicon_of(docs: DataFrame, labels: DataFrame) -> list[str]:
    """The fixed words and the fitted ones."""
    return sorted({*ABUSIVE, *fit_lexicon(docs, labels)})


def filter_documents(
    docs: DataFrame, policy: str = "v1", text: str = "text", lexicon: tuple[str, ...] | list[str] = ABUSIVE
) -> DataFrame:
    """The documents that pass ``policy``, with exactly their input columns."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col(f"`{text}`").alias("__text"))
    return apply_policy(ledger(packed, "__text", lexicon), policy).select("__row.*")


def ablation_of(docs: DataFrame, labels: DataFrame, policy: str = "v1") -> DataFrame:
    """The ablation of a policy over all documents: a row per rule."""
    return ablation(ledger(docs.select("doc_id", "text"), lexicon=lexicon_of(docs, labels)), policy)


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract digest of the ledger."""
    rows = ledger(docs.select("doc_id", "text"), lexicon=lexicon_of(docs, labels))
    base_failed = ~verdict("base")
    return rows.select(
        "doc_id", *MEASURES[:5], base_failed.alias("base_failed"), verdict("v1").alias("kept"), "failures"
    )


_ABUSIVE_SQL = ", ".join(f"('{w}')" for w in ABUSIVE)
_AFTER_SQL = AFTER_WORD.replace("'", "''")
OP1_SQL = rf"""
WITH k AS (
  SELECT doc_id, max(toxic::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL
  GROUP BY doc_id ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT {SAMPLE_LABELS}),
kw AS (
  SELECT toxic, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'),
                                                    lambda x: lower(rtrim(x, '{_AFTER_SQL}'))))) AS word
  FROM documents JOIN k USING (doc_id)),
lex AS (
  SELECT word FROM (SELECT word, sum(toxic) AS t, sum(1 - toxic) AS c FROM kw WHERE word <> '' GROUP BY word)
  WHERE t >= 4 + 4 * c AND 200 * t >= (SELECT sum(toxic) FROM k)),
lx AS (SELECT word FROM lex UNION SELECT * FROM (VALUES {_ABUSIVE_SQL})),
a AS (
  SELECT doc_id, count(*) AS n_abusive
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM documents)
  WHERE lower(rtrim(w, '{_AFTER_SQL}')) IN (SELECT word FROM lx) GROUP BY doc_id),
d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
w AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM d),
g AS (SELECT w.doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM w JOIN d USING (doc_id)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) v(k) WHERE n > 1 GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
         length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g'))::BIGINT AS n_upper,
         coalesce(n_abusive, 0)::BIGINT AS n_abusive
  FROM d LEFT JOIN c USING (doc_id) LEFT JOIN a USING (doc_id)),
f AS (SELECT *, ({" + ".join(f"CASE WHEN {r.fails} THEN {1 << k} ELSE 0 END" for k, r in enumerate(RULES))})::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, failures = 0 AS kept, failures
FROM f
"""

_BITS = {r.name: 1 << k for k, r in enumerate(RULES)}
#: The ablation over the same ledger.
ABLATION_SQL = OP1_SQL.rsplit("SELECT doc_id, n_words, word_chars", 1)[0] + """
SELECT n, kept, rule, n_failed, n_failed_only, kept + n_failed_only AS kept_without_rule FROM (
  SELECT rule, (SELECT count(*) FROM f) AS n, (SELECT count(*) FROM f WHERE failures = 0) AS kept,
         (SELECT count(*) FROM f WHERE failures & bit <> 0) AS n_failed, (SELECT count(*) FROM f WHERE failures = bit) AS n_failed_only
  FROM (VALUES """ + ", ".join(f"('{name}', {bit})" for name, bit in _BITS.items()) + ") v(rule, bit))"
