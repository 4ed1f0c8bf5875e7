"""Joins that resolve, reconcile and enrich."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.operators.sinks import spill


def reconcile(requested: DataFrame, returned: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, outcome): MATCHED, MISSING (no result), UNEXPECTED (no request); the first result of a key counts."""
    first = returned.groupBy(key).agg(F.min(seq).alias("first_seq"), F.count("*").alias("n_results"))
    asked = requested.select(key).distinct().withColumn("asked", F.lit(True))
    return asked.join(first, key, "full_outer").select(
        key,
        F.when(F.col("asked").isNull(), "UNEXPECTED").when(F.col("first_seq").isNull(), "MISSING").otherwise("MATCHED").alias("outcome"),
        F.coalesce(F.col("n_results") - 1, F.lit(0)).cast("long").alias("n_duplicates"),
    )


def resolve_names(names: DataFrame, companies: DataFrame, aliases: DataFrame) -> DataFrame:
    """Company of each name: a direct match wins over an alias; unresolved names are dropped, companies distinct."""
    direct = companies.filter("active").select(F.col("normalized").alias("name"), F.col("company_id").alias("direct_id"))
    active = companies.filter("active").select("company_id")
    by_alias = aliases.join(active, "company_id").groupBy(F.col("alias").alias("name")).agg(F.min("company_id").alias("alias_id"))
    out = names.select("name").distinct().join(direct, "name", "left").join(by_alias, "name", "left")
    resolved = out.withColumn("company_id", F.coalesce("direct_id", "alias_id")).filter("company_id IS NOT NULL")
    return resolved.groupBy("company_id").agg(F.min("name").alias("name"), F.bool_or(F.col("direct_id").isNotNull()).alias("direct"))


def canonicalize(df: DataFrame, name: Column, profiles: DataFrame) -> DataFrame:
    """Adds ``canonical``: of the first profile (by ``profile_seq``) whose canonical or normalised name matches, else the name."""
    keys = profiles.select("profile_seq", "canonical_name", F.explode(F.array_distinct(F.array("key_canonical", "key_normalized"))).alias("k"))
    best = keys.groupBy("k").agg(F.min_by("canonical_name", "profile_seq").alias("hit"))
    keyed = df.withColumn("__n", name)
    return keyed.join(best, F.col("__n") == F.col("k"), "left").withColumn("canonical", F.coalesce("hit", "__n")).drop("__n", "k", "hit")


def search(companies: DataFrame, aliases: DataFrame, q: str, limit: int = 20) -> DataFrame:
    """Active companies whose name or any alias holds ``q``; blank finds nothing."""
    q, limit = q.strip().lower(), max(1, min(20, limit))
    hit = aliases.filter(F.contains(F.lower("alias"), F.lit(q))).select("company_id").distinct().withColumn("via_alias", F.lit(True))
    found = companies.filter("active").join(hit, "company_id", "left")
    keep = F.lit(bool(q)) & (F.contains(F.lower("name"), F.lit(q)) | F.coalesce("via_alias", F.lit(False)))
    return found.filter(keep).select("company_id", "name").orderBy("name", "company_id").limit(limit)


def prefix_pairs(left: DataFrame, right: DataFrame, left_name: str = "name", right_name: str = "name") -> DataFrame:
    """Distinct (left, right) of lower-cased names of which one begins with the other; null and blank names meet nothing.

    Each name is cut to the lengths that names of the other side have, and the cuts are equi-joined with whole names: once with the right name as the
    shorter or equal one, once with the left name as the shorter one. Lengths are at most as many as the longest name has characters. Rows meet
    names of their own table again by an equi-join, so that a name of many rows is matched once.
    """
    names = lambda df, c, to: df.select(F.lower(F.trim(c)).alias(to)).filter(F.coalesce(F.col(to), F.lit("")) != "").distinct()
    a, b = names(left, left_name, "left"), names(right, right_name, "right")

    def cuts(long: DataFrame, name: str, short: DataFrame, other: str, strict: bool) -> DataFrame:
        lengths = F.array(*[F.lit(r[0]) for r in short.select(F.length(other)).distinct().collect()]).cast("array<int>")
        fits = F.filter(lengths, lambda n: (n < F.length(name)) if strict else (n <= F.length(name)))
        # substring counts from one; the cut is hashed by the join
        return long.select(name, F.explode(F.transform(fits, lambda n: F.substring(F.col(name), F.lit(1), n))).alias(other)).join(short, other)

    return cuts(a, "left", b, "right", False).select("left", "right").unionByName(cuts(b, "right", a, "left", True).select("left", "right"))


#: Characters of the grams by which keywords are sought.
GRAM = 3


def _grams(text: Column, sizes: list[int]) -> Column:
    """Distinct grams of the given sizes of a text."""
    chars = F.split(text, "")  # once per text: substring would count characters from the start each time

    def of_size(cs: Column, n: int) -> Column:
        found = F.transform(F.sequence(F.lit(0), F.size(cs) - n), lambda i: F.concat(*[F.get(cs, i + k) for k in range(n)]))
        return F.when(F.size(cs) >= n, found).otherwise(F.array().cast("array<string>"))

    def of(cs: Column) -> Column:
        return F.array_distinct(F.concat(*[of_size(cs, n) for n in sizes]))

    # a variable of a lambda is worked out once, an outer expression for each element
    return F.transform(F.array(chars), of)[0]


def containing(texts: DataFrame, keywords: DataFrame, id_col: str, text_col: str, keyword_col: str = "keyword") -> DataFrame:
    """Distinct (id, keyword) of texts that hold a keyword, both lower-cased; null and blank keywords are in nothing.

    A text that holds a keyword holds its rarest gram. Texts are cut into grams, of which those of any keyword are kept; each keyword is
    sought by the gram that fewest texts have, and what meets is verified against the text, which moves once. Short keywords are their own gram. Ids must be unique.
    """
    words = keywords.select(F.lower(F.trim(keyword_col)).alias("keyword")).filter(F.coalesce(F.col("keyword"), F.lit("")) != "").distinct()
    sizes = sorted(r[0] for r in words.select(F.least(F.length("keyword"), F.lit(GRAM))).distinct().collect())  # GRAM numbers at most
    if not sizes:
        return texts.select(F.col(id_col).alias("id"), F.lit("").alias("keyword")).limit(0)
    own = F.when(F.length("keyword") < GRAM, F.array("keyword")).otherwise(_grams(F.col("keyword"), [GRAM]))
    words = spill(words.select("keyword", F.explode(own).alias("gram")), "keyword-grams")
    rows = texts.select(F.col(id_col).alias("id"), F.lower(F.coalesce(text_col, F.lit(""))).alias("text"))
    held = rows.filter("text <> ''").select("id", F.explode(_grams(F.col("text"), sizes)).alias("gram"))
    held = spill(held.join(words.select("gram").distinct(), "gram", "left_semi"), "text-grams")
    seldom = words.join(held.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left")
    # a gram that no text has rules its keyword out
    chosen = seldom.groupBy("keyword").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least")).filter("least.n > 0")
    met = held.join(chosen.select("keyword", F.col("least.gram").alias("gram")), "gram").select("id", "keyword")
    return rows.join(met, "id").filter(F.contains("text", "keyword")).select("id", "keyword")
