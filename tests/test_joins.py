"""Prefix and containment joins against brute force, and their plans."""

import random

from pyspark.sql import functions as F

from postmill.operators import joins


def names(seed, n):
    d = random.Random(seed)
    return ["".join(d.choice("abé ") for _ in range(d.randrange(0, 5))) for _ in range(n)] + [None, "", " ", "ABC", "abcd", "삼성전자", "삼성"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_prefix_pairs(spark):
    left, right = names(1, 80), names(2, 60)
    found = joins.prefix_pairs(spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string"), "a", "b")
    clean = lambda xs: {x.strip(" ").lower() for x in xs if x and x.strip(" ")}
    want = sorted((a, b) for a in clean(left) for b in clean(right) if a.startswith(b) or b.startswith(a))
    assert sorted(map(tuple, found.collect())) == want
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    assert joins.prefix_pairs(spark.createDataFrame([], "name string"), spark.createDataFrame([("a",)], "name string")).count() == 0


def test_containing(spark):
    d = random.Random(3)
    texts = [(k, "".join(d.choice("abcé  \n") for _ in range(d.randrange(0, 60)))) for k in range(90)] + [(200, None), (201, ""), (202, "x" * 5000 + "needle in hay" + "y" * 5000), (203, "a.b*c"), (204, "백엔드 개발자")]
    words = ["a", "ab", "abc", "ABCA", "c é", "needle", "NEEDLE IN", "zzz", None, "", "  ", "b*c", ".", "백엔드", "개발", "\n", "a", "éa"]
    found = joins.containing(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(w,) for w in words], "keyword string"), "id", "text")
    clean = {w.strip(" ").lower() for w in words if w and w.strip(" ")}
    want = sorted((k, w) for k, t in texts for w in clean if w in (t or "").lower())
    assert sorted(map(tuple, found.collect())) == want
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)


def test_containing_nothing(spark):
    none, some = spark.createDataFrame([], "keyword string"), spark.createDataFrame([(1, "abc")], "id long, text string")
    assert joins.containing(some, none, "id", "text").count() == 0
    assert joins.containing(some.filter("false"), some.select(F.col("text").alias("keyword")), "id", "text").count() == 0
