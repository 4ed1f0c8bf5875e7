"""Identity merge against the row-by-row loop it stands for."""

import random

import pytest

from postmill.operators import identity

REPLACE, ENRICH = ["deadline", "content_hash"], ["roles", "location"]


def blank(v):
    return v is None or str(v).strip() == ""


def loop(rows, postings, sources):
    """What the sequence of updates leaves: (decisions, postings, sources)."""
    pool = {p["id"]: dict(p, rows=0) for p in postings}
    keys = {s["record_key"]: [s["posting_id"], s["content_hash"]] for s in sources}
    made, told = [], []
    everything = lambda: [*sorted(pool), *made]
    state = dict(pool)

    def first(field, value):
        return next((k for k in everything() if value is not None and state[k][field] == value), None)

    for r in sorted(rows, key=lambda r: r["seq"]):
        overwrites, key = False, r["record_key"]
        if key is not None and key in keys:
            target, via = keys[key][0], "KEY"
            overwrites = keys[key][1] is not None and keys[key][1] != r["content_hash"]
        else:
            target, via = first("fingerprint", r["fingerprint"]), "FINGERPRINT"
            if target is None:
                target, via = first("url", r["url"]), "URL"
            if target is None:
                target, via = ("new", r["seq"]), "NEW"
                made.append(target)
                state[target] = {"fingerprint": r["stored"], "url": r["url"], "rows": 0, **{c: r[c] for c in REPLACE + ENRICH}}
        if key is not None:
            old = keys.get(key, [target, None])
            keys[key] = [target, r["content_hash"] if r["content_hash"] is not None else old[1]]
        p = state[target]
        p["rows"] += 1
        if via != "NEW":
            for c in REPLACE:
                if not blank(r[c]):
                    p[c] = r[c]
            for c in ENRICH:
                if not blank(r[c]) and (overwrites or blank(p[c]) or p[c] == "[]"):
                    p[c] = r[c]
        told.append((r["seq"], via, target, overwrites))
    return told, state


def batch(seed, n, keys, same_stored):
    d = random.Random(seed)
    some = lambda letter, k: d.choice([None, *(f"{letter}{j}" for j in range(k))])
    value = lambda: d.choice([None, "", " ", "[]", "x", "y", "z"])
    rows = []
    for seq in range(n):
        fp = some("f", keys)
        rows.append({"seq": seq * 3 + 1, "record_key": some("k", keys), "fingerprint": fp, "stored": fp if same_stored else some("f", keys), "url": some("u", keys),
                     "content_hash": some("h", 3), "deadline": d.choice([None, "d1", "d2"]), "roles": value(), "location": value()})
    d.shuffle(rows)
    postings = [{"id": k, "fingerprint": some("f", keys * 3), "url": some("u", keys * 3), "content_hash": "h0", "deadline": None, "roles": value(), "location": value()} for k in range(keys // 3)]
    sources = [{"record_key": f"k{k}", "posting_id": d.randrange(keys // 3), "content_hash": some("h", 3)} for k in range(0, keys, 5)] if keys >= 3 else []
    return rows, postings, sources


ROW = "seq long, record_key string, fingerprint string, stored string, url string, content_hash string, deadline string, roles string, location string"
POSTING = "id long, fingerprint string, url string, content_hash string, deadline string, roles string, location string"
SOURCE = "record_key string, posting_id long, content_hash string"


def merged(spark, rows, postings, sources):
    make = lambda data, schema: spark.createDataFrame([tuple(r[f.split()[0]] for f in schema.split(", ")) for r in data], schema)
    pool, known = make(postings, POSTING), make(sources, SOURCE)
    told = identity.changed_hashes(identity.resolve(make(rows, ROW).repartition(3), pool, known), known).cache()
    return told, identity.merge_postings(told, pool, REPLACE, ENRICH)


def compare(spark, rows, postings, sources):
    want, state = loop(rows, postings, sources)
    told, after = merged(spark, rows, postings, sources)
    target = lambda r: r["posting_id"] if r["posting_id"] is not None else ("new", r["creator"])
    assert sorted((r["seq"], r["via"], target(r), r["overwrites"]) for r in told.collect()) == want
    got = {target(r): tuple(r[c] for c in ["n_rows", *REPLACE, *ENRICH]) for r in after.collect()}
    assert got == {k: tuple(p[c] for c in ["rows", *REPLACE, *ENRICH]) for k, p in state.items()}


@pytest.mark.parametrize(("seed", "n", "keys", "same"), [(1, 60, 12, True), (2, 80, 30, True), (3, 60, 9, False), (4, 120, 60, False), (5, 40, 3, True)])
def test_equals_the_loop(spark, seed, n, keys, same):
    compare(spark, *batch(seed, n, keys, same))


def row(seq, key, fp, url, **more):
    return {"seq": seq, "record_key": key, "fingerprint": fp, "stored": fp, "url": url, "content_hash": "h", "deadline": None, "roles": None, "location": None} | more


def test_chains_over_two_kinds_of_keys(spark):
    """A-B by fingerprint, B-C by address: B creates nothing, so C does; D finds C, E finds A by fingerprint though C has its address."""
    rows = [row(1, "a", "f1", "u1"), row(2, "b", "f1", "u2"), row(3, "c", "f3", "u2"), row(4, "d", None, "u2"), row(5, "e", "f1", "u2"), row(6, "b", "f9", "u9")]
    told, _ = merged(spark, rows, [], [])
    assert sorted((r["seq"], r["via"], r["creator"]) for r in told.collect()) == [
        (1, "NEW", 1), (2, "FINGERPRINT", 1), (3, "NEW", 3), (4, "URL", 3), (5, "FINGERPRINT", 1), (6, "KEY", 1),
    ]
    compare(spark, rows, [], [])


def test_a_later_creator_is_not_found(spark):
    rows = [row(1, "a", "f1", "u1", stored="f7"), row(2, "b", "f2", "u1", stored="f2"), row(3, "c", "f3", "u3", stored="f2"), row(4, "d", "f2", "u4", stored="f4")]
    compare(spark, rows, [], [])


def test_long_chain_and_common_keys(spark):
    chain = [row(k, f"c{k}", f"f{k // 2}", f"u{(k + 1) // 2}") for k in range(24)]
    common = [row(100 + k, "same", "same", "same", location=f"l{k}") for k in range(40)] + [row(200 + k, None, "same", None) for k in range(40)] + [row(300 + k, None, None, None) for k in range(3)]
    compare(spark, chain + common, [], [])


def test_rows_of_one_key_over_several_windows(spark, monkeypatch):
    monkeypatch.setattr(identity, "SCAN", 7)
    compare(spark, *batch(6, 90, 6, True))


def test_empty_tables(spark):
    told, after = merged(spark, [], [], [])
    assert told.count() == after.count() == 0
    rows, postings, sources = batch(7, 10, 6, True)
    compare(spark, [], postings, sources)
    compare(spark, rows, [], [])


def test_analysis_actions(spark):
    postings = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id long, input_hash string")
    known = spark.createDataFrame([(1, "a", "1"), (2, "x", "1"), (3, "c", "0")], "posting_id long, input_hash string, version string")
    assert {r["id"]: r["action"] for r in identity.analysis_actions(postings, known, "1").collect()} == {1: "TOUCH", 2: "RESET_PENDING", 3: "RESET_PENDING", 4: "INSERT_PENDING"}
