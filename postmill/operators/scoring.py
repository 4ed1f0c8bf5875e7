"""Relevance scores as sums of independent components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEIGHTS = {
    "role": 30, "role_broad": 15, "company": 15, "skill": 5, "skills_max": 25, "experience": 15, "industry": 15,
    "location": 10, "employment": 10, "company_size": 15, "official": 5, "open_recruitment": 5, "new_grad_hire": 5,
    "open_max": 5,
}
IT_GROUPS = ("BACKEND", "FRONTEND", "FULLSTACK", "DATA", "AI_ML", "MOBILE", "DEVOPS_INFRA", "GENERAL_IT", "OTHER_IT")
PARTS = ("role", "company", "skill", "experience", "industry", "location", "employment", "company_size", "open", "source")


def prefix_match(a: Column, b: Column) -> Column:
    """Either non-empty name begins with the other."""
    return (a != "") & (b != "") & (F.startswith(a, b) | F.startswith(b, a))


def keyword_score(
    role: Column, prefs: dict[str, Column], company: Column, skills_text: Column, experience: Column, location: Column,
    employment: Column, industries: Column, company_size: Column, official: Column,
) -> dict[str, Column]:
    """Components by name; ``prefs`` has lists companies, skills, locations, employment_types, industries, company_sizes."""
    w = WEIGHTS
    place = F.coalesce(location, F.lit(""))
    points = lambda hit, n: F.when(F.coalesce(hit, F.lit(False)), n).otherwise(0)
    skills = F.size(F.filter(prefs["skills"], lambda s: F.contains(F.lower(F.coalesce(skills_text, F.lit(""))), F.lower(s))))
    same = lambda values, x: F.exists(values, lambda v: F.lower(v) == F.lower(x))
    return {
        "role": points(role == "MATCH", w["role"]),
        "company": points(F.exists(prefs["companies"], lambda c: prefix_match(F.lower(company), F.lower(c))), w["company"]),
        "skill": F.least(skills * w["skill"], F.lit(w["skills_max"])),
        "experience": points(experience == "PASS_FULL", w["experience"]),
        "industry": points(F.exists(prefs["industries"], lambda i: F.exists(industries, lambda c: F.lower(c) == F.lower(i))), w["industry"]),
        "location": points(F.exists(prefs["locations"], lambda p: F.contains(place, p) | F.contains(p, place)), w["location"]),
        "employment": points(same(prefs["employment_types"], F.coalesce(employment, F.lit(""))), w["employment"]),
        "company_size": points(same(prefs["company_sizes"], company_size), w["company_size"]),
        "open": F.lit(0),
        "source": points(official, w["official"]),
    }


def classified_score(keyword: dict[str, Column], match: Column, scope: Column, recruitment: Column, new_grad: Column) -> dict[str, Column]:
    """Role, experience and the open-recruitment bonus by classification unless it is deferred."""
    w = WEIGHTS
    bonus = F.least(
        F.when(scope == "OPEN_RECRUITMENT", w["open_recruitment"]).otherwise(0)
        + F.when((recruitment == "NEW_GRAD_HIRE") & new_grad, w["new_grad_hire"]).otherwise(0),
        F.lit(w["open_max"]),
    )
    new = {
        "role": F.when(match["role"] == "DIRECT_MATCH", w["role"]).when(match["role"] == "BROAD_IT_MATCH", w["role_broad"]).otherwise(0),
        "experience": F.when(match["experience"] == "FULL", w["experience"]).otherwise(0),
        "open": F.when(match["non_it"], 0).otherwise(bonus),
    }
    return {k: F.when(match["deferred"], v).otherwise(new[k]) if k in new else v for k, v in keyword.items()}


def total(parts: dict[str, Column]) -> Column:
    out = F.lit(0)
    for k in PARTS:
        out = out + parts[k]
    return out


def classification_match(single: Column, multi: Column, status: Column, domain: Column, scope: Column, tracks: Column) -> Column:
    """Eligibility of a posting for a user: struct (deferred, non_it, eligible, role, experience).

    Unfinished analyses are deferred and other domains excluded; then the tracks decide, if there are any and the posting
    isn't for one role, else the posting as a whole.
    """
    done = F.coalesce(status.isin("SUCCEEDED", "FALLBACK"), F.lit(False))
    non_it = done & F.coalesce(domain == "NON_IT", F.lit(False))
    by_track = (F.size(F.coalesce(tracks, F.array().cast(TRACKS))) > 0) & ~F.coalesce(scope == "ROLE_SPECIFIC", F.lit(False))
    pick = lambda name: F.when(non_it, _NON_IT[name]).when(by_track, multi[name]).otherwise(single[name])
    return F.struct(
        (~done | (~non_it & ~by_track & single["deferred"])).alias("deferred"),
        non_it.alias("non_it"),
        pick("eligible").alias("eligible"),
        pick("role").alias("role"),
        pick("experience").alias("experience"),
    )


_NON_IT = {"eligible": False, "role": "MISMATCH", "experience": "UNKNOWN"}
TRACKS = "array<struct<no:int,groups:array<string>,accepts:boolean,min_years:int,requirement:string,recruitment:string,unknown:boolean>>"


def single_role_match(groups: Column, acceptable: Column, experience: Column) -> Column:
    """Eligibility by the posting as a whole: struct (deferred, eligible, role, experience)."""
    no_preference = F.size(acceptable) == 0
    unknown_groups = ~no_preference & (F.coalesce(F.size(groups), F.lit(0)) <= 0)
    role = (
        F.when(no_preference, "DIRECT_MATCH")
        .when(F.arrays_overlap(groups, acceptable), "DIRECT_MATCH")
        .when(F.array_contains(groups, "GENERAL_IT"), "BROAD_IT_MATCH")
        .otherwise("MISMATCH")
    )
    exp = F.when(role == "MISMATCH", "UNKNOWN").otherwise(experience)
    return F.struct(
        unknown_groups.alias("deferred"), ((role != "MISMATCH") & (exp != "EXCLUDED")).alias("eligible"), role.alias("role"), exp.alias("experience")
    )


def collection_score(seed: dict[str, list[str]], row: dict[str, Column]) -> Column:
    """Additive keyword score of a collected row; nothing stops at the first hit but the skills' cap."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    empty = F.array().cast("array<string>")
    count = lambda words, hit: sum((hit(w.lower()).cast("int") for w in words), F.lit(0))
    inside = lambda values, w: F.exists(F.coalesce(values, empty), lambda v: F.contains(F.lower(v), F.lit(w)))
    score = count(seed.get("roles", []), lambda w: F.contains(low(row["title"]), F.lit(w)) | inside(row["roles"], w)) * F.lit(3.0)
    score = score + count(seed.get("companies", []), lambda w: F.contains(low(row["company"]), F.lit(w))) * F.lit(2.0)
    score = score + F.least(count(seed.get("skills", []), lambda w: inside(row["skills"], w)) * F.lit(0.5), F.lit(2.0))
    for key, column, weight in (("industries", "description", 0.3), ("locations", "location", 0.2), ("experience_levels", "experience_level", 0.15), ("employment_types", "employment_type", 0.1)):
        score = score + count(seed.get(key, []), lambda w, c=column: F.contains(low(row[c]), F.lit(w))) * F.lit(weight)
    return F.round(score + F.when(low(row["description"]) != "", 0.3).otherwise(0.0), 6)


def multi_role_match(tracks: Column, acceptable: Column, new_grad: Column, experience_of, it_groups: tuple[str, ...]) -> Column:
    """Eligibility by the tracks of a posting: struct (eligible, role, experience, track).

    ``tracks`` are structs with (no, groups, accepts, min_years, requirement, recruitment, unknown). Role and
    experience come from the same track: the first that matches and isn't excluded, else the first that matches.
    """
    rated = F.transform(
        F.filter(tracks, lambda t: ~t["unknown"]),
        lambda t: F.struct(
            t["no"].alias("no"),
            t["groups"].alias("groups"),
            experience_of(t["accepts"], t["min_years"], t["requirement"], t["recruitment"], new_grad).alias("exp"),
        ),
    )
    free = F.size(acceptable) == 0
    direct = F.filter(rated, lambda t: F.when(free, F.arrays_overlap(t["groups"], F.array(*map(F.lit, it_groups)))).otherwise(F.arrays_overlap(t["groups"], acceptable)))
    broad = F.filter(rated, lambda t: F.array_contains(t["groups"], "GENERAL_IT"))
    fit = lambda xs: F.get(F.filter(xs, lambda t: t["exp"] != "EXCLUDED"), F.lit(0))
    out = lambda ok, role, exp, no: F.struct(F.lit(ok).alias("eligible"), F.lit(role).alias("role"), exp.alias("experience"), no.cast("int").alias("track"))
    none = F.lit(None).cast("int")
    return (
        F.when(fit(direct).isNotNull(), out(True, "DIRECT_MATCH", fit(direct)["exp"], fit(direct)["no"]))
        .when(free, out(False, "DIRECT_MATCH", F.lit("EXCLUDED"), none))
        .when(F.size(direct) > 0, out(False, "DIRECT_MATCH", F.get(direct, F.lit(0))["exp"], F.get(direct, F.lit(0))["no"]))
        .when(fit(broad).isNotNull(), out(True, "BROAD_IT_MATCH", fit(broad)["exp"], fit(broad)["no"]))
        .when(F.size(broad) > 0, out(False, "BROAD_IT_MATCH", F.lit("EXCLUDED"), F.get(broad, F.lit(0))["no"]))
        .otherwise(out(False, "MISMATCH", F.lit("UNKNOWN"), none))
    )


def first_hit_score(seed: dict[str, list[str]], row: dict[str, Column], weights: dict[str, tuple[str, float]]) -> Column:
    """Source-side score: each seed list counts once, at its first hit in its text."""
    out = F.lit(0.0)
    for key, (column, weight) in weights.items():
        hit = F.lit(False)
        for w in seed.get(key, []):
            hit = hit | F.contains(F.lower(F.coalesce(row[column], F.lit(""))), F.lit(w.lower()))
        out = out + F.when(hit, weight).otherwise(0.0)
    return out
