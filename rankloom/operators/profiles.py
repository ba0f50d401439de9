"""Profiles of résumés and postings: sections, splits, tenure, platform evidence, checks of generated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import results_told, round2


def section(text: Column, name: str) -> Column:
    """What follows the section's first header variant that occurs, up to the next header word of any section; lower case."""
    low = F.lower(text)
    at = lambda x, h: F.regexp_instr(x, F.lit(rf"\b{h}\b"))
    start = F.coalesce(*(F.when(at(low, h) > 0, at(low, h) + len(h)) for h in L.SECTIONS[name]))
    rest = F.substring(low, start, F.length(low))
    headers = [h for hs in L.SECTIONS.values() for h in hs]
    end = F.array_min(F.filter(F.array(*(at(rest, h) for h in headers)), lambda p: p > 0))
    return F.when(start.isNull(), "").otherwise(F.trim(F.regexp_replace(F.substring(rest, F.lit(1), F.coalesce(end - 1, F.length(rest))), r"^\s+|\s+$", "")))


def tenure_years(text: Column, as_of: tuple[int, int]) -> Column:
    """Years of the first dated span in a text (inclusive months / 12, from a month to 15 years); no span: 0.

    A missing first month is January, a missing last one December; two-digit years below 70 are of this century.
    `as_of` (year, month) stands for `present`, so results don't depend on the clock.
    """
    group = lambda k: F.lower(F.regexp_extract(text, L.DATE_SPAN, k))
    year = lambda g: F.when(g.cast("int") < 70, g.cast("int") + 2000).when(g.cast("int") < 100, g.cast("int") + 1900).otherwise(g.cast("int"))
    month = lambda g, other: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, L.MONTHS)), F.substring(g, 1, 3)).cast("int"), F.lit(0)), F.lit(other))
    y1, y2 = (F.nullif(group(k), F.lit("")) for k in (2, 4))
    now = group(5) != ""
    months = (F.when(now, as_of[0]).otherwise(year(y2)) - year(y1)) * 12 + F.when(now, as_of[1]).otherwise(month(group(3), 12)) - month(group(1), 1) + 1
    return F.when(y1.isNull(), 0.0).otherwise(F.least(F.greatest(months, F.lit(1)) / 12.0, F.lit(15.0)))


def target_platform(title: Column, skills: Column, fallback: Column, markers: dict[str, list[str]] = L.MARKERS) -> Column:
    """The platform with most points (4 for its name in the title, 1 for each marker among the skills); of equals the
    last by name; without points the fallback, if it is one."""
    low = F.lower(F.coalesce(title, F.lit("")))
    points = [F.struct((F.when(F.contains(low, F.lit(p)), 4).otherwise(0) + F.size(F.array_intersect(skills, F.array(*map(F.lit, ms))))).alias("n"), F.lit(p).alias("p")) for p, ms in markers.items()]
    best = F.array_max(F.filter(F.array(*points), lambda x: x["n"] > 0))
    return F.coalesce(best["p"], F.when(F.lower(fallback).isin(list(markers)), F.lower(fallback)), F.lit(""))


def platform_evidence(text: Column, skills: Column, platform: str, architect: Column) -> dict[str, Column]:
    """score, evidence, years, markers, cap, penalty of one platform for a lower-cased text and skills."""
    markers, low = L.MARKERS[platform], F.lower(F.coalesce(text, F.lit("")))
    count = lambda m: F.regexp_count(low, F.lit(rf"\b\Q{m}\E\b"))
    acted = lambda m: F.regexp_count(low, F.lit(rf"\b(?:{L.ACTIONS})\b[^.;\n]{{0,100}}\b\Q{m}\E\b|\b\Q{m}\E\b[^.;\n]{{0,100}}\b(?:{L.ACTIONS})\b"))
    has = {m: F.array_contains(skills, m) | (count(m) > 0) for m in markers}
    total = lambda f: sum((F.when(has[m], f(m)).otherwise(0) for m in markers), F.lit(0))
    n, frequency, actions = total(lambda m: F.lit(1)), total(lambda m: F.least(count(m), F.lit(5))), total(lambda m: F.least(acted(m), F.lit(3)))
    evidence = F.least(n / len(markers) * 55.0 + F.least(frequency * 2.0, F.lit(25.0)) + F.least(actions * 4.0, F.lit(20.0)), F.lit(100.0))
    years = F.least(n * 0.55 + frequency * 0.12 + actions * 0.35, F.lit(10.0))
    gates = L.ARCHITECT_MARKERS.get(platform, [])
    share = sum((F.when(has[g], 1.0).otherwise(0.0) for g in gates if g in has), F.lit(0.0)) / max(1, len(gates))
    gated = architect & F.lit(bool(gates))
    cap = F.when(gated, F.when(share < 0.34, 62.0).when(share < 0.5, 75.0).when(share < 0.67, 88.0).otherwise(100.0)).when(n <= 1, 72.0).otherwise(100.0)
    penalty = F.when(gated, F.when(share < 0.34, 14.0).when(share < 0.5, 8.0).when(share < 0.67, 3.0).otherwise(0.0)).when(n <= 1, 8.0).otherwise(0.0)
    return {"score": round2(F.least(F.least(12.0 + evidence * 0.76, F.lit(100.0)), cap)), "evidence": round2(evidence), "years": round2(years), "markers": n.cast("int"), "cap": cap, "penalty": penalty}


def achievements(text: Column) -> Column:
    """The first ten distinct passages that tell a measured result."""
    return F.slice(F.array_distinct(F.transform(results_told(text), lambda x: F.trim(x))), 1, 10)


def split_numbered(blobs: DataFrame) -> DataFrame:
    """blob_id, part, text: postings that start at a line `Job N:`; what comes before the first is left out."""
    parts = F.filter(F.split("text", r"(?imd)(?=^Job\s+\d+\s*:)"), lambda p: F.regexp_like(p, F.lit(r"(?i)^Job\s+\d+\s*:")))
    return blobs.select("blob_id", F.posexplode(parts).alias("part", "text")).select("blob_id", "part", F.trim(F.regexp_replace(F.col("text"), r"^[^\n]*\n?|\s+$", "")).alias("text"))


def split_ruled(blobs: DataFrame) -> DataFrame:
    """blob_id, part, text: pieces between lines of at least 20 equals signs, blank ones left out."""
    parts = F.filter(F.transform(F.split("text", r"={20,}"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    return blobs.select("blob_id", F.posexplode(parts).alias("part", "text"))


def marked_lines(text: Column, markers: list[str]) -> Column:
    """Lines that hold a marker, without bullets, distinct in order."""
    lines = F.transform(F.split(text, r"\R"), lambda x: F.trim(F.regexp_replace(x, r"^\s*[-*•]+\s*", "")))
    return F.array_distinct(F.filter(lines, lambda x: F.regexp_like(F.lower(x), F.lit("|".join(markers)))))


def unapproved_numbers(claims: Column, approved: Column) -> Column:
    """Numbers of the claims that the approved text lacks, each as often as it is claimed; one approved with a plus is approved without."""
    numbers = lambda x: F.regexp_extract_all(x, F.lit(L.NUMBER), F.lit(0))
    known = numbers(approved)
    every = F.array_union(known, F.transform(known, lambda n: F.rtrim(n, F.lit("+"))))
    return F.filter(numbers(claims), lambda n: ~F.array_contains(every, n))


def latex_errors(text: Column) -> Column:
    count = lambda s: F.regexp_count(text, F.lit(rf"\Q{s}\E"))
    checks = [
        (count("{") != count("}"), "Unbalanced LaTeX braces."),
        *((count(rf"\begin{{{e}}}") != count(rf"\end{{{e}}}"), f"Unbalanced {e} environments.") for e in ("itemize", "longtable")),
        *((count(rf"\{w}{{document}}") == 0, rf"Missing \{w}{{document}}.") for w in ("begin", "end")),
    ]
    return F.filter(F.array(*(F.when(bad, F.lit(said)) for bad, said in checks)), lambda e: e.isNotNull())


def repeated_values(values: Column) -> Column:
    """Values that occur more than once in a list, each once, in order of their first; equal ones are neighbours once sorted."""
    # a list of one, so that it is sorted once
    again = F.get(F.transform(F.array(F.array_sort(values)), lambda s: F.filter(s, lambda v, i: (i > 0) & (v == F.get(s, i - 1)))), F.lit(0))
    return F.array_intersect(values, again)


def domain_score(own: Column, asked: Column, own_confidence: Column, asked_confidence: Column, own_support: Column | None = None, asked_support: Column | None = None) -> Column:
    """50 where a domain is unknown; 80 to 100 where both are the same; else what each side says of the other's domain
    (own_support: the résumé's score of the asked domain, asked_support the reverse) on the mean, from 30 to 70, or 35."""
    unknown = lambda x: F.lower(F.coalesce(x, F.lit(""))).isin("", "unknown", "none")
    cross = (F.coalesce(own_support, F.lit(0.0)) + F.coalesce(asked_support, F.lit(0.0))) / 2.0 if own_support is not None else F.lit(0.0)
    same = round2(80.0 + 20.0 * F.least((own_confidence + asked_confidence) / 100.0, F.lit(1.0)))
    return F.when(unknown(own) | unknown(asked), 50.0).when(own == asked, same).when(cross > 0, round2(F.least(F.lit(70.0), F.greatest(F.lit(30.0), cross)))).otherwise(35.0)


def role_score(compatibility: Column, own_confidence: Column, asked_confidence: Column) -> Column:
    """Compatibility, up to 15 percent less where both roles are uncertain; 35 where a role is missing (no compatibility)."""
    sure = F.least(F.greatest((own_confidence + asked_confidence) / 200.0, F.lit(0.55)), F.lit(1.0))
    return F.when(compatibility.isNull(), 35.0).otherwise(round2(F.least(F.greatest(compatibility * (0.85 + 0.15 * sure), F.lit(0.0)), F.lit(100.0))))
