"""Postings: cleaning, sections, roles, certifications, and evidence that a skill is more than listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.scoring import clamp
from ..functions.text import any_in, once, round2, squeeze, stripped
from .skills import mentions


def find_column(columns: list[str], candidates: list[str], contains: list[str] = ()) -> str | None:
    """The column whose squeezed, lower-cased name is the first candidate found, else the first that contains a token."""
    names = {" ".join(c.split()).lower(): c for c in columns}
    exact = next((names[c.lower()] for c in candidates if c.lower() in names), None)
    return exact or next((c for n, c in names.items() if any(t in n for t in contains)), None)


def cleaned(text: Column) -> Column:
    """Text up to the first portal stop marker, without noise lines and blank lines."""
    longest = [max(n.split(), key=len) for n in L.PORTAL_NOISE]  # without these words no line is noise

    def kept(raw: Column, low: Column) -> Column:
        stop = F.array_min(F.filter(F.array(*(F.instr(low, s) for s in L.PORTAL_STOPS)), lambda p: p > 0))
        upto = once(stop, lambda p: F.when(p.isNull(), raw).otherwise(F.substring(raw, F.lit(1), p - 1)))
        lines = F.filter(F.transform(F.split(upto, r"\R"), squeeze), lambda x: x != "")
        noisy = lambda x: once(F.lower(x), lambda line: any_in(line, L.PORTAL_NOISE))
        return F.array_join(F.when(any_in(low, longest), F.filter(lines, lambda x: ~noisy(x))).otherwise(lines), "\n")

    return once(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), lambda raw: once(F.lower(raw), lambda low: kept(raw, low)))


def header_key(line: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(F.trim(line)), r"[:\-–—]+$", ""), r"[^a-z0-9\s']", " "))


def sections(text: Column, headers: dict[str, list[str]]) -> Column:
    """Map of section to its text: the lines behind its first header line, up to a header line of another section.

    Lines are read once: what is kept of them is where headers stand, and every section is a slice between two of these.
    A line is cleaned only where its first word begins a header. A section without a header is missing.
    """
    key = lambda h: " ".join("".join(c if c.isalnum() or c == "'" else " " for c in h.lower()).split())
    table = {h: name for name, hs in reversed(headers.items()) for h in map(key, hs)}
    known = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    begins = F.lit(r"^[^a-z0-9']*(?:" + "|".join(sorted({h.split(" ")[0] for h in table})) + ")")
    kind = lambda line: F.when(F.regexp_like(F.lower(line), begins), F.try_element_at(known, header_key(line)))

    def cut(lines: Column, heads: Column) -> Column:
        def one(name: str) -> Column:
            start = F.array_min(F.transform(F.filter(heads, lambda h: h["kind"] == name), lambda h: h["line"]))
            end = lambda s: F.coalesce(F.array_min(F.transform(F.filter(heads, lambda h: (h["kind"] != name) & (h["line"] > s)), lambda h: h["line"])), F.size(lines) + 1)
            body = lambda s: F.when(s.isNotNull(), stripped(F.array_join(F.slice(lines, s + 1, F.greatest(end(s) - s - 1, F.lit(0))), "\n")))
            return F.struct(F.lit(name).alias("key"), once(start, body).alias("value"))

        every = F.map_from_entries(F.filter(F.array(*map(one, headers)), lambda e: e["value"].isNotNull()))
        return F.when(F.size(heads) > 0, every).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))

    def found(lines: Column) -> Column:
        heads = F.filter(F.transform(lines, lambda line, i: F.struct((i + 1).alias("line"), kind(line).alias("kind"))), lambda h: h["kind"].isNotNull())
        return once(heads, lambda hs: cut(lines, hs))

    return once(F.split(F.coalesce(text, F.lit("")), r"\R"), found)


def posting_section(text: Column, name: str) -> Column:
    """Lines behind the first header line of the section, up to a header line of another section; none: empty."""
    return F.coalesce(F.try_element_at(sections(text, L.POSTING_SECTIONS), F.lit(name)), F.lit(""))


def looks_like_posting(text: Column) -> Column:
    return once(F.lower(F.coalesce(text, F.lit(""))), lambda low: (F.length(low) >= 250) & any_in(low, L.POSTING_SIGNALS))


def total_years(text: Column, this_year: int) -> Column:
    """The greatest `N years`, else the sum of year ranges (overlaps count twice)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    told = F.array_max(F.transform(F.regexp_extract_all(low, F.lit(r"(\d+(?:\.\d+)?)\s*\+?\s*years?"), F.lit(1)), lambda x: x.cast("double")))
    ends = lambda k: F.regexp_extract_all(low, F.lit(r"((?:19|20)\d{2})\s*(?:-|–|—|to)\s*((?:19|20)\d{2}|present|current)"), F.lit(k))
    number = lambda x: F.coalesce(x.try_cast("int"), F.lit(this_year))
    spans = F.zip_with(ends(1), ends(2), lambda a, b: F.greatest(number(b) - number(a), F.lit(0)))
    return F.coalesce(told, F.aggregate(spans, F.lit(0), lambda s, x: s + x).cast("double"))


def certifications(own: Column, asked: Column) -> dict[str, Column]:
    """matched and missing: an asked certification is matched if it, or 60 percent of its words of 3 letters, occurs."""
    text = F.array_join(own, " ")

    def has(c: Column) -> Column:
        words = F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: F.length(w) >= 3))
        found = F.filter(words, lambda w: F.contains(text, w))
        return F.contains(text, c) | (F.coalesce(F.try_divide(F.size(found), F.size(words)), F.lit(0.0)) >= 0.6)

    return {"matched": F.array_sort(F.filter(asked, has)), "missing": F.array_sort(F.filter(asked, lambda c: ~has(c)))}


def compatible_roles(pairs: DataFrame, table: DataFrame, families: DataFrame) -> DataFrame:
    """pairs (id, resume_role, job_role) with compatibility: of (job, resume), else of (resume, job), else 65 within a
    family and 30 across; a missing role has none. table (job_role, resume_role, score), families (role, family)."""
    back = table.select(F.col("job_role").alias("resume_role"), F.col("resume_role").alias("job_role"), F.col("score").alias("back"))
    family = lambda side: families.select(F.col("role").alias(f"{side}_role"), F.col("family").alias(f"{side}_family"))
    rows = pairs.join(table, ["job_role", "resume_role"], "left").join(back, ["job_role", "resume_role"], "left").join(family("job"), "job_role", "left").join(family("resume"), "resume_role", "left")
    known = (F.coalesce("resume_role", F.lit("")) != "") & (F.coalesce("job_role", F.lit("")) != "")
    same = F.coalesce(F.col("job_family") == F.col("resume_family"), F.lit(False))
    return rows.select("id", F.when(known, F.coalesce("score", "back", F.when(same, 65.0).otherwise(30.0))).alias("compatibility"))


def role_votes(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """id, role, score: the role with most points for a title and text; of equals the first.

    docs (id, title, text), terms (role, ord, kind, term: lower case). A term occurs where it stands between characters
    that aren't of a word; only the terms found in a document leave it.
    """
    t = terms.withColumn("size", F.count("*").over(Window.partitionBy("role", "kind")))
    titled = F.col("kind") == "title"

    def found(part: str, own: DataFrame) -> DataFrame:
        words = own.select(F.col("term").alias("skill"), F.col("term").alias("alias")).distinct()
        hits = mentions(docs.select(F.col("id").alias("doc_id"), F.col(part).alias("text")), words)
        return hits.select(F.col("doc_id").alias("id"), F.col("skill").alias("term")).join(own, "term")

    rows = found("title", t.where(titled)).unionByName(found("text", t.where(~titled)))
    kinds = rows.groupBy("id", "role", "ord", "kind").agg(F.count("*").alias("k"), F.first("size").alias("size"))
    p = L.ROLE_POINTS
    points = F.when(F.col("kind") == "title", F.lit(p["title"])).when(F.col("kind") == "excluded", -F.least(F.col("k") * p["excluded"], F.lit(p["excluded_most"])))
    for kind in ("required", "preferred", "keyword"):
        points = points.when(F.col("kind") == kind, F.col("k") / F.col("size") * p[kind])
    score = kinds.groupBy("id", "role", "ord").agg(clamp(F.sum(points)).alias("s"))
    return score.groupBy("id").agg(F.max(F.struct("s", (-F.col("ord")).alias("o"), "role")).alias("b")).select("id", "b.role", round2(F.col("b.s")).alias("score"))


def skill_evidence(header: Column, worked: Column, acted: Column, measured: Column, listed: Column, inferred: Column, project: Column) -> Column:
    """0 to 100 from how a skill shows: listed, in the work history (times), with actions (times), with a metric, in projects."""
    n = lambda c: F.coalesce(c, F.lit(0))
    base = F.greatest(F.when(listed | (n(header) > 0), 26.0).otherwise(0.0), F.when(n(worked) > 0, 43.0 + F.least(n(worked) * 4.0, F.lit(18.0))).otherwise(0.0), F.when(n(acted) > 0, 62.0 + F.least(n(acted) * 7.0, F.lit(20.0))).otherwise(0.0), F.when(measured, 84.0).otherwise(0.0))
    blended = F.when(project > 0, F.greatest(base, 0.35 * base + 0.65 * project)).otherwise(base)
    shown = listed | (n(header) + n(worked) > 0)
    return F.when(inferred & ~shown, 14.0).when(~shown & (project <= 0), 0.0).otherwise(F.least(blended, F.lit(100.0)))


def weighted_coverage(rows: DataFrame, required: bool) -> DataFrame:
    """rows (id, skill, tier, weight, critical, evidence) to id, coverage, demonstrated, listed, missing_critical."""
    tier = F.when(F.col("tier") == 1, 1.75).when(F.col("tier") == 2, 1.30).otherwise(1.0)
    w = F.greatest(F.col("weight"), F.lit(0.5)) * tier * F.when(F.col("critical"), 1.25).otherwise(1.0) * (1.15 if required else 1.0)
    names = lambda when: F.array_join(F.array_sort(F.collect_list(F.when(when, F.col("skill")))), ",")
    e = F.col("evidence")
    return rows.groupBy("id").agg(round2(F.sum(w * e) / F.sum(w)).alias("coverage"), names(e >= 68).alias("demonstrated"), names((e > 0) & (e < 68)).alias("listed"), names((e <= 0) & (F.col("tier") == 1) & F.lit(required)).alias("missing_critical"))


def adjusted(raw_bm25: Column, matched: Column, missing: Column, years: Column, asked: Column, targeted: Column, platform: Column, architect: Column, markers: Column) -> dict[str, Column]:
    """bm25, experience, cap and penalty as the decision step adjusts them."""
    bm25 = F.least(clamp(raw_bm25) * 0.48 + 34.0 * matched / F.greatest(matched + missing, F.lit(1)) + 6.0 * F.log1p(matched), F.lit(82.0))
    share = F.try_divide(years, asked)
    on_target = F.when(asked > 0, F.least(22.0 + 78.0 * F.least(share, F.lit(1.0)), F.lit(100.0))).otherwise(F.least(22.0 + 24.0 * F.sqrt(years), F.lit(94.0)))
    plain = F.when(asked <= 0, F.least(35.0 + 8.0 * years, F.lit(95.0))).otherwise(F.least(100.0 * share, F.lit(100.0)))
    step = lambda values, other: F.when(platform < 35, values[0]).when(platform < 50, values[1]).when(platform < 65, values[2]).otherwise(other)
    strict = architect & ((platform < 72) | (markers < 3))
    cap = F.when(~targeted, 100.0).otherwise(F.least(step((55.0, 68.0, 82.0), 100.0), F.when(strict, 78.0).otherwise(100.0)))
    penalty = F.when(~targeted, 0.0).otherwise(F.greatest(step((15.0, 9.0, 4.0), 0.0), F.when(strict, 6.0).otherwise(0.0)))
    return {"bm25": round2(bm25), "experience": round2(F.when(targeted, on_target).otherwise(plain)), "cap": cap, "penalty": penalty}


def split_structured(blobs: DataFrame) -> DataFrame:
    """blob_id, part, text: what lies behind each `JOB START` line up to the next `JOB END` line or the end; blank ones
    are left out."""
    marked = F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n")
    # a part begins behind a start; it ends at its first end line, and what lies between an end and a start is no part
    pieces = F.slice(F.split(marked, r"(?im)^[^\S\n]*JOB START[^\n]*$"), 2, 1 << 30)
    bodies = F.transform(pieces, lambda p: F.regexp_replace(F.element_at(F.split(p, r"(?im)^[^\S\n]*JOB END[^\n]*$", 2), 1), r"^\s+|\s+$", ""))
    return blobs.select("blob_id", F.posexplode(F.filter(bodies, lambda b: b != "")).alias("part", "text"))


def list_errors(values: Column, name: str, least: int, most: int, longest: int = 450) -> Column:
    """What is wrong with a list of generated lines: their number, a line too long, a line said twice."""
    from .profiles import repeated_values

    n = F.size(F.coalesce(values, F.array().cast("array<string>")))
    keys = F.transform(values, lambda v: F.lower(squeeze(v)))
    checks = [
        (~n.between(least, most), F.concat(F.lit(f"{name}: expected {least} to {most} lines, got "), n.cast("string"))),
        (F.size(F.filter(values, lambda v: F.length(v) > longest)) > 0, F.lit(f"{name}: a line is longer than {longest} characters")),
        (F.size(repeated_values(keys)) > 0, F.lit(f"{name}: a line is repeated")),
    ]
    return F.filter(F.array(*(F.when(bad, said) for bad, said in checks)), lambda e: e.isNotNull())
