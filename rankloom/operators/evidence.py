"""Evidence of experience: roles and families, years, projects, achievements, alignment of skills, posting fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import any_in, once, results_told, round2, stripped
from .skills import bounded


def role_family_score(own: Column, asked: Column, existing: Column) -> Column:
    """100 for the same role; else the larger of an existing score and what the families' table says from one to the other."""
    own, asked = (F.lower(F.coalesce(x, F.lit(""))) for x in (own, asked))
    family = lambda role: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in L.ROLE_FAMILIES.items() for x in kv)), role), role)
    a, b = family(own), family(asked)
    table = F.lit(None).cast("double")
    for (x, y), score in L.FAMILY_SCORES.items():
        table = F.when((a == x) & (b == y), F.lit(float(score))).otherwise(table)
    known = F.coalesce(table, F.when((a != "") & (b != ""), 35.0).otherwise(50.0))
    return F.when((own != "") & (own == asked), 100.0).otherwise(round2(F.greatest(F.coalesce(existing, F.lit(0.0)), known)))


def seniority(years: Column) -> Column:
    return F.when(years < 2, "Junior").when(years < 5, "Mid").when(years < 8, "Senior").when(years < 12, "Lead").otherwise("Architect")


def skill_years(total: Column, experience: Column, projects: Column, summary: Column) -> Column:
    """Years of a skill from where it is mentioned, at most all years; who has none counts as having one."""
    years = F.when(total == 0, 1.0).otherwise(total)
    return F.least(years, F.floor((experience * 2 + projects + summary) / 10.0 * years * 10 + 0.5) / 10)


def experience_confidence(total: Column, skills: Column) -> Column:
    """50, and more where years, skills, and over ten skills are known."""
    return F.lit(50) + F.when(total > 0, 20).otherwise(0) + F.when(skills > 0, 20).otherwise(0) + F.when(skills > 10, 10).otherwise(0)


def relevant_years(total: Column, years: Column, own: Column, target: Column) -> Column:
    """Most years of a target skill (years: map of skill to years), at most all years; where none has years, all years
    by the share of target skills held, at most three quarters; without targets all years."""
    target = F.array_distinct(F.filter(F.transform(target, lambda s: F.lower(F.trim(s))), lambda s: s != ""))
    held = F.map_values(F.map_filter(years, lambda k, _: F.array_contains(target, F.lower(F.trim(k)))))
    best = F.array_max(held)
    share = F.size(F.array_intersect(F.transform(own, lambda s: F.lower(F.trim(s))), target)) / F.greatest(F.size(target), F.lit(1))
    return F.when(F.size(target) == 0, total).when(best.isNotNull(), round2(F.least(F.when(total > 0, total).otherwise(best), best))).otherwise(round2(total * F.least(F.lit(0.75), share)))


def evidence_depth(text: Column, targets: list[str]) -> Column:
    """(score, strong, weak): skills shown in context, by numbers or often weigh more than skills only named.

    One struct, so that a text is searched once for each skill whatever is read of it; select it before its fields. Most
    texts have no word of work or no measure, and most don't hold a skill: the long patterns are tried on the others only.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    skills = sorted({t.strip().lower() for t in targets if t.strip()})
    works, measures = F.regexp_like(low, F.lit(rf"\b(?:{L.DEPTH_ACTIONS})\b")), F.regexp_like(low, F.lit(rf"\d\s*(?:{L.UNITS})\b"))
    action = rf"\b(?:{L.DEPTH_ACTIONS})\b"

    def shown(s: Column) -> Column:
        word = F.concat(F.lit(r"\b\Q"), s, F.lit(r"\E\b"))
        beside = F.concat(F.lit(rf"{action}[^.;\n]{{0,110}}"), word, F.lit("|"), word, F.lit(rf"[^.;\n]{{0,110}}{action}"))
        told = F.concat(word, F.lit(rf"[^.;\n]{{0,130}}\b\d+(?:\.\d+)?\s*(?:{L.UNITS})\b"))
        return F.struct(s.alias("skill"), F.regexp_count(low, word).alias("n"), F.when(works, F.regexp_like(low, beside)).otherwise(False).alias("acted"), F.when(measures, F.regexp_like(low, told)).otherwise(False).alias("measured"))

    held = F.transform(F.filter(F.array(*map(F.lit, skills)) if skills else F.array().cast("array<string>"), lambda s: F.contains(low, s)), shown)
    strong = lambda x: x["acted"] | x["measured"] | (x["n"] >= 3)
    points = lambda x: F.when(strong(x), F.least(F.lit(8.0), 3.0 + x["n"] * 0.8 + F.when(x["measured"], 2.0).otherwise(0.0))).when(x["n"] > 0, F.least(F.lit(2.0), 0.6 + x["n"] * 0.35)).otherwise(0.0)
    named = lambda xs, test: F.transform(F.filter(xs, test), lambda x: x["skill"])
    total = lambda xs: F.aggregate(F.transform(xs, points), F.lit(0.0), lambda a, p: a + p)
    score = lambda xs: round2(F.least(F.lit(100.0), total(xs) * 100.0 / (max(1, len(set(targets))) * 6.0)))
    # a list of one, so that what is found has a name and is computed once
    return F.transform(F.array(held), lambda xs: F.struct(score(xs).alias("score"), named(xs, strong).alias("strong"), named(xs, lambda x: ~strong(x) & (x["n"] > 0)).alias("weak")))[0]


def located(text: Column, found: Column) -> Column:
    """Passages of a text in order: list of at (from 1) and found. One is looked for behind the one before."""
    none = F.array().cast("array<struct<at:int,found:string>>")
    behind = lambda acc: F.when(F.size(acc) == 0, F.lit(1)).otherwise(F.element_at(acc, -1)["at"] + F.length(F.element_at(acc, -1)["found"]))
    return F.aggregate(found, none, lambda acc, m: F.array_append(acc, F.struct(F.call_function("locate", m, text, behind(acc)).alias("at"), m.alias("found"))))


def achievement_scores(text: Column, targets: Column) -> dict[str, Column]:
    """achievements near a target term (22 each, at most ten) and complex terms that are targets or near one (12.5 each)."""
    text = F.coalesce(text, F.lit(""))
    low = F.lower(text)
    targets = F.array_distinct(F.filter(F.transform(targets, lambda t: F.lower(F.trim(t))), lambda t: t != ""))
    around = lambda at, size, before, after: F.substring(low, F.greatest(at - before, F.lit(1)), F.least(at - 1, F.lit(before)) + size + after)
    near = lambda window: F.exists(targets, lambda t: F.contains(window, t))
    told = F.filter(located(text, results_told(text)), lambda m: near(around(m["at"], F.length(m["found"]), 140, 140)))
    achieved = F.slice(F.array_distinct(F.transform(told, lambda m: F.trim(m["found"]))), 1, 10)
    terms = F.array(*map(F.lit, sorted(L.COMPLEX_TERMS)))
    complex_ = F.filter(terms, lambda t: F.contains(low, t) & (F.array_contains(targets, t) | near(around(F.call_function("locate", t, low), F.lit(0), 160, 200))))
    return {"achievement": F.least(F.size(achieved) * 22.0, F.lit(100.0)), "complexity": F.least(F.size(complex_) * 12.5, F.lit(100.0)), "achievements": achieved, "complex": complex_}


def experience_blocks(text: Column) -> Column:
    """Parts that begin at lines `client:`; without such a line, parts of at least 120 characters at lines that end in a span of years."""
    # patterns are tried on texts that hold what they need
    ends = lambda p: F.concat(F.substring(p, 1, 1), F.substring(p, -1, 1))
    trimmed = lambda p: F.when(F.regexp_like(ends(p), F.lit(r"[\s\x85\u2028\u2029]")), F.regexp_replace(p, r"^\s+|\s+$", "")).otherwise(p)
    none = F.array().cast("array<string>")

    def parts(text: Column) -> Column:
        clients = F.filter(F.transform(F.split(text, r"(?im)(?=^\s*client\s*:)"), trimmed), lambda p: F.regexp_like(p, F.lit(r"(?i)^client\s*:")))
        clients = F.when(F.contains(F.lower(text), F.lit("client")), clients).otherwise(none)
        dated = F.split(text, r"(?im)(?=^.{0,100}(?:19|20)?\d{2}\s*(?:-|–|—|to)\s*(?:present|current|(?:19|20)?\d{2})\s*$)")
        dated = F.when(F.regexp_like(text, F.lit(r"\d\d\s*(?:-|–|—|[tT][oO])")), dated).otherwise(F.array(text))
        return once(clients, lambda found: F.when(F.size(found) > 0, found).otherwise(F.filter(F.transform(dated, trimmed), lambda p: F.length(p) >= 120)))

    return once(F.replace(F.coalesce(text, F.lit("")), F.lit("\f"), F.lit("\n")), parts)


def header_prior(text: Column, target: str) -> Column:
    """How far the head of a text speaks for the target platform rather than for another (0.12 to 1)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    boundary = F.call_function("locate", F.lit("professional experience"), low)
    head = F.substring(low, F.lit(1), F.when(boundary > 1, boundary - 1).otherwise(F.greatest(F.lit(1200), F.floor(F.length(low) / 3).cast("int"))))

    def points(platform: str) -> Column:
        marks = sum((F.least(F.regexp_count(head, F.lit(bounded(m))), F.lit(4)) for m in L.MARKERS[platform]), F.lit(0)).cast("double")
        core = F.when(F.regexp_like(head, F.lit(rf"(?im)^\s*core stack[^\n]*\Q{platform}\E")), 8.0).otherwise(0.0)
        return marks + core + F.when(F.regexp_like(head, F.lit(rf"(?im)^\s*(?:role|title)\s*:[^\n]*\Q{platform}\E")), 6.0).otherwise(0.0)

    own, other = points(target), F.greatest(*(points(p) for p in L.MARKERS if p != target))
    core = F.regexp_extract(head, r"(?im)^\s*core stack\s+([^\n]+)", 1)
    at = F.array(*(F.struct(F.call_function("locate", F.lit(p), core).alias("at"), F.lit(-k).alias("k"), F.lit(p).alias("p")) for k, p in enumerate(L.MARKERS)))
    first = F.array_min(F.filter(at, lambda x: x["at"] > 0))["p"]
    prior = 0.18 + 0.82 * own / F.greatest(F.lit(1.0), own + other)
    prior = F.when(first == target, F.greatest(prior, F.lit(0.92))).when(first.isNotNull(), F.least(prior, F.lit(0.46))).when(other > own, F.least(prior, F.lit(0.52))).otherwise(prior)
    return F.when(own <= 0, 0.12).otherwise(F.least(F.greatest(prior, F.lit(0.12)), F.lit(1.0)))


def project_evidence(resumes: DataFrame, target: str, required: list[str], years: Column, prior: Column) -> DataFrame:
    """id, projects, strong, years, score, confidence of a platform, from résumés (id, text).

    years: of a block `block`; prior: of a text `text`. Blocks that don't name the platform count for nothing.
    """
    low = F.lower("block")
    count = lambda terms: sum((F.regexp_like(low, F.lit(bounded(t))).cast("int") for t in terms), F.lit(0))
    blocks = resumes.select("id", prior.alias("prior"), F.explode_outer(experience_blocks(F.col("text"))).alias("block"))
    own, asked = count(L.MARKERS[target]), count(required)
    density = own / F.greatest(F.lit(1), sum((count(ms) for ms in L.MARKERS.values()), F.lit(0)))
    acted, measured = F.least(F.regexp_count(low, F.lit(rf"\b(?:{L.PROJECT_ACTIONS})\b")), F.lit(8)), F.least(F.regexp_count(low, F.lit(rf"\b\d+(?:\.\d+)?\s*(?:{L.PROJECT_UNITS})\b")), F.lit(5))
    strength = F.least(F.lit(100.0), 18.0 + own * 9.0 + asked * 4.0 + acted * 3.0 + measured * 2.5 + density * 18.0)
    rows = blocks.select("id", "prior", (own > 0).alias("hit"), strength.alias("s"), density.alias("d"), F.coalesce(years, F.lit(0.0)).alias("y"))
    relevance = F.least(F.lit(1.0), 0.20 + 0.50 * F.col("d") + 0.30 * F.col("s") / 100.0)
    worked = F.when(F.col("y") > 0, F.col("y") * relevance).otherwise(F.least(F.lit(0.75), F.col("s") / 160.0))
    hit = lambda x: F.when(F.col("hit"), x)
    sums = rows.groupBy("id", "prior").agg(F.count(hit(F.lit(1))).alias("projects"), F.count(hit(F.when(F.col("s") >= 68, 1))).alias("strong"), F.coalesce(F.avg(hit(F.col("s"))), F.lit(0.0)).alias("mean"), F.coalesce(F.sum(hit(worked)), F.lit(0.0)).alias("worked"))
    total = F.least(F.lit(12.0), F.col("worked") * (0.55 + 0.45 * F.col("prior")))
    score = F.least(F.lit(100.0), 8.0 + 42.0 * F.col("prior") + 30.0 * F.col("mean") / 100.0 + F.least(F.lit(20.0), total * 4.0))
    sure = F.when((score >= 78) & ((F.col("strong") >= 1) | (total >= 2.5)), "Strong").when(F.col("projects") > 0, "Moderate").otherwise("Weak")
    return sums.select("id", "projects", "strong", round2(total).alias("years"), round2(score).alias("score"), sure.alias("confidence"))


def aligned_skills(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tiered, critical_penalty from a row a skill that a posting names: weight, tier, required, held."""
    weight = F.coalesce("weight", F.lit(1.0)) * F.when(F.col("required"), 1.35).otherwise(1.0)
    critical = F.count(F.when(~F.col("held") & F.col("required") & (F.col("tier") == 1), 1))
    sums = rows.groupBy(*keys).agg(F.sum(weight).alias("all"), F.sum(F.when(F.col("held"), weight).otherwise(0.0)).alias("own"), critical.alias("critical"))
    return sums.select(*keys, round2(F.when(F.col("all") > 0, F.col("own") * 100.0 / F.col("all")).otherwise(72.0)).alias("tiered"), F.least(F.lit(18.0), F.col("critical") * 6.0).alias("critical_penalty"))


def blended(first: Column, second: Column, share: Column | float) -> Column:
    return round2(first * share + second * (1.0 - share))


def wanted_kind(required_text: Column, preferred_text: Column, aliases: Column) -> Column:
    """`required` where an alias stands in the required section or in neither, `preferred` where only in the other."""
    stands = lambda text: F.exists(aliases, lambda a: F.regexp_like(F.lower(F.coalesce(text, F.lit(""))), F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.lower(a), F.lit(r"\E(?!\w)"))))
    return F.when(stands(required_text), "required").when(stands(preferred_text), "preferred").otherwise("required")


def posting_url(text: Column) -> Column:
    """The first link to a job portal, else the first link, without punctuation at its end."""
    portal = F.regexp_extract(text, r"(?i)https?://(?:www\.)?(?:dice\.com|indeed\.com|linkedin\.com|ziprecruiter\.com)/[^\s<>\"]+", 0)
    found = once(portal, lambda p: F.when(p != "", p).otherwise(F.regexp_extract(text, r"(?i)https?://[^\s<>\"]+", 0)))
    return F.when(F.contains(text, F.lit("://")), F.regexp_replace(found, r"[.,);\]]+$", "")).otherwise("")


def posting_id(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?i)(?:job\s*#|job\s*id|position\s*id|requisition\s*id|req\s*id|dice\s*id)\s*[:#-]?\s*([a-z0-9/_-]+)", 1)
    return F.when(once(F.lower(text), lambda low: any_in(low, ["job", "position", "req", "dice"]) & any_in(low, ["id", "#"])), found).otherwise("")


def posting_title(text: Column) -> Column:
    """Of the first 25 lines that aren't blank the first of 3 to 160 characters that doesn't begin like a link or a label."""
    lines = F.filter(F.transform(F.split(text, r"\R"), lambda x: stripped(x)), lambda x: x != "")
    ignored = "^(?:" + "|".join(rf"\Q{p}\E" for p in L.TITLE_IGNORED) + ")"
    fits = F.filter(F.slice(lines, 1, 25), lambda x: F.length(x).between(3, 160) & ~F.regexp_like(F.lower(x), F.lit(ignored)))
    return F.coalesce(F.get(fits, F.lit(0)), F.lit(""))


def without_generic(found: DataFrame, generic: list[str] = L.GENERIC_SKILLS) -> DataFrame:
    """Rows of a column skill that name something specific."""
    return found.where(~F.col("skill").isin(generic))


def first_filled(*options: Column) -> Column:
    """The first of these that isn't null or blank, else empty."""
    return F.coalesce(*(F.when(F.trim(o) != "", o) for o in options), F.lit(""))


def check_weights(weights: dict[str, float], keys: list[str]) -> dict[str, float]:
    """The weights, where every key has one and they add up to 1 within a thousandth; else an error."""
    missing = sorted(set(keys) - set(weights))
    if missing:
        raise ValueError("Missing weights: " + ", ".join(missing))
    total = sum(weights[k] for k in keys)
    if abs(total - 1.0) > 0.001:
        raise ValueError(f"Weights must total 1.0, not {total:.4f}")
    return weights
