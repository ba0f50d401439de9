"""Postings parsed into profiles, and skills by the section of a text that names them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import any_in, once, round2, squeeze, stripped
from .pairs import Lexicon, domains_of, is_word, known_words, pattern, role_of, stands, standing, strings
from .postings import cleaned, sections
from .skills import mentions

#: Sections of a résumé and what a mention there adds to a skill's confidence.
PARTS = {"summary": "summary", "experience": "experience", "projects": "project", "skills": "skills", "certifications": "certification"}
#: Characters around a mention in which years count for it.
AROUND = 150


# ---- fields of a posting


def experience_range(text: Column) -> tuple[Column, Column]:
    """(least, most) years: of the first range, else of the first `N years of experience`, else the greatest number up to 30."""
    number, unit = r"(\d+(?:\.\d+)?)", r"(?:years|yrs)"
    told = any_in(F.lower(text), ["years", "yrs"])  # most texts name none, and no pattern is tried on them
    found = lambda p, k: F.when(told, once(F.regexp_extract(text, p, k), lambda v: F.when(v != "", v))).cast("double")
    spans = rf"(?i){number}\s*(?:-|–|to)\s*{number}\+?\s*{unit}"
    asked = found(rf"(?i)(?:minimum\s+of\s+|at\s+least\s+)?{number}\+?\s*{unit}(?:\s+of)?\s+(?:professional\s+)?experience", 1)
    every = F.filter(F.transform(F.regexp_extract_all(text, F.lit(rf"(?i){number}\+?\s*{unit}"), F.lit(1)), lambda x: x.cast("double")), lambda x: (x > 0) & (x <= 30))
    other = F.coalesce(asked, F.when(told, F.array_max(every)), F.lit(0.0))
    return F.coalesce(found(spans, 1), other), F.when(found(spans, 1).isNotNull(), found(spans, 2)).otherwise(other)


def titled_seniority(title: Column, years: Column) -> Column:
    """What the title says (its first phrase in the table's order), else what the years asked for say."""
    low = F.lower(F.coalesce(title, F.lit("")))
    said = F.coalesce(*(F.when(F.contains(low, F.lit(p)), F.lit(s)) for p, s in L.TITLE_SENIORITY.items()))
    return F.coalesce(said, F.when(years < 2, "Junior").when(years < 5, "Mid").when(years < 8, "Senior").when(years < 12, "Lead").otherwise("Architect"))


def lines_with(text: Column, markers: list[str]) -> Column:
    """Lines that hold a marker, without what numbers or bullets them, distinct in order."""
    holds = lambda x: once(F.lower(x), lambda low: any_in(low, markers))
    plain = F.transform(F.split(text, r"\R"), lambda x: stripped(F.regexp_replace(x, r"^[\s•*\-–—\d.)]+", "")))
    return F.when(holds(text), F.array_distinct(F.filter(plain, holds))).otherwise(F.array().cast("array<string>"))


def posting_columns() -> list[str]:
    return [
        "raw_text", "normalized_text", "title", "company", "location", "url", "job_id", "summary", "responsibilities", "qualifications", "minimum_experience", "maximum_experience", "seniority",
        "required_skills", "preferred_skills", "mandatory_requirements", "preferred_requirements", "certifications", "primary_role", "role_confidence", "primary_domain", "domain_confidence", "domain_scores", "role_scores",
    ]


def parse_postings(jobs: DataFrame, lex: Lexicon, aliases: dict[str, list[str]], *keep: str) -> DataFrame:
    """The 24 columns of posting_columns() from jobs (text, title, company, location, url, job_id), and the columns `keep`.

    aliases: skill to what it is called, lower case. One narrow pass over the texts; nothing is exchanged.
    """
    c = F.col
    blank = lambda name: stripped(F.coalesce(name, F.lit("")))
    rows = jobs.select(*keep, cleaned(c("text")).alias("raw_text"), *(blank(f).alias(f) for f in ("title", "company", "location", "url", "job_id")))
    normal = lambda x: squeeze(F.replace(F.replace(F.lower(x), F.lit("–"), F.lit("-")), F.lit("—"), F.lit("-")))
    rows = rows.withColumns({"normalized_text": normal(c("raw_text")), "low": F.lower("raw_text"), "parts": sections(c("raw_text"), L.POSTING_SECTIONS)})
    link = F.rtrim(F.regexp_extract("raw_text", r"(?i)https?://[^\s<>\"]+", 0), F.lit(".,);]"))
    link = F.when(F.contains("raw_text", F.lit("://")), link).otherwise("")
    number = F.regexp_extract("raw_text", r"(?i)(?:job\s*id|position\s*id|requisition\s*id|req\s*id)\s*[:#-]?\s*([a-z0-9/_-]+)", 1)
    number = F.when(any_in(c("low"), ["job", "position", "req"]) & any_in(c("low"), ["id"]), number).otherwise("")
    part = lambda name: F.coalesce(F.try_element_at("parts", F.lit(name)), F.lit(""))
    both = F.filter(F.array(part("required"), part("preferred")), lambda s: s != "")
    rows = rows.withColumns({
        "url": F.when(c("url") != "", c("url")).otherwise(link), "job_id": F.when(c("job_id") != "", c("job_id")).otherwise(number),
        "summary": part("summary"), "responsibilities": part("responsibilities"), "qualifications": F.array_join(both, "\n"), "_required": normal(part("required")), "_preferred": normal(part("preferred")),
    })
    rows = rows.withColumn("_years", F.when(c("qualifications") != "", c("qualifications")).otherwise(c("raw_text")))
    least, most = experience_range(c("_years"))
    names = sorted(n for ns in aliases.values() for n in ns)
    known = sorted({*lex.words, *filter(is_word, names)})
    rows = rows.withColumns({"minimum_experience": least, "maximum_experience": most, "_words": known_words(c("low"), known), "_title_words": known_words(F.lower("title"), lex.words)})
    table = [F.struct(F.lit(s).alias("skill"), strings(ns).alias("names"), (F.size(standing(c("low"), c("_words"), ns)) > 0).alias("held")) for s, ns in sorted(aliases.items())]
    in_ = lambda text, names: F.exists(names, lambda n: F.contains(text, n) & (stands(text, n) > 0))
    # a skill that neither section names counts as required
    found = F.transform(F.filter(F.array(*table), lambda s: s["held"]), lambda s: F.struct(s["skill"].alias("skill"), (in_(c("_required"), s["names"]) | ~in_(c("_preferred"), s["names"])).alias("required")))
    rows = rows.withColumn("_found", found)
    rows = rows.withColumns({"_skills": F.transform("_found", lambda s: s["skill"])})
    required = F.transform(F.filter("_found", lambda s: s["required"]), lambda s: s["skill"])
    rows = rows.withColumns({
        "required_skills": F.when(F.size(required) > 0, required).otherwise(c("_skills")), "preferred_skills": F.transform(F.filter("_found", lambda s: ~s["required"]), lambda s: s["skill"]),
        "seniority": titled_seniority(c("title"), c("minimum_experience")), "_domains": domains_of(c("low"), lex, c("_words")), "_roles": role_of(F.lower("title"), c("low"), c("_skills"), lex, every=True, words=F.array_union("_title_words", "_words")),
    })
    rows = rows.withColumns({"_role": F.array_max("_roles"), "_domain": F.array_max("_domains")})
    scores = lambda array, name: F.map_from_entries(F.transform(array, lambda x: F.struct(x[name].alias("key"), round2(x["score"]).alias("value"))))
    rows = rows.withColumns({
        "mandatory_requirements": lines_with(c("raw_text"), L.MANDATORY_MARKERS), "preferred_requirements": lines_with(c("raw_text"), L.PREFERRED_MARKERS), "certifications": lines_with(c("raw_text"), L.CERTIFICATION_MARKERS),
        "primary_role": c("_role.role"), "role_confidence": round2(c("_role.score")), "primary_domain": c("_domain.domain"), "domain_confidence": c("_domain.score"), "domain_scores": scores(c("_domains"), "domain"), "role_scores": scores(c("_roles"), "role"),
    })
    return rows.select(*keep, *posting_columns())


# ---- skills by section, with years near their mentions


def spots(rows: DataFrame, lengths: Column, gap: Column, *keys: str) -> DataFrame:
    """keys, at, size, said: matches from the lengths of the pieces between them; lengths and gap are arrays of equal size.

    Pieces' lengths are exploded, not texts, and a running sum over them says where each match begins.
    """
    each = rows.select(*keys, F.posexplode(F.arrays_zip(lengths.alias("piece"), gap.alias("gap"))).alias("k", "x")).select(*keys, "k", "x.piece", F.col("x.gap.size").alias("size"), F.col("x.gap.said").alias("said"))
    before = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return each.select(*keys, (F.sum(F.col("piece") + F.col("size")).over(before) - F.col("size")).alias("at"), "size", "said")


def years_near(rows: DataFrame, aliases: DataFrame, unit: str = "(?:years|yrs)") -> DataFrame:
    """id, skill, years: the most years within AROUND characters of a skill's mention in `text`; aliases (skill, alias).

    An index of positions for mentions and one for years are met band by band: a position joins years of its own band of
    AROUND characters and the two beside it, so a long text is never joined with itself. A number that the window cuts
    counts by the digits that lie in it.
    """
    known = strings(sorted(r.alias for r in aliases.select("alias").distinct().collect()))
    text = rows.select("id", F.coalesce("text", F.lit("")).alias("text"))

    def pieces(p: Column) -> Column:
        lengths = F.transform(F.split("text", p), lambda s: F.length(s))
        return F.slice(lengths, F.lit(1), F.size(lengths) - 1)

    one = lambda a: F.struct(a.alias("alias"), pieces(pattern(r"(?iU)(?<!\w)", a, r"(?!\w)")).alias("pieces"))
    met = text.select("id", F.explode(F.transform(F.filter(known, lambda a: F.contains(F.lower("text"), a)), one)).alias("m")).select("id", "m.alias", "m.pieces")
    same = F.transform("pieces", lambda _: F.struct(F.length("alias").alias("size"), F.lit("").alias("said")))
    places = spots(met, F.col("pieces"), same, "id", "alias").select("id", "alias", "at", F.floor(F.col("at") / AROUND).alias("band"))
    year = rf"(?i)(\d+(?:\.\d+)?)\+?\s*{unit}"
    whole = F.zip_with(F.regexp_extract_all("text", F.lit(year), F.lit(0)), F.regexp_extract_all("text", F.lit(year), F.lit(1)), lambda a, n: F.struct(F.length(a).alias("size"), n.alias("said")))
    told = text.select("id", pieces(F.lit(year)).alias("pieces"), whole.alias("gap")).where(F.size("gap") > 0)
    told = spots(told, F.col("pieces"), F.col("gap"), "id").select("id", F.col("at").alias("begin"), (F.col("at") + F.col("size")).alias("end"), "said")
    band = F.floor(F.col("end") / AROUND)
    told = told.select("id", "begin", "end", "said", F.explode(F.sequence(band - 1, band + 1)).alias("band"))
    left = F.greatest(F.col("at") - AROUND, F.lit(0))
    near = (F.col("end") <= F.col("at") + AROUND) & (F.col("begin") + F.length("said") > left)
    shown = F.ltrim(F.substring("said", (F.greatest(left - F.col("begin"), F.lit(0)) + 1).cast("int"), F.length("said")), F.lit("."))
    found = places.join(told, ["id", "band"]).where(near).select("id", "alias", shown.try_cast("double").alias("years"))
    return found.join(aliases, "alias").groupBy("id", "skill").agg(F.max("years").alias("years"))


def section_skills(rows: DataFrame, aliases: DataFrame, unit: str = "(?:years|yrs)", generic: list[str] = L.GENERIC_SKILLS) -> DataFrame:
    """id, skill, frequency, mentions by section, years, confidence, primary; rows: id and a text for each of PARTS.

    A skill is primary from a confidence of 70 and three mentions on. aliases (skill, alias: lower case) needs the skill's
    own name too. Null and missing texts name nothing.
    """
    aliases = aliases.where(~F.col("skill").isin(generic))
    parts = rows.select(F.explode(F.array(*(F.struct(F.col("id"), F.lit(p).alias("part"), F.coalesce(F.col(p), F.lit("")).alias("text")) for p in PARTS))).alias("s"))
    counted = mentions(parts.select(F.struct("s.id", "s.part").alias("doc_id"), "s.text"), aliases)
    by = {p: F.sum(F.when(F.col("doc_id.part") == p, F.col("n")).otherwise(0)) for p in PARTS}
    wide = counted.groupBy(F.col("doc_id.id").alias("id"), "skill").agg(F.sum("n").alias("frequency"), *(n.alias(p) for p, n in by.items()))
    years = years_near(rows.select("id", F.col("experience").alias("text")), aliases, unit)
    score = F.least(sum((F.col(p) * L.CONFIDENCE[k] for p, k in PARTS.items()), F.col("frequency") * 2).cast("double"), F.lit(100.0))
    out = wide.join(years, ["id", "skill"], "left").withColumns({"years": F.coalesce("years", F.lit(0.0)), "confidence": score})
    return out.withColumn("primary", (F.col("confidence") >= 70) & (F.col("frequency") >= 3))
