"""Checks of a generated résumé patch: structure, numbers of lines, repetitions, lengths, claims, isolation, headers, skills block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pairs import strings
from .profiles import unapproved_numbers

LISTS = ["summary_bullets", "skills", "experience_1_bullets", "experience_2_bullets", "unsupported_requirements", "change_notes"]
KEYS = ["summary_bullets", "skills", "skills_latex", "experience_1_bullets", "experience_2_bullets", "unsupported_requirements", "change_notes"]
BULLETS = ["summary_bullets", "experience_1_bullets", "experience_2_bullets"]
#: Field: what it is called, least and most lines.
COUNTS = {"summary_bullets": ("Summary", 4, 7), "experience_1_bullets": ("Experience 1", 6, 10), "experience_2_bullets": ("Experience 2", 5, 9)}
LONGEST = 450


def plain(x: Column) -> Column:
    """Lower case, single spaces, no escapes of LaTeX for percent and tilde."""
    text = F.replace(F.replace(F.lower(F.trim(x)), F.lit("\\%"), F.lit("%")), F.lit("\\textasciitilde"), F.lit(""))
    return F.regexp_replace(text, r"\s+", " ")


def patch_errors(patches: DataFrame, isolated: dict[str, list[str]], headers: list[str]) -> DataFrame:
    """id, errors from patches (id, patch: JSON, approved: text whose numbers may be claimed).

    isolated: field to phrases that belong elsewhere; headers: patterns that no line of experience may have. A patch that
    isn't JSON or lacks a key or a list has only the errors of its structure. All checks are made in one narrow pass.
    """
    c, none = F.col, F.array().cast("array<string>")
    rows = patches.select("id", F.coalesce("approved", F.lit("")).alias("approved"), F.try_parse_json("patch").alias("v"))
    part = lambda key: F.try_variant_get(c("v"), f"$.{key}", "variant")
    said = lambda found: F.filter(F.array(*found), lambda e: e.isNotNull())
    missing = said([F.when(part(k).isNull(), F.lit(f"Missing patch key: {k}")) for k in KEYS])
    kinds = [F.when(~F.startswith(F.schema_of_variant(part(k)), F.lit("ARRAY")), F.lit(f"Patch field must be a list: {k}")) for k in LISTS]
    wrong = said([*kinds, F.when(F.schema_of_variant(part("skills_latex")) != "STRING", F.lit("skills_latex must be a string."))])
    lines = {k: F.coalesce(F.try_variant_get(c("v"), f"$.{k}", "array<string>"), none) for k in BULLETS}
    rows = rows.withColumns({"missing": missing, "wrong": wrong, "latex": F.coalesce(F.try_variant_get(c("v"), "$.skills_latex", "string"), F.lit(""))} | lines)

    rows = rows.withColumns({f"k_{k}": F.transform(k, plain) for k in BULLETS})
    rows = rows.withColumns({f"s_{k}": F.array_sort(f"k_{k}") for k in BULLETS})
    counted = said([F.when(~F.size(k).between(a, b), F.lit(f"{name} must contain {a}-{b} bullets.")) for k, (name, a, b) in COUNTS.items()])

    def repeated(key: str) -> Column:
        """Repeated lines in order of their first; equal ones are neighbours once sorted."""
        twice = F.array_intersect(F.filter(f"k_{key}", lambda x: x != ""), F.filter(f"s_{key}", lambda x, i: (i > 0) & (x == F.get(f"s_{key}", i - 1))))
        return F.when(F.size(twice) > 0, F.concat(F.lit(f"Duplicate bullets in {key}: ['"), F.array_join(twice, "', '"), F.lit("']")))

    long_ = lambda k: F.transform(F.filter(k, lambda x: F.length(x) > LONGEST), lambda x: F.concat(F.lit(f"Bullet exceeds {LONGEST} characters in {k}: "), F.substring(x, 1, 100), F.lit("...")))
    every = F.array_join(F.concat(*BULLETS), "\n")
    claims = F.transform(unapproved_numbers(every, c("approved")), lambda n: F.concat(F.lit("Unapproved numeric claim detected: "), n))
    alone = lambda k, phrases: F.transform(F.filter(strings(phrases), lambda p: F.contains(F.lower(F.array_join(k, " ")), p)), lambda p: F.concat(F.lit(f"Experience isolation violation: {k} contains: "), p))
    header = "(?U)" + ("|".join(f"(?:{p})" for p in headers) or r"\z(?!\z)")
    headed = lambda k: F.transform(F.filter(k, lambda x: F.regexp_like(F.lower(x), F.lit(header))), lambda x: F.concat(F.lit("Experience bullet contains employer/role/date header text: "), F.substring(x, 1, 120)))
    block = [("\\section*", "skills_latex missing section declaration."), ("\\begin{longtable}", "skills_latex missing longtable start."), ("\\end{longtable}", "skills_latex missing longtable end."), ("\\textbf{", "skills_latex contains no skill categories.")]
    latex = F.when(c("latex") == "", F.array(F.lit("skills_latex is empty."))).otherwise(said([F.when(~F.contains("latex", F.lit(m)), F.lit(e)) for m, e in block]))
    content = F.concat(counted, said([repeated(k) for k in BULLETS]), *(long_(k) for k in BULLETS), claims, *(alone(k, ps) for k, ps in isolated.items()), headed("experience_1_bullets"), headed("experience_2_bullets"), latex)
    errors = F.when(c("v").isNull(), F.array(F.lit("Patch is not JSON."))).when(F.size("missing") > 0, c("missing")).when(F.size("wrong") > 0, c("wrong")).otherwise(content)
    return rows.select("id", errors.alias("errors"))
