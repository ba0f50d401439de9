"""Generated patches against all rules: fixed ones, and documents whose lines stand for generated ones."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import patches
from .catalog import lit, query, read, values
from .pair_catalog import LATIN

BLOCK = "\\section*{x}\\begin{longtable}\\textbf{a}\\end{longtable}"


def patch(**fields) -> str:
    return json.dumps({"summary_bullets": [], "skills": [], "skills_latex": "", "experience_1_bullets": [], "experience_2_bullets": [], "unsupported_requirements": [], "change_notes": []} | fields)


GENERATED = [
    (1, patch(summary_bullets=["a", "b", "c", "A  "], skills_latex=BLOCK, experience_1_bullets=["1", "2", "3", "cut 40\\% of cost", "Data Engineer at home", "payroll"], experience_2_bullets=["v", "w", "x", "y", "warranty claims of jul 2021"]), "1 2 3"),
    (2, "{}", ""), (3, "nope", None), (4, None, "x"), (5, patch(summary_bullets="x", skills_latex=1, change_notes={}), ""), (6, patch(), ""), (7, patch(summary_bullets=["x" * 451] * 2, experience_2_bullets=["7", "7"]), "7+"),
]
APART = {"experience_1_bullets": ["payroll", "headcount", " que ", " und "], "experience_2_bullets": ["warranty claim", "actuarial", "that the"]}
HEADS = [*L.HEADER_PATTERNS, r"^er\b", r"\bthe of\b"]


def patch_sql() -> str:
    each = lambda k, cond, text: f"list_transform(list_filter({k}, lambda x: {cond}), lambda x: {text})"
    norm = f"regexp_replace(replace(replace(lower(trim(x)), {lit(chr(92) + '%')}, '%'), {lit(chr(92) + 'textasciitilde')}, ''), '\\s+', ' ', 'g')"
    said = lambda xs: "list_filter([" + ", ".join(xs) + "], lambda e: e is not null)"
    twice = lambda k: f"list_filter(list_transform(n_{k}, lambda x, i: case when x <> '' and list_position(n_{k}, x) = i and len(list_filter(n_{k}, lambda y: y = x)) > 1 then x end), lambda x: x is not null)"
    rep = lambda k: f"case when len({twice(k)}) > 0 then 'Duplicate bullets in {k}: [''' || array_to_string({twice(k)}, ''', ''') || ''']' end"
    apart = [each(lit(ps), f"contains(lower(array_to_string({k}, ' ')), x)", f"'Experience isolation violation: {k} contains: ' || x") for k, ps in APART.items()]
    heads = [each(k, " or ".join(f"regexp_matches(regexp_replace(lower(x), '{LATIN}', 'z', 'g'), {lit(p)})" for p in HEADS), "'Experience bullet contains employer/role/date header text: ' || left(x, 120)") for k in patches.BULLETS[1:]]
    block = [("section*", "skills_latex missing section declaration."), ("begin{longtable}", "skills_latex missing longtable start."), ("end{longtable}", "skills_latex missing longtable end."), ("textbf{", "skills_latex contains no skill categories.")]
    latex = "case when latex = '' then ['skills_latex is empty.'] else " + said([f"case when not contains(latex, {lit(chr(92) + m)}) then {lit(e)} end" for m, e in block]) + " end"
    counts = said([f"case when len({k}) not between {a} and {b} then '{n} must contain {a}-{b} bullets.' end" for k, (n, a, b) in patches.COUNTS.items()])
    long_ = [each(k, "length(x) > 450", f"'Bullet exceeds 450 characters in {k}: ' || left(x, 100) || '...'") for k in patches.BULLETS]
    every = f"array_to_string(list_concat(list_concat({', '.join(patches.BULLETS[:2])}), {patches.BULLETS[2]}), chr(10))"
    claims = f"list_transform(list_filter(regexp_extract_all({every}, '{L.NUMBER}'), lambda n: not list_contains(known, n)), lambda n: 'Unapproved numeric claim detected: ' || n)"
    kinds = [*(f"case when json_type((p -> '$.{k}')) <> 'ARRAY' then 'Patch field must be a list: {k}' end" for k in patches.LISTS), "case when json_type((p -> '$.skills_latex')) <> 'VARCHAR' then 'skills_latex must be a string.' end"]
    lists = ", ".join(f"case when json_type((p -> '$.{k}')) = 'ARRAY' then from_json((p -> '$.{k}'), '[\"VARCHAR\"]') else [] end as {k}" for k in patches.BULLETS)
    content = [counts, said([rep(k) for k in patches.BULLETS]), *long_, claims, *apart, *heads, latex]
    return f"""with {values("v0", "id, patch, approved", GENERATED)}, v as (select id::bigint as id, patch, approved from v0 union all select doc_id + 1000, json_object('summary_bullets', string_split(text, chr(10))[1:5], 'skills', [], 'skills_latex', split_part(text, '.', 1), 'experience_1_bullets', string_split(text, '. '), 'experience_2_bullets', string_split(text, ', '), 'unsupported_requirements', [], 'change_notes', [])::varchar, source from documents),
j as (select id, coalesce(approved, '') as approved, case when json_valid(patch) then patch::json end as p from v),
f as (select *, {said([f"case when (p -> '$.{k}') is null then 'Missing patch key: {k}' end" for k in patches.KEYS])} as missing, {said(kinds)} as wrong, coalesce((p ->> '$.skills_latex'), '') as latex, {lists}, regexp_extract_all(approved, '{L.NUMBER}') as k0 from j),
n as (select *, list_concat(k0, list_transform(k0, lambda y: rtrim(y, '+'))) as known, {", ".join(f"list_transform({k}, lambda x: {norm}) as n_{k}" for k in patches.BULLETS)} from f)
select id, array_to_string(case when p is null then ['Patch is not JSON.'] when len(missing) > 0 then missing when len(wrong) > 0 then wrong else flatten([{", ".join(content)}]) end, ' | ') as errors from n"""


@query(patch_sql)
def patch_checks(spark, d):
    """X21, FS28, A12."""
    text, none = F.col("text"), F.array().cast("array<string>")
    split = lambda by: F.split(text, by)
    made = F.struct(
        F.slice(split("\n"), 1, 5).alias("summary_bullets"), none.alias("skills"), F.split_part("text", F.lit("."), F.lit(1)).alias("skills_latex"), split(r"\. ").alias("experience_1_bullets"), split(", ").alias("experience_2_bullets"),
        none.alias("unsupported_requirements"), none.alias("change_notes"),
    )
    docs = read(spark, d, "documents").select((F.col("doc_id") + 1000).alias("id"), F.to_json(made).alias("patch"), F.col("source").alias("approved"))
    rows = spark.createDataFrame(GENERATED, "id long, patch string, approved string").union(docs)
    return patches.patch_errors(rows, APART, HEADS).select("id", F.array_join("errors", " | ").alias("errors"))
