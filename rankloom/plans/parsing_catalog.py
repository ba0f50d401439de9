"""Parsed postings and skills by section over benchmark items and documents, with SQL of their own.

Items and documents have no headers, so rows that have them are joined in; the lexicon's terms are words of the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import parsing
from .catalog import lit, query, read, values
from .pair_catalog import LATIN, LEXICON, domain_case, role_case

NAMES = {"that": ["that", "that thing"], "this": ["this", "these"], "with": ["with"], "que": ["que", "la que"], "und": ["und", "und der"], "for": ["for"], "by": ["by"], "task": ["of"]}
POSTINGS = [
    (-1, "Apply Now\nJob Title: Senior that\nPosition ID: AB-12/x\nSee https://jobs.example/1?a=b).\nOverview\nWe need that and this.\n\nRequired Skills:\n- 5+ years of experience with that\n- must have this thing\nNice to have\n* que or la que\n* bonus: certified by la\nRequired Skills\n- und again\nResponsibilities:\nrun that for us\nSimilar jobs\nthat is cut", "Sr. that engineer", " Acme ", None, "", ""),
    (-2, "Requirements\n3-5 years of this\nminimum requirement: und\nPreferred Qualifications -\nthat plus with\nrequirements\nby required\n  2) AWS Certificate\n2) AWS Certificate\nAbout the role\nque", "associate", "", "Here", "http://own.example", "77"),
    (-3, "\r\nno headers at all\r\nat least 4 yrs experience with und\r\nDice Job match score hidden\r\n40 years, 12 years, 2.5+ yrs", "Director of la", None, None, None, None), (-4, None, None, None, None, None, None), (-5, "", " ", "x", "y", "z", "w"),
    (-6, "Qualifications\nPreferred Skills\nRequirements\nthat\nWhat you'll do\nDuties\nthis  and   that\t7 years professional experience", "mid level lead", "", "", "", ""),
]
RESUMES = [
    (-1, "That and this. la que", "3 years of that; " + "x" * 120 + " that again 12.5+ years in und\n" + "y" * 140 + " 7 yrs these, that.", "with that thing", "that, this, und der, of of", "certified that"),
    (-2, None, "15 years " + "z" * 141 + " that", "", None, ""), (-3, "", "1.25 years" + " " * 144 + "that and 12 years" + "w" * 133 + " und", None, "this", None), (-4, None, None, None, None, None), (-5, "of", "that thing for 9 years that thing that 30 yrs", "of", "of", "of"),
]
#: Numbers stand before these in documents, which hold no years.
UNIT = "(?:years|yrs|he|to|du|de|of|en|ar?es|th[a-z]*)"


def low(x: str) -> str:
    """Lower case, with accented letters as z, as this engine's patterns know ASCII words only."""
    return f"regexp_replace(lower(coalesce({x}, '')), '{LATIN}', 'z', 'g')"


def postings(spark, d):
    own = spark.createDataFrame(POSTINGS, "id long, text string, title string, company string, location string, url string, job_id string")
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text", F.split_part("text", F.lit(" "), F.lit(1)).alias("title"), *(F.lit(None).cast("string").alias(c) for c in ("company", "location", "url", "job_id")))
    docs = read(spark, d, "documents").select((F.col("doc_id") + 1_000_000).alias("id"), "text", F.col("source").alias("title"), *(F.lit("").alias(c) for c in ("company", "location", "url", "job_id")))
    return own.unionByName(items).unionByName(docs)


def listed(x: str) -> str:
    return f"array_to_string({x}, '|')"


def parse_sql() -> str:
    key = lambda h: " ".join("".join(c if c.isalnum() or c == "'" else " " for c in h).split())
    kinds = "map {" + ", ".join(f"{lit(k)}: {lit(n)}" for n, hs in L.POSTING_SECTIONS.items() for k in dict.fromkeys(map(key, hs))) + "}"
    strip = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    squeeze = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    stop = ", ".join(f"nullif(instr(lower(raw), {lit(m)}), 0)" for m in L.PORTAL_STOPS)
    noise = " or ".join(f"contains(lower(x), {lit(m)})" for m in L.PORTAL_NOISE)
    header = "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(x)), '[:\\-–—]+$', ''), '[^a-z0-9\\s'']', ' ', 'g'), '\\s+', ' ', 'g'))"

    def part(name: str) -> str:
        start = f"list_min(list_transform(list_filter(heads, lambda h: h.kind = '{name}'), lambda h: h.line))"
        end = f"list_min(list_transform(list_filter(heads, lambda h: h.kind <> '{name}' and h.line > {start}), lambda h: h.line))"
        return f"case when {start} is null then '' else {strip(f'array_to_string(lines[{start} + 1 : coalesce({end} - 1, len(lines))], chr(10))')} end as {name}"

    has = lambda text, names: "(" + " or ".join(f"regexp_matches({text}, '\\b{n}\\b')" for n in names) + ")"
    skills = sorted(NAMES.items())
    found = "[" + ", ".join(f"struct_pack(s := {lit(s)}, f := {has('low', ns)}, r := {has('rq', ns)} or not {has('pf', ns)})" for s, ns in skills) + "]"
    marked = lambda ms: f"list_filter(plain, lambda x: x <> '' and ({' or '.join(f'contains(lower(x), {lit(m)})' for m in ms)}))"
    distinct = lambda x: f"list_transform(list_filter(list_transform({x}, lambda v, i: struct_pack(v := v, i := i)), lambda p: list_position({x}, p.v) = p.i), lambda p: p.v)"
    n, unit = "(\\d+(?:\\.\\d+)?)", "(?:years|yrs)"
    get = lambda p, k: f"nullif(regexp_extract(q, '{p}', {k}), '')::double"
    span, asked, every = f"(?i){n}\\s*(?:-|–|to)\\s*{n}\\+?\\s*{unit}", f"(?i)(?:minimum\\s+of\\s+|at\\s+least\\s+)?{n}\\+?\\s*{unit}(?:\\s+of)?\\s+(?:professional\\s+)?experience", f"(?i){n}\\+?\\s*{unit}"
    other = f"coalesce({get(asked, 1)}, list_max(list_filter(list_transform(regexp_extract_all(q, '{every}', 1), lambda v: v::double), lambda v: v > 0 and v <= 30)), 0)"
    said = "coalesce(" + ", ".join(f"case when contains(lower(title), {lit(p)}) then {lit(s)} end" for p, s in L.TITLE_SENIORITY.items()) + ", case when lo < 2 then 'Junior' when lo < 5 then 'Mid' when lo < 8 then 'Senior' when lo < 12 then 'Lead' else 'Architect' end)"
    roles = role_case("lt", "low", "skills")
    return f"""with {values("v0", "id, text, title, company, location, url, job_id", POSTINGS)},
v as (select id::bigint as id, text, title, company, location, url, job_id from v0 union all select item_id, text, split_part(text, ' ', 1), null, null, null, null from benchmark union all select doc_id + 1000000, text, source, '', '', '', '' from documents),
w as (select id, {", ".join(f"{strip(f'coalesce({c}, {lit(str())})')} as {c}" for c in ("title", "company", "location", "url", "job_id"))}, replace(coalesce(text, ''), chr(13) || chr(10), chr(10)) as raw from v),
c as (select *, array_to_string(list_filter(list_transform(string_split_regex(case when least({stop}) is null then raw else substr(raw, 1, least({stop}) - 1) end, '\\r\\n|[\\n\\v\\f\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {squeeze('x')}), lambda x: x <> '' and not ({noise})), chr(10)) as rt from w),
l as (select *, string_split(rt, chr(10)) as lines, {low('rt')} as low, {squeeze("translate(lower(rt), '–—', '--')")} as nt from c),
h as (select *, list_filter(list_transform(lines, lambda x, i: struct_pack(line := i, kind := ({kinds})[{header}])), lambda h: h.kind is not null) as heads from l),
s as (select *, {", ".join(map(part, L.POSTING_SECTIONS))} from h),
t as (select * exclude (url, job_id), case when url <> '' then url else rtrim(regexp_extract(rt, '(?i)https?://[^\\s<>"]+'), '.,);]') end as url, case when job_id <> '' then job_id else regexp_extract(rt, '(?i)(?:job\\s*id|position\\s*id|requisition\\s*id|req\\s*id)\\s*[:#-]?\\s*([a-z0-9/_-]+)', 1) end as job_id,
  array_to_string(list_filter([required, preferred], lambda x: x <> ''), chr(10)) as ql, {low('required')} as rq, {low('preferred')} as pf, list_transform(lines, lambda x: {strip("regexp_replace(x, '^[\\s•*\\-–—\\d.)]+', '')")}) as plain from s),
u as (select *, case when ql <> '' then ql else rt end as q, list_filter({found}, lambda x: x.f) as found from t),
x as (select *, coalesce({get(span, 1)}, {other}) as lo, case when {get(span, 1)} is not null then {get(span, 2)} else {other} end as hi, list_transform(found, lambda x: x.s) as skills, list_transform(list_filter(found, lambda x: x.r), lambda x: x.s) as rs, list_transform(list_filter(found, lambda x: not x.r), lambda x: x.s) as ps, {low('title')} as lt from u),
y as (select *, {domain_case('low')} as domains, {roles} as role, {roles.replace('list_max(', '(', 1)} as roles from x)
select id, rt as raw_text, nt as normalized_text, title, company, location, url, job_id, summary, responsibilities, ql as qualifications, lo as minimum_experience, hi as maximum_experience, {said} as seniority,
{listed("case when len(rs) > 0 then rs else skills end")} as required_skills, {listed("ps")} as preferred_skills, {listed(distinct(marked(L.MANDATORY_MARKERS)))} as mandatory_requirements, {listed(distinct(marked(L.PREFERRED_MARKERS)))} as preferred_requirements, {listed(distinct(marked(L.CERTIFICATION_MARKERS)))} as certifications,
role.role as primary_role, floor(role.score * 100 + 0.5) / 100 as role_confidence, list_max(domains).domain as primary_domain, list_max(domains).score as domain_confidence, {listed("list_transform(domains, lambda d: d.domain || '=' || round(d.score)::int)")} as domain_scores, {listed("list_transform(roles, lambda r: r.role || '=' || floor(r.score + 0.5)::int)")} as role_scores from y"""


@query(parse_sql)
def posting_profile(spark, d):
    rows = parsing.parse_postings(postings(spark, d), LEXICON, NAMES, "id")
    flat = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), F.floor(e["value"] + 0.5).cast("string"))), "|")
    lists = ("required_skills", "preferred_skills", "mandatory_requirements", "preferred_requirements", "certifications")
    return rows.withColumns({c: F.array_join(c, "|") for c in lists} | {c: flat(c) for c in ("domain_scores", "role_scores")})


def section_sql() -> str:
    names = values("a0", "skill, alias", [(s, a) for s, ns in NAMES.items() for a in ns])
    n = "len(regexp_extract_all(low, '\\b' || alias || '\\b'))"
    year = f"(\\d+(?:\\.\\d+)?)\\+?\\s*{UNIT}"
    score = " + ".join(f"{p} * {L.CONFIDENCE[k]}" for p, k in parsing.PARTS.items())
    return f"""with {names}, a as (select * from a0 where not list_contains({lit(L.GENERIC_SKILLS)}, skill)), {values("r0", "id, summary, experience, projects, skills, certifications", RESUMES)},
r as (select id::bigint as id, summary, experience, projects, skills, certifications from r0 union all select doc_id, split_part(text, chr(10), 1), text, null, array_to_string(string_split(text, chr(10))[-1:], ''), '' from documents),
p as ({" union all ".join(f"select id, '{p}' as part, {low(p)} as low from r" for p in parsing.PARTS)}),
m as (select id, skill, part, sum({n})::bigint as n from p join a on contains(low, alias) group by all having sum({n}) > 0),
w as (select id, skill, sum(n)::bigint as frequency, {", ".join(f"coalesce(sum(n) filter (part = '{p}'), 0)::bigint as {p}" for p in parsing.PARTS)} from m group by all),
e as (select id, low from p where part = 'experience'),
k as (select id, skill, alias, unnest(string_split_regex(low, '\\b' || alias || '\\b')) as piece, generate_subscripts(string_split_regex(low, '\\b' || alias || '\\b'), 1) as k, len(string_split_regex(low, '\\b' || alias || '\\b')) as pieces from e join a on contains(low, alias)),
g as (select id, skill, sum(length(piece) + length(alias)) over (partition by id, skill, alias order by k) - length(alias) as pos, k, pieces from k qualify k < pieces),
y0 as (select id, unnest(regexp_extract_all(low, '{year}')) as whole, unnest(regexp_extract_all(low, '{year}', 1)) as said, unnest(string_split_regex(low, '{year}')[:-2]) as piece, generate_subscripts(regexp_extract_all(low, '{year}'), 1) as k from e where regexp_matches(low, '{year}')),
y as (select id, said, sum(length(piece) + length(whole)) over (partition by id order by k) as stop, sum(length(piece) + length(whole)) over (partition by id order by k) - length(whole) as start from y0),
n as (select g.id, g.skill, max(try_cast(ltrim(substr(said, (greatest(greatest(pos - 150, 0) - start, 0) + 1)::bigint), '.') as double)) as years from g join y on g.id = y.id where stop <= pos + 150 and start + length(said) > greatest(pos - 150, 0) group by all)
select w.*, coalesce(years, 0)::double as years, least({score} + frequency * 2, 100)::double as confidence, least({score} + frequency * 2, 100) >= 70 and frequency >= 3 as "primary" from w left join n using (id, skill)"""


@query(section_sql)
def skills_by_section(spark, d):
    own = spark.createDataFrame(RESUMES, "id long, summary string, experience string, projects string, skills string, certifications string")
    lines = F.split("text", "\n")
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), lines[0].alias("summary"), F.col("text").alias("experience"), F.lit(None).cast("string").alias("projects"), F.element_at(lines, -1).alias("skills"), F.lit("").alias("certifications"))
    aliases = spark.createDataFrame([(s, a) for s, ns in NAMES.items() for a in ns], "skill string, alias string")
    return parsing.section_skills(own.unionByName(docs), aliases, UNIT)
