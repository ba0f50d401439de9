"""Queries over inline profiles and postings, with SQL of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import profiles as P
from ..operators.relational import first_by
from .catalog import lit, query, read, texts, texts_sql, values

AS_OF = (2025, 6)
RESUMES = [
    (1, "Jane\nProfessional Summary\nBuilt things.\nTechnical Skills\nspark, sql\nEducation\nMSc"), (2, "no headers here"), (3, "Summary: ten. Work Experience at X, Jul '21 – Present\nSkills\npyspark"), (4, None), (5, "education\nfirst\nskills: a\nprojects: b"),
]
SPANS = [(1, "Jul '21 – Present"), (2, "2018 - 2020"), (3, "Mar 2019 to may 2019"), (4, "none"), (5, "dec 99 - Feb 01"), (6, "1990 - 2020"), (7, "May 2022 - Apr 2022"), (8, None)]
EVIDENCE = [
    (1, "designed a databricks lakehouse on delta lake. unity catalog; pyspark pyspark", ["databricks", "dlt"], True), (2, "snow", ["photon"], False), (3, None, [], True), (4, "we migrated delta live tables and configured photon; databricks databricks databricks databricks databricks databricks", [], False),
]
BLOBS = [(1, "intro\nJob 1: A\nbody a\nJob 2: B\nbody b\nmore\n"), (2, "nothing"), (3, "Job 7: only\nx"), (4, "one\n====================\ntwo\n=========================\n \n")]
CLAIMS = [(1, "cut 40% and 5 teams", "40% and 7"), (2, "1M rows, 2M rows", "1M+ rows"), (3, "no numbers", ""), (4, "99.5% of 100%", "99.5%")]
LATEX = [(1, r"\begin{document}\begin{itemize}\item a\end{itemize}\end{document}"), (2, r"\begin{document}{"), (3, r"\begin{itemize}\begin{longtable}\end{longtable}"), (4, "")]
TITLES = [(1, "Databricks Engineer", ["snowpipe"], ""), (2, "Engineer", ["dax", "tableau"], ""), (3, "Cook", [], "AWS"), (4, "Cook", [], "none"), (5, "Analyst", ["mdm", "aws", "reltio"], "azure")]
POST_LINES = [(1, "- must know sql\n* nice\n- must know sql\nrequired: spark"), (2, "nothing"), (3, "• Required degree\nmust")]


def head(x: str, headers) -> str:
    return "coalesce(" + ", ".join(f"case when pos({x}, '{h}') > 0 then pos({x}, '{h}') + {len(h)} end" for h in headers) + ")"


def section_sql(name: str) -> str:
    every = [h for hs in L.SECTIONS.values() for h in hs]
    pos = lambda x, h: f"(case when regexp_matches({x}, '\\b{h}\\b') then length(regexp_extract({x}, '(?s)^(.*?)\\b{h}\\b', 1)) + 1 else 0 end)"
    start = "coalesce(" + ", ".join(f"case when {pos('low', h)} > 0 then {pos('low', h)} + {len(h)} end" for h in L.SECTIONS[name]) + ")"
    ends = "list_min(list_filter([" + ", ".join(pos("rest", h) for h in every) + "], lambda p: p > 0))"
    return f"select id, '{name}' as section, case when start is null then '' else trim(regexp_replace(substr(rest, 1, coalesce({ends} - 1, length(rest))), '^\\s+|\\s+$', '', 'g')) end as body from (select *, substr(low, start, length(low)) as rest from (select id, low, {start} as start from r))"


@query(lambda: "with " + texts_sql("v", "id, t", RESUMES) + ", r as (select id, lower(coalesce(t, '')) as low from v) " + " union all ".join(f"({section_sql(n)})" for n in L.SECTIONS))
def resume_sections(spark, d):
    rows = texts(spark, d, RESUMES, "id int, t string").select("id", F.coalesce("t", F.lit("")).alias("t"))
    wide = rows.select("id", *(P.section(F.col("t"), n).alias(n) for n in L.SECTIONS))
    return wide.unpivot(["id"], list(L.SECTIONS), "section", "body")


MONTH_SQL = "coalesce(nullif(list_position({months}, substr({g}, 1, 3)), 0), {other})"


@query(lambda: "with " + texts_sql("v", "id, t", SPANS) + ", g as (select id, " + ", ".join(f"lower(regexp_extract(coalesce(t, ''), {lit(L.DATE_SPAN)}, {k})) as g{k}" for k in range(1, 6)) + " from v), y as (select *, " + ", ".join(f"case when try_cast(g{k} as int) < 70 then g{k}::int + 2000 when try_cast(g{k} as int) < 100 then g{k}::int + 1900 else try_cast(g{k} as int) end as y{k}" for k in (2, 4)) + f""" from g)
select id, case when g2 = '' then 0.0 else least(greatest((case when g5 <> '' then {AS_OF[0]} else y4 end - y2) * 12 + case when g5 <> '' then {AS_OF[1]} else {MONTH_SQL.format(months=lit(L.MONTHS), g="g3", other=12)} end - {MONTH_SQL.format(months=lit(L.MONTHS), g="g1", other=1)} + 1, 1) / 12.0, 15.0) end::double as years from y""")
def tenure_years(spark, d):
    return texts(spark, d, SPANS, "id int, t string").select("id", P.tenure_years(F.coalesce("t", F.lit("")), AS_OF).alias("years"))


def evidence_sql() -> str:
    ms, gs = L.MARKERS["databricks"], L.ARCHITECT_MARKERS["databricks"]
    n = lambda m: f"len(regexp_extract_all(low, '\\b{m}\\b'))"
    acts = lambda m: f"len(regexp_extract_all(low, '\\b(?:{L.ACTIONS})\\b[^.;\\n]{{0,100}}\\b{m}\\b|\\b{m}\\b[^.;\\n]{{0,100}}\\b(?:{L.ACTIONS})\\b'))"
    has = lambda m: f"(list_contains(s, '{m}') or {n(m)} > 0)"
    add = lambda f: " + ".join(f"case when {has(m)} then {f(m)} else 0 end" for m in ms)
    return f"""with {texts_sql("v", "id, t, s, architect", EVIDENCE, "['photon']::varchar[]", "length(text) % 2 = 0")}, l as (select id, s, architect, lower(coalesce(t, '')) as low from v),
c as (select id, architect, ({add(lambda m: "1")}) as n, ({add(lambda m: f"least({n(m)}, 5)")}) as f, ({add(lambda m: f"least({acts(m)}, 3)")}) as a, ({" + ".join(f"case when {has(g)} then 1.0::double else 0 end" for g in gs)}) / {len(gs)} as share from l),
e as (select *, least(n / {len(ms)} * 55.0::double + least(f * 2.0::double, 25) + least(a * 4.0::double, 20), 100) as ev from c),
k as (select *, case when architect then case when share < 0.34 then 62 when share < 0.5 then 75 when share < 0.67 then 88 else 100 end when n <= 1 then 72 else 100 end::double as cap, case when architect then case when share < 0.34 then 14 when share < 0.5 then 8 when share < 0.67 then 3 else 0 end when n <= 1 then 8 else 0 end::double as penalty from e)
select id, floor(least(least(12 + ev * 0.76::double, 100), cap) * 100 + 0.5) / 100 as score, floor(ev * 100 + 0.5) / 100 as evidence, floor(least(n * 0.55::double + f * 0.12::double + a * 0.35::double, 10) * 100 + 0.5) / 100 as years, n::int as markers, cap, penalty from k"""


@query(evidence_sql)
def platform_assess(spark, d):
    rows = texts(spark, d, EVIDENCE, "id int, t string, s array<string>, architect boolean", F.array(F.lit("photon")), F.length("text") % 2 == 0)
    found = P.platform_evidence(F.col("t"), F.col("s"), "databricks", F.col("architect"))
    return rows.select("id", *(c.alias(k) for k, c in found.items()))


@query(lambda: "with " + texts_sql("v", "id, title, s, fallback", TITLES, "case when contains(text, ' the ') then ['dax', 'emr']::varchar[] else [] end", "case when contains(text, 'que') then 'AWS' else 'none' end") + ", p as (select id, fallback, unnest([" + ", ".join(f"{{'n': case when contains(lower(title), '{p}') then 4 else 0 end + len(list_intersect(s, {lit(ms)})), 'p': '{p}'}}" for p, ms in L.MARKERS.items()) + f"]) as x from v), b as (select id, fallback, max(x) filter (x.n > 0) as x from p group by 1, 2) select id, coalesce(x.p, case when list_contains({lit(list(L.MARKERS))}, lower(fallback)) then lower(fallback) end, '') as platform from b")
def target_platform(spark, d):
    skills = F.when(F.contains("text", F.lit(" the ")), F.array(F.lit("dax"), F.lit("emr"))).otherwise(F.array().cast("array<string>"))
    rows = texts(spark, d, TITLES, "id int, title string, s array<string>, fallback string", skills, F.when(F.contains("text", F.lit("que")), "AWS").otherwise("none"))
    return rows.select("id", P.target_platform(F.col("title"), F.col("s"), F.col("fallback")).alias("platform"))


@query("with " + texts_sql("v", "blob_id, t", BLOBS) + r""", s as (select blob_id, list_filter(string_split(regexp_replace(t, '(?im)^(Job\s+\d+\s*:)', chr(1) || '\1', 'g'), chr(1)), lambda p: regexp_matches(p, '(?i)^Job\s+\d+\s*:')) as ps from v)
select blob_id, (i - 1)::int as part, trim(regexp_replace(regexp_replace(ps[i], '^[^\n]*\n?', ''), '\s+$', '')) as text from s, range(1, len(ps) + 1) t(i)""")
def split_jobs_numbered(spark, d):
    return P.split_numbered(texts(spark, d, BLOBS, "blob_id int, text string"))


@query("with " + texts_sql("v", "blob_id, t", BLOBS) + r", s as (select blob_id, list_filter(list_transform(regexp_split_to_array(t, '={20,}'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') as ps from v) select blob_id, (i - 1)::int as part, ps[i] as text from s, range(1, len(ps) + 1) t(i)")
def split_jobs_separator(spark, d):
    return P.split_ruled(texts(spark, d, BLOBS, "blob_id int, text string"))


@query("with " + texts_sql("v", "id, t", POST_LINES) + r", l as (select id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '^\s*[-*•]+\s*', ''))), lambda x: regexp_matches(lower(x), 'must|required')) as ls from v) select id, array_to_string(list_filter(ls, lambda x, i: list_position(ls, x) = i), ' / ') as lines from l")
def requirement_lines(spark, d):
    return texts(spark, d, POST_LINES, "id int, t string").select("id", F.array_join(P.marked_lines(F.col("t"), ["must", "required"]), " / ").alias("lines"))


@query(lambda: "with " + texts_sql("v", "id, c, a", CLAIMS, "split_part(text, chr(10), 1)") + f", n as (select id, regexp_extract_all(c, '{L.NUMBER}') as c, regexp_extract_all(a, '{L.NUMBER}') as a from v) select id, array_to_string(list_filter(c, lambda x: not list_contains(list_concat(a, list_transform(a, lambda y: rtrim(y, '+'))), x)), ',') as unapproved from n")
def numeric_claims(spark, d):
    return texts(spark, d, CLAIMS, "id int, c string, a string", F.split_part("text", F.lit("\n"), F.lit(1))).select("id", F.array_join(P.unapproved_numbers(F.col("c"), F.col("a")), ",").alias("unapproved"))


def counts(s: str) -> str:
    return f"((length(t) - length(replace(t, {lit(s)}, ''))) // {len(s)})"


@query(lambda: "with " + texts_sql("v", "id, t", LATEX) + " select id, array_to_string(list_filter([" + ", ".join([f"case when {counts('{')} <> {counts('}')} then 'Unbalanced LaTeX braces.' end", *(f"case when {counts(chr(92) + 'begin{' + e + '}')} <> {counts(chr(92) + 'end{' + e + '}')} then 'Unbalanced {e} environments.' end" for e in ("itemize", "longtable")), *(f"case when not contains(t, {lit(chr(92) + w + '{document}')}) then {lit('Missing ' + chr(92) + w + '{document}.')} end" for w in ("begin", "end"))]) + "], lambda e: e is not null), ' ') as errors from v")
def latex_balance(spark, d):
    return texts(spark, d, LATEX, "id int, t string").select("id", F.array_join(P.latex_errors(F.col("t")), " ").alias("errors"))


@query("select conv_id, array_to_string(list_filter(rs, lambda x, i: list_position(rs, x) = i and len(list_filter(rs, lambda y: y = x)) > 1), ',') as repeated from (select conv_id, list(role order by turn) as rs from conversations group by 1)")
def repeated_values(spark, d):
    roles = read(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("rs"))
    return roles.select("conv_id", F.array_join(P.repeated_values(F.col("rs")), ",").alias("repeated"))


@query("select doc_id, lower(lang) as lang, lower(source) as source from documents qualify row_number() over (partition by lower(lang), lower(source) order by doc_id) = 1")
def composite_dedupe(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.lower("lang").alias("lang"), F.lower("source").alias("source"))
    return first_by(rows, ["lang", "source"], F.col("doc_id"))


@query("select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as squeezed, substr(regexp_replace(text, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 80) as file_name from documents")
def text_cleanup(spark, d):
    return read(spark, d, "documents").select("doc_id", T.squeeze(F.col("text")).alias("squeezed"), T.safe_file_name(F.col("text")).alias("file_name"))


@query("""with x as (select l_orderkey, l_linenumber, (l_partkey % 101)::double as compat, l_quantity * 2 as c1, (l_suppkey % 101)::double as c2, case when l_orderkey % 7 = 0 then '' else l_returnflag end as own, l_linestatus as asked, (l_orderkey % 3) * 31.5::double as s1, (l_linenumber % 4) * 47.0::double as s2 from lineitem)
select l_orderkey, l_linenumber, case when own = '' then 35 else floor(least(greatest(compat * (0.85::double + 0.15::double * least(greatest((c1 + c2) / 200, 0.55), 1)), 0), 100) * 100 + 0.5) / 100 end::double as role_score, case when own = '' then 50 when replace(own, 'N', 'O') = asked then floor((80 + 20 * least((c1 + c2) / 100, 1)) * 100 + 0.5) / 100 when s1 + s2 > 0 then floor(least(greatest((s1 + s2) / 2, 30), 70) * 100 + 0.5) / 100 else 35 end::double as domain_score from x""")
def role_and_domain_scores(spark, d):
    c = lambda e: F.expr(e).cast("double")
    x = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", c("l_partkey % 101").alias("compat"), (F.col("l_quantity") * 2).alias("c1"), c("l_suppkey % 101").alias("c2"), F.when(F.col("l_orderkey") % 7 == 0, "").otherwise(F.replace("l_returnflag", F.lit("N"), F.lit("O"))).alias("own"), F.col("l_linestatus").alias("asked"), c("l_orderkey % 3 * 31.5").alias("s1"), c("l_linenumber % 4 * 47.0").alias("s2"))
    compat = F.when(F.col("own") != "", F.col("compat"))
    return x.select("l_orderkey", "l_linenumber", P.role_score(compat, F.col("c1"), F.col("c2")).alias("role_score"), P.domain_score(F.col("own"), F.col("asked"), F.col("c1"), F.col("c2"), F.col("s1"), F.col("s2")).alias("domain_score"))
