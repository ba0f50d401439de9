"""Queries over inline postings and their scores, with SQL of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import postings as P
from .catalog import lit, query, read, texts, texts_sql, values

TEXTS = [
    (1, "Overview\nwe build\nRequired Skills:\nspark\nsql\nQualifications\nmore\nNice-to-have\nkafka\nDuties\nx\nRequirements\nlate"), (2, "no headers"), (3, "REQUIREMENTS —\na  b\n\nDice Job Match Score 5\nkeep   this\nSimilar Jobs\ngone"), (4, None),
    (5, "responsibilities\n" + "long text " * 30),
]
YEARS = [(1, "5 years here, 7+ years there"), (2, "2015 - 2018 and 2017 to present"), (3, "2020 - 2019"), (4, None), (5, "2.5 years")]
CERTS = [(1, ["aws certified solutions architect"], ["aws solutions architect", "azure fundamentals", "pmp"]), (2, [], ["a b"]), (3, ["pmp"], [])]
ROLES = [(1, "bi dev", "data eng"), (2, "data eng", "bi dev"), (3, "ml eng", "data eng"), (4, "cook", "data eng"), (5, "", "data eng"), (6, None, "x"), (7, "etl dev", "bi dev")]
COMPAT = [("data eng", "bi dev", 55.0), ("bi dev", "data eng", 45.0), ("etl dev", "bi dev", 70.0)]
FAMILIES = [("data eng", "eng"), ("ml eng", "eng"), ("bi dev", "bi"), ("cook", "kitchen")]
DOCS = [(1, "senior data engineer", "spark and sql, also kafka"), (2, "cook", "sql"), (3, "bi developer", "dashboards, sql; java"), (4, "", "")]
TERMS = [
    ("data engineer", 0, "title", "data engineer"), ("data engineer", 0, "required", "spark"), ("data engineer", 0, "required", "sql"), ("data engineer", 0, "preferred", "kafka"), ("data engineer", 0, "excluded", "java"),
    ("bi developer", 1, "title", "bi developer"), ("bi developer", 1, "required", "sql"), ("bi developer", 1, "required", "dax"), ("bi developer", 1, "keyword", "dashboards"), ("bi developer", 1, "excluded", "java"),
]
JUDGED = [("that", 1, 10.0, True), ("que", 1, 10.0, True), ("the", 2, 5.0, False), ("er", 3, 1.0, False)]
EVIDENCE = [("a", "spark", 1, 10.0, True, 84.0), ("a", "sql", 2, 5.0, False, 26.0), ("a", "delta", 1, 10.0, True, 0.0), ("b", "x", 3, 0.1, False, 70.0)]


def clean_sql(x: str = "t") -> str:
    low = f"lower({x})"
    stop = "list_min(list_filter([" + ", ".join(f"instr({low}, {lit(s)})" for s in L.PORTAL_STOPS) + "], lambda p: p > 0))"
    noise = " or ".join(f"contains(lower(l), {lit(n)})" for n in L.PORTAL_NOISE)
    return f"array_to_string(list_filter(list_transform(string_split(substr({x}, 1, coalesce({stop} - 1, length({x}))), chr(10)), lambda l: trim(regexp_replace(l, '\\s+', ' ', 'g'))), lambda l: l <> '' and not ({noise})), chr(10))"


@query(lambda: "with " + texts_sql("v", "id, t0", TEXTS) + f", c as (select id, coalesce(t0, '') as t from v) select id, {clean_sql()} as body from c")
def portal_cleaning(spark, d):
    return texts(spark, d, TEXTS, "id int, t string").select("id", P.cleaned(F.col("t")).alias("body"))


KEY_SQL = "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(x)), '[:\\-–—]+$', ''), '[^a-z0-9\\s'']', ' ', 'g'), '\\s+', ' ', 'g'))"


def sections_sql() -> str:
    key = lambda h: " ".join(h.replace("-", " ").split())
    part = lambda n: f"""select id, '{n}' as section, case when s is null then '' else regexp_replace(array_to_string(ls[s + 1:coalesce(e, len(ls) + 1) - 1], chr(10)), '^\\s+|\\s+$', '', 'g') end as body from (
      select *, list_min(list_filter(range(1, len(ks) + 1), lambda i: i > s and list_contains({lit([key(h) for m, hs in L.POSTING_SECTIONS.items() for h in hs if m != n])}, ks[i]))) as e from (select *, list_min(list_filter(range(1, len(ks) + 1), lambda i: list_contains({lit([key(h) for h in L.POSTING_SECTIONS[n]])}, ks[i]))) as s from k))"""  # noqa: E731
    return "with " + texts_sql("v", "id, t0", TEXTS) + f", l as (select id, string_split(coalesce(t0, ''), chr(10)) as ls from v), k as (select id, ls, list_transform(ls, lambda x: {KEY_SQL}) as ks from l) " + " union all ".join(part(n) for n in L.POSTING_SECTIONS)


@query(sections_sql)
def jd_sections(spark, d):
    found = texts(spark, d, TEXTS, "id int, t string").select("id", P.sections(F.col("t"), L.POSTING_SECTIONS).alias("s"))
    wide = found.select("id", *(F.coalesce(F.try_element_at("s", F.lit(n)), F.lit("")).alias(n) for n in L.POSTING_SECTIONS))
    return wide.unpivot(["id"], list(L.POSTING_SECTIONS), "section", "body")


@query(lambda: "with " + texts_sql("v", "id, t", TEXTS) + f" select id, length(coalesce(t, '')) >= 250 and ({' or '.join(f'contains(lower(coalesce(t, {lit(chr(32))})), {lit(s)})' for s in L.POSTING_SIGNALS)}) as posting from v")
def looks_like_posting(spark, d):
    return texts(spark, d, TEXTS, "id int, t string").select("id", P.looks_like_posting(F.col("t")).alias("posting"))


@query("with " + texts_sql("v", "id, t0", YEARS) + r""", r as (select id, lower(coalesce(t0, '')) as t from v),
e as (select id, list_max(list_transform(regexp_extract_all(t, '(\d+(?:\.\d+)?)\s*\+?\s*years?', 1), lambda x: x::double)) as told, regexp_extract_all(t, '((?:19|20)\d{2})\s*(?:-|–|—|to)\s*((?:19|20)\d{2}|present|current)', 1) as a, regexp_extract_all(t, '((?:19|20)\d{2})\s*(?:-|–|—|to)\s*((?:19|20)\d{2}|present|current)', 2) as b from r)
select id, coalesce(told, coalesce(list_sum(list_transform(range(1, len(a) + 1), lambda i: greatest(coalesce(try_cast(b[i] as int), 2025) - a[i]::int, 0))), 0)::double) as years from e""")
def total_years(spark, d):
    return texts(spark, d, YEARS, "id int, t string").select("id", P.total_years(F.col("t"), 2025).alias("years"))


@query("with " + values("v0", "id, own, asked", CERTS) + """, v as (select * from v0 union all select doc_id + 1000, [lower(split_part(text, '.', 1))]::varchar[], ['that the', 'und die von', 'er and ing']::varchar[] from documents), t as (select id, array_to_string(own, ' ') as o, asked from v), u as (select id, o, unnest(asked) as c from t),
h as (select id, c, contains(o, c) or coalesce((select avg(contains(o, w)::int) from (select distinct unnest(string_split(c, ' ')) as w) where length(w) >= 3), 0) >= 0.6 as has from u)
select v.id, coalesce(string_agg(c, ',' order by c) filter (has), '') as matched, coalesce(string_agg(c, ',' order by c) filter (not has), '') as missing from v left join h on h.id = v.id group by v.id""")
def certifications_match(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id") + 1000, F.array(F.lower(F.split_part("text", F.lit("."), F.lit(1)))), F.array(*map(F.lit, ["that the", "und die von", "er and ing"])))
    rows = spark.createDataFrame(CERTS, "id int, own array<string>, asked array<string>").union(docs)
    return rows.select("id", *(F.array_join(c, ",").alias(k) for k, c in P.certifications(F.col("own"), F.col("asked")).items()))


@query("with " + values("p0", "id, resume_role, job_role", ROLES) + ", p as (select * from p0 union all select doc_id + 1000, case lang when 'en' then 'data eng' when 'de' then 'bi dev' when 'fr' then 'ml eng' when 'es' then 'cook' end, case when contains(text, ' the ') then 'data eng' when contains(text, ' que ') then 'etl dev' else 'bi dev' end from documents), " + values("c", "j, r, score", COMPAT) + ", " + values("f", "role, family", FAMILIES) + """
select id, case when coalesce(resume_role, '') <> '' and coalesce(job_role, '') <> '' then coalesce(a.score, b.score, case when x.family = y.family then 65 else 30 end)::double end as compatibility
from p left join c a on a.j = job_role and a.r = resume_role left join c b on b.j = resume_role and b.r = job_role left join f x on x.role = job_role left join f y on y.role = resume_role""")
def role_compatibility(spark, d):
    own = F.when(F.col("lang") == "en", "data eng").when(F.col("lang") == "de", "bi dev").when(F.col("lang") == "fr", "ml eng").when(F.col("lang") == "es", "cook")
    asked = F.when(F.contains("text", F.lit(" the ")), "data eng").when(F.contains("text", F.lit(" que ")), "etl dev").otherwise("bi dev")
    docs = read(spark, d, "documents").select(F.col("doc_id") + 1000, own, asked)
    return P.compatible_roles(spark.createDataFrame(ROLES, "id int, resume_role string, job_role string").union(docs), spark.createDataFrame(COMPAT, "job_role string, resume_role string, score double"), spark.createDataFrame(FAMILIES, "role string, family string"))


@query("with " + texts_sql("v", "id, body, title", [(i, b, t) for i, t, b in DOCS], "split_part(text, ' ', 1)") + ", " + values("t", "role, ord, kind, term", TERMS) + r""", n as (select role, kind, count(*) as size from t group by 1, 2),
p as (select id, ' ' || regexp_replace(title, '[^\w]+', ' ', 'g') || ' ' as title, ' ' || regexp_replace(body, '[^\w]+', ' ', 'g') || ' ' as body from v),
h as (select id, role, ord, kind, count(*) as k from p join t on contains(case when kind = 'title' then title else body end, ' ' || term || ' ') group by 1, 2, 3, 4),
s as (select id, role, ord, least(greatest(sum(case kind when 'title' then 55 when 'excluded' then -least(k * 20, 40) when 'required' then 25.0 * k / size else 10.0 * k / size end), 0), 100)::double as s from h join n using (role, kind) group by 1, 2, 3)
select id, role, floor(s * 100 + 0.5) / 100 as score from s qualify row_number() over (partition by id order by s desc, ord) = 1""")
def role_classify(spark, d):
    return P.role_votes(texts(spark, d, [(i, b, t) for i, t, b in DOCS], "id int, text string, title string", F.lower(F.split_part("text", F.lit(" "), F.lit(1)))), spark.createDataFrame(TERMS, "role string, ord int, kind string, term string"))


@query("with " + values("v0", "id, skill, tier, weight, critical, evidence", EVIDENCE) + ", " + values("k", "skill, tier, weight, critical", JUDGED) + """, v as (select * from v0 union all select doc_id::varchar, skill, tier, weight, critical, least(len(string_split(text, skill)) - 1, 100)::double from documents, k where text <> ''), w as (select *, greatest(weight, 0.5)::double * case tier when 1 then 1.75 when 2 then 1.3 else 1 end * case when critical then 1.25 else 1 end * 1.15::double as w from v)
select id, floor(sum(w * evidence::double) / sum(w) * 100 + 0.5) / 100 as coverage, coalesce(string_agg(skill, ',' order by skill) filter (evidence >= 68), '') as demonstrated, coalesce(string_agg(skill, ',' order by skill) filter (evidence > 0 and evidence < 68), '') as listed, coalesce(string_agg(skill, ',' order by skill) filter (evidence <= 0 and tier = 1), '') as missing_critical from w group by id""")
def weighted_coverage(spark, d):
    asked = F.inline(F.array(*(F.struct(F.lit(s).alias("skill"), F.lit(t).alias("tier"), F.lit(w).alias("weight"), F.lit(c).alias("critical")) for s, t, w, c in JUDGED)))
    docs = read(spark, d, "documents").where("text <> ''").select(F.col("doc_id").cast("string"), "text", asked)
    docs = docs.select("doc_id", "skill", "tier", "weight", "critical", F.least(F.size(F.split("text", F.col("skill"))) - 1, F.lit(100)).cast("double"))
    return P.weighted_coverage(spark.createDataFrame(EVIDENCE, "id string, skill string, tier int, weight double, critical boolean, evidence double").union(docs), True)


X = "with x as (select l_orderkey, l_linenumber, (l_partkey % 121)::double as raw, l_suppkey % 12 as matched, l_linenumber - 1 as missing, l_quantity / 5 as years, (l_orderkey % 9)::double as asked, l_returnflag <> 'N' as targeted, (l_partkey % 101)::double as platform, l_linestatus = 'O' as architect, l_suppkey % 5 as markers, l_suppkey % 4 as header, l_partkey % 6 as worked, l_orderkey % 4 as acted, l_partkey % 9 = 0 as measured, l_orderkey % 3 = 0 as listed, l_orderkey % 2 = 0 as inferred, case when l_partkey % 5 = 0 then l_quantity * 2 else 0 end as project from lineitem) "


def scored(spark, d):
    c = lambda e: F.expr(e)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", c("cast(l_partkey % 121 as double) as raw"), c("l_suppkey % 12 as matched"), c("l_linenumber - 1 as missing"), c("l_quantity / 5 as years"), c("cast(l_orderkey % 9 as double) as asked"), c("l_returnflag <> 'N' as targeted"), c("cast(l_partkey % 101 as double) as platform"), c("l_linestatus = 'O' as architect"), c("l_suppkey % 5 as markers"), c("l_suppkey % 4 as header"), c("l_partkey % 6 as worked"), c("l_orderkey % 4 as acted"), c("l_partkey % 9 = 0 as measured"), c("l_orderkey % 3 = 0 as listed"), c("l_orderkey % 2 = 0 as inferred"), c("case when l_partkey % 5 = 0 then l_quantity * 2 else 0 end as project"))


@query(X + """select l_orderkey, l_linenumber, floor(least(least(raw, 100) * 0.48::double + 34.0::double * matched / greatest(matched + missing, 1) + 6.0::double * ln(1 + matched), 82) * 100 + 0.5) / 100 as bm25,
floor(case when targeted then case when asked > 0 then least(22 + 78.0::double * least(years / asked, 1), 100) else least(22 + 24.0::double * sqrt(years), 94) end when asked <= 0 then least(35 + 8.0::double * years, 95) else least(100.0::double * (years / asked), 100) end * 100 + 0.5) / 100 as experience,
case when not targeted then 100 else least(case when platform < 35 then 55 when platform < 50 then 68 when platform < 65 then 82 else 100 end, case when architect and (platform < 72 or markers < 3) then 78 else 100 end) end::double as cap,
case when not targeted then 0 else greatest(case when platform < 35 then 15 when platform < 50 then 9 when platform < 65 then 4 else 0 end, case when architect and (platform < 72 or markers < 3) then 6 else 0 end) end::double as penalty from x""")
def decision_adjustments(spark, d):
    c = P.adjusted(*(F.col(x) for x in ("raw", "matched", "missing", "years", "asked", "targeted", "platform", "architect", "markers")))
    return scored(spark, d).select("l_orderkey", "l_linenumber", *(v.alias(k) for k, v in c.items()))


@query(X + """, b as (select *, greatest(case when listed or header > 0 then 26 else 0 end, case when worked > 0 then 43 + least(worked * 4, 18) else 0 end, case when acted > 0 then 62 + least(acted * 7, 20) else 0 end, case when measured then 84 else 0 end)::double as s, listed or header + worked > 0 as shown from x)
select l_orderkey, l_linenumber, floor(case when inferred and not shown then 14 when not shown and project <= 0 then 0 else least(case when project > 0 then greatest(s, 0.35::double * s + 0.65::double * project) else s end, 100) end * 100 + 0.5) / 100 as evidence from b""")
def decision_evidence(spark, d):
    from ..functions.text import round2

    e = P.skill_evidence(*(F.col(x) for x in ("header", "worked", "acted", "measured", "listed", "inferred", "project")))
    return scored(spark, d).select("l_orderkey", "l_linenumber", round2(e).alias("evidence"))


JOBS = [(1, "Data Engineer", "ACME", "", "http://x/1", " body\n"), (2, None, None, "Oslo", None, None)]
STARTED = [(1, "x\nJOB START\none\nJOB END\nbetween\nJOB START\ntwo\nmore"), (2, "none"), (3, "JOB START\n \nJOB END"), (4, None)]
PATCHES = [(1, ["a", "b", "A  "]), (2, ["a"] * 3), (3, ["x", "y", "z", "w"]), (4, ["q" * 451, "b", "c", "d"]), (5, [])]
RESULTS = [(1, "We reduced load time by 45 hours. Improved nothing; processed 3 tb daily\nsaved 10 days and cut 5 days"), (2, "45% cut"), (3, ""), (4, "increased 2 million rows. increased 2 million rows")]


@query("with " + values("v0", "n, title, company, location, url, body", JOBS) + r""", v as (select * from v0 union all select doc_id + 1000, split_part(text, ' ', 1), source, lang, '', text from documents) select n, repeat('=', 100) || chr(10) || 'JOB ' || n || chr(10) || 'Job Title: ' || coalesce(title, '') || chr(10) || case when coalesce(company, '') <> '' then 'Company: ' || company || chr(10) else '' end || case when coalesce(location, '') <> '' then 'Location: ' || location || chr(10) else '' end
|| case when coalesce(url, '') <> '' then 'Job URL: ' || url || chr(10) else '' end || repeat('-', 100) || chr(10) || regexp_replace(coalesce(body, ''), '^\s+|\s+$', '', 'g') || chr(10) || chr(10) as rendered from v""")
def render_postings(spark, d):
    from ..sources.sinks import rendered

    docs = read(spark, d, "documents").select(F.col("doc_id") + 1000, F.split_part("text", F.lit(" "), F.lit(1)), "source", "lang", F.lit(""), "text")
    rows = spark.createDataFrame(JOBS, "n int, title string, company string, location string, url string, body string").union(docs)
    return rows.select("n", rendered(*map(F.col, rows.columns)).alias("rendered"))


@query(lambda: "with " + texts_sql("v", "blob_id, t", STARTED) + r""", s as (select blob_id, string_split(regexp_replace(regexp_replace(coalesce(t, ''), '(?im)^[^\S\n]*JOB START[^\n]*$', chr(1), 'g'), '(?im)^[^\S\n]*JOB END[^\n]*$', chr(2), 'g'), chr(1))[2:] as ps from v),
b as (select blob_id, list_filter(list_transform(ps, lambda p: regexp_replace(string_split(p, chr(2))[1], '^\s+|\s+$', '', 'g')), lambda p: p <> '') as ps from s) select blob_id, (i - 1)::int as part, ps[i] as text from b, range(1, len(ps) + 1) t(i)""")
def split_jobs_structured(spark, d):
    return P.split_structured(texts(spark, d, STARTED, "blob_id int, text string"))


@query("with " + values("v0", "id, ls", PATCHES) + r""", v as (select * from v0 union all select doc_id + 1000, string_split(text, chr(10)) from documents), k as (select id, ls, list_transform(ls, lambda x: lower(trim(regexp_replace(x, '\s+', ' ', 'g')))) as ks from v)
select id, array_to_string(list_filter([case when len(ls) not between 4 and 7 then 'summary: expected 4 to 7 lines, got ' || len(ls) end, case when len(list_filter(ls, lambda x: length(x) > 450)) > 0 then 'summary: a line is longer than 450 characters' end, case when len(ks) > len(list_distinct(ks)) then 'summary: a line is repeated' end], lambda e: e is not null), ' | ') as errors from k""")
def patch_validation(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id") + 1000, F.split("text", "\n"))
    return spark.createDataFrame(PATCHES, "id int, ls array<string>").union(docs).select("id", F.array_join(P.list_errors(F.col("ls"), "summary", 4, 7), " | ").alias("errors"))


@query(lambda: "with " + texts_sql("v", "id, t", RESULTS) + f", r as (select id, list_transform(regexp_extract_all(t, {lit(L.ACHIEVED)}), lambda x: trim(x)) as rs from v), u as (select id, list_filter(rs, lambda x, i: list_position(rs, x) = i) as rs from r) select id, array_to_string(rs[1:10], ' | ') as found, least(len(rs) * 22.0, 100)::double as score from u")
def achievements(spark, d):
    from ..operators.profiles import achievements as told

    rows = texts(spark, d, RESULTS, "id int, t string").select("id", told(F.col("t")).alias("found"))
    return rows.select("id", F.array_join("found", " | ").alias("found"), F.least(F.size("found") * 22.0, F.lit(100.0)).alias("score"))
