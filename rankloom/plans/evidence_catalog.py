"""Queries over evidence of experience and posting fields, with SQL of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import evidence as E
from ..operators import reports, skills
from .catalog import MENTIONS, WORDS, lit, query, read, texts, texts_sql, values

ROLES = ["data engineer", "Databricks Architect", "data analyst", "etl developer", "mdm developer", "cook", ""]
TARGETS = ["that", "the", "und"]
REQUIRED = ["sql", "spark", "airflow"]
HELD = [
    (1, 8.0, {"Spark": 3.5, "sql": 9.0}, ["spark", "sql"], ["SQL ", "spark", ""]), (2, 0.0, {"spark": 2.25}, ["spark"], ["spark"]), (3, 6.0, {"java": 4.0}, ["java", "sql"], ["sql", "spark", "scala", "dbt"]),
    (4, 6.0, {}, ["sql", "spark"], ["sql", "spark"]), (5, 7.5, {"sql": 1.0}, ["sql"], []), (6, 5.0, {}, [], ["x"]),
]
ACHIEVED = [
    (1, "We reduced spark job time by 40% overall. Then improved nothing. We cut costs 3x for kafka and streaming on docker", ["spark", " Kafka"]), (2, "increased sales by 12%", ["spark"]), (3, None, ["x"]), (4, "processed 5 tb daily; processed 5 tb daily; rbac and ci/cd for SQL", ["sql", "daily", "rbac"]), (5, "", []),
]
WANTED = [(1, "must know C++ and sql", "nice: python", ["c++"]), (2, "sql", "python, C++", ["c++", "cpp"]), (3, "", "", ["java"]), (4, "javascript", "java here", ["java"]), (5, None, "go", ["go"]), (6, "ci/cd", "ci/cd", ["CI/CD"])]
FIELDS = [
    (1, "Apply now\nhttps://x.example/a\nSenior Data Engineer\nJob ID: ab-12\nhttps://www.dice.com/jobs/1?x=2)."), (2, "job # 77 at https://site.example/p,"), (3, None), (4, "\n\n  Skills: sql\nPosted today\n ab\nTitle of it "), (5, "https://Indeed.com/v requisition id: R_9"),
]


def r2(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5) / 100"


def family_sql() -> str:
    roles = values("f", "role, family", list(L.ROLE_FAMILIES.items()))
    scores = values("t", "a, b, s", [(*k, v) for k, v in L.FAMILY_SCORES.items()])
    return f"""with {roles}, {scores}, x as (select l_orderkey, l_linenumber, lower(({lit(ROLES)})[(l_partkey % 7 + 1)::int]) as own, lower(({lit(ROLES)})[(l_suppkey % 7 + 1)::int]) as asked, (l_partkey % 101)::double as had from lineitem)
select l_orderkey, l_linenumber, case when own <> '' and own = asked then 100 else {r2("greatest(had, coalesce(t.s::double, case when own <> '' and asked <> '' then 35 else 50 end))")} end::double as score
from x left join f p on p.role = own left join f q on q.role = asked left join t on t.a = coalesce(p.family, own) and t.b = coalesce(q.family, asked)"""


@query(family_sql)
def role_family(spark, d):
    pick = lambda c: F.element_at(F.array(*map(F.lit, ROLES)), (F.col(c) % 7 + 1).cast("int"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", E.role_family_score(pick("l_partkey"), pick("l_suppkey"), (F.col("l_partkey") % 101).cast("double")).alias("score"))


@query("""with x as (select l_orderkey, sum(l_quantity)::double % 17 as total, count(*) as k, sum(l_linenumber)::double as e, sum(l_suppkey % 5)::double as p, sum(l_partkey % 3)::double as s from lineitem group by 1)
select l_orderkey, case when total < 2 then 'Junior' when total < 5 then 'Mid' when total < 8 then 'Senior' when total < 12 then 'Lead' else 'Architect' end as seniority,
least(case when total = 0 then 1 else total end, floor((e * 2 + p + s) / 10 * case when total = 0 then 1 else total end * 10 + 0.5) / 10)::double as years, (50 + case when total > 0 then 20 else 0 end + case when k > 0 then 20 else 0 end + case when k > 10 then 10 else 0 end)::int as confidence from x""")
def experience_profile(spark, d):
    add = lambda e: F.sum(F.expr(e)).cast("double")
    x = read(spark, d, "lineitem").groupBy("l_orderkey").agg((add("l_quantity") % 17).alias("total"), F.count("*").alias("k"), add("l_linenumber").alias("e"), add("l_suppkey % 5").alias("p"), add("l_partkey % 3").alias("s"))
    return x.select("l_orderkey", E.seniority(F.col("total")).alias("seniority"), E.skill_years(*map(F.col, ("total", "e", "p", "s"))).alias("years"), E.experience_confidence(F.col("total"), F.col("k")).cast("int").alias("confidence"))


@query(lambda: "with " + values("h0", "id, skill, years", [(i, k, v) for i, _, m, *_ in HELD for k, v in m.items()]) + ", " + values("v0", "id, total, own, target", [(i, t, o, g) for i, t, _, o, g in HELD]) + f""",
k as (select doc_id + 1000 as id, n_chars, list_filter({lit(TARGETS)}, lambda w: contains(coalesce(text, ''), ' ' || w || ' ')) as own from documents), h as (select * from h0 union all select id, unnest(own), (n_chars % 7 + 0.5)::double from k where n_chars % 4 > 0),
v as (select id, total::double as total, own, target from v0 union all select id, (n_chars % 17)::double, own, ['that', 'der']::varchar[] from k),
w as (select id, total::double as total, list_transform(own, lambda x: lower(trim(x))) as own, list_distinct(list_filter(list_transform(target, lambda x: lower(trim(x))), lambda x: x <> '')) as target from v),
b as (select w.id, max(years)::double as best from w join h on h.id = w.id and list_contains(target, lower(trim(skill))) group by 1)
select w.id, case when len(target) = 0 then total when best is not null then {r2("least(case when total > 0 then total else best end, best)")} else {r2("total * least(0.75::double, len(list_intersect(own, target)) / greatest(len(target), 1)::double)")} end::double as years from w left join b using (id)""")
def relevant_years(spark, d):
    n, own = F.col("n_chars"), F.filter(F.array(*map(F.lit, TARGETS)), lambda w: F.contains(F.coalesce("text", F.lit("")), F.concat(F.lit(" "), w, F.lit(" "))))
    told = F.when(n % 4 > 0, F.map_from_entries(F.transform(own, lambda w: F.struct(w.alias("key"), (n % 7 + 0.5).cast("double").alias("value"))))).otherwise(F.create_map().cast("map<string,double>"))
    docs = read(spark, d, "documents").select(F.col("doc_id") + 1000, (n % 17).cast("double"), told, own, F.array(F.lit("that"), F.lit("der")))
    rows = spark.createDataFrame(HELD, "id int, total double, years map<string,double>, own array<string>, target array<string>").union(docs)
    return rows.select("id", E.relevant_years(*map(F.col, ("total", "years", "own", "target"))).alias("years"))


def depth_sql() -> str:
    n = lambda s: f"len(regexp_extract_all(low, '\\b{s}\\b'))"
    acted = lambda s: f"regexp_matches(low, '\\b(?:{L.DEPTH_ACTIONS})\\b[^.;\\n]{{0,110}}\\b{s}\\b|\\b{s}\\b[^.;\\n]{{0,110}}\\b(?:{L.DEPTH_ACTIONS})\\b')"
    metric = lambda s: f"regexp_matches(low, '\\b{s}\\b[^.;\\n]{{0,130}}\\b\\d+(?:\\.\\d+)?\\s*(?:{L.UNITS})\\b')"
    rows = " union all ".join(f"select doc_id, '{s}' as skill, {n(s)} as n, {metric(s)} as metric, ({acted(s)} or {metric(s)} or {n(s)} >= 3) as strong from l" for s in TARGETS)
    points = "case when strong then least(8, 3 + n * 0.8::double + case when metric then 2 else 0 end) when n > 0 then least(2, 0.6::double + n * 0.35::double) else 0 end::double"
    return f"""with l as (select doc_id, regexp_replace(lower(coalesce(text, '')), '[\\x{{aa}}\\x{{b5}}\\x{{ba}}\\x{{c0}}-\\x{{d6}}\\x{{d8}}-\\x{{f6}}\\x{{f8}}-\\x{{2af}}]', 'z', 'g') as low from documents), r as ({rows})
select doc_id, {r2(f"least(100, sum({points} order by skill) * 100 / {len(TARGETS) * 6.0}::double)")} as score, coalesce(string_agg(skill, ',' order by skill) filter (strong), '') as strong, coalesce(string_agg(skill, ',' order by skill) filter (not strong and n > 0), '') as weak from r group by 1"""


@query(depth_sql)
def evidence_depth(spark, d):
    found = read(spark, d, "documents").select("doc_id", E.evidence_depth(F.col("text"), TARGETS).alias("found"))
    return found.select("doc_id", "found.score", *(F.array_join(f"found.{k}", ",").alias(k) for k in ("strong", "weak")))


@query("""with x as (select l_orderkey, l_suppkey % 4 as tier, (l_partkey % 5 + 1)::double / 2 as weight, l_linenumber % 2 = 1 as required, l_returnflag = 'R' as held, l_quantity::double as q from lineitem),
g as (select l_orderkey, sum(weight * case when required then 1.35::double else 1 end) as a, sum(case when held then weight * case when required then 1.35::double else 1 end else 0 end) as o, count(*) filter (not held and required and tier = 1) as c, avg(q) as q from x group by 1)
select l_orderkey, floor(case when a > 0 then o * 100 / a else 72 end * 100 + 0.5) / 100 as tiered, least(18, c * 6)::double as critical_penalty from g""")
def recruiter_alignment(spark, d):
    e = F.expr
    rows = read(spark, d, "lineitem").select("l_orderkey", e("l_suppkey % 4").alias("tier"), e("(l_partkey % 5 + 1) / 2").cast("double").alias("weight"), e("l_linenumber % 2 = 1").alias("required"), e("l_returnflag = 'R'").alias("held"))
    return E.aligned_skills(rows, ["l_orderkey"])


def contains_sql(text: str) -> str:
    """An alias of `aliases` stands in the text between characters that aren't of a word."""
    bare = "list_reduce(list_prepend('', list_transform(string_split(lower(a), ''), lambda c: case when regexp_matches(c, '[a-z0-9]') then c else '\\' || c end)), lambda p, q: p || q)"
    return f"len(list_filter(aliases, lambda a: regexp_matches(lower(coalesce({text}, '')), '(?:^|[^\\pL\\pN_])' || {bare} || '(?:$|[^\\pL\\pN_])'))) > 0"


@query(lambda: "with " + values("v0", "id, req, pref, aliases", WANTED) + f", v as (select * from v0 union all select doc_id + 1000, split_part(text, chr(10), 1), text, ['that', 'und']::varchar[] from documents) select id, case when {contains_sql('req')} then 'required' when {contains_sql('pref')} then 'preferred' else 'required' end as kind from v")
def required_or_preferred(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id") + 1000, F.split_part("text", F.lit("\n"), F.lit(1)), "text", F.array(F.lit("that"), F.lit("und")))
    rows = spark.createDataFrame(WANTED, "id int, req string, pref string, aliases array<string>").union(docs)
    return rows.select("id", E.wanted_kind(F.col("req"), F.col("pref"), F.col("aliases")).alias("kind"))


def fields_sql(rows: str, key: str) -> str:
    portal = r"(?i)https?://(?:www\.)?(?:dice\.com|indeed\.com|linkedin\.com|ziprecruiter\.com)/[^\s<>\"]+"
    lines = "list_filter(list_transform(string_split_regex(text, '\\r\\n|[\\n\\x0b\\x0c\\r\\x{85}\\x{2028}\\x{2029}]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
    title = f"list_filter({lines}[1:25], lambda x: length(x) between 3 and 160 and len(list_filter({lit(L.TITLE_IGNORED)}, lambda p: starts_with(lower(x), p))) = 0)[1]"
    return f"""select {key}, coalesce(regexp_replace(coalesce(nullif(regexp_extract(text, '{portal}'), ''), regexp_extract(text, '(?i)https?://[^\\s<>\\"]+')), '[.,);\\]]+$', ''), '') as url,
coalesce(regexp_extract(text, '(?i)(?:job\\s*#|job\\s*id|position\\s*id|requisition\\s*id|req\\s*id|dice\\s*id)\\s*[:#-]?\\s*([a-z0-9/_-]+)', 1), '') as job_id, coalesce({title}, '') as title from {rows}"""


def fields_of(rows, key):
    text = F.col("text")
    return rows.select(key, E.posting_url(text).alias("url"), E.posting_id(text).alias("job_id"), E.posting_title(text).alias("title"))


@query(lambda: fields_sql("documents", "doc_id"))
def document_fields(spark, d):
    return fields_of(read(spark, d, "documents"), "doc_id")


@query(lambda: "with " + texts_sql("v", "id, text", FIELDS) + " " + fields_sql("v", "id"))
def posting_fields(spark, d):
    return fields_of(texts(spark, d, FIELDS, "id int, text string"), "id")


@query(MENTIONS + f"select skill, sum(n)::bigint as total, count(*) as documents, row_number() over (order by sum(n) desc, count(*) desc, skill)::int as place from m where skill not in ({', '.join(map(lit, ['linking', *L.GENERIC_SKILLS]))}) group by 1")
def specific_skills(spark, d):
    from pyspark.sql import Window

    found = E.without_generic(skills.mentions(read(spark, d, "documents"), spark.createDataFrame(WORDS, "skill string, alias string")), ["linking", *L.GENERIC_SKILLS])
    sums = found.groupBy("skill").agg(F.sum("n").alias("total"), F.count("*").alias("documents"))
    # one row a skill of the dictionary, so one window holds them
    return sums.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), F.desc("documents"), "skill")))


@query("""select doc_id, coalesce(case when trim(text) <> '' then text end, case when trim(concat_ws(' ', lang, source)) <> '' then concat_ws(' ', lang, source) end, '') as content,
coalesce(case when trim(source) <> '' then source end, 'doc_' || doc_id, '') as name from documents""")
def text_fallback(spark, d):
    c = F.col
    rows = read(spark, d, "documents")
    return rows.select("doc_id", E.first_filled(c("text"), F.concat_ws(" ", "lang", "source")).alias("content"), E.first_filled(c("source"), F.concat(F.lit("doc_"), c("doc_id"))).alias("name"))


PARTS = list(reports.LABELS)
PENALTIES = ["missing_required_penalty", "role_mismatch_penalty", "experience_penalty", "total_penalty", "final_score"]


@query(lambda: "with x as (select l_orderkey, l_linenumber, " + ", ".join(f"((l_partkey * {k + 3} + l_suppkey) % 101)::double as {c}" for k, c in enumerate(PARTS + PENALTIES)) + " from lineitem) unpivot x on " + ", ".join(PARTS + PENALTIES) + " into name component value score")
def component_rows(spark, d):
    wide = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(F.expr(f"(l_partkey * {k + 3} + l_suppkey) % 101").cast("double").alias(c) for k, c in enumerate(PARTS + PENALTIES)))
    return wide.unpivot(["l_orderkey", "l_linenumber"], PARTS + PENALTIES, "component", "score")
