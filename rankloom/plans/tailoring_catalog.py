"""Queries over exports, templates, lines and patches, with SQL of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import nested, ordering
from ..operators import tailoring as T
from .catalog import lit, query, read, texts, texts_sql, values
from .evidence_catalog import fields_sql

BODY = "Responsibilities\nBuild and run pipelines. " + "Work with teams on data of all kinds and keep it whole. " * 5
EXPORTS = [
    (1, f"Links\nJob Title: Data Engineer\nCompany: Bank\nLocation - Leeds\nhttps://www.dice.com/job-detail/1\n{BODY}\nJob Title: ETL Developer\r\nEmployer: Mill\nhttps://www.dice.com/job-detail/2\n{BODY}"),
    (2, f"Apply now\nAnalyst of sales\n{BODY}\n\n\n\n\nApply now\nJob ID: 77\nAnalyst of costs\n{BODY}"),
    (3, f"Title: Only one\nhttps://site.example/a).\n{BODY}"), (4, None), (5, "https://a.example/1 and https://b.example/2\nshort"), (6, "  \n "),
    (7, f"x https://a.example/1 job id: A1\n{BODY}\nhttps://a.example/1 job id: a1\nx https://a.example/1\n{BODY}\ncompany: late\n job # 5 https://a.example/3 {BODY}"),
    (8, f"Req ID: 1\n{BODY}\nposition id - 2\nhttps://c.example/z\nshort\nrequisition id: 3\nApply now\nThird\n{BODY}"),
]
SEARCHES = [
    (1, "https://x.example/s?q=data+engineer&page=3"), (2, "https://x.example/s?query=a%20b&q="), (3, "https://x.example/s"), (4, None), (5, "https://x.example/s?search=z&keywords=k%26l&b=1&b=2#top"), (6, "https://x.example/s?page=9&a=1&c=x~y*z&a=2"), (7, "https://x.example/s?"),
]
TEX = [
    (1, "\\section*{PROFESSIONAL SUMMARY:}\n\\begin{itemize}\n \\item One  a\n\\item Two\n b \\item in line\n\\end{itemize}\n\\section*{Technical Skills:}\n\\begin{longtable}x\\end{longtable}\n\\section*{PROFESSIONAL EXPERIENCE:}\nA \\textbf{Responsibilities:}\\begin{itemize}\n\\item E1\n\\item E2 \\end{itemize}\nB \\textbf{responsibilities:}\n\\begin{itemize}\n\\item F1\n\\item F2\n  \\end{itemize}"),
    (2, "nothing"), (3, "\\section*{professional summary:} \\begin{itemize} no items \n\\end{itemize}"), (4, None),
]
RESUME_LINES = [
    (1, "JANE DOE\njane@mail.example\nProfessional  Summary:\nBuilt things\nthat last\n• item one\ncontinues here\n\nClient: Bank\nJun 2021 - Present\nplain\n555-123-4567 call\nmore\n\uf0d8 eighth mark\nof bullets"), (2, None), (3, "MY BIG PROJECT\nlinkedin.com/in/x\n- a\n* b\nskills\nEnvironment: sql"), (4, "\n\none\n\n\ntwo\n"),
]
PATCHES = [(1, ["a"], None, ["b", "a"]), (2, None, None, None), (3, [], ["x"], [])]
SHEET = [
    (" 7 ", " Job ", "70.5"), ("", "x", "70"), ("8", None, "n/a"), ("9", "y", None), ("10", "z", "80"), ("11", "low", " 12 "), (None, "q", "3"), ("12", "edge", "0"),
]
NAMED = [(1, None, "2025-06-01 07:08:09"), (2, " out ", "2025-06-01 00:00:00"), (3, "A.XLSX", "2025-06-01 00:00:00"), (4, "  ", "1999-12-31 23:59:59")]
ANSWERS = [(1, '{"bullets": ["a", "b"], "note": "n"}'), (2, "not json"), (3, None), (4, '{"bullets": []}'), (5, ""), (6, '{"note": "é"}')]


def places_sql(x: str, pattern: str) -> str:
    size = lambda list_: f"coalesce(list_sum(list_transform({list_}, lambda p: length(p))), 0)::bigint"
    ps, fs = f"string_split_regex({x}, {lit(pattern)})", f"regexp_extract_all({x}, {lit(pattern)})"
    return f"list_transform(range(1, len({fs}) + 1), lambda i: {size(f'{ps}[1:i]')} + {size(f'list_slice({fs}, 1, i - 1)')})"


def chunks_sql(x: str, starts: str) -> str:
    part = f"regexp_replace(substr({x}, {starts}[i] + 1, coalesce({starts}[i + 1], length({x})) - {starts}[i]), '^\\s+|\\s+$', '', 'g')"
    return f"case when len({starts}) < 2 then [{x}] else list_filter(list_transform(range(1, len({starts}) + 1), lambda i: {part}), lambda c: c <> '') end"


def exports_sql() -> str:
    pre = "substr(x, greatest(u - 1200, 0) + 1, least(u, 1200))"
    heads = ", ".join(f"case when regexp_matches({pre}, {lit('(?im)^' + h)}) then greatest(u - 1200, 0) + length(regexp_extract({pre}, {lit('(?ims)' + chr(92) + 'A(.*)^' + h)}, 1)) end" for h in L.POSTING_HEADS)
    labelled = lambda names: ", ".join(rf"nullif(trim(regexp_extract(text, '(?im)^\s*{n}\s*[:\-]\s*(.+?)\s*$', 1)), '')" for n in names)
    signal = " or ".join(f"contains(lower(text), '{s}')" for s in L.POSTING_SIGNALS)
    return rf"""with {texts_sql("v", "blob_id, t", EXPORTS)},
c as (select blob_id, regexp_replace(regexp_replace(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as x from v where t is not null),
u as (select *, case when len(regexp_extract_all(x, {lit(L.PORTAL_LINK)})) >= 2 then {places_sql("x", L.PORTAL_LINK)} else {places_sql("x", L.ANY_LINK)} end as us from c where x <> ''),
s as (select blob_id, x, list_transform(us, lambda u: coalesce(least({heads}), u - length(regexp_extract(substr(x, 1, u), '[^\n]*$')))) as ss from u),
r as (select blob_id, x, list_filter(ss, lambda s, i: i = 1 or s > list_max(ss[1:i - 1])) as ss, list_sort(list_distinct(flatten([{", ".join(places_sql("x", p) for p in L.POSTING_MARKERS)}]))) as ms from s),
k as (select blob_id, x, {chunks_sql("x", "ss")} as cs, {chunks_sql("x", "ms")} as ds from r),
p as (select blob_id, x, case when len(cs) > 1 then cs else ds end as ps from k),
e as (select blob_id, i, ps[i] as text from p, range(1, len(ps) + 1) t(i) where len(ps) > 1 union all select blob_id, 0, x from p),
f as (select * exclude (title), coalesce({labelled([r"job\s*title", r"position\s*title", "title"])}, title) as title, coalesce({labelled(["company", "employer"])}, '') as company, coalesce({labelled(["location"])}, '') as location from ({fields_sql("e", "blob_id, i, text")})),
g as (select * from f where i > 0 and length(text) >= 250 and ({signal}) qualify row_number() over (partition by blob_id, lower(url), lower(job_id), trim(regexp_replace(lower(title), '\s+', ' ', 'g')) order by i) = 1),
a as (select * from g union all select * from f where i = 0 and blob_id not in (select blob_id from g))
select blob_id, (row_number() over (partition by blob_id order by i) - 1)::int as part, title, company, location, url, job_id, text from a"""


@query(exports_sql)
def split_jobs_url(spark, d):
    return T.split_by_links(texts(spark, d, EXPORTS, "blob_id int, text string"))


def searches(spark, d):
    pages, id_ = read(spark, d, "pages"), F.col("page_id")
    own = spark.createDataFrame(SEARCHES, "id int, url string").union(pages.select(id_ + 1000, "url"))
    return own.union(pages.select(id_ + 1_000_000, F.concat("url", F.lit("?q="), id_.cast("string"), F.lit("&page=3&q=x+y"))))


def pairs_sql() -> str:
    return values("v0", "id, url", SEARCHES) + r""", v as (select * from v0 union all select page_id + 1000, url from pages union all select page_id + 1000000, url || '?q=' || page_id || '&page=3&q=x+y' from pages), q as (select id, url, list_filter(list_transform(string_split(coalesce(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), ''), '&'), lambda p: {'k': url_decode(replace(split_part(p, '=', 1), '+', ' ')), 'v': url_decode(replace(regexp_extract(p, '=(.*)$', 1), '+', ' '))}), lambda p: p.v <> '') as ps from v)"""


@query(lambda: "with " + pairs_sql() + " select id, " + ", ".join("coalesce(" + ", ".join(f"list_filter(ps, lambda p: p.k = '{k}')[1].v" for k in keys) + f", '{name}') as {name}" for name, keys in L.SEARCH_KEYS.items()) + " from q")
def search_keyword(spark, d):
    rows = searches(spark, d)
    return rows.select("id", *(T.search_keyword(F.col("url"), keys, name).alias(name) for name, keys in L.SEARCH_KEYS.items()))


@query(lambda: "with " + pairs_sql() + """, k as (select id, url, unnest(ps || [{'k': 'page', 'v': '2'}]) as p, generate_subscripts(ps || [{'k': 'page', 'v': '2'}], 1) as i from q),
o as (select id, url, p.k as k, case when p.k = 'page' then '2' else p.v end as v, i, min(i) over (partition by id, p.k) as f from k qualify p.k <> 'page' or i = f),
w as (select id, url, string_agg(replace(url_encode(k), '%20', '+') || '=' || replace(url_encode(v), '%20', '+'), '&' order by f, i) as asked from o group by 1, 2)
select id, regexp_extract(url, '^[^?#]*') || '?' || asked || regexp_extract(url, '#.+$') as url from w""")
def page_url_rewrite(spark, d):
    return searches(spark, d).select("id", T.with_page(F.col("url"), 2).alias("url"))


def items_sql(x: str, behind: str) -> str:
    pattern = lit(rf"(?s)(?i:{behind}).*?\\begin\{{itemize\}}(.*?)\\end\{{itemize\}}")
    inner = f"regexp_extract({x}, {pattern}, 1)"
    items = rf"string_split_regex(regexp_extract({inner}, '(?s)\\item\s+(.*)$', 1), '\n\s*\\item\s+')"
    squeezed = rf"list_transform(case when regexp_matches({inner}, '\n\s*$') then {items} else list_slice({items}, 1, len({items}) - 1) end, lambda i: trim(regexp_replace(i, '\s+', ' ', 'g')))"
    return f"case when regexp_matches({x}, {pattern}) then case when contains({inner}, '\\item') then array_to_string({squeezed}, '|') else '' end end"


def template_sql() -> str:
    duties, work = r"\\textbf\{Responsibilities:\}", r"\\section\*\{PROFESSIONAL EXPERIENCE:\}"
    return f"""with {texts_sql("v", "id, t", TEX)}, r as (select *, regexp_extract(t, {lit(rf"(?s){work}.*?\\end\{{itemize\}}(.*)$")}, 1) as rest from v)
select id, {items_sql("t", r"\\section\*\{PROFESSIONAL SUMMARY:\}")} as summary, nullif(regexp_extract(t, {lit(r"(?is)\\section\*\{TECHNICAL SKILLS:\}.*?\\end\{longtable\}")}), '') as skills_block, {items_sql("t", rf"{work}.*?{duties}")} as experience_1, {items_sql("rest", duties)} as experience_2 from r"""


@query(template_sql)
def template_sections(spark, d):
    found = T.template_sections(F.col("t"))
    return texts(spark, d, TEX, "id int, t string").select("id", *((c if k == "skills_block" else F.array_join(c, "|")).alias(k) for k, c in found.items()))


def lines_sql(rows: str, tail: str) -> str:
    capital = r"upper(l) = l and lower(l) <> l and len(string_split(l, ' ')) between 2 and 6 and length(l) <= 60"
    bullet = " or ".join(f"starts_with(l, '{b}')" for b in L.BULLETS)
    return rf"""with {rows}, s as (select id, unnest(string_split(coalesce(t, ''), chr(10))) as raw, generate_subscripts(string_split(coalesce(t, ''), chr(10)), 1) as n from v), l as (select id, n, trim(regexp_replace(raw, '\s+', ' ', 'g')) as l from s),
k as (select *, case when l = '' then 'blank' when list_contains({lit(L.LINE_HEADINGS)}, trim(rtrim(lower(l), ':'))) or ({capital}) then 'heading' when {bullet} then 'bullet' when regexp_matches(lower(l), {lit(L.DATED_LINE)}) then 'dated'
  when contains(l, '@') or contains(lower(l), 'linkedin.com') or regexp_matches(l, '\b\d{{3}}[-.\s]\d{{3}}[-.\s]\d{{4}}\b') then 'contact' else 'text' end as kind from l)
{tail}"""


@query(lambda: lines_sql("v as (select doc_id as id, text as t from documents)", "select kind, count(*) as lines, count(distinct id) as documents from k group by 1"))
def line_kinds(spark, d):
    lines = read(spark, d, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("l"))
    kinds = lines.select("doc_id", T.line_kind(T.squeeze(F.col("l"))).alias("kind")).groupBy("kind", "doc_id").agg(F.count("*").alias("n"))
    return kinds.groupBy("kind").agg(F.sum("n").alias("lines"), F.count("*").alias("documents"))


@query(lambda: lines_sql(texts_sql("v", "id, t", RESUME_LINES), """, g as (select *, sum(case when kind = 'text' and before in ('text', 'contact') then 0 else 1 end) over (partition by id order by n) as g from (select *, lag(kind) over (partition by id order by n) as before from k)),
j as (select id, g, string_agg(l, ' ' order by n) as l from g group by 1, 2) select id, string_agg(l, '|' order by g) as lines from j group by 1"""))
def joined_lines(spark, d):
    joined = T.joined_lines(texts(spark, d, RESUME_LINES, "id int, text string"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])
    return joined.groupBy("id").agg(F.array_join(in_order, "|").alias("lines"))


@query(lambda: "with " + values("v0", "id, a, b, c", PATCHES) + ", v as (select * from v0 union all select doc_id + 1000, string_split(split_part(text, chr(10), 1), ' '), null, [source, lang]::varchar[] from documents) select id, array_to_string(list_concat(coalesce(a, []), coalesce(b, []), coalesce(c, [])), ',') as notes from v")
def merged_patch(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id") + 1000, F.split(F.split_part("text", F.lit("\n"), F.lit(1)), " "), F.lit(None).cast("array<string>"), F.array("source", "lang"))
    rows = spark.createDataFrame(PATCHES, "id int, a array<string>, b array<string>, c array<string>").union(docs)
    return rows.select("id", F.array_join(T.merged_patch([F.col(c) for c in "abc"]), ",").alias("notes"))


@query(lambda: "with " + values("v0", "job_id, job_name, best", SHEET) + ", v as (select * from v0 union all select ' c' || c_custkey, c_name, case when c_custkey % 9 = 0 then 'n/a' else (c_acctbal / 100)::varchar end from customer) select trim(job_id) as job_id, trim(coalesce(job_name, '')) as job_name, try_cast(best as double) as best from v where trim(job_id) <> '' and try_cast(best as double) >= 0 and try_cast(best as double) < 80")
def summary_rows(spark, d):
    key = F.col("c_custkey")
    customers = read(spark, d, "customer").select(F.concat(F.lit(" c"), key.cast("string")), "c_name", F.when(key % 9 == 0, "n/a").otherwise((F.col("c_acctbal") / 100).cast("string")))
    rows = spark.createDataFrame(SHEET, "job_id string, job_name string, best string").union(customers)
    return T.scored_rows(rows, "job_id", "best", ["job_id", "job_name", "best"], 0.0, 80.0)


@query("""with x as (select l_orderkey, l_linenumber, (l_extendedprice % 9000 - 50)::double as s from lineitem), y as (select *, greatest(s, 0) as g, floor(greatest(s, 0) / 60)::bigint as m from x)
select l_orderkey, l_linenumber, case when g < 60 then printf('%.2f seconds', g) when m < 60 then printf('%d minutes %.2f seconds', m, g % 60) else printf('%d hours %d minutes %.2f seconds', m // 60, m % 60, g % 60) end as took from y""")
def said_duration(spark, d):
    seconds = (F.col("l_extendedprice") % 9000 - 50).cast("double")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.said_duration(seconds).alias("took"))


@query(lambda: "with " + values("v0", "id, given, made", NAMED) + ", v as (select id, given, made::timestamp as made from v0 union all select event_id + 1000, case when event_id % 3 = 0 then event_type when event_id % 3 = 1 then ' ' end, ts::timestamp from events), n as (select id, coalesce(nullif(trim(given), ''), 'ATS_Result_' || strftime(made::timestamp, '%Y%m%d_%H%M%S')) as n from v) select id, case when ends_with(lower(n), '.xlsx') then n else n || '.xlsx' end as name from n")
def result_name(spark, d):
    i = F.col("event_id")
    events = read(spark, d, "events").select(i + 1000, F.when(i % 3 == 0, F.col("event_type")).when(i % 3 == 1, " "), F.col("ts").cast("timestamp"))
    rows = spark.createDataFrame(NAMED, "id int, given string, made string").withColumn("made", F.col("made").cast("timestamp")).union(events)
    return rows.select("id", T.result_name(F.col("given"), F.col("made").cast("timestamp")).alias("name"))


@query(lambda: f"""with x as (select l_orderkey, l_linenumber, case when l_partkey % 5 > 0 then (l_suppkey % 7)::double / 6 end as share, ({lit(["databricks", "snowflake", "", "azure"])})[(l_partkey % 4 + 1)::int] as own, ({lit(["databricks", "azure", "", "snowflake"])})[(l_orderkey % 4 + 1)::int] as asked, (l_linenumber * 3)::double as before from lineitem),
y as (select *, own <> '' and asked <> '' as known, floor(share * 100 * 100 + 0.5) / 100 as raw from x),
z as (select *, case when known and own = asked then greatest(raw, 95) when known and list_contains({lit(L.STRICT_PLATFORMS)}, asked) then least(raw, 45) else raw end as score, case when known and own <> asked and list_contains({lit(L.STRICT_PLATFORMS)}, asked) then greatest(before, 8) else before end as after from y)
select l_orderkey, l_linenumber, (case when share is null then 50 else score end)::double as platform_score, (case when share is null then before when score < 20 then 18 when score < 40 then 10 else after end)::double as platform_penalty, (case when share is not null and score >= 80 then 4 else 0 end)::double as core_bonus from z""")
def platform_alignment(spark, d):
    pick = lambda names, c: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % 4 + 1).cast("int"))
    share = F.when(F.col("l_partkey") % 5 > 0, (F.col("l_suppkey") % 7).cast("double") / 6)
    found = T.platform_alignment(share, pick(["databricks", "snowflake", "", "azure"], "l_partkey"), pick(["databricks", "azure", "", "snowflake"], "l_orderkey"), (F.col("l_linenumber") * 3).cast("double"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(c.alias(k) for k, c in found.items()))


@query(lambda: "with " + values("v0", "id, t", ANSWERS) + ", v as (select * from v0 union all select event_id + 1000, case when event_id % 4 = 0 then '{\"bullets\": [\"' || event_type || '\", \"b\"], ' || substr(props, 2) when event_id % 4 = 1 then event_type else props end from events) select id, case when json_valid(t) then coalesce(array_to_string(from_json(json_extract(t, '$.bullets'), '[\"VARCHAR\"]'), ','), '') end as bullets, case when coalesce(t, '') = '' then 'empty answer' when not json_valid(t) then 'invalid JSON: ' || t end as error from v")
def model_answers(spark, d):
    """FC4: a model's answer parsed; what isn't JSON is a row with an error."""
    i, kind = F.col("event_id"), F.col("event_type")
    made = F.when(i % 4 == 0, F.concat(F.lit('{"bullets": ["'), kind, F.lit('", "b"], '), F.substring("props", 2, 1 << 20))).when(i % 4 == 1, kind).otherwise(F.col("props"))
    rows = spark.createDataFrame(ANSWERS, "id int, t string").union(read(spark, d, "events").select(i + 1000, made))
    parsed = F.from_json("t", "bullets array<string>, note string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    empty = F.coalesce("t", F.lit("")) == ""
    bad = parsed["_bad"].isNotNull()
    error = F.when(empty, "empty answer").when(bad, F.concat(F.lit("invalid JSON: "), F.substring("t", 1, 1500)))
    return rows.select("id", F.when(~empty & ~bad, F.coalesce(F.array_join(parsed["bullets"], ","), F.lit(""))).alias("bullets"), error.alias("error"))


@query("select count(*) as found, count(*) filter (text is null or trim(text) = '') as failed, count(distinct source) as sources, count(*) filter (lang is not null) as labelled from documents")
def run_counters(spark, d):
    """A13, A15: what a run found, in one pass."""
    return read(spark, d, "documents").agg(F.count("*").alias("found"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("failed"), F.count_distinct("source").alias("sources"), F.count_if(F.col("lang").isNotNull()).alias("labelled"))


@query("""with s as (select l_orderkey, l_returnflag as role, sum(l_quantity)::double as score, min(l_linenumber) as first_line from lineitem group by 1, 2) select l_orderkey, string_agg(role, ',' order by score desc, first_line, role) as roles from s group by 1""")
def role_scores_sorted(spark, d):
    """O3: roles by falling score, of equals the first line's, then by name."""
    s = read(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("role")).agg(F.sum("l_quantity").cast("double").alias("score"), F.min("l_linenumber").alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "line", "role")))
    return s.groupBy("l_orderkey").agg(F.array_join(F.transform(ordered, lambda x: x["role"]), ",").alias("roles"))


NESTED = [
    (1, '{"b": 2, "skills": ["x", {"text": "deep", "a": true}], "text": "first", "z": null, "e": ""}'), (2, "[1, [2, [3, {\"title\": \"t\", \"summary\": \"s\"}]]]"), (3, "not json"), (4, None), (5, "{}"), (6, '"plain"'), (7, "null"), (8, "{bad"), (9, '{"a": {"b": {"c": {"education": "e", "d": 1.5}}}}'),
]


@query(lambda: "with recursive " + values("v0", "id, t", NESTED) + f""", v as (select id::bigint as id, t from v0 union all select event_id + 1000, case event_id % 5 when 0 then '{{"k2": ["' || event_type || '", {{"role": "r' || user_id || '"}}], "summary": ' || props || '}}' when 1 then props || '}}' else props end from events),
w as (select id, t::json as j, []::varchar[] as pos from v where json_valid(t) union all
  select w.id, e.value as j, list_append(w.pos, case when json_type(w.j) = 'ARRAY' then printf('%010d', e.key::bigint) when list_contains({lit(nested.TEXT_KEYS)}, e.key) then printf('0%05d', list_position({lit(nested.TEXT_KEYS)}, e.key)) else '1' || e.key end) as pos from w, json_each(w.j) e where json_type(w.j) in ('OBJECT', 'ARRAY')),
l as (select id, pos, case when json_type(j) = 'BOOLEAN' then case when j::varchar = 'true' then 'True' else 'False' end else j ->> '$' end as said from w where json_type(j) not in ('OBJECT', 'ARRAY', 'NULL'))
select v.id, coalesce((select string_agg(said, ' ' order by pos) from l where l.id = v.id and said <> ''), '') as text, case when t is not null and not json_valid(t) then 'invalid JSON: ' || substr(t, 1, 200) end as error from v""")
def nested_evidence(spark, d):
    """SRC11, FC1: text of nested documents, keys in order of weight; malformed ones as an error."""
    i = F.col("event_id")
    deep = F.concat(F.lit('{"k2": ["'), F.col("event_type"), F.lit('", {"role": "r'), F.col("user_id").cast("string"), F.lit('"}], "summary": '), F.col("props"), F.lit("}"))
    events = read(spark, d, "events").select((i + 1000).alias("id"), F.when(i % 5 == 0, deep).when(i % 5 == 1, F.concat("props", F.lit("}"))).otherwise(F.col("props")).alias("json"))
    return nested.nested_text(spark.createDataFrame(NESTED, "id long, json string").union(events))


@query("select page_id, regexp_extract(url, '://([^/?#]*)', 1) as host, url, row_number() over (order by encode(regexp_extract(url, '://([^/?#]*)', 1)), encode(url), page_id) as ord from pages")
def page_order(spark, d):
    """SRC10, O1: a global order by ranges and counts, so no task sees all rows."""
    pages = read(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), "url")
    return ordering.numbered(pages, F.col("host"), F.col("url"), F.col("page_id"))
