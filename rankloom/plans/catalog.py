"""Queries over the test tables, each with SQL of its own that another engine can run."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import scoring, text
from ..operators import ranking, relational, reports, rules, skills
from ..sources import pages as pg

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql() if callable(sql) else sql
        return f

    return add


def read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def lit(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(lit, v)) + "]::varchar[]"
    return repr(v).lower() if isinstance(v, bool) else repr(v)


def values(name: str, cols: str, rows) -> str:
    """A fixture as a common table expression."""
    return f"{name}({cols}) as (values " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


def texts_sql(name: str, cols: str, rows, *more: str) -> str:
    """A fixture of ids and texts with all documents and benchmark items behind it; more: SQL for further columns."""
    extra = "".join(f", {m}" for m in more)
    return values(f"{name}_own", cols, rows) + f", {name}({cols}) as (select * from {name}_own union all select doc_id + 1000, text{extra} from documents union all select -1000 - item_id, text{extra} from benchmark)"


def texts(spark, d, rows, schema: str, *more):
    """The same in Spark; schema names the fixture's columns, more are columns over `text`."""
    own = spark.createDataFrame(rows, schema)
    names, c = own.columns, F.col
    parts = [read(spark, d, "documents").select((c("doc_id") + 1000).alias("id"), "text"), read(spark, d, "benchmark").select((-1000 - c("item_id")).alias("id"), "text")]
    for part in parts:
        own = own.union(part.select(c("id").alias(names[0]), c("text").alias(names[1]), *(m.alias(n) for m, n in zip(more, names[2:], strict=True))))
    return own


# ---- BM25, ranking, vectors


def sql_tokens(col: str) -> str:
    x = f"lower(coalesce({col}, ''))"
    for a, b in L.PHRASES:
        x = f"replace({x}, '{a}', '{b}')"
    return f"list_filter(regexp_extract_all({x}, '{L.TOKEN}'), lambda t: length(t) >= 2 and not list_contains({lit(L.STOP_WORDS)}, t))"


def bm25_sql(tail: str) -> str:
    return f"""
with q as (select item_id as job_id, term, 1 + ln(count(*)) as w from (select item_id, ln(1) as z, unnest({sql_tokens("text")}) as term from benchmark) group by 1, 2),
q2 as (select job_id, term, 1 + ln(1 + (exp(w - 1) - 1)) as w from q),
d as (select doc_id, term, count(*) as tf from (select doc_id, unnest({sql_tokens("text")}) as term from documents) group by 1, 2),
p as (select job_id, doc_id, count(*) as matches, sum(ln(2) * tf * 2.5 / (tf + 1.5) * w) as raw, sum(ln(2) * w) as hit, sum(w) as hw from d join q2 using (term) group by 1, 2),
n as (select job_id, count(*) as query_terms, sum(w) as aw from q2 group by 1),
s as (select job_id, doc_id, matches, query_terms, floor(matches / query_terms * 100.0 * 100 + 0.5) / 100 as coverage,
  floor(least(raw / (hit + ln(6) * (aw - hw)) * 100.0 * 0.65 + matches / query_terms * 100.0 * 0.35, 100.0) * 100 + 0.5) / 100 as score from p join n using (job_id))
{tail}"""


def pairs(spark, d):
    return ranking.bm25_pairs(read(spark, d, "documents"), read(spark, d, "benchmark").select(F.col("item_id").alias("job_id"), "text"))


@query(lambda: bm25_sql("select job_id, doc_id, matches, query_terms, coverage, score from s qualify row_number() over (partition by job_id order by score desc, doc_id) = 1"))
def bm25_rank_top1(spark, d):
    return ranking.best(pairs(spark, d))


@query(lambda: bm25_sql("select job_id, count(*) as pairs, sum(matches)::bigint as matches, max(score) as best, min(score) as worst from s group by job_id"))
def bm25_components(spark, d):
    return pairs(spark, d).groupBy("job_id").agg(F.count("*").alias("pairs"), F.sum("matches").alias("matches"), F.max("score").alias("best"), F.min("score").alias("worst"))


@query(lambda: bm25_sql("select job_id, doc_id, score, row_number() over (partition by job_id order by score desc, doc_id) as rank from s qualify rank <= 10"))
def rank_within_job_top10(spark, d):
    return ranking.ranked(pairs(spark, d)).where("rank <= 10").select("job_id", "doc_id", "score", "rank")


@query("""
with p as (select v.vec_id, b.vec_id as probe_id, floor(least(greatest(list_dot_product(v.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(v.embedding::double[], v.embedding::double[])) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[]))), 0), 1) * 100 * 100 + 0.5) / 100 as score
  from embeddings v join embeddings b on b.vec_id % 50 = 0 and v.vec_id <> b.vec_id)
select probe_id, vec_id, score, row_number() over (partition by probe_id order by score desc, vec_id) as rank from p qualify rank <= 5""")
def cosine_topk(spark, d):
    vectors = read(spark, d, "embeddings")
    return ranking.top_vectors(vectors, vectors.where("vec_id % 50 = 0"), 5)


# ---- urls, links, pages

SQL_URL = f"""
with r as (select page_id, rtrim(trim(trim(coalesce(url, '')), '"' || chr(39)), '.,);]}}') as raw from pages),
p as (select page_id, raw, regexp_extract(raw, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 1) as scheme, regexp_extract(raw, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 2) as host, regexp_extract(raw, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)', 3) as path,
  list_sort(list_transform(list_filter(string_split(regexp_extract(raw, '[?]([^#]*)', 1), '&'), lambda x: x <> '' and not list_contains({lit(L.TRACKING_KEYS)}, lower(split_part(x, '=', 1)))), lambda x: case when contains(x, '=') then x else x || '=' end)) as q from r),
k as (select page_id, case when raw = '' or lower(raw) = 'nan' then '' when host = '' then rtrim(lower(raw), '/') else lower(scheme) || '://' || regexp_replace(lower(host), '^www[.]', '') || rtrim(regexp_replace(path, '/{{2,}}', '/', 'g'), '/') || case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end end as url_key from p)
"""


@query(SQL_URL + "select page_id, url_key from k")
def url_normalize_a(spark, d):
    return read(spark, d, "pages").select("page_id", text.url_key(F.col("url")).alias("url_key"))


@query("select page_id, rtrim(replace(split_part(split_part(lower(trim(coalesce(url, ''))), '#', 1), '?', 1), 'www.dice.com', 'dice.com'), '/') as url_key from pages")
def url_normalize_b(spark, d):
    return read(spark, d, "pages").select("page_id", text.url_key_plain(F.col("url")).alias("url_key"))


@query(SQL_URL + "select url_key, page_id from k qualify row_number() over (partition by url_key order by page_id) = 1")
def url_dedupe(spark, d):
    keyed = read(spark, d, "pages").select(text.url_key(F.col("url")).alias("url_key"), "page_id")
    return relational.first_by(keyed, ["url_key"], F.col("page_id"))


@query("""select distinct page_id, split_part(h, '?', 1) as link from (select page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as h from pages) where contains(split_part(h, '?', 1), '/')""")
def link_extract(spark, d):
    return pg.links(read(spark, d, "pages"), ["/"])


@query("""select page_id, coalesce(nullif(trim(regexp_extract(html, '<h1[^>]*>([^<]*)<', 1)), ''), nullif(trim(regexp_extract(html, '<title>([^<]*)<', 1)), ''), '') as title, coalesce(nullif(trim(regexp_extract(html, '<html lang="([a-z]+)"', 1)), ''), '') as lang from pages""")
def page_fields(spark, d):
    return pg.fields(read(spark, d, "pages"), {"title": ["<h1[^>]*>([^<]*)<", "<title>([^<]*)<"], "lang": ['<html lang="([a-z]+)"']})


@query("""
with f as (select page_id // 10 as page_no, regexp_extract(url, '://([^/]*)', 1) as link from pages), n as (select link, min(page_no) as page_no from f group by 1),
s as (select min(page_no) as stop from f where page_no not in (select page_no from n))
select link, page_no from n where coalesce(page_no < (select stop from s), true)""")
def crawl_until_no_new(spark, d):
    found = read(spark, d, "pages").select(F.floor(F.col("page_id") / 10).alias("page_no"), F.regexp_extract("url", "://([^/]*)", 1).alias("link"))
    return pg.crawled(found).select("link", "page_no")


@query("select page_id, case when regexp_matches(url, 'page=[0-9]+') then regexp_replace(url, 'page=[0-9]+', 'page=3', 'g') else url || case when contains(url, '?') then '&' else '?' end || 'page=3' end as next_url from pages")
def page_url_builder(spark, d):
    return read(spark, d, "pages").select("page_id", pg.page_url(F.col("url"), 3).alias("next_url"))


# ---- incremental load, lookups

HALVES = "with k as (select regexp_extract(url, '://([^/]*)', 1) as host, page_id from pages), m as (select host, min(page_id) as page_id from k where page_id % 3 = 0 group by host), i as (select * from k where page_id % 3 <> 0) "


def halves(spark, d):
    k = read(spark, d, "pages").select(F.regexp_extract("url", "://([^/]*)", 1).alias("host"), "page_id")
    return k.where("page_id % 3 = 0").groupBy("host").agg(F.min("page_id").alias("page_id")), k.where("page_id % 3 <> 0")


@query(HALVES + "select host, page_id from i where host not in (select host from m)")
def master_anti_join(spark, d):
    master, incoming = halves(spark, d)
    return relational.new_rows(incoming, master, "host")


@query(HALVES + "select host, page_id from (select host, page_id, 0 as side from m union all select host, page_id, 1 from i) qualify row_number() over (partition by host order by side, page_id) = 1")
def master_upsert(spark, d):
    return relational.upsert(*halves(spark, d), "host", "page_id").select("host", "page_id")


@query("select o_orderkey, o_totalprice, c_name from orders join customer on c_custkey = o_custkey where o_totalprice >= 45000 and o_totalprice < 80000 order by o_totalprice desc, o_orderkey limit 50")
def score_band_topn(spark, d):
    orders = read(spark, d, "orders").where("o_totalprice >= 45000 and o_totalprice < 80000")
    named = orders.join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return named.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice", "c_name")


@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def links_semi_join(spark, d):
    wanted = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return read(spark, d, "orders").join(wanted, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("select c_custkey, o_orderkey from customer left join (select o_custkey, max(o_orderkey) as o_orderkey from orders group by 1) on o_custkey = c_custkey")
def links_lookup_last_wins(spark, d):
    links = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return relational.latest_lookup(read(spark, d, "customer").select("c_custkey"), links, "c_custkey", "o_orderkey")


@query("with j as (select page_id + 1 as index, case page_id % 3 when 0 then null when 1 then '' else url end as url from pages), l as (select page_id as row_order, url as link_url from pages) select index, coalesce(nullif(url, ''), case when (select count(*) from j) = (select count(*) from l) then link_url end) as url from j left join l on row_order + 1 = index")
def positional_join(spark, d):
    pages, i = read(spark, d, "pages"), F.col("page_id")
    jobs = pages.select((i + 1).alias("index"), F.when(i % 3 == 0, None).when(i % 3 == 1, "").otherwise(F.col("url")).alias("url"))
    return relational.positional(jobs, pages.select(i.alias("row_order"), "url"))


WANTED = [(1, "j-1", "", "x"), (2, "", "http://u/2", "x"), (3, "abc9", "", ""), (4, "none", "", "senior data engineer"), (5, "", "", "lead data engineer remote"), (6, "zz", "", "q")]
ENTRIES = [(0, "j-9", "http://u/2", "data engineer", "about ABC9 here"), (1, "j-1", "", "senior data engineer", "first"), (2, "j-1", "", "lead data engineer", "again abc9"), (3, "", "", "short", "none of it")]


@query("with " + values("j0", "job_ord, job_id, url, title", WANTED) + ", " + values("e0", "entry_ord, e_id, e_url, e_title, e_text", ENTRIES) + """, j as (select * from j0 union all select item_id + 1000, lower(substr(text, 30, 7)), '', lower(substr(text, 1, 50)) from benchmark), e as (select * from e0 union all select doc_id + 1000, '', '', lower(substr(text, 1, 12)), lower(text) from documents)
select job_ord, entry_ord, tier from (select job_ord, entry_ord, case when job_id <> '' and job_id = e_id then 1 when url <> '' and url = e_url then 2 when job_id <> '' and contains(lower(e_text), job_id) then 3 when title <> '' and title = e_title then 4
  when title <> '' and length(e_title) >= 12 and (contains(title, e_title) or contains(e_title, title)) then 5 end as tier from j, e) where tier is not null qualify row_number() over (partition by job_ord order by tier, entry_ord) = 1""")
def fallback_lookup(spark, d):
    jobs = spark.createDataFrame(WANTED, "job_ord int, job_id string, url string, title string")
    entries = spark.createDataFrame(ENTRIES, "entry_ord int, job_id string, url string, title string, description string")
    none = F.lit("")
    more = read(spark, d, "benchmark").select(F.col("item_id") + 1000, F.lower(F.substring("text", 30, 7)), none, F.lower(F.substring("text", 1, 50)))
    docs = read(spark, d, "documents").select(F.col("doc_id") + 1000, none, none, F.lower(F.substring("text", 1, 12)), "text")
    return relational.lookup(jobs.union(more), entries.union(docs))


# ---- rules

POSTS = [
    (1, "Senior Data Engineer", "We need 12+ years of experience. US citizens only."), (2, "Java Developer", "Nothing else"), (3, "Analyst", "Intro\nBuild a data pipeline\nmore"), (4, "Basic Clerk", "files"),
    (5, "Data Analyst", "10 plus years is nice"), (6, "ETL Developer", "Active security clearance; no visa sponsorship"), (7, "Cook", "soup"), (8, "Data Engineer", "At least ten years required. TS / SCI"), (9, None, None),
]


def sql_first(x, keywords):
    return "coalesce(" + ", ".join(f"case when contains({x}, {lit(k)}) then {lit(k)} end" for k in keywords) + ")"


def sql_match(x, patterns):
    return "coalesce(" + ", ".join(f"nullif(trim(regexp_replace(regexp_extract({x}, {lit('(?i)' + p)}), '\\s+', ' ', 'g')), '')" for p in patterns) + ")"


@query(lambda: "with " + values("p0", "id, title_, text_", POSTS) + f""", p as (select * from p0 union all select doc_id + 1000, substr(text, 1, 60), text from documents),
a as (select id, lower(trim(coalesce(title_, ''))) as title, coalesce(text_, '') as text, regexp_extract(coalesce(text_, ''), {lit(L.LONG_EXPERIENCE)}) as found from p),
b as (select *, instr(text, found) as pos from a),
c as (select *, lower(substr(text, greatest(pos - 100, 1), pos + length(found) + 100 - greatest(pos - 100, 1))) as near, lower(array_to_string(string_split(text, chr(10))[1:20], ' ')) as intro from b),
r as (select id, list_filter([
  'Experience: ' || case when found <> '' and not ({sql_first("near", L.PREFERRED_WORDS)} is not null and {sql_first("near", L.REQUIRED_WORDS)} is null) then trim(found) end,
  'Citizenship: ' || {sql_match("text", L.CITIZENSHIP)}, 'Clearance: ' || {sql_match("text", L.CLEARANCE)},
  'Role: ' || case when {sql_first("title", L.ACCEPT_TITLES)} is not null then null when {sql_first("title", L.REJECT_TITLES)} is not null then 'Irrelevant title keyword: ' || {sql_first("title", L.REJECT_TITLES)} when {sql_first("intro", L.ACCEPT_TITLES)} is not null then null else 'No recognized data-role keyword' end],
  lambda x: x is not null) as rs from c)
select id, array_to_string(rs, ' | ') as reasons, len(rs) = 0 as accepted from r""")
def rule_filter_reasons(spark, d):
    posts = spark.createDataFrame(POSTS, "id int, title string, text string")
    docs = read(spark, d, "documents").select(F.col("doc_id") + 1000, F.substring("text", 1, 60), "text")
    return rules.judged(posts.union(docs)).select("id", F.array_join("reasons", " | ").alias("reasons"), "accepted")


@query(lambda: f"with t as (select lang, {sql_first('lower(text)', ['the', 'und', 'que'])} as keyword from documents) select lang, keyword, count(*) as n from t group by all")
def accept_reject_counts(spark, d):
    return read(spark, d, "documents").select("lang", text.first_keyword(F.lower("text"), ["the", "und", "que"]).alias("keyword")).groupBy("lang", "keyword").agg(F.count("*").alias("n"))


# ---- skills, classes

WORDS = [("article", "the"), ("article", "a"), ("linking", "and"), ("linking", "of the"), ("place", "in"), ("place", "in the"), ("deictic", "that"), ("symbol", "!!"), ("symbol", ", and")]
GROUPS = [("english", 0, "the"), ("english", 0, "of"), ("english", 0, "and"), ("german", 1, "der"), ("german", 1, "und"), ("german", 1, "die"), ("french", 2, "les"), ("french", 2, "que")]


def sql_runs(n):
    return "w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') as w from documents), g as (select doc_id, unnest(w) as alias from w " + " ".join(f"union all select doc_id, array_to_string(w[i:i + {k}], ' ') from w, range(1, len(w) - {k} + 1) t(i)" for k in range(1, n)) + ")"


#: What stands before and behind each occurrence decides whether it counts.
MENTIONS = "with " + values("x", "skill, alias", WORDS) + r""", s as (select doc_id, skill, alias, string_split(lower(text), alias) as p from documents join x on contains(lower(text), alias)),
k as (select doc_id, skill, len(list_filter(range(1, len(p)), lambda i: not regexp_matches(case when p[i] = '' and i > 1 then alias else p[i] end, '[\pL\pN\pM_]$') and not regexp_matches(case when p[i + 1] = '' and i + 1 < len(p) then alias else p[i + 1] end, '^[\pL\pN\pM_]'))) as n from s),
m as (select doc_id, skill, sum(n)::bigint as n from k where n > 0 group by 1, 2) """


def counted(spark, d):
    return skills.mentions(read(spark, d, "documents"), spark.createDataFrame(WORDS, "skill string, alias string"))


@query(MENTIONS + "select doc_id, skill, n from m")
def skill_mentions(spark, d):
    return counted(spark, d)


@query(MENTIONS + ", c as (select doc_id, sum(case when skill = 'article' then n else 0 end) as e, sum(case when skill = 'linking' then n else 0 end) as p, sum(n) as t from m group by 1) select doc_id, least(e * 20 + p * 15 + t * 2, 100)::double as confidence from c")
def skill_confidence(spark, d):
    wide = counted(spark, d).groupBy("doc_id").agg(F.sum(F.when(F.col("skill") == "article", F.col("n")).otherwise(0)).alias("e"), F.sum(F.when(F.col("skill") == "linking", F.col("n")).otherwise(0)).alias("p"), F.sum("n").alias("t"))
    zero = F.lit(0)
    return wide.select("doc_id", skills.confidence({"experience": F.col("e"), "project": F.col("p"), "summary": zero, "skills": zero, "certification": zero}, F.col("t")).alias("confidence"))


@query(MENTIONS + """, o as (select doc_id, list_sort(list(skill)) as own from m group by 1), a as (select ['article', 'deictic', 'place', 'rare'] as asked)
select doc_id, array_to_string(list_sort(list_filter(asked, lambda x: list_contains(own, x))), ',') as matched, array_to_string(list_sort(list_filter(asked, lambda x: not list_contains(own, x))), ',') as missing, floor(len(list_filter(asked, lambda x: list_contains(own, x))) * 100.0 / len(asked) * 100 + 0.5) / 100 as coverage from o, a""")
def skill_match_missing(spark, d):
    own = counted(spark, d).groupBy("doc_id").agg(F.collect_list("skill").alias("own"))
    o = skills.overlap(F.col("own"), F.array(*map(F.lit, ["article", "deictic", "place", "rare"])))
    return own.select("doc_id", F.array_join(o["matched"], ",").alias("matched"), F.array_join(o["missing"], ",").alias("missing"), o["coverage"].alias("coverage"))


@query("with " + values("x", "label, ord, term", GROUPS) + ", " + sql_runs(1) + """, n as (select label, min(ord) as o, count(*) as size from x group by 1),
s as (select doc_id, label, o, count(distinct term) * 100.0 / size as s from g join x on alias = term join n using (label) group by doc_id, label, o, size)
select doc_id, coalesce(label, 'english') as label, floor(coalesce(s, 0) * 100 + 0.5) / 100 as score from documents left join (select * from s qualify row_number() over (partition by doc_id order by s desc, o) = 1) using (doc_id)""")
def domain_classify(spark, d):
    return skills.votes(read(spark, d, "documents"), spark.createDataFrame(GROUPS, "label string, ord int, term string"))


OWNED = [(1, "Delta Live Tables"), (1, "python"), (2, "powercenter"), (2, "CDC"), (3, "dlt"), (3, " Tableau "), (4, "cooking"), (5, "adf"), (5, "kinesis")]
#: Skills that stand for words of the documents.
SPOKEN = {"that": "pyspark", "this": "dlt", "with": "emr", "que": "snowpipe", "les": "dynamic tables", "und": "ADF", "der": " powercenter", "the": "Tableau"}
CLOSURE = "with " + values("o0", "id, s", OWNED) + ", " + values("w", "word, skill", list(SPOKEN.items())) + ", o as (select * from o0 union all select doc_id + 1000, skill from documents join w on contains(text, ' ' || word || ' ')), " + values("edge", "src, dst", [(a, L.ALIASES.get(b, b)) for a, bs in L.ONTOLOGY.items() for b in bs]) + ", " + values("al", "alias, canon", list(L.ALIASES.items())) + """,
own as (select distinct id, coalesce(canon, lower(trim(s))) as skill from o left join al on alias = lower(trim(s))),
one as (select distinct id, dst as skill from own join edge on src = skill), two as (select distinct id, dst as skill from one join edge on src = skill),
f as (select id, skill, bool_or(e) as explicit from (select *, true as e from own union all select *, false from one union all select *, false from two) group by 1, 2) """


def inferred(spark, d):
    words = F.array(*(F.when(F.contains("text", F.lit(f" {w} ")), F.lit(s)) for w, s in SPOKEN.items()))
    docs = read(spark, d, "documents").select((F.col("doc_id") + 1000).alias("id"), F.explode(F.filter(words, lambda s: s.isNotNull())).alias("skill"))
    return skills.closure(spark.createDataFrame(OWNED, "id int, skill string").union(docs), *skills.ontology(spark))


@query(CLOSURE + "select id, skill, explicit from f")
def ontology_closure(spark, d):
    return inferred(spark, d)


@query(CLOSURE + ", " + values("ev", "ord, platform, skill", [(k, p, s) for k, (p, ss) in enumerate(L.PLATFORMS.items()) for s in ss]) + """, p as (select id, platform, ord, sum(case when explicit then 2.0 else 0.75 end) as points from f join ev using (skill) group by 1, 2, 3)
select id, platform, floor(least(55.0 + 45.0 * points / (sum(points) over (partition by id)), 100.0)::double * 100 + 0.5) / 100 as confidence from p qualify row_number() over (partition by id order by points desc, ord) = 1""")
def specialization(spark, d):
    return skills.specialization(inferred(spark, d), spark)


# ---- scores on a numeric grid

GRID = """with x as (select l_orderkey, l_linenumber, least(l_extendedprice / 1000, 100) as platform, (l_partkey % 101)::double as required, (l_suppkey * 7 % 101)::double as role, l_quantity * 2 as experience, l_discount * 1000 as preferred, l_tax * 1000 as achievement, (l_orderkey % 101)::double as complexity,
  (l_linenumber * 14)::double as semantic, (l_partkey * 3 % 101)::double as bm25, (l_suppkey % 101)::double as domain, 50.0::double as certification, (l_partkey % 26)::double as missing_required_penalty, (l_suppkey % 21)::double as role_mismatch_penalty, (l_orderkey % 16)::double as experience_penalty, (l_linenumber * 2)::double as platform_mismatch_penalty,
  (l_partkey % 7)::double as critical_skill_penalty, case when l_orderkey % 5 = 0 then 62.0 else 100.0 end::double as cap, l_returnflag <> 'N' as has_target from lineitem)"""


def grid(spark, d):
    c = lambda e: F.expr(e).cast("double")
    return read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", c("least(l_extendedprice / 1000, 100)").alias("platform"), c("l_partkey % 101").alias("required"), c("l_suppkey * 7 % 101").alias("role"), c("l_quantity * 2").alias("experience"), c("l_discount * 1000").alias("preferred"), c("l_tax * 1000").alias("achievement"), c("l_orderkey % 101").alias("complexity"),
        c("l_linenumber * 14").alias("semantic"), c("l_partkey * 3 % 101").alias("bm25"), c("l_suppkey % 101").alias("domain"), F.lit(50.0).alias("certification"), c("l_partkey % 26").alias("missing_required_penalty"), c("l_suppkey % 21").alias("role_mismatch_penalty"), c("l_orderkey % 16").alias("experience_penalty"), c("l_linenumber * 2").alias("platform_mismatch_penalty"),
        c("l_partkey % 7").alias("critical_skill_penalty"), F.when(F.col("l_orderkey") % 5 == 0, 62.0).otherwise(100.0).alias("cap"), (F.col("l_returnflag") != "N").alias("has_target"),
    )


def sql_weigh(w):
    return "(" + " + ".join(["0.0::double", *(f"{k} * {v!r}::double" for k, v in w.items())]) + ")"


FINAL = GRID + f""", y as (select *, case when has_target then {sql_weigh(L.PLATFORM_WEIGHTS)} else {sql_weigh(L.GENERIC_WEIGHTS)} end as w,
  {sql_weigh(L.PENALTY_WEIGHTS)} + case when has_target and platform < 80 then (80 - platform) * 0.22::double else 0 end + case when required < 55 then (55 - required) * 0.10::double else 0 end as pen,
  case when has_target and platform >= 72 and required >= 80 and role >= 90 then case when platform >= 86 and experience >= 70 then 10 else 8 end when not has_target and required >= 82 and role >= 85 then 4 else 0 end as bonus,
  case when has_target then 0.90::double + 0.10::double * least(greatest(least(platform, required, role) / 100, 0), 1) else 0.93::double + 0.07::double * least(greatest(least(required, role) / 100, 0), 1) end as gate from x),
z as (select *, floor(w * 100 + 0.5) / 100 as weighted, floor(pen * 100 + 0.5) / 100 as penalty, floor(least(greatest(least(cap, (w + bonus - pen) * gate), 0), 100) * 100 + 0.5) / 100 as final from y)
"""


def finals(spark, d):
    weighted, penalty, final = scoring.final_score(F.col("cap"), F.col("has_target"))
    return grid(spark, d).select("l_orderkey", "l_linenumber", weighted.alias("weighted"), penalty.alias("penalty"), final.alias("final"))


@query(FINAL + "select l_orderkey, l_linenumber, weighted, penalty, final from z")
def final_score(spark, d):
    return finals(spark, d)


@query(FINAL + "select case when final >= 85 then 'APPLY' when final >= 75 then 'STRONG MATCH' when final >= 65 then 'REVIEW' else 'LOW MATCH' end as recommendation, count(*) as n from z group by 1")
def recommendation_counts(spark, d):
    return finals(spark, d).groupBy(scoring.recommendation(F.col("final")).alias("recommendation")).agg(F.count("*").alias("n"))


@query("""
with x as (select l_orderkey, l_linenumber, l_quantity / 4 as own, (l_partkey % 16)::double as asked, l_suppkey % 10 as missing, (l_linenumber % 4 * 4) as total from lineitem)
select l_orderkey, l_linenumber, case when asked <= 0 then 75.0 when own >= asked then floor((90 + least((own - asked) * 2, 10)) * 100 + 0.5) / 100 else floor(90.0::double * (own / asked) * 100 + 0.5) / 100 end as experience_score,
 case when asked <= 0 or own >= asked then 0.0 when asked - own >= 5 then 15.0 when asked - own >= 3 then 10.0 when asked - own >= 1 then 5.0 else 2.0 end::double as experience_penalty,
 case when total = 0 or missing = 0 then 0.0 when missing / total >= 0.75 then 25.0 when missing / total >= 0.5 then 18.0 when missing / total >= 0.3 then 10.0 else 4.0 end::double as missing_penalty,
 case when own >= 12 then 'principal' when own >= 8 then 'lead' when own >= 5 then 'senior' when own >= 2 then 'mid' else 'junior' end as seniority from x""")
def experience_scores(spark, d):
    x = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 4).alias("own"), (F.col("l_partkey") % 16).cast("double").alias("asked"), (F.col("l_suppkey") % 10).alias("missing"), (F.col("l_linenumber") % 4 * 4).alias("total"))
    own, asked = F.col("own"), F.col("asked")
    return x.select("l_orderkey", "l_linenumber", scoring.experience_score(own, asked).alias("experience_score"), scoring.experience_penalty(own, asked).alias("experience_penalty"), scoring.missing_penalty(F.col("missing"), F.col("total")).alias("missing_penalty"), scoring.seniority(own).alias("seniority"))


# ---- reports over matches

MATCHES = [
    ("j1", "ann", 0, 82.5, ["spark", "sql"], ["kafka"], ["dbt"], [], ["cert a"]), ("j1", "bob", 1, 82.5, ["sql"], ["kafka", "spark"], [], ["dbt"], []), ("j1", "cat", 2, 90.0, ["kafka", "spark", "sql"], [], [], ["dbt"], ["cert a"]),
    ("j2", "ann", 0, 40.0, [], ["etl"], ["sql"], ["dbt"], []), ("j2", "bob", 1, 40.0, ["etl"], [], [], ["dbt", "sql"], []), ("j3", "bob", 1, 0.0, [], [], [], [], []),
]
COLS = ["job_id", "resume", "resume_ord", "score", "matched_required", "missing_required", "matched_preferred", "missing_preferred", "missing_certifications"]
ASKED, LIKED = ["that", "the", "und", "que"], ["with", "les", "von"]


def m_sql() -> str:
    have = lambda ws, no="": f"list_filter({lit(ws)}, lambda w: {no} contains(coalesce(text, ''), ' ' || w || ' '))"
    return "with " + values("m0", ", ".join(COLS), MATCHES) + f", m as (select job_id, resume, resume_ord, score::double as score, {', '.join(COLS[4:])} from m0 union all select 'b' || doc_id % 40, 'd' || doc_id, doc_id, (n_chars % 101)::double, {have(ASKED)}, {have(ASKED, 'not')}, {have(LIKED)}, {have(LIKED, 'not')}, [source]::varchar[] from documents)"


M = m_sql()
LABEL = "case when score >= 85 then 'APPLY' when score >= 75 then 'STRONG MATCH' when score >= 65 then 'REVIEW' else 'LOW MATCH' end"


def matches(spark, d):
    """Fixed matches, and every document against one of 40 jobs, matched by its words."""
    own = spark.createDataFrame(MATCHES, "job_id string, resume string, resume_ord int, score double, " + ", ".join(f"{c} array<string>" for c in COLS[4:]))
    i, held = F.col("doc_id"), lambda w: F.contains(F.coalesce("text", F.lit("")), F.concat(F.lit(" "), w, F.lit(" ")))
    have = lambda ws: F.filter(F.array(*map(F.lit, ws)), held)
    lack = lambda ws: F.filter(F.array(*map(F.lit, ws)), lambda w: ~held(w))
    docs = read(spark, d, "documents").select(F.concat(F.lit("b"), (i % 40).cast("string")), F.concat(F.lit("d"), i.cast("string")), i, (F.col("n_chars") % 101).cast("double"), have(ASKED), lack(ASKED), have(LIKED), lack(LIKED), F.array("source"))
    return own.union(docs)


@query(M + f" select job_id, resume, score::double as score, {LABEL} as recommendation, row_number() over (partition by job_id order by score desc, resume_ord) as rank from m")
def report_rankings(spark, d):
    return reports.rankings(matches(spark, d))


@query(M + f" select job_id, resume as best_resume, score::double as best_score, {LABEL} as recommendation, array_to_string(matched_required, ', ') as matched_required, array_to_string(missing_required, ', ') as missing_required, count(*) over (partition by job_id) as compared from m qualify row_number() over (partition by job_id order by score desc, resume_ord) = 1")
def report_summary(spark, d):
    return reports.summary(matches(spark, d))


@query(M + " select job_id, resume, unnest(missing_required) as skill, 'Required' as kind from m union all select job_id, resume, unnest(missing_preferred), 'Preferred' from m union all select job_id, resume, unnest(missing_certifications), 'Certification' from m")
def report_missing(spark, d):
    return reports.missing(matches(spark, d))


@query(M + """, f as (select * from m qualify row_number() over (partition by job_id order by score desc, resume_ord) = 1), r as (select distinct job_id, unnest(list_concat(matched_required, missing_required)) as skill from f), p as (select distinct job_id, unnest(list_concat(matched_preferred, missing_preferred)) as skill from f),
e as (select skill, 'r' as k from r union all select skill, 'p' from p union all select skill, 't' from (select * from r union select * from p) union all select skill, 'm' from (select distinct job_id, resume, unnest(list_concat(matched_required, matched_preferred)) as skill from m) union all select skill, 'x' from (select distinct job_id, resume, unnest(list_concat(missing_required, missing_preferred)) as skill from m))
select skill, count(*) filter (k = 'r') as required, count(*) filter (k = 'p') as preferred, count(*) filter (k = 't') as total_jobs, count(*) filter (k = 'm') as matched, count(*) filter (k = 'x') as missing from e group by skill""")
def report_skill_frequency(spark, d):
    return reports.skill_frequency(matches(spark, d))


@query(lambda: GRID + " select job_id, resume, component, component_score, weight, floor(component_score * weight * 10000 + 0.5) / 10000 as contribution from (" + " union all ".join(f"select l_orderkey as job_id, l_linenumber as resume, '{k}' as component, {k} as component_score, {v!r}::double as weight from x" for k, v in L.PLATFORM_WEIGHTS.items()) + ")")
def report_breakdown(spark, d):
    return reports.breakdown(grid(spark, d).withColumnsRenamed({"l_orderkey": "job_id", "l_linenumber": "resume"}))
