"""Exports split by their links, urls of searches, lists of LaTeX templates, lines of résumés, patches and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import SPACE, all_in, any_in, odd_letters, once, round2, squeeze, stripped
from .evidence import posting_id, posting_title, posting_url
from .postings import looks_like_posting


def bare(text: Column) -> Column:
    return stripped(text, space=SPACE)


def places(text: Column, pattern: str) -> Column:
    """Where matches of a pattern begin, from 0 and in order; what lies between matches tells it."""
    steps = lambda found: F.zip_with(F.slice(F.split(text, pattern), 1, F.size(found)), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size")))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("at"))
    walk = lambda acc, s: F.struct((acc["end"] + s["gap"] + s["size"]).alias("end"), F.array_append(acc["at"], acc["end"] + s["gap"]).alias("at"))
    at = lambda found: F.when(F.size(found) == 0, F.array().cast("array<int>")).otherwise(F.aggregate(steps(found), start, walk, lambda acc: acc["at"]))
    return once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), at)


def chunks(text: Column, starts: Column) -> Column:
    """The text from each start to the next one or the end, without blank ones; the whole text where starts are less than two."""
    part = lambda s, i: bare(F.substring(text, s + 1, F.coalesce(F.get(starts, i + 1), F.length(text)) - s))
    return F.when(F.size(starts) < 2, F.array(text)).otherwise(F.filter(F.transform(starts, part), lambda c: c != ""))


def posting_start(text: Column, url_at: Column) -> Column:
    """The first of the last header lines of each kind in the 1200 characters before a link, else the start of its line."""
    begin = F.greatest(url_at - 1200, F.lit(0))
    prefix = F.substring(text, begin + 1, url_at - begin)
    last = lambda h: F.when(F.regexp_like(prefix, F.lit(rf"(?imdU)^{h}")), begin + F.length(F.regexp_extract(prefix, rf"(?imsdU)\A(.*)^{h}", 1)))
    line = url_at - F.length(F.substring_index(F.substring(text, F.lit(1), url_at), "\n", -1))
    return F.coalesce(F.least(*map(last, L.POSTING_HEADS)), line)


def split_by_links(blobs: DataFrame) -> DataFrame:
    """blob_id, part, title, company, location, url, job_id, text of the postings of an export (blob_id, text).

    Parts begin at portal links (at any links where portal links are less than two), each pulled back to its header;
    without two such parts at marker lines. Parts that don't look like postings and those that repeat link, id and title
    are left out; where none is left, and where nothing splits, the whole text is one part. Null and blank: none.
    A pattern is tried only on texts that hold words which it needs.
    """
    text = F.coalesce("text", F.lit(""))
    clean = bare(F.regexp_replace(F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text), "\n{4,}", "\n\n\n"))
    x, nowhere = F.col("_x"), F.array().cast("array<int>")
    rows = blobs.where(bare(text) != "").select("blob_id", clean.alias("_x")).withColumn("_low", F.lower("_x"))
    linked = F.contains(x, F.lit("://"))
    rows = rows.withColumn("_u", F.when(linked, places(x, L.PORTAL_LINK)).otherwise(nowhere)).withColumn("_u", F.when(linked & (F.size("_u") < 2), places(x, L.ANY_LINK)).otherwise(F.col("_u")))
    rows = rows.withColumn("_s", F.transform("_u", lambda u: posting_start(x, u)))
    rising = F.filter("_s", lambda s, i: (i == 0) | (s > F.array_max(F.slice("_s", 1, F.greatest(i, F.lit(1))))))
    rows = rows.withColumn("_r", rising).withColumn("_c", chunks(x, F.col("_r")))
    marks = F.array_sort(F.array_distinct(F.flatten(F.array(*(F.when(all_in(F.col("_low"), ws), places(x, p)).otherwise(nowhere) for p, ws in zip(L.POSTING_MARKERS, L.MARKER_WORDS, strict=True))))))
    rows = rows.withColumn("_m", marks).withColumn("_c", F.when(F.size("_c") <= 1, chunks(x, F.col("_m"))).otherwise(F.col("_c")))

    def fields(t: Column) -> Column:
        filled = lambda v: F.when(v != "", v)
        value = lambda n: once(bare(F.regexp_extract(t, rf"(?imdU)^\s*{n}\s*[:\-]\s*(.+?)\s*$", 1)), filled)

        def of(low: Column) -> Column:
            labelled = lambda word, names: F.when(any_in(low, [word]) | odd_letters(low), F.coalesce(*map(value, names)))
            title = F.coalesce(labelled("title", [r"job\s*title", r"position\s*title", "title"]), posting_title(t))
            company = F.coalesce(labelled("company", ["company"]), labelled("employer", ["employer"]), F.lit(""))
            named = {"title": title, "company": company, "location": F.coalesce(labelled("location", ["location"]), F.lit("")), "url": posting_url(t), "job_id": posting_id(t), "text": t}
            return F.struct(*(c.alias(k) for k, c in named.items()))

        return once(F.lower(t), of)

    postings = F.when(F.size("_c") > 1, F.filter("_c", looks_like_posting)).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("_p", F.transform(postings, fields))
    key = lambda p: F.struct(F.lower(p["url"]), F.lower(p["job_id"]), squeeze(F.lower(p["title"])))
    rows = rows.withColumn("_k", F.transform("_p", key))
    fresh = F.filter("_p", lambda p, i: F.array_position(F.col("_k"), key(p)) == i + 1)
    split = (F.size("_c") > 1) & (F.size("_p") > 0)
    rows = rows.withColumn("_p", F.when(split, fresh).otherwise(F.array(fields(x))))
    # there is always a part; an inner explode would have Spark infer a filter on parts and compute all columns anew below it
    return rows.select("blob_id", F.posexplode_outer("_p").alias("part", "_f")).select("blob_id", "part", "_f.*")


def pairs_of(url: Column) -> Column:
    """Keys and values of a url's query, decoded; pairs without a value are left out."""
    asked = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    plain = lambda p: F.coalesce(F.try_url_decode(p), p)
    every = F.transform(F.split(asked, "&"), lambda p: F.struct(plain(F.substring_index(p, "=", 1)).alias("k"), plain(F.regexp_extract(p, "=(.*)$", 1)).alias("v")))
    return F.filter(every, lambda p: p["v"] != "")


def search_keyword(url: Column, keys: list[str], default: str) -> Column:
    """The first value of the first of these keys that the url's query has, else the default."""
    found = pairs_of(url)
    first = lambda k: F.get(F.filter(found, lambda p: p["k"] == k), F.lit(0))["v"]
    return F.coalesce(*map(first, keys), F.lit(default))


def with_page(url: Column, page: int) -> Column:
    """The url with its query written anew, values of a key together, and the page's number set."""
    coded = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    found = pairs_of(url)
    keys = F.array_distinct(F.concat(F.transform(found, lambda p: p["k"]), F.array(F.lit("page"))))
    said = lambda k: F.when(k == "page", F.array(F.lit(f"page={page}"))).otherwise(F.transform(F.filter(found, lambda p: p["k"] == k), lambda p: F.concat(coded(k), F.lit("="), coded(p["v"]))))
    query = F.array_join(F.flatten(F.transform(keys, said)), "&")
    return F.concat(F.regexp_extract(url, r"^[^?#]*", 0), F.lit("?"), query, F.regexp_extract(url, "#.+$", 0))


def itemized(text: Column, behind: str) -> Column:
    """Items of the first itemize list behind a pattern, squeezed; null where there is none. An item ends where a line
    begins with the next item or with the list's end."""
    pattern = rf"(?s)(?i:{behind}).*?\\begin\{{itemize\}}(.*?)\\end\{{itemize\}}"
    inner = F.regexp_extract(text, pattern, 1)
    items = F.split(F.regexp_extract(inner, r"(?s)\\item\s+(.*)$", 1), r"\n\s*\\item\s+")
    items = F.when(F.regexp_like(inner, F.lit(r"\n\s*\z")), items).otherwise(F.slice(items, 1, F.size(items) - 1))
    items = F.when(F.contains(inner, F.lit("\\item")), F.transform(items, squeeze)).otherwise(F.array().cast("array<string>"))
    return F.when(F.regexp_like(text, F.lit(pattern)), items)


def template_sections(text: Column) -> dict[str, Column]:
    """summary, skills_block, experience_1, experience_2 of a LaTeX résumé; null where a part isn't found."""
    duties = r"\\textbf\{Responsibilities:\}"
    work = r"\\section\*\{PROFESSIONAL EXPERIENCE:\}"
    skills = r"(?is)\\section\*\{TECHNICAL SKILLS:\}.*?\\end\{longtable\}"
    rest = F.regexp_extract(text, rf"(?s){work}.*?\\end\{{itemize\}}(.*)$", 1)
    return {"summary": itemized(text, r"\\section\*\{PROFESSIONAL SUMMARY:\}"), "skills_block": F.nullif(F.regexp_extract(text, skills, 0), F.lit("")), "experience_1": itemized(text, rf"{work}.*?{duties}"), "experience_2": itemized(rest, duties)}


def line_kind(line: Column) -> Column:
    """heading, bullet, dated (dates, roles, clients), contact or text; blank lines are blank. Lines come squeezed."""
    low = F.lower(line)
    name = F.trim(F.rtrim(low, F.lit(":")))
    capital = (F.upper(line) == line) & (low != line) & F.size(F.split(line, " ")).between(2, 6) & (F.length(line) <= 60)
    begins = lambda starts: reduce(lambda a, s: a | F.startswith(line, F.lit(s)), starts, F.lit(False))
    dated = F.regexp_like(low, F.lit(L.DATED_LINE))
    contact = F.contains(line, F.lit("@")) | F.contains(low, F.lit("linkedin.com")) | F.regexp_like(line, F.lit(r"\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b"))
    return F.when(line == "", "blank").when(name.isin(L.LINE_HEADINGS) | capital, "heading").when(begins(L.BULLETS), "bullet").when(dated, "dated").when(contact, "contact").otherwise("text")


def joined_lines(rows: DataFrame) -> DataFrame:
    """id, n, line of rows (id, text): lines with wrapped text joined; n numbers what comes out of a text.

    Text goes on from the text or contact line before it, which a blank, heading, bullet or dated line ends. Lines are
    exploded once; a line that begins something new raises a running number, and lines of one number are one.
    """
    lines = rows.select("id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "raw")).select("id", "at", squeeze(F.col("raw")).alias("line"))
    own = Window.partitionBy("id").orderBy("at")
    kinds = lines.withColumn("kind", line_kind(F.col("line"))).withColumn("before", F.lag("kind").over(own))
    goes_on = (F.col("kind") == "text") & F.coalesce(F.col("before").isin("text", "contact"), F.lit(False))
    parts = kinds.withColumn("n", F.sum(F.when(goes_on, 0).otherwise(1)).over(own))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), " ")
    return parts.groupBy("id", "n").agg(whole.alias("line"))


def merged_patch(parts: list[Column]) -> Column:
    """Generated lists one behind another; a missing one is empty."""
    return F.concat(*(F.coalesce(p, F.array().cast("array<string>")) for p in parts))


def scored_rows(rows: DataFrame, key: str, score: str, needed: list[str], least: float, most: float) -> DataFrame:
    """Rows of a report's sheet, cells trimmed, with a number as score from `least` to below `most`; those without a key
    or a number go. A missing column is an error."""
    if absent := [c for c in needed if c not in rows.columns]:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    cells = rows.select(*(bare(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in needed))
    cells = cells.withColumn(score, F.col(score).try_cast("double"))
    return cells.where((F.col(key) != "") & (F.col(score) >= least) & (F.col(score) < most))


def said_duration(seconds: Column) -> Column:
    """`2.50 seconds`, `3 minutes 1.00 seconds`, `1 hours 2 minutes 3.00 seconds`; below zero counts as zero."""
    s = F.greatest(seconds.cast("double"), F.lit(0.0))
    rest, minutes = F.pmod(s, F.lit(60.0)), F.floor(s / 60)
    return F.when(s < 60, F.format_string("%.2f seconds", s)).when(minutes < 60, F.format_string("%d minutes %.2f seconds", minutes, rest)).otherwise(F.format_string("%d hours %d minutes %.2f seconds", F.floor(minutes / 60), F.pmod(minutes, F.lit(60)), rest))


def result_name(given: Column, at: Column) -> Column:
    """A report's file name: the given one, else one with the time; `.xlsx` is added where it is missing."""
    name = F.trim(F.coalesce(given, F.lit("")))
    name = F.when(name == "", F.concat(F.lit("ATS_Result_"), F.date_format(at, "yyyyMMdd_HHmmss"))).otherwise(name)
    return F.when(F.endswith(F.lower(name), F.lit(".xlsx")), name).otherwise(F.concat(name, F.lit(".xlsx")))


def platform_alignment(share: Column, own: Column, asked: Column, penalty: Column) -> dict[str, Column]:
    """platform_score, platform_penalty and core_bonus from the share of core skills held (null: no core skills, which is
    neutral), the platform a résumé is of and the one asked for, and the penalty so far."""
    score = round2(share * 100.0)
    known = (F.coalesce(own, F.lit("")) != "") & (F.coalesce(asked, F.lit("")) != "")
    strange = known & (own != asked) & asked.isin(L.STRICT_PLATFORMS)
    score = F.when(known & (own == asked), F.greatest(score, F.lit(95.0))).when(strange, F.least(score, F.lit(45.0))).otherwise(score)
    so_far = F.when(strange, F.greatest(penalty, F.lit(8.0))).otherwise(penalty)
    lost = F.when(score / 100 < 0.20, 18.0).when(score / 100 < 0.40, 10.0).otherwise(so_far)
    core = share.isNotNull()
    return {"platform_score": F.when(core, score).otherwise(50.0), "platform_penalty": F.when(core, lost).otherwise(penalty), "core_bonus": F.when(core & (score / 100 >= 0.80), 4.0).otherwise(0.0)}
