"""Exports of several postings: fixed ones of each format, and all documents."""

from __future__ import annotations

from ..functions import lexicon as L
from ..operators import blobs
from .catalog import lit, query, texts, texts_sql

EXPORTS = [
    (1, "intro\n===== JOB START =====\nJob Title: One  a\nCompany - Bank\nLink: see https://x.example/1?a=2 now\nJOB END\nbetween\n\n  job  start\nEmployer: Mill\nLocation:\tLeeds\nJOB START\nnested\n===== JOB END\nJOB START\n\nJOB END\njob start\nlast without end https://y.example"),
    (2, "before\nJob 1\nTitle of one\nhttps://z.example/2\n\n\n\n\nbody\nSimilar Jobs near you\ngone\nJob 2 \nPosition: two\nDice Id : x\ngone\nJob 3\n\nTechnology Professionals\n"),
    (3, "Processing: Data Engineer\nJob URL: not a link\nbody\n processing : job 7\nplain title\nmore\nProcessing:\nnext line"),
    (4, "first\n" + "=" * 20 + "\n \n" + "=" * 30 + "\nhttps://only.example/x\ncompany: c\n" + "t" * 181 + "\nsecond title"),
    (5, "just one\r\nposting\rhere"), (6, " \n "), (7, None), (8, "url: u\nlink: l"), (9, "=" * 25 + "\nonly\n" + "=" * 25),
]


def blob_sql() -> str:
    strip = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    squeeze = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    full = lambda xs: f"list_filter(list_transform({xs}, lambda p: {strip('p')}), lambda p: p <> '')"
    behind = lambda pattern: f"string_split(regexp_replace(w, {lit(pattern)}, chr(1) || '\\1', 'g'), chr(1))[2:]"
    cut = strip("p")
    for c in L.BLOB_CUTS:
        cut = f"regexp_replace({cut}, {lit(c)}, '')"
    numbered = full(f"list_transform({behind(L.BLOB_NUMBER)}, lambda p: regexp_replace({cut}, '\\n{{3,}}', chr(10) || chr(10), 'g'))")
    has = lambda p: f"regexp_matches(w, {lit(p)})"
    label = lambda names: "coalesce(" + ", ".join(f"nullif({squeeze(f'''regexp_extract(text, '(?im)^\\s*{n}\\s*[:\\-]\\s*(.+?)\\s*$', 1)''')}, '')" for n in names) + ", '')"
    link = lambda x: f"regexp_extract({x}, '(?i)https?://[^\\s<>\"]+')"
    told = squeeze(f"regexp_extract(regexp_extract(text, {lit(L.BLOB_PROCESSING)}, 1), '(?s)^[^:]*:(.*)$', 1)")
    ignored = " or ".join(f"starts_with(lower(x), {lit(p)})" for p in L.BLOB_IGNORED)
    lines = f"list_filter(list_transform(string_split_regex(text, '\\r\\n|[\\n\\x0b\\x0c\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {squeeze('x')}), lambda x: x <> '' and not ({ignored}) and not regexp_matches(x, '(?i)^https?://[^\\s<>\"]+$') and length(x) <= 180)"
    return f"""with {texts_sql("v", "blob_id, t", EXPORTS)},
w as (select blob_id, {strip("replace(replace(coalesce(t, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))")} as w from v),
r as (select *, {full(f"string_split_regex(w, {lit(L.BLOB_RULE)})")} as ruled from w),
p as (select blob_id, case when w = '' then [] when {has(L.BLOB_START)} then {full(f"regexp_extract_all(w, {lit(L.BLOB_BETWEEN)}, 1)")} when {has(L.BLOB_NUMBER)} then {numbered} when {has(L.BLOB_PROCESSING)} then {full(behind(L.BLOB_PROCESSING))} when len(ruled) > 1 then ruled else [w] end as ps from r),
e as (select blob_id, (i - 1)::int as part, ps[i] as text from p, range(1, len(ps) + 1) t(i)),
f as (select *, {label(["Job Title", "Title", "Job Name", "Position"])} as titled, {told} as told, {label(["Job URL", "URL", "Link", "Job Link"])} as given, {label(["Company", "Company Name", "Employer"])} as company, {label(["Location", "Job Location"])} as location from e)
select blob_id, part, case when titled <> '' then titled when told <> '' and not regexp_matches(told, '(?i)^(?:job\\s*)?\\d+$') then told else coalesce({lines}[1], 'Unknown') end as title, company, location, case when given = '' then {link("text")} else coalesce(nullif({link("given")}, ''), given) end as link, text from f"""


@query(blob_sql)
def posting_blobs(spark, d):
    """FS9, FS5."""
    return blobs.split_blobs(texts(spark, d, EXPORTS, "blob_id int, text string")).drop("url")
