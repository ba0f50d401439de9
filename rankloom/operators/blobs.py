"""Exports of several postings in one text: split by the first format that fits, and the fields of each posting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import squeeze, url_key
from .pairs import strings

MARK = "\x01"


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def postings_in(text: Column) -> Column:
    """The postings of a text, in order. Formats: start and end lines; `Job N` lines, cut at what a portal adds;
    `Processing:` lines; rules of equal signs; else the whole text. A blank text has none.
    """
    whole = stripped(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))
    full = lambda parts: F.filter(F.transform(parts, stripped), lambda p: p != "")
    behind = lambda pattern: F.slice(F.split(F.regexp_replace(whole, pattern, f"{MARK}$1"), MARK), 2, 1 << 30)
    between = full(F.regexp_extract_all(whole, F.lit(L.BLOB_BETWEEN), F.lit(1)))
    cut = lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(p, L.BLOB_CUTS[0], ""), L.BLOB_CUTS[1], ""), L.BLOB_CUTS[2], "")
    numbered = full(F.transform(behind(L.BLOB_NUMBER), lambda p: F.regexp_replace(cut(stripped(p)), r"\n{3,}", "\n\n")))
    ruled = full(F.split(whole, L.BLOB_RULE))
    fits = lambda p: F.regexp_like(whole, F.lit(p))
    many = F.when(fits(L.BLOB_START), between).when(fits(L.BLOB_NUMBER), numbered).when(fits(L.BLOB_PROCESSING), full(behind(L.BLOB_PROCESSING))).when(F.size(ruled) > 1, ruled).otherwise(F.array(whole))
    return F.when(whole == "", F.array().cast("array<string>")).otherwise(many)


def labelled(text: Column, labels: list[str]) -> Column:
    """What stands behind the first of these labels that begins a line, else empty."""
    found = lambda label: F.nullif(squeeze(F.regexp_extract(text, rf"(?imd)^\s*\Q{label}\E\s*[:\-]\s*(.+?)\s*$", 1)), F.lit(""))
    return F.coalesce(*map(found, labels), F.lit(""))


def titled(text: Column) -> Column:
    """The labelled title, else what is being processed (unless a number), else the first line that is no label, link or longer than 180 characters, else `Unknown`."""
    told = squeeze(F.regexp_extract(F.regexp_extract(text, L.BLOB_PROCESSING, 1), r"(?s)^[^:]*:(.*)$", 1))
    number = F.regexp_like(told, F.lit(r"(?i)^(?:job\s*)?\d+$"))
    lines = F.filter(F.transform(F.split(text, r"\R"), squeeze), lambda x: x != "")
    plain = F.filter(lines, lambda x: ~F.exists(strings(L.BLOB_IGNORED), lambda p: F.startswith(F.lower(x), p)) & ~F.regexp_like(x, F.lit(r"(?i)^https?://[^\s<>\"]+$")) & (F.length(x) <= 180))
    label = labelled(text, ["Job Title", "Title", "Job Name", "Position"])
    return F.when(label != "", label).when((told != "") & ~number, told).otherwise(F.coalesce(F.get(plain, F.lit(0)), F.lit("Unknown")))


def split_blobs(blobs: DataFrame) -> DataFrame:
    """blob_id, part (from 0), title, company, location, link, url (canonical), text of every posting in blobs (blob_id, text)."""
    rows = blobs.select("blob_id", F.posexplode(postings_in(F.col("text"))).alias("part", "text"))
    text, link = F.col("text"), lambda x: F.regexp_extract(x, r"(?i)https?://[^\s<>\"]+", 0)
    given = labelled(text, ["Job URL", "URL", "Link", "Job Link"])
    rows = rows.select(
        "blob_id", "part", titled(text).alias("title"), labelled(text, ["Company", "Company Name", "Employer"]).alias("company"), labelled(text, ["Location", "Job Location"]).alias("location"),
        F.when(given == "", link(text)).otherwise(F.coalesce(F.nullif(link(given), F.lit("")), given)).alias("link"), "text",
    )
    return rows.withColumn("url", url_key(F.col("link")))
