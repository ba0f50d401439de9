"""Scraped pages as tables: links, fields, crawls with an early stop; texts of files."""

from __future__ import annotations

import zipfile
from io import BytesIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import numbered


def links(pages: DataFrame, containing: list[str]) -> DataFrame:
    """page_id, link: distinct targets without query whose url contains one of the strings."""
    every = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    found = pages.select("page_id", F.explode(F.array_distinct(F.transform(every, lambda h: F.split_part(h, F.lit("?"), F.lit(1))))).alias("link"))
    wanted = F.lit(False)
    for c in containing:
        wanted = wanted | F.contains("link", F.lit(c))
    return found.where(wanted)


def fields(pages: DataFrame, patterns: dict[str, list[str]]) -> DataFrame:
    """page_id and for each field what the first of its patterns that matches something not blank finds, else ''."""
    first = lambda ps: F.coalesce(*(F.nullif(F.trim(F.regexp_extract("html", p, 1)), F.lit("")) for p in ps), F.lit(""))
    return pages.select("page_id", *(first(ps).alias(name) for name, ps in patterns.items()))


def crawled(found: DataFrame) -> DataFrame:
    """found (page_no, link): the links of pages before the first page that adds nothing new."""
    new = found.groupBy("link").agg(F.min("page_no").alias("page_no"))
    fresh = new.select("page_no").distinct().withColumn("fresh", F.lit(True))
    stop = found.select("page_no").distinct().join(fresh, "page_no", "left").where("fresh is null").agg(F.min("page_no").alias("stop")).scalar()
    return new.where(F.coalesce(F.col("page_no") < stop, F.lit(True)))


def page_url(url, page: int):
    """The url of another result page: its page number replaced, or appended."""
    sep = F.when(F.contains(url, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    return F.when(F.regexp_like(url, F.lit(r"page=\d+")), F.regexp_replace(url, r"page=\d+", f"page={page}")).otherwise(F.concat(url, sep, F.lit(f"page={page}")))


def read_texts(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, name, text of .txt, .tex and .docx files, other kinds with an error; lock files (~$) are left out.

    Files are ordered by lower-cased name and path in `ord`.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)

    def text(kind, content):
        if kind in ("txt", "tex"):
            return bytes(content).decode("utf-8", "ignore"), None
        if kind == "docx":
            return docx_text(bytes(content)), None
        return None, f"unsupported file type: .{kind}"

    def run(batches):
        import pandas as pd

        for b in batches:
            out = [text(str(p).rpartition(".")[2].lower(), c) for p, c in zip(b.path, b.content, strict=True)]
            yield pd.DataFrame({"path": b.path, "text": [x[0] for x in out], "error": [x[1] for x in out]})

    name = F.element_at(F.split("path", "/"), -1)
    rows = files.where(~F.element_at(F.split("path", "/"), -1).startswith("~$")).select("path", "content").mapInPandas(run, "path string, text string, error string")
    # names and paths alone are put in order; texts stay where they were read
    names = numbered(files.select("path").withColumn("name", name).where(~F.col("name").startswith("~$")), F.lower("name"), F.lower("path"), F.col("path"))
    return rows.join(names.select("path", "name", "ord"), "path")


def docx_text(content: bytes, tables: bool = True) -> str:
    """Paragraphs of a .docx file, then table rows with cells joined by ` | `."""
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    said = lambda x: "".join(t.text or "" for t in x.iter(f"{w}t"))
    lines = [said(p) for p in body.findall(f"{w}p")]
    if tables:
        lines += [" | ".join(said(c).strip() for c in row.findall(f"{w}tc")) for t in body.findall(f"{w}tbl") for row in t.findall(f"{w}tr")]
    return "\n".join(lines)
