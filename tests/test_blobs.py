"""Exports split by format, against a plain loop over them."""

import random
import re

from rankloom.functions import lexicon as L
from rankloom.operators import blobs
from rankloom.plans import blob_catalog


def parts(text):
    text = (text or "").replace("\r\n", "\n").replace("\r", "\n").strip()
    if not text:
        return []
    start, end = re.compile(L.BLOB_START), re.compile(r"(?im)^\s*(?:={5,}\s*)?JOB\s+END(?:\s*={5,})?\s*$")
    out, pos = [], 0
    if start.search(text):
        while m := start.search(text, pos):
            e = end.search(text, m.end())
            out.append(text[m.end() : e.start() if e else len(text)].strip())
            pos = e.end() if e else len(text)
        return [x for x in out if x]
    for pattern, dice in ((r"(?m)^Job\s+\d+\s*$", True), (r"(?im)^\s*Processing\s*:\s*.*$", False)):
        marks = [m.start() for m in re.finditer(pattern, text)]
        if marks:
            for a, b in zip(marks, [*marks[1:], len(text)], strict=True):
                chunk = text[a:b].strip()
                if dice:
                    for stop in ("Similar Jobs", "Technology Professionals", "Dice Id"):
                        chunk = re.split(rf"(?im)^{stop}.*$", chunk, maxsplit=1)[0]
                    chunk = re.sub(r"\n{3,}", "\n\n", chunk).strip()
                out.append(chunk)
            return [x for x in out if x]
    ruled = [x.strip() for x in re.split(r"(?m)^\s*={20,}\s*$", text) if x.strip()]
    return ruled if len(ruled) > 1 else [text]


def test_formats_equal_a_loop(spark):
    rng = random.Random(12)
    kinds = [["JOB START", "job end", "===== JOB START =====", "x", "", "Job 1"], ["Job 1", "Job 22 ", "Similar Jobs", "dice id 5", "", "a b", "technology professionals"], ["Processing: x", " processing :", "Processing: 7", "y", ""], ["=" * 20, "=" * 25, "z", "", "zz"], ["plain", "", "text"]]
    rows = [(k, "\n".join(rng.choice(kinds[k % 5]) for _ in range(rng.randrange(0, 14)))) for k in range(400)] + [(i + 1000, t) for i, t in blob_catalog.EXPORTS]
    got = {r.blob_id: r.ps for r in spark.createDataFrame(rows, "blob_id int, text string").select("blob_id", blobs.postings_in(blobs.F.col("text")).alias("ps")).collect()}
    assert got == {k: parts(t) for k, t in rows}


def test_fields_of_postings(spark):
    got = {(r.blob_id, r.part): r for r in blobs.split_blobs(spark.createDataFrame(blob_catalog.EXPORTS, "blob_id int, text string")).collect()}
    assert (got[1, 0].title, got[1, 0].company, got[1, 0].link, got[1, 0].url) == ("One a", "Bank", "https://x.example/1?a=2", "https://x.example/1?a=2")
    assert (got[1, 1].company, got[1, 1].location) == ("Mill", "Leeds") and got[2, 0].title == "Title of one" and got[2, 1].title == "two"
    assert [got[3, k].title for k in range(3)] == ["Data Engineer", "processing : job 7", "next line"] and got[3, 0].link == "not a link"
    assert got[4, 1].title == "second title" and got[5, 0].title == "just one" and (6, 0) not in got and got[8, 0].title == "Unknown"
