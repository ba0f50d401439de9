"""Parsed postings and skills by section against plain loops over lines and characters."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rankloom.functions import lexicon as L
from rankloom.operators import containment, parsing, rule_table
from rankloom.plans import parsing_catalog as C
from rankloom.plans import rule_catalog


def header(line):
    line = re.sub(r"[:\-–—]+$", "", line.strip().lower())
    return " ".join(re.sub(r"[^a-z0-9\s']", " ", line).split())


def sections(text):
    """A state machine over lines, once for each section."""
    keys = {n: {header(h) for h in hs} for n, hs in L.POSTING_SECTIONS.items()}
    out = {}
    for name, own in keys.items():
        body = None
        for line in text.split("\n"):
            k = header(line)
            if body is None:
                body = [] if k in own else None
            elif k not in own and any(k in o for o in keys.values()):
                break
            else:
                body.append(line)
        if body is not None:
            out[name] = "\n".join(body).strip()
    return out


def test_sections_equal_a_state_machine(spark):
    rng = random.Random(5)
    lines = ["Required Skills:", "nice-to-have --", "Responsibilities", "About the Role", "requirements", "- that", "", "  two  words ", "Qualifications!", "overview:::", "must have SKILLS", "what you'll do", "text"]
    rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 30)))) for k in range(300)]
    got = {r.id: r.s for r in spark.createDataFrame(rows, "id int, text string").select("id", parsing.sections(C.F.col("text"), L.POSTING_SECTIONS).alias("s")).collect()}
    assert got == {k: sections(t) for k, t in rows}


@pytest.mark.parametrize("text, want", [
    ("3-5 years of x and 9 years", (3.0, 5.0)), ("at least 4+ years of professional experience, 12 years", (4.0, 4.0)), ("12 years, 40 years, 2.5 yrs", (12.0, 12.0)), ("none", (0.0, 0.0)), ("40 years", (0.0, 0.0)), ("2 to 3.5+ yrs", (2.0, 3.5)), (None, (0.0, 0.0)),
])
def test_experience_range(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(*(c.alias(n) for n, c in zip("ab", parsing.experience_range(C.F.col("t")), strict=True))).first()
    assert (row.a, row.b) == want


def test_columns_of_a_posting(spark):
    assert len(parsing.posting_columns()) == 24
    row = {r.id: r for r in parsing.parse_postings(C.postings(spark, "/root/testdata/sf0.001").where("id < 0"), C.LEXICON, C.NAMES, "id").collect()}[-1]
    assert (row.url, row.job_id, row.company, row.seniority, row.minimum_experience) == ("https://jobs.example/1?a=b", "AB-12/x", "Acme", "Senior", 5.0)
    assert row.summary == "We need that and this." and row.responsibilities == "run that for us" and "Similar" not in row.raw_text
    assert "que" in row.preferred_skills and "that" in row.required_skills and row.mandatory_requirements == ["Required Skills:", "must have this thing", "Required Skills"]


def brute_years(text, aliases, unit="(?:years|yrs)"):
    spots = [m.start() for a in aliases for m in re.finditer(rf"(?<!\w){re.escape(a)}(?!\w)", text, re.I)]
    found = [float(v) for p in spots for v in re.findall(rf"(\d+(?:\.\d+)?)\+?\s*{unit}", text[max(0, p - 150) : p + 150], re.I)]
    return max(found, default=None)


def test_years_near_mentions(spark):
    rng = random.Random(8)
    bits = ["that ", "This thing ", "thatx ", "12 years ", "3.25+yrs ", "7 years", "1 ", "x" * 40, " ", "\n", "140.75 yrs ", ".5 years "]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 60)))) for k in range(400)] + [(400, None), (401, "")]
    aliases = {"that": ["that"], "this": ["this", "this thing"]}
    got = {(r.id, r.skill): r.years for r in parsing.years_near(spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame([(s, a) for s, xs in aliases.items() for a in xs], "skill string, alias string")).collect()}
    want = {(k, s): y for k, t in rows for s, xs in aliases.items() if (y := brute_years(t or "", xs)) is not None}
    assert got == want and len(want) > 200


def test_skills_by_section(spark):
    aliases = spark.createDataFrame([(s, a) for s, ns in C.NAMES.items() for a in ns], "skill string, alias string")
    rows = spark.createDataFrame(C.RESUMES, "id long, summary string, experience string, projects string, skills string, certifications string")
    got = {(r.id, r.skill): r for r in parsing.section_skills(rows, aliases).collect()}
    one = got[-1, "that"]  # `that thing` counts as itself and as `that`
    assert (one.summary, one.experience, one.projects, one.skills, one.certifications, one.frequency) == (1, 3, 2, 1, 1, 8)
    assert one.confidence == 100.0 and one.primary and one.years == 12.5
    assert not any(s == "task" for _, s in got) and not got[-3, "this"].primary and (-4, "that") not in got


def test_containment_equals_all_pairs(spark):
    rng = random.Random(2)
    texts = [(k, "".join(rng.choice("ab é\n😀c") for _ in range(rng.randrange(0, 60)))) for k in range(200)] + [(200, None), (201, ""), (7, "ab")]
    needles = [(k, t[1][a : a + n] if t[1] else t[1]) for k, t in enumerate(texts[:120]) for a, n in [(rng.randrange(0, 9), rng.choice([0, 1, 2, 3, 5, 8, 9, 20]))]] + [(500, None), (501, "zzz"), (502, "ab")]
    own, all_ = spark.createDataFrame(needles, "needle_id long, needle string"), spark.createDataFrame(texts, "text_id long, text string")
    found = containment.contained(own, all_)
    want = sorted({(i, j) for i, n in needles if n for j, t in texts if t and n in t})
    assert sorted({(r.needle_id, r.text_id) for r in found.collect()}) == want and len(want) > 500
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert containment.contained(own.limit(0), all_).count() == 0


def test_words_of_rules_end_where_ascii_does(spark):
    rules = rule_table.rule_table(spark, [("v", "citizenship", 0, r"\bund\s+die\b"), ("v", "experience", 0, r"\b1\d years\b"), ("v", "around", 0, "6"), ("v", "wished", 0, "plus"), *(("v", f"label:{k}", 0, k + ": ") for k in ("citizenship", "experience", "role", "unknown"))])
    rows = spark.createDataFrame([(1, "t", "so und die\u00f6te"), (2, "t", "so und dieote"), (3, "t", "\U0001f600" * 8 + "a plus 12 years")], "id int, title string, text string")
    found = {r.id: r.reasons for r in rule_table.judged_by(rows, rules).collect()}
    assert found[1] == ["citizenship: und die", "role: unknown: "] and found[2] == ["role: unknown: "]
    assert found[3] == ["role: unknown: "]  # places are counted in characters: `plus` is near


def test_rule_versions_differ_where_they_should(spark):
    rules = rule_table.rule_table(spark, [r for v in ("current", "former") for r in rule_table.published(v)])
    rows = spark.createDataFrame([(i, t, x) for i, t, x in [*rule_catalog.POSTS, *rule_catalog.MORE_POSTS]], "id long, title string, text string")
    found = rule_table.judged_by(rows, rules)
    assert "Join" in found._jdf.queryExecution().executedPlan().toString() and found.count() == 2 * rows.count()
    got = {(r.id, r.version): r.reasons for r in found.collect()}
    assert got[10, "current"] == ["Citizenship/Visa: gc only", "Non Data Role: Irrelevant title keyword: servicenow"]
    assert got[10, "former"] == ["USC/GC or no-sponsorship requirement: gc only", "Non-data role: Irrelevant title keyword: servicenow"]
    assert got[11, "current"] == [] and got[11, "former"] == ["10+ years experience: 12 years"]  # 100 and 90 characters around
    assert got[12, "current"][0].startswith("10+ years required: 15 yrs") and got[12, "former"][0] == "USC/GC or no-sponsorship requirement: visa sponsorship is not available"
    assert got[13, "current"] == [] and got[13, "former"] == ["10+ years experience: 20 years"]


def test_global_order_has_no_single_task(spark):
    from pyspark.sql import functions as F

    from rankloom.operators.ordering import numbered

    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), "id").repartition(6)
    found = numbered(rows, F.col("v"))
    assert [r.v for r in found.orderBy("ord").collect()] == list(range(5000)) and {r["ord"] for r in found.collect()} == set(range(1, 5001))
    plan = numbered(rows, F.col("v"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") == 1 and "rangepartitioning" not in plan  # of tasks' counts; the rows are dealt already


def test_nested_text(spark):
    from rankloom.operators import nested

    deep = "1"
    for k in range(40):
        deep = f'{{"k{k}": {deep}}}'
    rows = [(1, '{"b": [true, 1.5], "title": "t", "text": "first"}'), (2, deep), (3, "[1]]"), (4, "1, 2"), (5, None), (6, ""), (7, "[]"), (8, '{"a": "x"} y')]
    got = {r.id: (r.text, r.error) for r in nested.nested_text(spark.createDataFrame(rows, "id int, json string")).collect()}
    assert got[1] == ("first t True 1.5", None) and got[2] == ("1", None) and got[5] == ("", None) and got[7] == ("", None)
    assert all(got[k][0] == "" and got[k][1].startswith("invalid JSON: ") for k in (3, 4, 6, 8))


def test_counters_come_with_the_rows_written(spark, tmp_path):
    from pyspark.sql import functions as F

    from rankloom.sources.sinks import write_counted

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id % 2 = 0")
    seen = write_counted(docs, str(tmp_path / "out"), english=F.count_if(F.col("lang") == "en"), longest=F.max(F.length("text")))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert seen == {"rows": back.count(), "english": back.where("lang = 'en'").count(), "longest": back.agg(F.max(F.length("text"))).first()[0]}


def test_vectors_in_blocks(spark, monkeypatch):
    from rankloom.operators import ranking

    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    probes = vectors.where("vec_id % 50 = 0")
    want = sorted(map(tuple, ranking.top_vectors(vectors, probes, 3).collect()))
    monkeypatch.setattr(ranking, "BLOCK", 3)
    found = ranking.top_vectors(vectors, probes, 3)
    assert sorted(map(tuple, found.collect())) == want
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()


def test_patch_errors(spark):
    from rankloom.operators import patches
    from rankloom.plans import patch_catalog as P

    rows = spark.createDataFrame(P.GENERATED, "id long, patch string, approved string")
    got = {r.id: r.errors for r in patches.patch_errors(rows, P.APART, P.HEADS).collect()}
    assert got[1] == [
        "Duplicate bullets in summary_bullets: ['a']", "Unapproved numeric claim detected: 40", "Unapproved numeric claim detected: 2021", "Experience isolation violation: experience_1_bullets contains: payroll",
        "Experience isolation violation: experience_2_bullets contains: warranty claim", "Experience bullet contains employer/role/date header text: Data Engineer at home", "Experience bullet contains employer/role/date header text: warranty claims of jul 2021",
    ]
    assert got[2] == [f"Missing patch key: {k}" for k in patches.KEYS] and got[3] == got[4] == ["Patch is not JSON."]
    assert got[5] == ["Patch field must be a list: summary_bullets", "Patch field must be a list: change_notes", "skills_latex must be a string."]
    assert got[6][-1] == "skills_latex is empty." and len(got[6]) == 4
    assert "Bullet exceeds 450 characters in summary_bullets: " + "x" * 100 + "..." in got[7] and not any("claim" in e for e in got[7])


def test_repeated_lines_take_no_square_of_steps(spark):
    import json
    import time

    from rankloom.operators import patches
    from rankloom.plans import patch_catalog as P

    lines = [f"line {i}" for i in range(6000)] + ["b", "a", "B ", "a", ""]
    rows = spark.createDataFrame([(1, P.patch(experience_2_bullets=lines), "")], "id long, patch string, approved string")
    assert json.loads(P.patch(experience_2_bullets=lines))["experience_2_bullets"] == lines
    began = time.time()
    (row,) = patches.patch_errors(rows, P.APART, P.HEADS).collect()
    assert "Duplicate bullets in experience_2_bullets: ['b', 'a']" in row.errors
    assert time.time() - began < 5  # 36 million comparisons took longer


def test_vectors_without_all_numbers_score_nothing(spark):
    from rankloom.operators import ranking

    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [1.0, None]), (5, [0.0, 0.0]), (6, [1.0]), (7, [-1.0, 0.0]), (8, []), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    found = {r.vec_id: (r.score, r["rank"]) for r in ranking.top_vectors(rows, rows.where("vec_id = 1"), 20).collect()}
    assert found == {2: (70.71, 1)} | {i: (0.0, k + 2) for k, i in enumerate((3, 4, 5, 6, 7, 8))}
    plan = ranking.top_vectors(rows, rows.where("vec_id = 1"), 20)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan


def test_lookups_of_equal_values_are_no_pairs(spark):
    from rankloom.operators import relational

    entries = spark.createDataFrame([(k, "", "http://u", "title of an entry", f"text with needle{k % 2}") for k in range(300)], "entry_ord int, job_id string, url string, title string, description string")
    jobs = spark.createDataFrame([(k, "needle1" if k % 3 else "", "http://u" if k % 2 else "", "the title of an entry here") for k in range(400)], "job_ord int, job_id string, url string, title string")
    found = relational.lookup(jobs, entries)
    want = {k: (0, 2) if k % 2 else (1, 3) if k % 3 else (0, 5) for k in range(400)}
    assert {r.job_ord: (r.entry_ord, r.tier) for r in found.collect()} == want
    # of equal values only the first entry meets jobs, so 200 x 300 pairs of equal urls are not made
    assert found._jdf.queryExecution().optimizedPlan().toString().count("min(entry_ord#") >= 3


def test_long_needles_are_looked_up_by_few_substrings(spark):
    text = "".join(f" word{k}" for k in range(3000))
    rows = spark.createDataFrame([(1, text), (2, text[5:9000] + "x"), (3, "word"), (4, " w"), (5, "word12 word13")], "i long, t string")
    needles, texts = rows.select(F.col("i").alias("needle_id"), F.col("t").alias("needle")), rows.select(F.col("i").alias("text_id"), F.col("t").alias("text"))
    found = containment.contained(needles, texts)
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 2), (3, 1), (3, 2), (3, 3), (3, 5), (4, 1), (4, 2), (4, 4), (4, 5), (5, 1), (5, 2), (5, 5)]
    assert containment.MOST == 8 and not hasattr(containment, "SIZES")


def test_repeated_values_of_long_lists(spark):
    import time

    from rankloom.operators import profiles

    lists = [["b", "a", None, "b", "c", "a", None, "b"], [], None, [str(i % 19999) for i in range(20_000)]]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<string>")
    began = time.time()
    found = {r.i: r.x for r in rows.select("i", profiles.repeated_values(F.col("v")).alias("x")).collect()}
    assert found == {0: ["b", "a"], 1: [], 2: None, 3: ["0"]}
    assert time.time() - began < 10  # 400 million comparisons took longer
