"""Rule filter for postings: why one is rejected, in the order experience, citizenship, clearance, role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import any_in, first_keyword, first_match, once, squeeze


def covering(phrases: list[str]) -> list[str]:
    """Few words such that every phrase has one of them."""
    chosen, left = [], list(phrases)
    while left:
        words = sorted({w for p in left for w in p.split()})
        chosen.append(max(words, key=lambda w: (sum(w in p for p in left), len(w))))
        left = [p for p in left if chosen[-1] not in p]
    return chosen


ACCEPT_WORDS = covering(L.ACCEPT_TITLES)


def experience_reason(text: Column, low: Column) -> Column:
    """Ten years or more, unless the 100 characters on either side only wish for them."""

    def near(found: Column, at: Column) -> Column:
        start = F.greatest(at - 100, F.lit(1))
        return F.lower(F.substring(text, start, at + F.length(found) + 100 - start))

    def wished(found: Column) -> Column:
        around = once(F.regexp_instr(text, F.lit(L.LONG_EXPERIENCE)), lambda at: near(found, at))
        return once(around, lambda n: any_in(n, L.PREFERRED_WORDS) & ~any_in(n, L.REQUIRED_WORDS))

    said = lambda found: F.when(found != "", F.when(~wished(found), squeeze(found)))
    return F.when(any_in(low, ["year", "yr"]), once(F.regexp_extract(text, L.LONG_EXPERIENCE, 0), said))


def role_reason(title: Column, text: Column) -> Column:
    """What speaks against a role: its title, and where that says nothing the first twenty lines."""
    intro = F.lower(F.array_join(F.slice(F.split(text, r"\R", 21), 1, 20), " "))
    accepted = once(intro, lambda x: any_in(x, ACCEPT_WORDS) & any_in(x, L.ACCEPT_TITLES))
    by_intro = F.when(~accepted, "No recognized data-role keyword")
    bad = lambda t: once(first_keyword(t, L.REJECT_TITLES), lambda k: F.when(k.isNotNull(), F.concat(F.lit("Irrelevant title keyword: "), k)).otherwise(by_intro))
    return once(F.lower(squeeze(F.coalesce(title, F.lit("")))), lambda t: F.when(~any_in(t, L.ACCEPT_TITLES), bad(t)))


def reasons(title: Column, text: Column) -> Column:
    """Why a posting is rejected. A text is lower-cased once, and a pattern is tried where words stand that it needs."""

    def every(low: Column) -> Column:
        return F.array(
            F.concat(F.lit("Experience: "), experience_reason(text, low)),
            F.concat(F.lit("Citizenship: "), first_match(text, low, L.CITIZENSHIP, L.CITIZENSHIP_NEEDS)),
            F.concat(F.lit("Clearance: "), first_match(text, low, L.CLEARANCE, L.CLEARANCE_NEEDS)),
            F.concat(F.lit("Role: "), role_reason(title, text)),
        )

    return F.filter(once(F.lower(text), every), lambda r: r.isNotNull())


def judged(jobs: DataFrame) -> DataFrame:
    """jobs (with title, text) plus reasons (array) and accepted."""
    text = F.coalesce("text", F.lit(""))
    return jobs.withColumn("reasons", reasons(F.col("title"), text)).withColumn("accepted", F.size("reasons") == 0)
