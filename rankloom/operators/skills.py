"""Skills in texts: dictionary matches, ontology closure, coverage, role and domain votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import round2


#: Aliases up to which a dictionary is carried in the plan; larger ones are joined.
SMALL_DICTIONARY = 2000


def bounded(term: str) -> str:
    """Pattern of a term between characters that aren't of a word; the term may hold any characters."""
    return rf"(?U)(?<!\w)\Q{term}\E(?!\w)"


def mentions(docs: DataFrame, aliases: DataFrame) -> DataFrame:
    """doc_id, skill, n: alias mentions added up by skill (overlapping aliases count twice).

    docs (doc_id, text), aliases (skill, alias, lower case). An alias counts where it stands between characters that
    aren't of a word, so `c++` and `ci/cd` are found. A small dictionary travels in the plan: a substring test picks a
    document's aliases and only these are counted, without moving texts. A larger one meets documents by the first word
    of its aliases; texts are joined in once more for the aliases met.
    """
    low = docs.select("doc_id", F.lower("text").alias("low"))
    known = [r.alias for r in aliases.select("alias").distinct().limit(SMALL_DICTIONARY + 1).collect()]
    if not known:
        return low.where("false").select("doc_id", F.lit("").alias("skill"), F.lit(0).cast("long").alias("n"))
    if len(known) <= SMALL_DICTIONARY:
        met = low.select("doc_id", "low", F.explode(F.filter(F.array(*map(F.lit, sorted(known))), lambda a: F.contains(F.col("low"), a))).alias("alias"))
    else:
        first = F.regexp_extract(F.col("alias"), r"(?U)\w+", 0)
        words = low.select("doc_id", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.split("low", r"(?U)\W+")))).alias("first"))
        met = words.join(aliases.select("alias", first.alias("first")).distinct(), "first").select("doc_id", "alias").join(low, "doc_id")
    counted = met.select("doc_id", "alias", F.regexp_count("low", F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.col("alias"), F.lit(r"\E(?!\w)"))).alias("n")).where("n > 0")
    return counted.join(aliases.select("skill", "alias"), "alias").groupBy("doc_id", "skill").agg(F.sum("n").alias("n"))


def confidence(counts: dict[str, Column], total: Column) -> Column:
    return F.least(sum((counts[s] * w for s, w in L.CONFIDENCE.items()), total * 2).cast("double"), F.lit(100.0))


def overlap(own: Column, asked: Column, empty: float = 70.0) -> dict[str, Column]:
    """matched, missing (sorted) and coverage in percent; `empty` where nothing is asked (70 for required skills, 75 for
    preferred ones, 50 for those of a role)."""
    a, b = (F.array_sort(F.array_distinct(F.filter(F.transform(x, lambda v: F.lower(F.trim(v))), lambda v: v != ""))) for x in (own, asked))
    matched = F.array_sort(F.array_intersect(b, a))
    return {"matched": matched, "missing": F.array_sort(F.array_except(b, a)), "coverage": F.when(F.size(b) == 0, empty).otherwise(round2(F.try_divide(F.size(matched) * 100.0, F.size(b))))}


def ontology(spark) -> tuple[DataFrame, DataFrame]:
    """(edges src, dst with canonical dst; aliases alias, canon) as tables."""
    edges = spark.createDataFrame([(a, L.ALIASES.get(b, b)) for a, bs in L.ONTOLOGY.items() for b in bs], "src string, dst string")
    return edges, spark.createDataFrame(list(L.ALIASES.items()), "alias string, canon string")


def closure(rows: DataFrame, edges: DataFrame, aliases: DataFrame, depth: int = 2) -> DataFrame:
    """rows (id, skill) to id, skill, explicit: canonical skills and all that at most `depth` steps infer from them."""
    own = rows.join(aliases, F.lower(F.trim("skill")) == F.col("alias"), "left").select("id", F.coalesce("canon", F.lower(F.trim("skill"))).alias("skill")).where("skill != ''").distinct()
    found, last = own.withColumn("explicit", F.lit(True)), own
    for _ in range(depth):
        last = last.join(edges, F.col("skill") == F.col("src")).select("id", F.col("dst").alias("skill")).distinct()
        found = found.union(last.withColumn("explicit", F.lit(False)))
    return found.groupBy("id", "skill").agg(F.max("explicit").alias("explicit"))


def specialization(found: DataFrame, spark) -> DataFrame:
    """id, platform, confidence: the platform that closure() rows speak for most, the first of equals."""
    evidence = spark.createDataFrame([(k, p, s) for k, (p, ss) in enumerate(L.PLATFORMS.items()) for s in ss], "ord int, platform string, skill string")
    points = found.join(evidence, "skill").groupBy("id", "platform", "ord").agg(F.sum(F.when(F.col("explicit"), 2.0).otherwise(0.75)).alias("points"))
    best = points.groupBy("id").agg(F.max(F.struct("points", (-F.col("ord")).alias("o"), "platform")).alias("b"), F.sum("points").alias("all"))
    return best.select("id", "b.platform", round2(F.least(55.0 + 45.0 * F.col("b.points") / F.col("all"), F.lit(100.0))).alias("confidence"))


def votes(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, label, score: the label of which most terms (label, ord, term) occur in the text, in percent; of equals the
    first by ord; a text without any has the first label of all at 0."""
    size = terms.groupBy("label").agg(F.count("*").alias("size"), F.min("ord").alias("ord"))
    hit = mentions(docs, terms.select(F.col("term").alias("skill"), F.col("term").alias("alias"))).select("doc_id", F.col("skill").alias("term"))
    score = hit.join(terms.select("label", "term"), "term").groupBy("doc_id", "label").agg(F.countDistinct("term").alias("k")).join(size, "label")
    best = score.groupBy("doc_id").agg(F.max(F.struct((F.col("k") * 100.0 / F.col("size")).alias("s"), (-F.col("ord")).alias("o"), "label")).alias("b"))
    none = size.agg(F.min_by("label", "ord").alias("l")).scalar()
    return docs.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.coalesce("b.label", none).alias("label"), round2(F.coalesce("b.s", F.lit(0.0))).alias("score"))
