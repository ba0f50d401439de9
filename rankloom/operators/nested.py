"""Text out of nested JSON, in an order of keys that says which fields matter most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys whose values come first, in this order.
TEXT_KEYS = [
    "text", "raw_text", "cleaned_text", "normalized_text", "content", "description", "job_description", "resume_text", "summary", "professional_summary", "objective", "title", "job_name", "role", "roles", "skills",
    "required_skills", "preferred_skills", "technical_skills", "certifications", "projects", "responsibilities", "experience", "work_experience", "education",
]


def nested_text(rows: DataFrame, keys: list[str] = TEXT_KEYS) -> DataFrame:
    """id, text, error from rows (id, json): all values joined by spaces, and what isn't JSON as an error.

    Objects give the values of `keys` first and then the others by name (a VARIANT doesn't keep the order of the rest),
    lists theirs in order, nulls and empty strings nothing. A row keeps a list of places and values; all containers in it
    are opened a level at a time until no row has one, so depth is not bounded, nothing is exchanged and no level is made
    from the texts anew. A null is no text and no error.
    """
    c = F.col
    wrapped = lambda a, b: F.try_parse_json(F.concat(F.lit(a), "json", F.lit(b)))
    # the parser stops behind the first value; inside both of these nothing may follow it
    parsed = rows.select("id", "json", wrapped("[", "]").alias("in_list"), wrapped('{"a":', "}").isNotNull().alias("in_object"))
    parsed = parsed.select("id", "json", F.when(c("in_object"), F.try_variant_get("in_list", "$[0]", "variant")).alias("v"))
    kind = lambda v: F.schema_of_variant(v)
    is_object, is_list = (lambda v: kind(v).startswith("OBJECT")), (lambda v: kind(v).startswith("ARRAY"))
    rank = lambda key: F.array_position(F.array(*map(F.lit, keys)), key)
    # an entry's place: listed keys by their number, the others behind them by name, list entries by position
    by_key = lambda key: F.when(rank(key) > 0, F.format_string("0%05d", rank(key))).otherwise(F.concat(F.lit("1"), key))
    entry = lambda at, place, v: F.struct(F.concat(at, F.array(place)).alias("at"), v.alias("v"))

    def opened(x: Column) -> Column:
        fields = F.transform(F.map_entries(F.try_variant_get(x["v"], "$", "map<string,variant>")), lambda e: entry(x["at"], by_key(e["key"]), e["value"]))
        items = F.transform(F.try_variant_get(x["v"], "$", "array<variant>"), lambda v, i: entry(x["at"], F.format_string("%010d", i), v))
        return F.when(is_object(x["v"]), fields).when(is_list(x["v"]), items).otherwise(F.array(F.struct(x["at"].alias("at"), x["v"].alias("v"))))

    level = parsed.withColumn("all", F.when(c("v").isNotNull(), F.array(F.struct(F.array().cast("array<string>").alias("at"), c("v").alias("v")))))
    while not level.where(F.exists("all", lambda x: is_object(x["v"]) | is_list(x["v"]))).isEmpty():
        level = level.withColumn("all", F.flatten(F.transform("all", opened)))
    word = lambda v: F.variant_get(v, "$", "string")
    said = F.transform("all", lambda x: F.struct(x["at"].alias("at"), F.when(kind(x["v"]) == "BOOLEAN", F.initcap(word(x["v"]))).otherwise(word(x["v"])).alias("said")))
    text = F.array_join(F.transform(F.array_sort(F.filter(said, lambda x: x["said"] != "")), lambda x: x["said"]), " ")
    error = F.when(c("json").isNotNull() & c("v").isNull(), F.concat(F.lit("invalid JSON: "), F.substring("json", 1, 200)))
    return level.select("id", F.coalesce(text, F.lit("")).alias("text"), error.alias("error"))
