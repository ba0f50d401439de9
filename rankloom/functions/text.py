"""Column expressions over text. All are built-in functions, so they stay inside code generation."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L


def round2(x: Column) -> Column:
    """Half up on the double's own value; the same in every engine (differs from banker's rounding only at near ties)."""
    return F.floor(x * 100 + 0.5) / 100


#: White space of all scripts but the blank, as a class of patterns and as characters; that of ASCII, with the blank.
ODD_SPACE = r"\t\n\x0B\f\r\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
SPACE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
ASCII_SPACE = " \t\n\v\f\r"


def squeeze(x: Column) -> Column:
    """Runs of white space as one blank, none at the ends. Single blanks, which most are, match nothing and are not rewritten.

    What stands in ASCII from ! to ~, which most characters do, is told by one comparison before the longer class is asked.
    """
    other = "(?![!-~])"
    return F.trim(F.regexp_replace(x, rf"{other}(?: {other}[{ODD_SPACE} ]+|(?! )[{ODD_SPACE}][{ODD_SPACE} ]*)", " "))


def stripped(x: Column, *, space: str = ASCII_SPACE) -> Column:
    """Without these characters at the ends. By keyword, as transform() gives a second parameter the index of an element."""
    return F.btrim(x, F.lit(space))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed once however often it is used (a list of one gives it a name)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def any_in(text: Column, words: Iterable[str]) -> Column:
    """Whether a text holds one of these; quick beside a pattern, so a pattern that needs one is tried on few texts."""
    return reduce(lambda a, w: a | F.contains(text, F.lit(w)), words, F.lit(False))


def all_in(text: Column, words: Iterable[Iterable[str]]) -> Column:
    """Whether a text holds one of the words of every list."""
    return reduce(lambda a, ws: a & any_in(text, ws), words, F.lit(True))


def odd_letters(low: Column) -> Column:
    """Whether a lower-cased text holds letters beyond ASCII that patterns with (?iU) take for s or i."""
    return any_in(low, ("\u017f", "\u0131", "\u0307"))


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def all_tokens(text: Column, phrases=L.PHRASES) -> Column:
    """Lower-case, fold phrases in order, match tokens."""
    folded = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), phrases, F.lower(F.coalesce(text, F.lit(""))))
    return F.regexp_extract_all(folded, F.lit(L.TOKEN), F.lit(0))


def tokens(text: Column, stop_words=L.STOP_WORDS, phrases=L.PHRASES) -> Column:
    """all_tokens without short ones and stop words."""
    stop = F.array(*map(F.lit, stop_words)) if stop_words else F.array().cast("array<string>")
    return F.filter(all_tokens(text, phrases), lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t))


def first_keyword(text: Column, keywords: list[str]) -> Column:
    """The first keyword in list order that the text contains, else null."""
    return F.coalesce(*(F.when(F.contains(text, F.lit(k)), F.lit(k)) for k in keywords))


def first_match(text: Column, low: Column, patterns: list[str], needs: list[list[list[str]]]) -> Column:
    """What the first pattern in list order that matches finds, squeezed, else null.

    needs: for each pattern lists of words, one of each of which stands wherever it matches; low: the lower-cased text.
    """
    found = lambda p: once(squeeze(F.regexp_extract(text, f"(?i){p}", 0)), lambda found: F.when(found != "", found))
    return F.coalesce(*(F.when(all_in(low, ws), found(p)) for p, ws in zip(patterns, needs, strict=True)))


def results_told(text: Column) -> Column:
    """Passages that tell a measured result (L.ACHIEVED), in order.

    The pattern looks back from every place, so it is tried on single clauses that hold a verb and a digit: at a break
    that no passage can cross (a dot beside no digit, a semicolon, a line's end without a unit behind it) texts are cut.
    """
    none = F.array().cast("array<string>")
    told = lambda x: F.regexp_like(x, F.lit(r"\d")) & once(F.lower(x), lambda low: any_in(low, L.RESULTS.split("|")))
    clauses = F.filter(F.split(text, rf"(?i);|\.(?!\d)|(?<!\d)\.|\n(?!\s*(?:{L.RESULT_UNITS}))"), told)
    every = F.flatten(F.transform(clauses, lambda x: F.regexp_extract_all(x, F.lit(L.ACHIEVED), F.lit(0))))
    return F.when(text.isNull(), F.lit(None).cast("array<string>")).when(told(text), every).otherwise(none)


def url_key(url: Column) -> Column:
    """Canonical url: no quotes or trailing punctuation, lower-case scheme and host, no www., single slashes, no tracking
    keys, sorted query, no fragment; what isn't a url is lower-cased."""
    raw = F.rtrim(F.btrim(F.btrim(F.coalesce(url, F.lit(""))), F.lit("\"'")), F.lit(".,);]}"))
    parts = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    part = lambda k: F.regexp_extract(raw, parts, k)
    host = F.regexp_replace(F.lower(part(2)), r"^www\.", "")
    path = F.rtrim(F.regexp_replace(part(3), "/{2,}", "/"), F.lit("/"))
    pairs = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(L.TRACKING_KEYS))
    pairs = F.array_sort(F.transform(pairs, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("=")))))
    query = F.array_join(pairs, "&")
    whole = F.concat(F.lower(part(1)), F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when((raw == "") | (F.lower(raw) == "nan"), "").when(part(2) == "", F.rtrim(F.lower(raw), F.lit("/"))).otherwise(whole)


def url_key_plain(url: Column) -> Column:
    """Lower-case url without query, fragment and trailing slash; one site's www. is dropped."""
    bare = F.split_part(F.split_part(F.lower(F.btrim(F.coalesce(url, F.lit("")))), F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    return F.rtrim(F.replace(bare, F.lit("www.dice.com"), F.lit("dice.com")), F.lit("/"))


def label_value(text: Column, label: str) -> Column:
    """The rest of the first line `Label: value` or `Label - value`."""
    return F.regexp_extract(text, rf"(?imd)^[ \t]*{label}[ \t]*[:\-][ \t]*(\S.*?)[ \t]*$", 1)


def title_key(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^a-z0-9+#.\-\s]", " "), r"\s+", " "))


def phrase_count(text: Column, phrase: str) -> Column:
    """Occurrences of a phrase with no word character on either side."""
    return F.regexp_count(text, F.lit(rf"(?U)(?<!\w)\Q{phrase}\E(?!\w)"))


def safe_file_name(name: Column) -> Column:
    """80 characters at most; a run of others becomes one, so no more is rewritten than the runs and characters that make these."""
    start = F.regexp_extract(name, r"\A(?:[^A-Za-z0-9._-]++|[A-Za-z0-9._-]){0,80}", 0)
    return F.regexp_replace(start, "[^A-Za-z0-9._-]+", "_")


def latex_escape(text: Column) -> Column:
    """All special characters in a single pass."""
    special = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
    table = F.create_map(*(F.lit(x) for pair in special.items() for x in pair))
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")


def years_required(text: Column) -> Column:
    """Years of experience that a posting asks for: lower end of a range, else the number before `years of experience`,
    else the greatest number of years up to 30."""
    low = F.lower(text)
    span = F.regexp_extract(low, r"(\d{1,2})\s*(?:-|to)\s*(\d{1,2})\s*\+?\s*(?:years|yrs)", 1)
    asked = F.regexp_extract(low, r"(\d{1,2})\s*\+?\s*(?:years|yrs)\s*(?:of\s+)?(?:\w+\s+)?experience", 1)
    every = F.filter(F.transform(F.regexp_extract_all(low, F.lit(r"(\d{1,2})\s*\+?\s*(?:years|yrs)"), F.lit(1)), lambda x: x.cast("int")), lambda x: (x > 0) & (x <= 30))
    number = lambda x: F.nullif(x, F.lit("")).cast("int")
    return F.coalesce(number(span), number(asked), F.array_max(every), F.lit(0)).cast("double")
