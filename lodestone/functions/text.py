"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in search.
STOPWORDS = tuple(
    "a an the and or but nor so yet in on at to for of with by from into through during before after above below between out off over under up "
    "about against along among around as except per than toward within is are was were be been being have has had do does did will would could "
    "should may might shall can need must am it its this that these those i we you he she they me us him her them my our your his their what "
    "which who whom when where how why not no also if then just only very too again further once here there all any both each few more most "
    "other some such same either neither s t re".split()
)
#: Fixed value: what a query is told to be, before it is embedded.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
_BULLET = r"^\s*([•‣◦⁃∙●○▪▫–—]|[-*+]|\d{1,2}[.)]|[a-zA-Z][.)])\s"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, r"[\r\n]+", " ")


def or_else(first: Column, second: Column) -> Column:
    """The first, unless null or empty."""
    return F.coalesce(F.nullif(first, F.lit("")), second)


def tokenize(text: Column) -> Column:
    """Lowered words of two characters or more, of letters, digits and ``_ . - ° / %``, without stopwords; null gives none."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s.\-°/%]", " ")
    return F.filter(F.split(plain, r"(?U)\s+"), lambda t: (F.length(t) >= 2) & ~t.isin(*STOPWORDS))


def has_bullet(text: Column) -> Column:
    """Whether a line begins as a list item does."""
    return F.exists(F.split(text, "\n"), lambda line: line.rlike(_BULLET))


def query_text(text: Column) -> Column:
    return F.concat(F.lit(QUERY_PREFIX), strip(text))


def preview(text: Column) -> Column:
    """The first three lines of a text that is longer than that, or than 300 characters."""
    lines = F.split(text, "\n")
    return F.when((F.size(lines) > 3) | (F.length(text) > 300), F.array_join(F.slice(lines, 1, 3), "\n")).otherwise(text)


def short_section(section: Column) -> Column:
    """A section's first 22 characters, and that more follow."""
    return F.when(F.length(section) > 22, F.concat(F.substring(section, 1, 22), F.lit("…"))).otherwise(section)


def breadcrumb(section: Column) -> Column:
    return F.split(section, r"\s*[>/]\s*")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)[/\\]*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def markdown(rows: Column) -> Column:
    """A table of cells as markdown: cells stripped, null as empty, empty rows left out; under two rows, an empty text."""
    clean = F.transform(rows, lambda r: F.transform(r, lambda c: F.coalesce(strip(c), F.lit(""))))
    clean = F.filter(clean, lambda r: F.exists(r, lambda c: c != ""))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(clean[0], lambda c: F.lit("---")), "|"), F.lit("|"))
    lines = F.concat(F.array(line(clean[0])), F.array(rule), F.transform(F.slice(clean, 2, F.greatest(F.size(clean) - 1, F.lit(0))), line))
    return F.when(F.size(clean) >= 2, F.array_join(lines, "\n")).otherwise("")


def highlight(text: Column, query: str) -> Column:
    """``text`` with the query's longer words marked."""
    import re

    words = [re.escape(w) for w in query.split() if len(w) > 2 and w.lower() not in STOPWORDS]
    return F.regexp_replace(text, "(?i)(" + "|".join(words) + ")", "<mark>$1</mark>") if words else text


def confidence_band(score: Column) -> Column:
    percent = F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)) * 100
    return F.when(percent >= 65, "high").when(percent >= 35, "medium").otherwise("low")
