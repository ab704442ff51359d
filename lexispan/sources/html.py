"""Links out of HTML pages, and forms out of wiki text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import absolute_url, file_name, strip


def links(pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id", pattern: str = r"(?i)\.pdf") -> DataFrame:
    """(link, label, page, filename): absolute links whose address fits a pattern, each once, as the first page has it."""
    anchors = F.regexp_extract_all(F.col(html), F.lit(r'(?is)(<a\s[^>]*href="[^"]*"[^>]*>.*?</a>)'), 1)
    rows = pages.select(F.col(key).alias("page"), url, F.posexplode(anchors).alias("place", "anchor"))
    rows = rows.withColumns({"href": F.regexp_extract("anchor", r'(?is)href="([^"]*)"', 1), "label": F.trim(F.regexp_replace("anchor", r"<[^>]+>", ""))}).where(F.col("href").rlike(pattern))
    rows = rows.withColumn("link", absolute_url(url, "href"))
    first = rows.groupBy("link").agg(F.min_by(F.struct("label", "page"), F.struct("page", "place")).alias("of"))
    return first.select("link", "of.label", "of.page", file_name("link").alias("filename"))


#: Bold words, link targets and headings that hold the letter, namespaces whose links don't count, and what opens the language's section.
BOLD, LINK, HEADING = r"'''([^']*å[^']*)'''", r"\[\[([^\]|]*å[^\]|]*)", r"=====?\s*([^=\n]*å[^=\n]*)\s*=====?"
NAMESPACES = ("Categoreye", "Imådje")
SECTION_BOLD, SECTION_LINK, SECTION_HEADS = r"'''([^']+)'''", r"\[\[([^\]|]+)", ("== {{langue|wa}}", "==wallon==")


def wiki_forms(text, title) -> F.Column:
    """Distinct forms with å of a page of the language's own wiki, sorted: its title, bold words, link targets outside two namespaces, and headings."""
    text, title = (F.col(x) if isinstance(x, str) else x for x in (text, title))
    found = lambda p: F.regexp_extract_all(text, F.lit(p), 1)
    long = lambda xs: F.filter(xs, lambda x: F.length(x) >= 2)
    links = F.filter(long(found(LINK)), lambda x: ~F.startswith(x, F.lit(NAMESPACES[0])) & ~F.startswith(x, F.lit(NAMESPACES[1])))
    own = F.when(F.contains(title, F.lit("å")), F.array(title)).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(own, long(found(BOLD)), links, F.transform(found(HEADING), strip))))


def section_forms(text, title) -> F.Column:
    """Distinct forms with å or Å of the language's section of a page of another wiki, sorted, and the page's title."""
    text, title = (F.col(x) if isinstance(x, str) else x for x in (text, title))

    def step(state, line):
        opens = F.contains(line, F.lit(SECTION_HEADS[0])) | F.contains(F.lower(F.replace(line, F.lit(" "), F.lit(""))), F.lit(SECTION_HEADS[1]))
        inside = F.when(opens, True).when(F.startswith(line, F.lit("== ")), False).otherwise(state["inside"])
        return F.struct(inside.alias("inside"), F.when(inside, F.concat(state["lines"], F.array(line))).otherwise(state["lines"]).alias("lines"))

    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("lines"))
    body = F.aggregate(F.split(text, "\n"), start, step, lambda s: s["lines"])
    found = F.flatten(F.transform(body, lambda line: F.concat(F.regexp_extract_all(line, F.lit(SECTION_BOLD), 1), F.regexp_extract_all(line, F.lit(SECTION_LINK), 1))))
    return F.array_sort(F.array_distinct(F.concat(F.array(title), F.filter(found, lambda x: F.contains(F.lower(x), F.lit("å"))))))


#: Fixed value: reading a category stops once more members than this are seen.
ENOUGH_MEMBERS = 5000


def members_seen(batch: int) -> int:
    """How many members of a category are read, in whole batches, before the reading stops."""
    return (ENOUGH_MEMBERS // batch + 1) * batch


def section(lines: DataFrame, keys: list[str], order: str, line: str, header: str, into: str = "inside") -> DataFrame:
    """Lines with a running flag: on at the header, off at the next heading."""
    from pyspark.sql import Window

    mark = F.when(F.contains(F.lower(F.replace(F.col(line), F.lit(" "), F.lit(""))), F.lit(header)), True).when(F.startswith(F.col(line), F.lit("== ")), False)
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(into, F.coalesce(F.last(mark, ignorenulls=True).over(window), F.lit(False)))
