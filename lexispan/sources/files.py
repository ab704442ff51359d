"""Text files with page marks, JSON arrays, manifests, and classes of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import scans
from ..operators.stored import stored

PAGE_MARK = r"^=== PAGE (\d+) ===$"
#: Pages and letters that a file's class is told from.
FIRST_PAGES, ENOUGH_TEXT = 3, 100
#: Most rows that are joined to one.
MOST_SHOWN = 100_000


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files, read in byte ranges, so a file of any size is many tasks.

    Lines end in a line feed, with or without a carriage return in front. Spark reads each range's lines in order; they are
    numbered within their range, and a range's first number is the count of the lines of those before it. A line feed
    at the end of a file begins no further line.
    """
    place = F.monotonically_increasing_id()  # rises with the order in which a task reads lines
    read = spark.read.option("lineSep", "\n").text(path)
    rows = read.select(F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("__block"), place.alias("__place"), F.regexp_replace("value", "\r$", "").alias("line"))
    inside = Window.partitionBy("__path", "__block").orderBy("__place")
    rows = rows.withColumn("__n", F.row_number().over(inside) - 1)
    blocks = rows.groupBy(F.col("__path").alias("__p"), F.col("__block").alias("__b")).agg(F.count("*").alias("__lines"))
    earlier = F.sum("__lines").over(Window.partitionBy("__p").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("__p", "__b", F.coalesce(earlier, F.lit(0)).alias("__before"))
    joined = rows.join(starts, (F.col("__path") == F.col("__p")) & (F.col("__block") == F.col("__b")))
    return joined.select("file", (F.col("__before") + F.col("__n")).alias("line_no"), "line")


def paged(lines: DataFrame, key: str = "file", order: str = "line_no", line: str = "line") -> DataFrame:
    """Lines with the page whose mark came last, without the marks; lines before the first mark have page 0. The mark is carried over the ranges of a long file."""
    number = F.regexp_extract(F.trim(line), PAGE_MARK, 1)
    marked = lines.withColumn("__mark", F.when(number != "", number.try_cast("int")))
    seen = scans.carried(marked, [key], [order], "__mark", "page")
    return seen.withColumn("page", F.coalesce("page", F.lit(0))).where("__mark is null").drop("__mark")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that are one JSON array of objects each, read in byte ranges, so a file of any size is many tasks.

    A file is cut at its closing braces, wherever they stand. Whether a piece begins inside a string is the parity of the unescaped quotes
    in front of it, and how deep it lies is the sum of the brackets outside strings: two running sums over ranges, whose
    totals alone are put in order. A record ends with a piece behind which the depth is that of the array. Files are told by their paths; an element that is no object is skipped.
    """
    place = F.monotonically_increasing_id()  # rises with the order in which a task reads pieces
    read = spark.read.option("lineSep", "}").text(path)
    pieces = read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__range"), place.alias("__place"), F.col("value").alias("piece"))
    bare = F.regexp_replace("piece", r"(?s)\\.", "")  # without what a backslash escapes
    pieces = stored(pieces.withColumns({"bare": bare, "quotes": F.regexp_count(bare, F.lit('"'))}), "pieces")
    quoted = scans.running_sum(pieces, ["path"], "quotes", "quotes_before")
    inside = F.col("quotes_before") % 2 == 1
    outer = F.regexp_replace(F.concat(F.when(inside, '"').otherwise(""), "bare"), '"[^"]*("|$)', "")
    closes = (F.col("quotes_before") + F.col("quotes")) % 2 == 0  # the brace behind the piece is no part of a string
    depth = F.regexp_count(outer, F.lit(r"[\[{]")) - F.regexp_count(outer, F.lit(r"[\]}]")) - closes.cast("int")
    deep = scans.running_sum(quoted.withColumns({"closes": closes, "step": depth}), ["path"], "step", "depth_before")
    ends = F.col("closes") & (F.col("depth_before") + F.col("step") == 1)
    marked = scans.running_sum(deep.withColumn("ends", ends.cast("long")), ["path"], "ends", "record")
    parts = F.array_sort(F.collect_list(F.struct("__range", "__place", "piece")))
    text = F.concat(F.array_join(F.transform(parts, lambda p: p["piece"]), "}"), F.lit("}"))
    records = marked.groupBy("path", "record").agg(text.alias("text"), F.max("ends").alias("ended")).where("ended = 1")
    body = F.regexp_replace("text", r"^[^{]*", "")
    return records.select(F.from_json(body, schema).alias("row"), "path", "record").select("row.*")


def first_that_has_rows(*tables: DataFrame) -> DataFrame:
    """The first table that isn't empty, or the last one."""
    return next((t for t in tables[:-1] if not t.isEmpty()), tables[-1])


def file_kind(pages: DataFrame, key: str, page: str, chars: str, images: str) -> DataFrame:
    """(key, kind): native_text, scanned_image or empty, from the first pages."""
    near = F.col(page) <= FIRST_PAGES
    out = pages.groupBy(key).agg(F.coalesce(F.sum(F.when(near, F.col(chars))), F.lit(0)).alias("__c"), F.coalesce(F.sum(F.when(near, F.col(images))), F.lit(0)).alias("__i"))
    return out.select(key, F.when(F.col("__c") > ENOUGH_TEXT, "native_text").when(F.col("__i") > 0, "scanned_image").otherwise("empty").alias("kind"))


def with_fallback(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All rows of the first extractor, and the second one's for files that the first gave nothing for."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def retried(manifest: DataFrame, results: DataFrame, key: str, done: str) -> DataFrame:
    """The manifest with the failed rows' outcome replaced by that of a second try; other rows stay."""
    again = results.select(key, F.col(done).alias("__again"))
    return manifest.join(again, key, "left").withColumn(done, F.when(~F.col(done), F.coalesce("__again", F.lit(False))).otherwise(F.col(done))).drop("__again")


def page_marked(rows: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """(key, value): the pages of a file under page marks, as one text."""
    block = F.concat(F.lit("=== PAGE "), F.col(page).cast("string"), F.lit(" ===\n"), F.col(text))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), block.alias("b")))), lambda x: x["b"]), "\n").alias("value"))


def displayable(rows: DataFrame, most: int = MOST_SHOWN) -> DataFrame:
    """The rows, if they are few enough to become one row; ValueError otherwise."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"over {most} rows are too many for one page or script")
    return rows


def script_value(rows: DataFrame, order: list[str], name: str = "window.dictionaryData") -> DataFrame:
    """One row that assigns all rows, as a JSON array, to a script's global: for results of a display's size only."""
    rows, fields = displayable(rows), [c for c in rows.columns]
    array = F.array_sort(F.collect_list(F.struct(*order, F.to_json(F.struct(*fields)).alias("__json"))))
    return rows.agg(F.concat(F.lit(f"{name} = ["), F.array_join(F.transform(array, lambda x: x["__json"]), ","), F.lit("];")).alias("value"))


def write_entries(rows: DataFrame, path: str, order: list[str]) -> None:
    """JSON Lines in row order over as many files as the range exchange gives; the path must be new, so older versions stay."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("error").json(path)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions under a path, in order."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in store.listStatus(folder)] if store.exists(folder) else []
    numbers = [n.removeprefix("version=") for n in names if n.startswith("version=")]
    return sorted(int(n) for n in numbers if n.isdigit())


def write_version(rows: DataFrame, path: str, order: list[str]) -> int:
    """Writes rows as the next version under a path, and returns its number: what stood there before is the backup."""
    number = max(versions(rows.sparkSession, path), default=0) + 1
    write_entries(rows, f"{path}/version={number}", order)
    return number


def report(rows: DataFrame) -> Column:
    """A row's columns as one JSON document."""
    return F.to_json(F.struct(*rows.columns))


def html_report(sample: DataFrame, totals: DataFrame, order: list[str], title: str = "Report") -> DataFrame:
    """One row: a page with the total count and a table of a sample, which must be of a display's size."""
    sample = displayable(sample)
    cells = F.array_join(F.transform(F.array(*[F.col(c).cast("string") for c in sample.columns]), lambda x: F.concat(F.lit("<td>"), x, F.lit("</td>"))), "")
    table = sample.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, cells.alias("__cells")))), lambda r: F.concat(F.lit("<tr>"), r["__cells"], F.lit("</tr>"))), "").alias("rows"))
    return table.crossJoin(totals).select(F.concat(F.lit(f"<h1>{title}</h1><p>"), F.col("n").cast("string"), F.lit(" rows</p><table>"), F.col("rows"), F.lit("</table>")).alias("html"))
