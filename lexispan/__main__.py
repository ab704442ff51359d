"""Builds a dictionary from spans: python -m lexispan SPANS OUT [--rules FILE] [--test] [--step N] [--incremental]."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import flow, increments, layout, parsing, quality, ranking
from .sources import files

#: Files of a trial run, and the numbers of the main files of each tome.
TRIAL_FILES = ("tome2-08.pdf", "tome2-15.pdf", "tome3-07.pdf")
MAIN_FILES = {2: (7, 31), 3: (6, 31)}


def page_lines(spans: DataFrame) -> DataFrame:
    """Lines of spans (slice, page, text, bold, italic, font, x0, y0, x1), by column: what `flow.flat_entries` takes."""
    tome, _, _ = parsing.file_meta("slice")
    rows = spans.withColumns({"tome": tome, "x_center": (F.col("x0") + F.col("x1")) / 2})
    sided = layout.routed(rows, ["slice", "page"], "x_center").withColumnRenamed("side", "column")
    keys = ["slice", "tome", "page", "column"]
    placed = layout.lines(sided.select(*keys, "y0", "x0", "x1", "text", "bold", "italic", "font"), keys, "y0", "x0")
    span = F.struct("place", "text", "bold", "italic", "font", "x0", "x1", "y0")
    lines = placed.groupBy(*keys, "line_no").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    kept = lines.where(layout.in_text_area(F.get("spans", 0)["y0"], layout.line_text("spans")))
    margins = layout.left_margin(kept.withColumn("__x0", F.get("spans", 0)["x0"]), ["slice", "page"], "column", "__x0")
    return kept.join(margins, ["slice", "page", "column"])


def main_files(spans: DataFrame, trial: bool) -> DataFrame:
    if trial:
        return spans.where(F.col("slice").isin(*TRIAL_FILES))
    tome, number, _ = parsing.file_meta("slice")
    wanted = F.lit(False)
    for t, (low, high) in MAIN_FILES.items():
        wanted = wanted | ((tome == t) & number.between(low, high))
    return spans.where(wanted)


def changed_entries(spans: DataFrame, table: list[tuple[str, str]], path: str) -> DataFrame:
    """Flat entries of all spans, of which only those of pages are made anew whose spans or rules differ from the run before."""
    tome, _, _ = parsing.file_meta("slice")
    rows = spans.withColumn("tome", tome)
    units = increments.digest(rows, ["slice", "tome", "page"], also=repr(table))
    store = increments.GroupStore(spans.sparkSession, path, ["tome", "page"])
    store.run(units, lambda groups: flow.flat_entries(page_lines(rows.join(groups, ["tome", "page"], "left_semi").drop("tome")), table))
    return store.current()


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lexispan")
    parser.add_argument("spans", help="Parquet of spans")
    parser.add_argument("out", help="folder of the results; each run adds a version")
    parser.add_argument("--rules", help="JSON Lines of key and val")
    parser.add_argument("--test", action="store_true", help="only the trial files")
    parser.add_argument("--step", type=int, choices=(1, 2, 3), help="stop behind lines (1), flat entries (2) or nested entries (3)")
    parser.add_argument("--incremental", action="store_true", help="make only the pages anew that have changed since the last such run")
    asked = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("lexispan").getOrCreate()
    last = asked.step or 4
    spans = main_files(spark.read.parquet(asked.spans), asked.test)
    lines = page_lines(spans)
    if last == 1:
        files.write_version(lines, f"{asked.out}/lines", ["slice", "page", "column", "line_no"])
        return
    table = [(r["key"], r["val"]) for r in spark.read.schema("key string, val string").json(asked.rules).collect()] if asked.rules else []
    entries = changed_entries(spans, table, f"{asked.out}/pages") if asked.incremental else flow.flat_entries(lines, table)
    number = files.write_version(entries, f"{asked.out}/flat", ["tome", "page", "word"])
    flat = spark.read.schema(entries.schema).json(f"{asked.out}/flat/version={number}")
    if last == 2:
        return
    files.write_version(flow.nested_entries(flat), f"{asked.out}/entries", ["tome", "page", "mot"])
    if last == 3:
        return
    report = quality.quality(flat, "word", "definition", F.col("needs_review"), F.col("a_ring_corrected"), quality.WORD_LIMIT, quality.SHORT, quality.LONG)
    report.write.mode("error").json(f"{asked.out}/report/version={number}")
    sample = ranking.page(flat.select("tome", "page", "word", "definition"), [F.col("tome").asc(), F.col("page").asc(), F.col("word").asc()], 100)
    files.html_report(sample, flat.agg(F.count("*").alias("n")), ["rank"]).write.mode("error").text(f"{asked.out}/report_html/version={number}")


if __name__ == "__main__":
    main()
