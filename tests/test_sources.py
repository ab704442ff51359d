import json
import random

from pyspark.sql import functions as F

from lexispan.sources import files, html
from lexispan.streaming import live


def test_page_marked_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "one\ntwo"), ("a", 2, "three")], "file string, page int, text string")
    for r in files.page_marked(rows, "file", "page", "text").collect():
        (tmp_path / "a.txt").write_text(r["value"])
    lines = files.paged(files.text_lines(spark, str(tmp_path)))
    assert [(r["page"], r["line"]) for r in lines.orderBy("line_no").collect()] == [(1, "one"), (1, "two"), (2, "three")]


def test_json_array_and_entries(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([{"mot": "é", "page": 2}, {"mot": "a"}]))
    rows = files.json_array(spark, str(tmp_path / "e.json"), "mot string, page int")
    assert {tuple(r) for r in rows.collect()} == {("é", 2), ("a", None)}
    files.write_entries(rows, str(tmp_path / "out"), ["mot"])
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert files.first_that_has_rows(rows.limit(0), rows).count() == 2
    assert files.script_value(rows, ["mot"]).first()[0] == 'window.dictionaryData = [{"mot":"a"},{"mot":"é","page":2}];'


def test_links(spark):
    page = '<a href="/a.PDF?x=1"> <b>A</b> one</a> <a class="z" href="http://h.org/a.PDF?x=1">again</a><a href="b.html">no</a>'
    rows = spark.createDataFrame([(1, "http://h.org/p", page), (2, "http://h.org/p", None)], "page_id int, url string, html string")
    assert [tuple(r) for r in html.links(rows).collect()] == [("https://h.org/a.PDF?x=1", "A one", 1, "a.PDF")]


def test_wiki_section(spark):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(("== fr ==", "no", "== {{langue|wa}} ==", "'''tåve'''", "== en ==", "no"))], "p int, n int, line string")
    inside = html.section(rows, ["p"], "n", "line", "=={{langue|wa}}==").orderBy("n").collect()
    assert [r["inside"] for r in inside] == [False, False, True, True, False, False]


def test_manifest(spark):
    manifest = spark.createDataFrame([("a", True), ("b", False), ("c", False)], "f string, done boolean")
    again = spark.createDataFrame([("b", True), ("a", False)], "f string, done boolean")
    assert {tuple(r) for r in files.retried(manifest, again, "f", "done").collect()} == {("a", True), ("b", True), ("c", False)}


def test_settled_stream(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00.0", "a"), (1, "2024-01-01 00:00:00.1", "ab"), (1, "2024-01-01 00:00:05.0", "x"), (1, "2024-01-01 01:00:00.0", "end")], "u int, ts string, q string")
    events.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("u int, ts timestamp, q string").parquet(str(tmp_path / "in"))
    run = live.settled_stream(stream, "u", "ts", "q").writeStream.format("memory").queryName("settled").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    run.stop()
    assert {r["q"] for r in spark.sql("select q from settled").collect()} == {"ab", "x"}


def test_command_line_builds_versions(spark, tmp_path):
    from lexispan import __main__ as command

    span = lambda page, y, x0, text, italic=False: ("tome2-08.pdf", page, text, False, italic, "Times", float(x0), float(y), float(x0 + 80))
    rows = []
    for page in (1, 2):
        for y, words in ((200, "bwès, m., bois"), (210, "suite"), (220, "adje, f., âge long")):
            rows.append(span(page, y, 130 if words == "suite" else 140, words))
            rows.append(span(page, y, 330 if words == "suite" else 340, words.replace("b", "p")))
        rows += [span(page, 100, 140, "header"), span(page, 230, 140, "12")]
    rows.append(("other.pdf", *rows[0][1:]))
    path = f"{tmp_path}/spans"
    spark.createDataFrame(rows, "slice string, page int, text string, bold boolean, italic boolean, font string, x0 double, y0 double, x1 double").write.parquet(path)
    (tmp_path / "rules.json").write_text('{"key": "adje", "val": "ådje"}\n')
    out = f"{tmp_path}/out"
    command.main([path, out, "--rules", f"{tmp_path}/rules.json"], spark)
    flat = spark.read.json(f"{out}/flat/version=1")
    assert sorted((r["word"], r["page"], r["definition"]) for r in flat.collect()) == sorted((w, p, d) for p in (1, 2) for w, d in (("bwès", "bois suite"), ("pwès", "pois suite"), ("ådje", "âge long")))
    assert spark.read.json(f"{out}/entries/version=1").count() == 6
    assert spark.read.json(f"{out}/report/version=1").first()["total"] == 6
    command.main([path, out, "--test", "--step", "1"], spark)
    assert spark.read.json(f"{out}/lines/version=1").count() == 12
    command.main([path, out, "--step", "2"], spark)
    assert spark.read.json(f"{out}/flat/version=2").count() == 6 and not (tmp_path / "out/entries/version=2").exists()


def test_long_files_are_read_in_ranges(spark, tmp_path):
    """Files cut in ranges of a few bytes give the same numbers and pages as whole ones, whatever their line ends."""
    rng = random.Random(1)
    texts = {}
    for name in "abc":
        lines = [rng.choice(["", "é" * rng.randint(0, 9), f"=== PAGE {rng.randint(1, 99)} ===", "x" * rng.randint(1, 60), " tail "]) for _ in range(200)]
        texts[f"{name}.txt"] = rng.choice(["\n", "\r\n"]).join(lines) + rng.choice(["", "\n"])
        (tmp_path / f"{name}.txt").write_bytes(texts[f"{name}.txt"].encode())
    (tmp_path / "empty.txt").write_text("")
    expected = []
    for name, text in texts.items():
        page = 0
        for i, line in enumerate(text.removesuffix("\n").removesuffix("\r").replace("\r\n", "\n").split("\n")):
            if line.startswith("=== PAGE"):
                page = int(line.split()[2])
            else:
                expected.append((name, i, page, line))
    for size in ("64", "1000", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            found = files.paged(files.text_lines(spark, str(tmp_path)))
            assert sorted((r["file"], r["line_no"], r["page"], r["line"]) for r in found.collect()) == sorted(expected), size
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_history_stream_keeps_the_cap_and_restarts(spark, tmp_path):
    day = lambda d, u, q: (u, f"2024-01-{d:02d} 00:00:00", q)
    schema = "u int, ts string, q string"

    def put(n, rows):
        spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(name):
        stream = spark.readStream.schema("u int, ts timestamp, q string").parquet(str(tmp_path / "in"))
        view = {}

        def keep(batch, _):
            for r in batch.collect():
                view.setdefault(r["u"], {})[r["place"]] = r["q"]

        out = live.history_stream(stream, "u", "ts", "q", most=3, keep="20 days").writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        out.awaitTermination()
        return view

    put(1, [day(1, 1, "a"), day(2, 1, "b"), day(3, 1, "A"), day(1, 2, "x"), day(2, None, "no")])
    assert run("one") == {1: {1: "A", 2: "b"}, 2: {1: "x"}}
    put(2, [day(4, 1, "c"), day(5, 1, "d"), day(6, 1, "C")])
    assert run("two") == {1: {1: "C", 2: "d", 3: "A"}}
    put(3, [day(28, 2, "y")])
    run("three")
    put(4, [day(29, 1, "e")])
    assert run("four")[1] == {1: "e"}


def test_command_line_on_an_empty_table(spark, tmp_path):
    from lexispan import __main__ as command

    spark.createDataFrame([], "slice string, page int, text string, bold boolean, italic boolean, font string, x0 double, y0 double, x1 double").write.parquet(f"{tmp_path}/spans")
    command.main([f"{tmp_path}/spans", f"{tmp_path}/out"], spark)
    assert spark.read.json(f"{tmp_path}/out/report/version=1").first()["total"] == 0
    rows = [("tome2-08.pdf", 1, "12", False, False, "Times", 140.0, 200.0, 220.0)]
    spark.createDataFrame(rows, "slice string, page int, text string, bold boolean, italic boolean, font string, x0 double, y0 double, x1 double").write.parquet(f"{tmp_path}/one")
    command.main([f"{tmp_path}/one", f"{tmp_path}/out"], spark)
    assert spark.read.json(f"{tmp_path}/out/report/version=2").first()["total"] == 0


def test_long_arrays_are_read_in_ranges(spark, tmp_path):
    """Strings that hold brackets, quotes and backslashes, nested objects and arrays, in files cut anywhere: the rows of a whole read."""
    rng = random.Random(2)
    words = ["}", "{", "]", "[", '"', "\\", "\\\\", '\\"', "},{", "é", "a b", "\n", '"}', "", "😀"]
    text = lambda: "".join(rng.choice(words) for _ in range(rng.randint(0, 6)))
    schema = "mot string, n int, tags array<string>, ex array<struct<w:string,f:string>>, o struct<x:string>"
    for name, indent in (("a", None), ("b", 1), ("c", 3)):
        rows = [{"mot": text(), "n": i, "tags": [text() for _ in range(rng.randint(0, 3))], "ex": [{"w": text(), "f": text()} for _ in range(rng.randint(0, 2))], "o": {"x": text()}} for i in range(60)]
        (tmp_path / f"{name}.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=name == "b"))
    (tmp_path / "none.json").write_text("[]\n")
    expected = sorted(map(str, spark.read.schema(schema).json(str(tmp_path), multiLine=True).collect()))
    assert len(expected) == 180
    for size in ("100", "3000", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            assert sorted(map(str, files.json_array(spark, str(tmp_path), schema).collect())) == expected, size
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_further_run_makes_only_changed_pages(spark, tmp_path):
    from lexispan import __main__ as command
    from lexispan.operators import increments

    def spans(*changes):
        rows = []
        for name in ("tome2-08.pdf", "tome2-09.pdf"):
            for page in (1, 2, 3):
                for y, words in ((200, f"bwès{page}, m., bois"), (220, f"adje, f., âge {name}")):
                    rows += [(name, page, words, False, False, "Times", x0, float(y), x0 + 80) for x0 in (140.0, 340.0)]
                rows += [(name, page, "suite", False, False, "Times", x0, 210.0, x0 + 80) for x0 in (130.0, 330.0)]
        for name, page, kind in changes:
            if kind == "gone":
                rows = [r for r in rows if (r[0], r[1]) != (name, page)]
            else:
                rows += [(name, page, f"{kind}, m., novea", False, False, "Times", x0, 240.0, x0 + 80) for x0 in (140.0, 340.0)]
                rows += [(name, page, "suite", False, False, "Times", x0, 250.0, x0 + 80) for x0 in (130.0, 330.0)]
        return spark.createDataFrame(rows, "slice string, page int, text string, bold boolean, italic boolean, font string, x0 double, y0 double, x1 double")

    def entries(df):
        return sorted((r["tome"], r["page"], r["word"], r["definition"], r["slice"]) for r in df.collect())

    table, path = [("adje", "ådje")], str(tmp_path / "pages")
    states = [(), (("tome2-09.pdf", 2, "trô"),), (("tome2-09.pdf", 2, "trô"), ("tome2-08.pdf", 3, "gone"), ("tome2-09.pdf", 3, "gone"), ("tome2-10.pdf", 4, "noû"))]
    made = []
    for changes in states:
        now = spans(*changes)
        found = entries(command.changed_entries(now, table, path))
        assert found and found == entries(command.flow.flat_entries(command.page_lines(now), table))
        last = max(command.files.versions(spark, f"{path}/rows"))
        made.append({r["page"] for r in spark.read.parquet(f"{path}/rows/version={last}").collect()})
    assert made == [{1, 2, 3}, {2}, {4}]
    command.changed_entries(spans(*states[-1]), table, path)
    assert spark.read.parquet(f"{path}/rows/version=4").count() == 0
    command.changed_entries(spans(*states[-1]), [("adje", "adjî")], path)
    assert spark.read.parquet(f"{path}/rows/version=5").select("page").distinct().count() == 3
    store = increments.GroupStore(spark, path, ["tome", "page"])
    assert {r["word"] for r in store.current().collect()} >= {"adjî", "trô", "noû"}
