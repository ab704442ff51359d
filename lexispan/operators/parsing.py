"""Lines to dictionary entries: start marks, segments, headwords and definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACES, clean, col, strip, strip_all
from .layout import line_text

#: Grammar marks; the order matters, as the first that fits is taken.
MARKS = ("m\\.", "f\\.", "î\\.", "v\\.", "adj\\.", "adv\\.", "prép\\.", "conj\\.", "interj\\.", "loc\\.", "n\\.pr\\.", "pron\\.", "num\\.", "art\\.", "part\\.", "suff\\.", "préf\\.", "v\\.\\s*tr\\.", "v\\.\\s*intr\\.", "v\\.\\s*réfl\\.", "v\\.\\s*imp\\.")
#: Letters that may not follow a mark, and letters of headwords.
AFTER_MARK, WORD_LETTERS = "a-zA-Zàâéèêëîïôùûüœæç", "a-zàâéèêëîïôùûüçœæå'-"
GRAMMAR = rf"(?iu)(?<![\p{{L}}\p{{N}}_])({'|'.join(MARKS)})(?![{AFTER_MARK}])"
HOMOGRAPH, NUMBER_IN_FRONT = rf"(?iu)^\d+\.\s*[{WORD_LETTERS}]", r"^\d+\.\s*"
ONLY_IN_CASES = r"(?iu),\s*seul[*t.]?\s+dans\s+"
SHORT_HEAD = rf"(?iu)^([{WORD_LETTERS}]{{1,30}})\s*([,;.:])\s*(.+)"
#: Indentation of an entry's first line, and marks that begin none.
INDENT, NO_START = (6.5, 18.0), "—–-[]{}().,;:!?*#°"
#: Faults of a headword or definition that need review.
LONG_WORD, SHORT_DEFINITION = 60, 5
#: Marker words of the two directions, and how much text is looked at.
LOCAL_WORDS, FRENCH_WORDS, LOOK_AT = r"\b(li|èl|nos|vos|dj|dji)\b", r"\b(le|la|les|un|une|des|il|elle)\b", 2000


def file_meta(name) -> tuple[Column, Column, Column]:
    """Tome, file number and direction that a file name tells."""
    tome = F.regexp_extract(col(name), r"tome(\d+)-(\d+)", 1)
    number = F.regexp_extract(col(name), r"tome(\d+)-(\d+)", 2)
    tome, number = (F.when(x == "", 0).otherwise(x.try_cast("int")) for x in (tome, number))
    return tome, number, F.when(tome == 3, "francais-wallon").otherwise("wallon-francais")


def direction(text, source) -> Column:
    """By the source's name, or else by which language has more marker words; a tie is French first."""
    head = F.left(col(text), F.lit(LOOK_AT))
    by_words = F.when(F.regexp_count(head, F.lit("(?U)" + LOCAL_WORDS)) > F.regexp_count(head, F.lit("(?U)" + FRENCH_WORDS)), "wallon-francais").otherwise("francais-wallon")
    name = col(source)
    return F.when(name.contains("liegeois") & ~name.contains("francais"), "wallon-francais").when(name.contains("francais-liegeois"), "francais-wallon").otherwise(by_words)


def _bold(span) -> Column:
    return span["bold"] | F.contains(F.lower(span["font"]), F.lit("bold"))


def _italic(span) -> Column:
    return span["italic"] | F.contains(F.lower(span["font"]), F.lit("italic"))


def entry_start(spans, margin, tome) -> Column:
    """Whether a line (an array of spans) begins an entry: by indentation, first letter, and style or marks."""
    spans, margin, tome = col(spans), col(margin), col(tome)
    text, first = line_text(spans), F.get(spans, 0)
    head = F.rtrim(F.get(F.split(text, r"\s+"), 0), F.lit(".,;:"))
    lone_number = head.rlike(r"^\d+$|^[IVXivx]+$") & ~text.rlike(HOMOGRAPH)
    begin = F.left(text, F.lit(60))
    forward = _italic(first) | begin.rlike(GRAMMAR) | begin.rlike("[:;]") | text.rlike(rf"(?iu)^[{WORD_LETTERS}]{{1,30}}\s*[,;.:]")
    reverse = ~_bold(first) & ~_italic(first) & F.exists(spans, _bold)
    allowed = (text != "") & first["x0"].between(margin + INDENT[0], margin + INDENT[1]) & ~text.startswith("Fig.") & ~text.startswith("=== PAGE") & ~F.contains(F.lit(NO_START), F.left(text, F.lit(1))) & ~lone_number
    return F.coalesce(allowed & F.when(tome == 2, forward).when(tome == 3, reverse).otherwise(False), F.lit(False))


def _spanned(spans: Column, leads) -> tuple[Column, Column]:
    """Texts of the leading spans that fit, and of the rest, each joined by spaces."""
    n = F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + F.when(s["on"] & leads(x), 1).otherwise(0)).alias("n"), (s["on"] & leads(x)).alias("on")), lambda s: s["n"])
    texts = F.transform(spans, lambda s: s["text"])
    return F.array_join(F.slice(texts, F.lit(1), n), " "), F.array_join(F.slice(texts, n + 1, F.size(spans)), " ")


def split_entry(spans, tome) -> Column:
    """(word, grammar, definition) of an entry's first line.

    Forward: at the first grammar mark, else at the first colon or semicolon, else where
    the italic spans end, else after a short word and a mark, else after the first token.
    Reverse: where the bold spans begin.
    """
    spans, tome = col(spans), col(tome)
    text = F.regexp_replace(line_text(spans), NUMBER_IN_FRONT, "")
    parts = lambda w, g, d: F.struct(w.alias("word"), g.alias("grammar"), d.alias("definition"))
    empty = F.lit("")

    def with_cases(before, grammar, definition):
        at = F.regexp_instr(before, F.lit(ONLY_IN_CASES))
        tail = F.concat(strip(F.substr(before, at)), F.lit(" : "), definition)
        return F.when(at > 0, parts(strip(F.left(before, at - 1)), grammar, tail)).otherwise(parts(before, grammar, definition))

    mark = F.regexp_extract(text, GRAMMAR, 1)
    mark_at = F.regexp_instr(text, F.lit(GRAMMAR))
    by_mark = with_cases(F.rtrim(strip(F.left(text, mark_at - 1)), F.lit(",; ")), F.rtrim(mark, F.lit(".")), F.ltrim(strip(F.substr(text, mark_at + F.length(mark))), F.lit(",;.: ")))
    colon_at = F.regexp_instr(text, F.lit("[:;]"))
    by_colon = with_cases(strip(F.left(text, colon_at - 1)), empty, strip(F.substr(text, colon_at + 1)))
    head, rest = _spanned(spans, _italic)
    head = F.rtrim(strip(F.regexp_replace(head, NUMBER_IN_FRONT, "")), F.lit(",;.: "))
    token = F.regexp_extract(text, r"^(\S+)", 1)
    by_token = parts(F.rtrim(token, F.lit(",;.:")), empty, strip(F.substr(text, F.length(token) + 1)))
    by_short = parts(strip(F.regexp_extract(text, SHORT_HEAD, 1)), empty, strip(F.regexp_extract(text, SHORT_HEAD, 3)))
    by_style = F.when(head != "", parts(head, empty, strip(rest))).when(text.rlike(SHORT_HEAD), by_short).otherwise(by_token)
    forward = F.when(mark_at > 0, by_mark).when(colon_at > 0, by_colon).otherwise(by_style)
    plain, bold = _spanned(spans, lambda s: ~_bold(s))
    reverse = parts(F.rtrim(strip(plain), F.lit(",;.: ")), empty, strip(bold))
    return F.when(tome == 2, forward).when(tome == 3, reverse).otherwise(parts(line_text(spans), empty, empty))


def build_entry(word, definition) -> tuple[Column, Column]:
    """The definition without a leading repeat of the headword, and whether the entry needs review."""
    w, d = col(word), strip(col(definition))
    d = F.when(F.startswith(F.lower(d), F.lower(w)), F.ltrim(F.substr(d, F.length(w) + 1), F.lit(",;.: "))).otherwise(d)
    return d, (F.length(w) > LONG_WORD) | (F.length(d) < SHORT_DEFINITION) | F.contains(w, F.lit("\n"))


def segments(rows: DataFrame, keys: list[str], order: str, start: Column, into: str = "segment") -> DataFrame:
    """Rows numbered by segment within their scope: each start opens one; rows before the first are left out."""
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(into, F.sum(F.coalesce(start, F.lit(False)).cast("int")).over(window)).where(F.col(into) > 0)


def carried(rows: DataFrame, keys: list[str], order: str, marker: str, into: str) -> DataFrame:
    """The last marker seen up to each row."""
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(into, F.last(marker, ignorenulls=True).over(window))


def page_at_flush(starts: DataFrame, keys: list[str], order: str, page: str, final: str, into: str) -> DataFrame:
    """An entry's page is the one seen when the next entry begins; the last one gets the scope's final page."""
    return starts.withColumn(into, F.coalesce(F.lead(page).over(Window.partitionBy(*keys).orderBy(order)), F.col(final)))


def entries(lines: DataFrame, keys: list[str], order: str, spans: str, margin: str, tome: str) -> DataFrame:
    """Entries of a column's lines: (keys, segment, word, grammar, definition, needs_review). Entries never span two scopes."""
    marked = lines.withColumn("__start", entry_start(spans, margin, tome))
    cut = segments(marked, keys, order, F.col("__start"))
    first = F.when(F.col("__start"), split_entry(spans, tome))
    text = cut.withColumn("__first", first).withColumn("__text", F.when(F.col("__start"), F.col("__first.definition")).otherwise(line_text(spans)))
    joined = text.groupBy(*keys, "segment").agg(
        F.first("__first", ignorenulls=True).alias("__first"),
        F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct(order, "__text"))), lambda x: x["__text"]), lambda t: t != ""), " ").alias("definition"),
    )
    joined = joined.withColumns({"word": F.col("__first.word"), "grammar": F.col("__first.grammar")})
    definition, review = build_entry("word", "definition")
    return joined.withColumns({"definition": definition, "needs_review": review}).select(*keys, "segment", "word", "grammar", "definition", "needs_review")


def paragraphs(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, block, word, definition): of blocks of two lines or more the first is the headword, the rest the definition."""
    blocks = rows.select(*keys, F.posexplode(F.split(text, r"\n\n+")).alias("block", "__text"))
    found = F.filter(F.transform(F.split("__text", "\n"), strip), lambda x: x != "")
    blocks = blocks.withColumn("__lines", found).where(F.size("__lines") >= 2)
    out = blocks.select(*keys, "block", F.rtrim(F.get("__lines", 0), F.lit(".,;:")).alias("word"), F.array_join(F.slice("__lines", F.lit(2), F.size("__lines")), " ").alias("definition"))
    return out.where(F.length("word").between(2, 80) & F.col("definition").rlike(BLOCK_LETTER))


#: Patterns of a headword and a definition (a colon or dash behind a capital, capitals, a dash), and headwords that are table heads.
CAPITALS = "A-ZÁÀÂÉÈÊËÎÏÔÙÛÜŒ"
ENTRY_PATTERNS = (
    rf"^([{CAPITALS}][^:\n]{{1,50}}?)[{SPACES}]*[:—][{SPACES}]*(.+)",
    rf"^([{CAPITALS}]{{2,}}(?:[{SPACES}]+[a-záàâéèêëîïôùûüœæ.]+)?)[{SPACES}]+(.+)",
    rf"^([^\-—\n]{{2,40}})[{SPACES}]*[—\-][{SPACES}]*(.+)",
)
TABLE_HEADS = ("page", "liégeois", "français", "wallon", "traduction")
PAGE_BREAK = r"\n\n--- PAGE \d+ ---\n\n"
BLOCK_LETTER = "[a-záàâéèêëîïôùûüœæçDJ]"


def with_pattern_entries(rows: DataFrame, text: str, into: str) -> DataFrame:
    """The input with an array of (word, definition) of a cleaned text: by the pattern with the most matches, the first of equals.

    Each pattern runs over a text once; only the chosen one's matches are taken apart, each on its own.
    """
    names = [f"__found{i}" for i in range(len(ENTRY_PATTERNS))]
    found = rows.withColumns({n: F.regexp_extract_all(text, F.lit("(?md)" + p), 0) for n, p in zip(names, ENTRY_PATTERNS)})
    most = F.greatest(*[F.size(n) for n in names])

    def parts(name, pattern):
        of = lambda m, i: F.regexp_extract(m, "(?md)" + pattern, i)
        return F.transform(name, lambda m: F.struct(F.rtrim(strip_all(of(m, 1)), F.lit(".,;:")).alias("word"), strip_all(of(m, 2)).alias("definition")))

    chosen = F.lit(None)
    for n, p in reversed(list(zip(names, ENTRY_PATTERNS))):
        chosen = F.when(F.size(n) >= most, parts(n, p)).otherwise(chosen)
    good = lambda x: F.length(x["word"]).between(2, 80) & (F.length(x["definition"]) >= 2) & ~x["word"].rlike(r"^\p{Nd}+$") & ~F.lower(x["word"]).isin(*TABLE_HEADS)
    return found.withColumn(into, chosen).withColumn(into, F.filter(into, good)).drop(*names)


def block_entries(text) -> Column:
    """(word, definition) of a cleaned text's blocks, as an array: the first line of a block of two or more, and the others."""
    lines = F.transform(F.split(col(text), r"\n\n+"), lambda b: F.filter(F.transform(F.split(b, "\n"), strip), lambda x: x != ""))
    pairs = F.transform(F.filter(lines, lambda x: F.size(x) >= 2), lambda x: F.struct(F.rtrim(F.get(x, 0), F.lit(".,;:")).alias("word"), F.array_join(F.slice(x, F.lit(2), F.size(x)), " ").alias("definition")))
    return F.filter(pairs, lambda x: F.length(x["word"]).between(2, 80) & x["definition"].rlike(BLOCK_LETTER))


def file_entries(files: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, parser, place, word, definition): of each file's two parses the one with more entries, the patterns' one of equals."""
    whole = files.select(*keys, clean(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), PAGE_BREAK, "\n\n")).alias("__text"))
    both = with_pattern_entries(whole, "__text", "__a").withColumn("__b", block_entries("__text"))
    first = F.size("__a") >= F.size("__b")
    chosen = both.select(*keys, F.when(first, "patterns").otherwise("blocks").alias("parser"), F.posexplode(F.when(first, F.col("__a")).otherwise(F.col("__b"))).alias("place", "__e"))
    return chosen.select(*keys, "parser", "place", "__e.word", "__e.definition")


def best_pattern(text, patterns: list[str]) -> Column:
    """The number of the pattern with the most matches, from 0; the first of equals."""
    counts = [F.regexp_count(col(text), F.lit(p)) for p in patterns]
    out, most = F.lit(0), counts[0]
    for i, n in enumerate(counts[1:], 1):
        out, most = F.when(n > most, i).otherwise(out), F.greatest(n, most)
    return out


def best_of(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """(key, rows, chosen): of two parsers' results the first one's where it has as many rows or more."""
    counts = [r.groupBy(key).agg(F.count("*").alias(n)) for r, n in ((first, "__a"), (second, "__b"))]
    both = counts[0].join(counts[1], key, "full").na.fill(0)
    return both.select(key, F.greatest("__a", "__b").alias("rows"), F.when(F.col("__a") >= F.col("__b"), "first").otherwise("second").alias("chosen"))
