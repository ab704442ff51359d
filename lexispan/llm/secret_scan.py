"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty for the rest."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import chunks, text_of

#: The base patterns, the group whose length counts, and the least length.
BASE_KINDS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),  # the longest runs: a run of under 16 never counts
)
#: Without one of these strings (in lower case) the pattern can't match.
NEEDED = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",)}
#: Words that make what is near them sensitive, whole or as a part of a camel-case name.
WORDS = r"pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|client[_-]?secret|connection[_-]?string"
FRONT, BACK = "(?:(?<![a-z])|(?-i:(?<=[a-z])(?=[A-Z])))", "(?:(?![a-z])|(?-i:(?<=[a-z])(?=[A-Z])))"
CONTEXT = re.compile(f"{FRONT}(?:(?:{WORDS})s?|bearer|authorization){BACK}", re.ASCII | re.IGNORECASE)
QUICK = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "authorization", "connection")
#: What a value stands right behind: a name with a sign of assignment, or the user of an address.
ASSIGNED = re.compile(r"""(?:[A-Za-z_][A-Za-z0-9_.-]*["']?\x20{0,3}(?:=>|:=|[:=])\x20{0,3}["'`]?|://[^\s/:@]{1,64}:)""", re.ASCII)
#: Identifiers that are common in code and settings, to prime the compressor.
IDENTIFIERS = (
    "password passwd passphrase secret token access_token refresh_token api_key apikey access_key secret_key private_key public_key client_id client_secret "
    "authorization Authorization: Bearer Basic credentials username user_name connection_string database_url hostname localhost example.com https://www. http:// "
    "config settings environment variables os.environ process.env getenv import from return function class public static final void string String const "
    "def self None true false null undefined development production staging default changeme your_token_here your_api_key_here xxxxxxxxxxxxxxxx "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 0000000000000000 user_repository service_account project_identifier "
    "documentation configuration authentication administration responsibilities responsibility internationalization implementation communication verification "
    "confirmation notification registration subscription organization application requirements instructions independently automatically immediately successfully"
).encode()
#: What a string consists of, and where it is cut in pieces, which are measured first.
STRING, PIECE = re.compile(r"[!#-&*-;=?-Z^-z|~]+"), re.compile(r"[A-Za-z0-9+/_.=~$!-]+")
MARKS = "+/_.=~$!-%@#&*^:;,?"
ORDER = {"assign": 0, "access": 1, "hex": 2, "novel": 3}
#: In how many documents an identifier stands that counts as common: so many at least, and this share of all; and most bytes of identifiers that are kept.
LEAST_DOCUMENTS, LEAST_SHARE, LEARNED_BYTES = 3, 0.0015, 8_192


@dataclass(frozen=True)
class Settings:
    """What is measured, and against what.

    A string of `shortest` or more characters counts as being in sensitive context if it
    begins within `reach` characters behind a sensitive word, or ends within `before` characters
    in front of one; one that looks like a word of a text (up to `longest_word` letters of one case, or with a first capital) must
    begin within `wordlike_reach` behind it, as rare words don't compress, either. A string right behind a name with a sign of assignment, or
    behind the user of an address, counts if it has `shortest_assigned` or more characters, letters and digits among them. With `everywhere`
    every string of `shortest` or more characters is measured, wherever it stands. A string is measured by its pieces (runs of letters, digits and a few marks), or whole if none of
    these is novel. Its surroundings are `around` characters on each side. It is novel if its marginal size is
    `least_ratio` of its length or more (see `least_bytes`). `identifiers` primes the
    compressor besides the surroundings.
    """

    least_ratio: float = 0.75
    shortest: int = 12
    reach: int = 160
    before: int = 64
    wordlike_reach: int = 24
    longest_word: int = 32
    shortest_assigned: int = 20
    everywhere: bool = False
    around: int = 256
    identifiers: bytes = IDENTIFIERS


DEFAULT = Settings()


def learned(docs: DataFrame, settings: Settings = DEFAULT, text: str = "text") -> Settings:
    """The settings with a dictionary of the corpus's own: the identifiers that most documents hold, up to LEARNED_BYTES.

    Every document is counted, whatever the table's size; only the identifiers that are kept come to the driver.
    Identifiers are runs of 6 to 40 letters, digits and underscores in LEAST_DOCUMENTS documents and in LEAST_SHARE of all or more.
    """
    least = max(LEAST_DOCUMENTS, math.ceil(docs.count() * LEAST_SHARE))
    names = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]{6,40}"), 0))).alias("name"))
    often = names.groupBy("name").count().where(F.col("count") >= least).orderBy(F.desc("count"), "name").limit(LEARNED_BYTES // 7).collect()
    kept, size = [], 0
    for r in often:
        size += len(r["name"]) + 1
        if size > LEARNED_BYTES:
            break
        kept.append(r["name"])
    # what stands last is nearest to a string, so cheapest to refer to
    return replace(settings, identifiers=" ".join([*reversed(kept), ""]).encode() + settings.identifiers)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base matches in code points, end exclusive."""
    low, out = text.lower(), []
    for kind, pattern, group, least in BASE_KINDS:
        if kind in NEEDED and not any(x in low for x in NEEDED[kind]):
            continue
        out += [(kind, *m.span()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(out, key=lambda x: (x[1], ORDER[x[0]]))


def marginal_bytes(candidate: str, before: str, after: str, identifiers: bytes = IDENTIFIERS) -> int:
    """Compressed bytes that the candidate adds to its surroundings, primed by them and by the identifiers."""
    around = (before + " " + after).encode()
    primed = zstandard.ZstdCompressionDict(identifiers + b" " + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    near = before[-32:].encode()
    return len(packer.compress(near + candidate.encode())) - len(packer.compress(near))


def alphabet_size(value: str) -> int:
    """Letters of the smallest usual alphabet that holds the string: digits, hexadecimal, base32, or whole classes of characters."""
    for letters in ("0123456789", "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"):
        if set(value) <= set(letters) and not value.isalpha():
            return len(letters)
    classes = ((str.islower, 26), (str.isupper, 26), (str.isdigit, 10))
    return sum(n for test, n in classes if any(map(test, value))) + len({c for c in value if not c.isalnum()})


def least_bytes(value: str, least_ratio: float) -> float:
    """The bound of a string: long random strings of a small alphabet shrink to the bits of their letters, and some bytes of tables."""
    return min(least_ratio * len(value), math.log2(max(2, alphabet_size(value))) / 8 * len(value) + 8)


def outside(start: int, end: int, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The parts of a range that no span covers; the spans are in order of their starts."""
    out = []
    for _, a, b in spans:
        if b <= start or a >= end:
            continue
        if a > start:
            out.append((start, a))
        start = max(start, b)
    return out + [(start, end)] * (start < end)


def wordlike(value: str, longest: int = DEFAULT.longest_word) -> bool:
    return len(value) <= longest and value.isalpha() and (value[1:].islower() or value.isupper())


def close_behind(text: str, start: int, settings: Settings) -> bool:
    """Whether a sensitive word ends within `wordlike_reach` characters in front of a place."""
    words = CONTEXT.finditer(text, max(0, start - settings.wordlike_reach - 32), start)
    return any(start - w.end() <= settings.wordlike_reach for w in words)


def in_context(text: str, settings: Settings) -> list[tuple[int, int, bool]]:
    """Strings near sensitive words and strings right behind assignments, from left to right, each once; and whether it is the former."""
    if settings.everywhere:
        return [(*m.span(), True) for m in STRING.finditer(text)]
    found: dict[int, tuple[int, int, bool]] = {}
    low = text.lower()
    if any(x in low for x in QUICK):
        reached = 0
        for word in CONTEXT.finditer(text):
            at = max(reached, word.start() - settings.before)
            while at > reached and STRING.match(text[at - 1]):  # a string that lies across the border is taken whole
                at -= 1
            stop = word.end() + settings.reach
            while (m := STRING.search(text, at)) and m.start() < stop:
                at = reached = m.end()
                found[m.start()] = (*m.span(), True)
    if "=" in text or ":" in text:
        for name in ASSIGNED.finditer(text):
            m = STRING.match(text, name.end())
            if m and len(m[0]) >= settings.shortest_assigned and not any(a <= m.start() < e for a, e, _ in [found.get(m.start(), (0, 0, True))]):
                found.setdefault(m.start(), (*m.span(), False))
    return sorted(found.values())


def novel_spans(text: str, base: list[tuple[str, int, int]], settings: Settings = DEFAULT) -> list[tuple[str, int, int]]:
    """Strings in sensitive context, or assigned, that the primed compressor can't shrink.

    Of a string that base spans overlap, the parts outside them are measured. Copies behind
    a string don't count as its surroundings, and further copies in sensitive context share
    its verdict. The sensitive words themselves are never reported.
    """
    out, verdicts = [], {}

    def novel(start: int, end: int, sensitive: bool) -> bool:
        value = text[start:end]
        core = value.strip(MARKS) or value  # the same with and without marks around it
        if len(value) < (settings.shortest if sensitive else settings.shortest_assigned) or CONTEXT.fullmatch(core):
            return False
        if wordlike(core, settings.longest_word) and not (settings.everywhere or sensitive and close_behind(text, start, settings)):
            return False
        if not sensitive and not (any(map(str.isdigit, core)) and any(map(str.isalpha, core))):
            return False
        if not verdicts.get(core):
            after = text[end : end + settings.around + len(value)].replace(core, " ")[: settings.around]
            verdicts[core] = marginal_bytes(value, text[max(0, start - settings.around) : start], after, settings.identifiers) >= least_bytes(value, settings.least_ratio)
        return verdicts[core]

    taken = 0
    for first, last, sensitive in in_context(text, settings):
        for start, end in outside(max(first, taken), last, base):
            pieces = [(m.start(), m.end()) for m in PIECE.finditer(text, start, end) if novel(m.start(), m.end(), sensitive)]
            if not pieces and not PIECE.fullmatch(text, start, end) and novel(start, end, sensitive):
                pieces = [(start, end)]
            out += [("novel", a, b) for a, b in pieces]
            taken = max(taken, end)
    return out


def spans_of(text: str, settings: Settings = DEFAULT) -> list[tuple[str, int, int]]:
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, settings), key=lambda x: (x[1], ORDER[x[0]]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", settings: Settings = DEFAULT) -> DataFrame:
    """(id, spans): for every row an array of (kind, start, end), by start and kind.

    Kinds are assign, access and hex (fixed patterns) and novel (strings near a sensitive
    word, or right behind an assignment, that zstandard, primed with the surroundings and an identifier dictionary, can't
    compress). Strings of letters alone count, too. `learned` adds a corpus's own identifiers to the dictionary. A novel span never overlaps a base span, and base spans always stay.
    Null and empty texts get an empty array; texts of any length are scanned whole;
    repeated rows and null ids get a row each; an empty table gives no rows.
    """
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([docs.schema[id_col], T.StructField("spans", T.ArrayType(span))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def apply(batches):
        for batch in chunks(batches, text):
            found = [[dict(zip(("kind", "start", "end"), s)) for s in spans_of(x, settings)] for x in text_of(batch, text).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], [id_col, "spans"])

    return docs.select(id_col, text).mapInArrow(apply, schema)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the kinds, and the spans as one string."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        id_col,
        *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex", "novel")),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "novel")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", length: str = "n_chars", mark: str = "[SECRET]", settings: Settings = DEFAULT) -> DataFrame:
    """The input with every reported span replaced; overlapping spans become one mark. Clean rows stay as they are, null texts stay null.

    `length` is set to the new number of characters where a text changes. Empty texts stay
    empty, texts of any length are cleaned whole, repeated rows and null ids stay, other
    columns are kept whatever their names, and an empty table gives no rows.
    """

    def cleaned(x: str) -> str:
        out, at = [], 0
        for _, start, end in spans_of(x, settings):
            if start >= at:
                out += [x[at:start], mark]
            at = max(at, end)
        return "".join(out) + x[at:] if out else x

    names = docs.columns

    def apply(batches):
        for batch in chunks(batches, text):
            columns = list(batch.columns)
            old = columns[names.index(text)].to_pylist()
            new = [None if x is None else cleaned(x) for x in old]
            columns[names.index(text)] = pa.array(new, columns[names.index(text)].type)
            if length in names:
                kept = columns[names.index(length)]
                columns[names.index(length)] = pa.array([k if a == b else len(b) for k, a, b in zip(kept.to_pylist(), old, new)], kept.type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(apply, docs.schema)
