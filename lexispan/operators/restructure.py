"""Flat entries to nested ones: grammar, brackets, domains, references, definitions and examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, strip

#: Grammar marks, compound ones first, and what may not follow them.
GRAMMAR = r"(?iu)(?<![\p{L}\p{N}_])(v\.\s*tr\.|v\.\s*intr\.|v\.\s*réfl\.|v\.\s*imp\.|v\.|m\.|f\.|adj\.|adv\.|prép\.|conj\.|interj\.|loc\.|n\.pr\.|pron\.|num\.|art\.|part\.|suff\.|préf\.)(?![a-zA-Zàâéèêëîïôùûüœæç])"
#: Long names of marks without their last dot, used only where expansion is asked for.
LONG_NAMES = {"adj": "adjectif", "adv": "adverbe", "prép": "préposition", "conj": "conjonction", "interj": "interjection", "loc": "locution", "n.pr": "nom propre", "pron": "pronom", "num": "numéral", "art": "article", "part": "participe", "suff": "suffixe", "préf": "préfixe", "v. tr": "verbe transitif", "v. intr": "verbe intransitif", "v. réfl": "verbe réfléchi", "v. imp": "verbe impersonnel", "v": "verbe"}
#: Domain marks, in the order in which they are listed.
DOMAINS = ("fig.", "arch.", "t. de houill.", "t. de bat.", "t. enf.", "t. rural", "néol.", "techn.", "arg.", "pop.", "t. de serr.", "t. d'arm.", "t. de chaudr.", "prov.")
#: What may follow "see" and "syn.", and what no reference contains.
TARGET = r"[a-zàâéèêëîïôùûüçœæåÅ'\-,\s]"
NO_REFERENCE = ("les", "le", "la", "tome", "page", "art", "subst")
SHORT_BRACKET = 6
MARKS = ",;.: "


def _any(x: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(x, F.lit(w))
    return out


def _pieces(x: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(x, pattern), strip), lambda p: p != "")


def _targets(text: Column, lead: str, most: int) -> Column:
    found = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{lead})\s+({TARGET}{{1,{most}}})"), 1), lambda m: F.split(m, ",")))
    return F.filter(F.transform(found, lambda t: F.rtrim(strip(t), F.lit(",;.:"))), lambda t: t != "")


def _without_brackets(x: Column) -> Column:
    """Closed brackets become a blank; an unclosed one goes to the end."""
    return collapse(F.regexp_replace(F.regexp_replace(x, r"\[[^\]]*\]", " "), r"\[.*$", ""))


def _brackets(x: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(x, F.lit(r"\[([^\]]*)(?:\]|$)"), 1), strip), lambda b: b != "")


def restructure(rows: DataFrame, expand_grammar: bool = False) -> DataFrame:
    """Nested entries of flat ones (word, definition, grammar, type, tome, page, slice); other columns are kept.

    Marks keep their short names unless `expand_grammar`: a stored mark has lost its last
    dot, by which the long names would be found. Arrays are empty, never null.
    """
    text = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    out = rows.withColumns({"__w": text("word"), "__d": text("definition"), "__g": text("grammar")})
    # grammar
    in_word, in_text = F.regexp_extract("__w", GRAMMAR, 1), F.regexp_extract(F.left("__d", F.lit(60)), GRAMMAR, 1)
    mark = F.when(F.col("__g") != "", F.col("__g")).otherwise(F.rtrim(F.when(in_word != "", in_word).otherwise(in_text), F.lit(".")))
    out = out.withColumn("__g", mark)
    low = F.lower("__g")
    masculine, feminine = low.isin("m", "m.", "masculin"), low.isin("f", "f.", "féminin")
    name = F.col("__g")
    if expand_grammar:
        table = F.create_map(*[F.lit(x) for k, v in LONG_NAMES.items() for x in (k, v)])
        name = F.coalesce(F.try_element_at(table, F.rtrim(name, F.lit("."))), name)
    out = out.withColumns({"genre": F.when(masculine, "masculin").when(feminine, "féminin").otherwise(""), "categorie": F.when(masculine | feminine, "nom").otherwise(name)})
    # brackets
    out = out.withColumn("__b", F.concat(_brackets(F.col("__w")), _brackets(F.col("__d"))))
    out = out.withColumns({"__w": _without_brackets(F.col("__w")), "__d": _without_brackets(F.col("__d"))})
    spoken = lambda b: b.startswith("-") | (F.length(b) <= SHORT_BRACKET)
    out = out.withColumns({"prononciation": F.array_join(F.filter("__b", spoken), "; "), "origine": F.array_join(F.filter("__b", lambda b: ~spoken(b)), "; ")})
    # domains, references, synonyms, variants
    marks = F.filter(F.array(*[F.lit(x) for x in DOMAINS]), lambda m: F.contains(F.left("__d", F.lit(120)), m) | F.contains(F.col("__w"), m))
    out = out.withColumn("domaines", F.transform(marks, lambda m: F.rtrim(m, F.lit("."))))
    references = F.filter(_targets(F.col("__d"), r"Voy\.|voir|Cf\.", 100), lambda t: (F.length(t) < 40) & ~_any(F.lower(t), NO_REFERENCE))
    synonyms = F.filter(_targets(F.col("__d"), r"syn\.", 60), lambda t: F.length(t) < 30)
    pipes = F.transform(F.split("__d", r"\|"), strip)
    out = out.withColumns({"renvois": F.array_distinct(references), "synonymes": F.array_distinct(synonyms), "variantes": F.filter(F.slice(pipes, F.lit(2), F.size(pipes)), lambda v: v != ""), "__m": F.get(pipes, 0)})
    # definitions and examples
    forward = F.col("type") == "wallon-francais"
    cut = F.when(F.instr("__m", ":") > 0, F.instr("__m", ":")).otherwise(F.instr("__m", ";"))
    out = out.withColumn("__cut", cut)
    has = F.col("__cut") > 0
    before, after = F.when(has, strip(F.left("__m", F.col("__cut") - 1))).otherwise(F.col("__m")), F.when(has, strip(F.substr("__m", F.col("__cut") + 1))).otherwise("")
    bare = lambda x: F.ltrim(strip(F.regexp_replace(x, GRAMMAR, "")), F.lit(MARKS))
    pair = lambda a, b: F.struct(a.alias("wallon"), b.alias("francais"))
    comma = lambda x: F.instr(x, ",")
    left, right = lambda x: strip(F.left(x, comma(x) - 1)), lambda x: strip(F.substr(x, comma(x) + 1))
    dashed = lambda x: F.translate(x, "—–", "~~")
    useful = lambda x: ~_any(F.lower(x), ("voy.", "cf."))
    fits = lambda d: (d != "") & ~_any(F.lower(d), ("voy.", "cf.", "syn."))
    forward_definitions = F.filter(F.transform(_pieces(before, "[,;]"), bare), fits)
    forward_examples = F.transform(F.filter(_pieces(after, ";"), useful), lambda x: F.when(comma(x) > 0, pair(dashed(left(x)), right(x))).otherwise(pair(dashed(x), F.lit(""))))
    parts = _pieces(F.col("__m"), ";")
    reverse_definitions = F.transform(F.slice(parts, 1, 1), bare)
    reverse_examples = F.transform(F.filter(F.slice(parts, F.lit(2), F.size(parts)), useful), lambda x: F.when(comma(x) > 0, pair(right(x), left(x))).otherwise(pair(x, F.lit(""))))
    out = out.withColumn("__defs", F.when(forward, forward_definitions).otherwise(reverse_definitions))
    none = F.array().cast("array<string>")
    out = out.withColumns(
        {
            "definitions": F.when(F.size("__defs") == 0, F.array("__m")).otherwise(F.col("__defs")),
            "exemples": F.when(forward, forward_examples).otherwise(reverse_examples),
            "expressions": none,
            "notes": F.lit(""),
            "mot": F.rtrim(strip(F.regexp_replace("__w", GRAMMAR, "")), F.lit(MARKS)),
            "page": F.coalesce(F.col("page"), F.lit(0)).cast("string"),
        }
    )
    return out.drop("__w", "__d", "__g", "__b", "__m", "__cut", "__defs", "word", "definition", "grammar")
