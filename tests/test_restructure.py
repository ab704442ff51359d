from lexispan.operators import restructure

FLAT = "word string, definition string, grammar string, type string, tome int, page int, slice string"


def entry(spark, word="mot", definition="", grammar="", kind="wallon-francais", **options):
    rows = spark.createDataFrame([(word, definition, grammar, kind, 2, 7, "s")], FLAT)
    return restructure.restructure(rows, **options).first()


def test_grammar(spark):
    assert (entry(spark, grammar="adj")["categorie"], entry(spark, grammar="f")["categorie"], entry(spark, grammar="f")["genre"]) == ("adj", "nom", "féminin")
    assert entry(spark, grammar="adj", expand_grammar=True)["categorie"] == "adjectif"
    assert entry(spark, word="mot m.")["mot"] == "mot"


def test_brackets(spark):
    row = entry(spark, definition="a [x] b [yy[z] c [open")
    assert row["prononciation"] == "x; yy[z; open"
    assert entry(spark, definition="x [du latin mot] y")["origine"] == "du latin mot"


def test_references(spark):
    assert entry(spark, definition="Voy. amon, ale")["renvois"] == ["amon"]
    assert entry(spark, definition="x, syn. aute, bon")["synonymes"] == ["aute", "bon"]
    assert entry(spark, definition="fig. x techn.")["domaines"] == ["fig", "techn"]


def test_definitions_and_examples(spark):
    row = entry(spark, definition="un, deux : — fé, faire ; cf. x ; – tot | variante")
    assert row["definitions"] == ["un", "deux"]
    assert [tuple(e) for e in row["exemples"]] == [("~ fé", "faire"), ("~ tot", "")]
    assert row["variantes"] == ["variante"] and row["page"] == "7" and row["expressions"] == []
    row = entry(spark, definition="fé ; faire, fé ; seul", kind="francais-wallon")
    assert row["definitions"] == ["fé"] and [tuple(e) for e in row["exemples"]] == [("fé", "faire"), ("seul", "")]
    assert entry(spark, definition="voy. x")["definitions"] == ["voy. x"]
    assert entry(spark, definition=None)["definitions"] == [""]
