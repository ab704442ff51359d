import hashlib
import random

import pytest
import re

from lexispan.llm import secret_scan

#: Plain forms of the fixed patterns.
PLAIN = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)


def brute(text):
    found = [(m.start(), n, f"{kind}:{m.start()}:{m.end()}") for n, (kind, p, group, least) in enumerate(PLAIN) for m in re.finditer(p, text, re.ASCII) if len(m[group]) >= least]
    return ",".join(x[2] for x in sorted(found))


def test_base_spans_equal_brute_force():
    rng = random.Random(3)
    pieces = ["token", "Password", "api_key", "APIKEY", "secret", "passwd", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH12345", "0123456789abcdef", "deadbeef", "xyz.-_/+=", "é", "😀", "\n", "ſecret", "toKen"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert ",".join(f"{k}:{a}:{b}" for k, a, b in secret_scan.base_spans(text)) == brute(text), text


def test_novelty():
    assert [s[0] for s in secret_scan.spans_of("my password is Xk29fQz81LmPw0Rt, sir")] == ["novel"]
    assert secret_scan.spans_of("my password is zzzzzzzzzzzzzzzzzzzzzzzzzzz1, sir") == []
    # what the surroundings already hold isn't new
    assert secret_scan.spans_of("see Xk29fQz81LmPw0Rt and Xk29fQz81LmPw0Rt " + "of the long way home " * 4 + ": the password is Xk29fQz81LmPw0Rt") == []
    assert secret_scan.spans_of("the name is Xk29fQz81LmPw0Rt") == []


def test_digest_and_edges(edge, none):
    rows = secret_scan.digest(secret_scan.find_secrets(edge)).collect()
    assert len(rows) == 13
    for r in rows:
        text = next(t for i, t in ((x["doc_id"], x["text"]) for x in edge.collect()) if i == r["doc_id"]) or ""
        assert r["base_sha256"] == hashlib.sha256(brute(text).encode()).hexdigest()
    ten = [r for r in rows if r["doc_id"] == 10]
    assert [(r["n_assign"], r["n_access"], r["n_hex"]) for r in ten] == [(1, 1, 1)] * 2
    assert secret_scan.find_secrets(none).count() == 0


def test_redact(edge, none):
    before, after = edge.collect(), secret_scan.redact(edge).collect()
    assert secret_scan.redact(edge).columns == edge.columns and len(after) == len(before)
    assert secret_scan.redact(none).count() == 0
    for a, b in zip(before, after):
        if a["doc_id"] == 10:
            assert b["text"].count("[SECRET]") == 3 and b["n_chars"] == len(b["text"])
            assert secret_scan.base_spans(b["text"]) == []
        else:
            assert a == b


def test_every_candidate_is_measured():
    rng = random.Random(8)
    drawn = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for n in (24, 30, 60):
        value = drawn(letters, n)
        assert secret_scan.spans_of(f"Authorization: Bearer {value} ok") == [("novel", 22, 22 + n)]
    for n in (12, 15):
        value = drawn(letters + "0123456789", n)
        assert [s[0] for s in secret_scan.spans_of(f"use pwd={value} here")] == ["novel"]
    assert secret_scan.spans_of("the password is in the documentation of responsibilities") == []


def test_a_secret_written_twice_is_found_twice():
    text = "my password is Xk29fQz81LmPw0Rt, again: the password is Xk29fQz81LmPw0Rt."
    assert [text[a:b].rstrip(".") for _, a, b in secret_scan.spans_of(text)] == ["Xk29fQz81LmPw0Rt"] * 2


def test_long_secrets_of_small_alphabets():
    rng = random.Random(9)
    for letters, sizes in (("0123456789ABCDEF", (128, 256)), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", (256, 512)), ("abcdefghijklmnopqrstuvwxyz0123456789", (512,))):
        for n in sizes:
            value = "".join(rng.choice(letters) for _ in range(n))
            assert [s[0] for s in secret_scan.spans_of(f"the secret is {value} now") if s[0] != "hex"] == ["novel"], (letters, n)
    assert secret_scan.spans_of("the secret is " + "abcdefgh12345678" * 16) == []


def test_the_rest_of_a_base_span_is_measured():
    text = "credentials Qz81LmPw0RtXk29fQ~0123456789abcdef01 end"
    assert [s[0] for s in secret_scan.spans_of(text)] == ["novel", "hex"]


def test_recall_on_planted_strings_and_silence_on_words():
    """Random strings in the usual places: all are found, also 150 characters behind the word, in front of it, and behind a plural."""
    rng = random.Random(10)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    forms = ["db passwords are {}", "Authorization: Bearer {}", "the secret " + "of the long way home " * 7 + "{} tail", "{} is the token", "connection_string Server=x;Pwd {};", "credentials: user bob, then {}"]
    found = total = 0
    for form in forms:
        for n in (12, 15, 20, 32, 64):
            for _ in range(10):
                value = "".join(rng.choice(letters) for _ in range(n))
                text = form.format(value)
                total += 1
                found += any(kind == "novel" and value in text[a:b] for kind, a, b in secret_scan.spans_of(text))
    assert found >= 0.99 * total
    words = "the administration of the internationalization project keeps its secret and the password in the documentation of the organization"
    assert secret_scan.spans_of(words) == []


def test_words_of_a_text_must_follow_closely():
    assert secret_scan.spans_of("the token is very far away from all of the erroneousnesses here") == []
    assert [s[0] for s in secret_scan.spans_of("a token, of old, and the password is qxzvkwjhgfdp")] == ["novel"]
    assert [s[0] for s in secret_scan.spans_of("the token is very far away from all of the qXzvKwjhGfdp here")] == ["novel"]


def test_settings_are_parameters():
    text = "the secret " + "of the long way home " * 20 + "Xk29fQz81LmPw0Rt"
    assert secret_scan.spans_of(text) == []
    assert len(secret_scan.spans_of(text, secret_scan.Settings(reach=500))) == 1
    assert len(secret_scan.spans_of("pwd Xk29fQz8", secret_scan.Settings(shortest=8))) == 1


#: Forms that name a secret by a word, by a camel-case name, by a name alone, or by the user of an address; with marks among the letters, too.
FORMS = {
    "password is {}": "aB3%xZ9@kL2#mN8&qW",
    "userToken {}": None,
    "dsn = postgres://admin:{}@db.local/x": None,
    "export GH=ghp_{}": None,
    "the secret of this place is said to be {}": "qzvkxwjhgfdpbnmrtlcsyaeiouqxkzwvjhgbpfmd",
    "SESSION_ID: '{}'": None,
    "Authorization: Basic {}": None,
    '{{"clientSecretValue": "{}"}}': None,
    "key => {}": None,
    "my passwords: {}, old": None,
}


@pytest.mark.parametrize("form", FORMS)
def test_recall_in_ten_forms(form):
    rng = random.Random(form)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    values = [FORMS[form]] if FORMS[form] else ["".join(rng.choice(letters) for _ in range(n)) for n in (24, 30, 36) for _ in range(20)]
    hits = 0
    for value in values:
        text = "some words of a text before it. " + form.format(value) + " and some more behind it"
        hits += any(value in text[a:b] or text[a:b] in value and b - a > 0.8 * len(value) for kind, a, b in secret_scan.spans_of(text) if kind in ("novel", "assign"))
    assert hits >= 0.97 * len(values)


def test_assignments_of_words_and_numbers_are_no_secrets():
    for text in ("note: internationalization", "time: 2024-01-15", "url = https://www.example.com/documentation/configuration", "title: the quick brown fox", "width=128000000000", "see http://localhost:8080"):
        assert secret_scan.spans_of(text) == [], text


def test_every_string_can_be_measured():
    value = "Xk29fQz81LmPw0RtB7"
    text = f"nothing says what {value} is"
    assert secret_scan.spans_of(text) == []
    at = text.index(value)
    assert secret_scan.spans_of(text, secret_scan.Settings(everywhere=True)) == [("novel", at, at + len(value))]


def test_a_corpus_teaches_its_identifiers(spark):
    """A name of digits and letters that many documents hold is known, and no secret any more."""
    docs = [(i, f"call buildX9Kq2_v71Zt8 with token buildX9Kq2_v71Zt8 number {i}") for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    text = "the token is buildX9Kq2_v71Zt8 here"
    assert secret_scan.spans_of(text) != []
    settings = secret_scan.learned(df)
    assert b"buildX9Kq2_v71Zt8" in settings.identifiers and secret_scan.spans_of(text, settings) == []
    assert secret_scan.learned(df.limit(0)).identifiers.endswith(secret_scan.IDENTIFIERS)


def test_identifiers_are_counted_in_all_documents(spark):
    """A name in six of 4,000 documents is common, one in five isn't, wherever they stand."""
    n = 4000
    often, seldom = ([f"{kind}_{k:02}_X9Kq2" for k in range(40)] for kind in ("often", "seldom"))
    held = {i: [] for i in range(n)}
    for times, names in ((6, often), (5, seldom)):
        for k, name in enumerate(names):
            for j in range(times):
                held[(97 * k + 613 * j) % n].append(name)
    df = spark.createDataFrame([(i, " ".join(["word", *names])) for i, names in held.items()], "doc_id long, text string")
    kept = secret_scan.learned(df).identifiers.removesuffix(secret_scan.IDENTIFIERS).decode().split()
    assert sorted(kept) == often
