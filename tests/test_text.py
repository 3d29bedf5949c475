from pyspark.sql import functions as F

from attestra.functions import canonical_json as J
from attestra.functions import hashing, html, redaction, text as T
from tests import model

TEXTS = [
    "Müssen natürliche Personen über KI-Systeme informiert werden?",
    "GROẞ Straße ÄÖÜ x yy z-9 --- a",
    "𝒳 𝒳𝒴 emoji 😀😀 tail",
    " lead and﻿trail　\r\nnext\0line ",
    "",
    "a.b,c;d 42 7 ½",
]


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t"))).first()[0]


def test_terms_follow_the_model(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select(
        "t", T.terms(F.col("t")).alias("a"), T.embedding_tokens(F.col("t")).alias("b")
    )
    for row in rows.collect():
        assert row["a"] == model.terms(row["t"])
        assert row["b"] == model.terms(row["t"], fold=False)


def test_normalization_and_lengths(spark):
    assert one(spark, TEXTS[3], T.normalize_text) == "lead and﻿trail　\nnextline"
    assert one(spark, "x😀y", T.utf16_length) == 4
    assert one(spark, "plain", T.utf16_length) == 5
    assert one(spark, TEXTS[3], T.whitespace_tokens) == model.split_blanks(TEXTS[3])


def test_warnings(spark):
    kind = lambda k: lambda t: T.extraction_warnings(t, F.lit(k))
    text = "Hidden-Text SCANNED-PDF"
    assert one(spark, text, kind("pdf")) == ["hidden-text-warning", "ocr-used"]
    assert one(spark, text, kind("markdown")) == ["hidden-text-warning"]


def test_word_xml(spark):
    xml = "<w:p><w:t>A</w:t><w:tab/><w:t>&lt;b&gt; &amp;lt;</w:t></w:p>"
    assert one(spark, xml, T.word_xml_to_text) == "  A \t <b> &lt; \n"


def test_sentences(spark):
    assert one(spark, " One.  Two!\nThree? four ", T.sentences) == ["One.", "Two!", "Three?", "four"]
    assert one(spark, "One. Two! Three", T.sentences) == ["One.", "Two!", "Three"]


def test_html_article(spark):
    page = (
        "<script>var x='<p>';</script><p>intro (1) Text &#228; &#x41; &amp;lt; &quot;q&quot;</p>"
        "<style>p{}</style> more © Europäische Union foot"
    )
    body = one(spark, page, lambda t: html.article_body(html.visible_text(t)))
    assert body["body"] is None and body["problem"] == "undecoded entity"
    body = one(spark, page.replace("&amp;lt;", "&AMP; &apos;"),
               lambda t: html.article_body(html.visible_text(t)))
    assert body["body"] == "(1) Text ä A & ' \"q\" more" and body["problem"] is None
    for text, problem in (
        ("no marker © Europäische Union", "start marker missing"),
        ("(1) text", "end marker missing"),
        ("(1) &auml; © Europäische Union", "undecoded entity"),
    ):
        assert one(spark, text, html.article_body)["problem"] == problem


def test_stable_ids(spark):
    got = one(spark, "a/b", lambda t: hashing.stable_id("doc", t, F.lit(3)))
    assert got == hashing.stable_id_text("doc", "a/b", "3") and len(got) == 28


def test_canonical_numbers():
    cases = {
        1.0: "1", -0.0: "0", 0.1: "0.1", 1e-7: "1e-7", 1.5e-6: "0.0000015", 1e21: "1e+21",
        123456789012345680000.0: "123456789012345680000", 5e-324: "5e-324", 1.25e30: "1.25e+30",
        100: "100", 0.000001: "0.000001", 12.5: "12.5",
    }
    for value, text in cases.items():
        assert J.canonical_text(value) == text


def test_canonical_objects(spark):
    raw = '{"b": [1.0, {"z": null, "a": true}], "10": 1, "9": 2, "ä": "\\u001f\\"", "A": 1e400}'
    ok = raw.replace(', "A": 1e400', "")
    assert one(spark, ok, J.canonical_json) == (
        '{"9":2,"10":1,"b":[1,{"a":true,"z":null}],"ä":"\\u001f\\""}'
    )
    for bad in ("NaN", "Infinity"):
        try:
            J.canonical_text(float(bad.lower()))
        except ValueError:
            continue
        raise AssertionError(bad)


def test_json_string_escapes(spark):
    text = 'q"b\\s/\x1f\x0b\n\t literal \\u000B ä'
    got = one(spark, text, lambda t: J.lower_escapes(J.json_string(t)))
    assert got == J.canonical_text(text)
    assert one(spark, None, lambda t: J.json_string(t)) == "null"


def test_redaction(spark):
    nested = '{"queryText":"x","keep":1,"deep":{"password":"p","list":[{"pii":1},[{"pii":2}]]}}'
    assert one(spark, nested, redaction.redact_json) == (
        '{"queryText":"[redacted]","keep":1,"deep":{"password":"[redacted]",'
        '"list":[{"pii":"[redacted]"},[{"pii":2}]]}}'
    )
    assert one(spark, "see postgres://h", redaction.has_prompt_secret)
    assert not one(spark, "risk assessment", redaction.has_prompt_secret)
    assert one(spark, "h", lambda t: redaction.egress_allowed(t, [])) is False
