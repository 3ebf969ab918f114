"""Text of markup against the standard library's decoder, form by form."""

import html

import pytest
from pyspark.sql import functions as F

from intentloom.functions import markup

FORMS = [
    "a &amp; b", "&amp;lt;", "&lt;b&gt;", "&copy 2024", "&copy2024", "&notit; &notin; &not;", "&nosuch; &nosuchname", "&", "&&amp;&", "&;", "& amp;", "&#65;&#x41;&#X41;", "&#65 &#x41 &#65a &#x41g", "&#0; &#00065;",
    "&#128; &#150; &#x9f; &#129; &#141;", "&#xD800; &#xdfff; &#x110000; &#99999999999999999999; &#xFFFFFFFFFFFFFFFFFFFF;", "&#1; &#8; &#11; &#13; &#31; &#127;", "&#xFDD0; &#xFFFE; &#x1FFFF; &#x10FFFF;",
    "&#x1F600; &#128512;", "&#; &#x; &#xg; &#-1;", "&NotEqualTilde; &fjlig; &acE;", "&AMP;&amp &Amp;", "&ampamp; &ltgt &ltcc;", "plain", "", "&nbsp;x", "&quot;q&quot; &apos;", "&CounterClockwiseContourIntegral;!", "&hellip;&middot;", "é&eacute;\U0001f600",
]


def test_references_as_the_standard_library_reads_them(spark):
    rows = spark.createDataFrame(list(enumerate(FORMS)), "i int, t string").select("i", markup.decoded_references(F.col("t")).alias("t")).collect()
    assert {FORMS[r.i]: r.t for r in rows} == {t: html.unescape(t) for t in FORMS}
    assert spark.range(1).select(markup.decoded_references(F.lit(None))).first()[0] == ""


def test_every_name_of_the_table(spark):
    names = [*markup.NAMES]
    rows = spark.createDataFrame([(n, f"<{n}>&{n}.") for n in names], "n string, t string").select("n", markup.decoded_references(F.col("t")).alias("t")).collect()
    assert {r.n: r.t for r in rows} == {n: f"<{n}>" + html.unescape(f"&{n}.") for n in names}


def test_a_table_of_ones_own(spark):
    c = markup.decoded_references(F.lit("&me; &amp; &me"), {"me;": "I"})
    assert spark.range(1).select(c).first()[0] == "I &amp; &me"


@pytest.mark.parametrize(("page", "text"), [
    ("<p>Fish &amp; <b>chips</b></p>", "Fish & chips"), ("<script>a &lt; b</script>x&lt;y", "x<y"), ("a&#32;&#10; b", "a b"), ("a&nbsp;b", "a b"), ("&lt;b&gt;bold&lt;/b&gt;", "<b>bold</b>"), (None, ""), ("<!-- &amp; -->", ""),
])
def test_element_text(spark, page, text):
    assert spark.createDataFrame([(page,)], "h string").select(markup.element_text(F.col("h"))).first()[0] == text
