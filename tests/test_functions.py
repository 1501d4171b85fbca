"""Value fixtures of the functions."""

import pytest
from pyspark.sql import functions as F

from grainfield.functions import answers, privacy, text, urls
from grainfield.operators import html, relevance


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.mark.parametrize("given, expected", [(None, ""), ("  Größe\n ÄÖÜ ", "groesse aeoeue"), ("", "")])
def test_normalize(spark, given, expected):
    assert one(spark, text.normalize_text("t"), t=given) == expected


def test_keywords(spark):
    model = {"a": ["oeffentliche-auslegung", "radweg"], "b": ["satzung"]}
    hits = one(spark, text.category_hits(text.normalize_text("t"), model), t="Öffentliche Auslegung der Radwege; Satzungen, Vorsatzung")
    assert hits == {"a": ["oeffentliche-auslegung", "radweg"], "b": ["satzung"]}
    assert one(spark, text.coverage_score(text.category_hits(text.normalize_text("t"), model), model), t="") == 0.0


def test_ensemble(spark):
    row = relevance.classify(spark.createDataFrame([("Bebauungsplan und Satzung",), ("",)], "t string"), "t", text.DEFAULT_KEYWORDS).collect()
    assert abs(row[0].score - (0.4 * row[0].tfidf_score + 0.6 * row[0].bayes_score)) < 0.001
    assert row[1].score == 0 and not row[1].is_relevant and row[1].top_category == "bauen"


@pytest.mark.parametrize(
    "given, expected",
    [("a@b.de und c.d@e.org", "[E-MAIL ENTFERNT] und [E-MAIL ENTFERNT]"), ("040 123456789", "[TEL ENTFERNT]"), ("DE89 3704 0044 0532 0130 00", "[IBAN ENTFERNT]"), ("DE89370400440532013000", "[IBAN ENTFERNT]"), (None, None)],
)
def test_redact(spark, given, expected):
    assert one(spark, privacy.redact("t")[0], t=given) == expected


def test_redact_order(spark):
    assert "[TEL ENTFERNT]" in one(spark, privacy.redact("t", "phone_first")[0], t="DE89 3704 0044 0532 0130 00")


@pytest.mark.parametrize("url", ["https://x.de/login", "https://x.de/Admin/1", "https://x.de/datenschutz", "https://x.de/bewerbung"])
def test_sensitive(spark, url):
    assert one(spark, privacy.is_sensitive_url("u"), u=url) and not one(spark, privacy.is_sensitive_url("u"), u="https://x.de/news")


def test_compare_key(spark):
    given = ["http://www.x.de/a/", "https://x.de/a?b=1", "https://x.de/a/index.html", "HTTPS://X.de/a#c"]
    assert {one(spark, urls.compare_key("u"), u=u) for u in given} == {"x.de/a"}


@pytest.mark.parametrize("given, expected", [("www.muster.de", "muster.de"), ("muster.de", "muster.de"), ("www.sub.muster.de", "sub.muster.de")])
def test_www(spark, given, expected):
    assert one(spark, urls.strip_www("h"), h=given) == expected


@pytest.mark.parametrize(
    "href, expected",
    [("b", "https://x.de/a/b"), ("/b#c", "https://x.de/b"), ("?q=1", "https://x.de/a/i.html?q=1"), ("//y.de/b", "https://y.de/b"), ("../b", "https://x.de/b"), ("http://z.de", "http://z.de")],
)
def test_resolve(spark, href, expected):
    assert one(spark, html.resolve(F.col("h"), F.lit("https://x.de/a/i.html")), h=href) == expected


def test_chunks(spark):
    c = one(spark, text.chunks("t", 6, 2), t="0123456789")
    assert [x.start for x in c] == [0, 4, 8] and [x.body for x in c] == ["012345", "456789", "89"] and c[1].prefix == "23"
    assert text.chunk_step(10, 10) == (1, 9)


ANSWERS = [
    ("```json\n{\"massnahmen\": [{\"massnahme\": \"A\", \"kategorie\": \"\"}]}\n```", "ok", ["A"]),
    ("<think>{x}</think>{\"funde\": [\"T1\", \"T2\"]}", "ok", ["T1", "T2"]),
    ("{\"results\": [{\"titel\": \"K\"},]}", "repaired", ["K"]),
    ("nichts", "parse_error", []),
    ("", "empty_response", []),
    (None, "empty_response", []),
    ("{\"a\": [ {\"massnahme\": \"R\"} x", "parse_error", ["R"]),
]


@pytest.mark.parametrize("raw, status, titles", ANSWERS)
def test_answers(spark, raw, status, titles):
    parsed = answers.parse_answers(spark.createDataFrame([("https://x.de/", raw)], "url string, raw string"))
    assert parsed.first().status == status
    assert [r.massnahme for r in answers.findings(parsed).orderBy("pos").collect()] == titles


def test_pages(spark):
    page = """<html><body><nav><p>Menu</p></nav><script>var x = "<p>no</p>";</script><p>Text &amp; mehr</p>
    <div><p>Siehe <a href='/plan.html'>Plan</a> <a href="https://other.de/x">fremd</a> <a href="#a">anker</a></p></div></body></html>"""
    parsed = html.parse_pages(spark.createDataFrame([(1, "https://www.x.de/", page), (2, "https://x.de/", None)], "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in parsed.collect()} == {1: "Text & mehr Siehe Plan fremd anker", 2: ""}
    link = html.links(parsed).collect()
    assert [(r.url, r.anchor, r.context) for r in link] == [("https://www.x.de/plan.html", "Plan", "Siehe Plan fremd anker")]


def test_rank(spark):
    rows = spark.createDataFrame([(1, 0, "https://x.de/impressum", "Impressum", "", 0.5), (1, 1, "https://x.de/bebauungsplan", "Bebauungsplan", "", 0.5), (1, 2, "https://x.de/a.PDF", "", "", 0.5)], "page_id int, pos int, url string, anchor string, context string, page_score double")
    ranked = relevance.rank_links(relevance.score_links(rows, text.DEFAULT_KEYWORDS)).orderBy("rank").collect()
    assert [r.pos for r in ranked] == [2, 1, 0]


def test_robots(spark):
    rules = html.robots_rules(spark.createDataFrame([("x.de", "User-agent: *\nDisallow: /privat\nAllow: /\n# c")], "host string, txt string"))
    rows = spark.createDataFrame([(1, "https://x.de/privat/a"), (2, "https://x.de/b"), (3, "https://y.de/privat")], "page_id int, url string")
    assert {r.page_id: r.allowed for r in html.robots_allowed(rows, rules).collect()} == {1: False, 2: True, 3: True}


def test_metadata(spark):
    df = spark.createDataFrame([({"Author": "x", "IP": "y", "t": "z"},)], "m map<string,string>")
    assert df.select(privacy.sanitize_metadata("m").alias("m")).first().m == {"Author": "[ENTFERNT – DSGVO Art. 5]", "IP": "[ENTFERNT – DSGVO Art. 5]", "t": "z"}
