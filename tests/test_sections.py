from pyspark.sql import functions as F

from gleanery.operators import html, sections, validation


def nodes(spark, *texts, doc="d"):
    return spark.createDataFrame([(doc, i, t) for i, t in enumerate(texts)], "doc string, node_idx int, text string")


def extract(spark, *texts, **kw):
    return [r.asDict() for r in sections.extract_sections(nodes(spark, *texts), **kw).orderBy("seg").collect()]


def test_titles_parts_and_bodies(spark):
    got = extract(spark, "before", "PART II", "Item 7. Management", "one", "two", "ITEM 8 -", "Statements", "three", "Item 5.", "PART IV", "body five", "Signatures", "Item 9. Never")
    assert [(s["part"], s["item"], s["title"], s["text"]) for s in got] == [("PART II", "Item 7", "Management", "one\ntwo"), ("PART II", "Item 8", "Statements", "three"), ("PART II", "Item 5", "", "body five")]


def test_longest_duplicate_wins_then_first(spark):
    got = extract(spark, "Item 7. A", "short", "Item 7. B", "longer text", "Item 7. C", "equal lengt")
    assert [(s["title"], s["duplicates"], s["seg"]) for s in got] == [("B", 2, 1)]


def test_item_beyond_the_canon_keeps_the_part_seen(spark):
    got = extract(spark, "Item 17. X", "a", "PART III", "Item 18. Y", "b")
    assert [(s["item"], s["part"]) for s in got] == [("Item 17", None), ("Item 18", "PART III")]


def test_headings_fire_once_and_only_in_item_15(spark):
    heading = "Management’s Discussion and Analysis:"
    assert [s["item"] for s in extract(spark, "Item 9. Z", heading, "text")] == ["Item 9"]
    got = extract(spark, "Item 15. Exhibits", "list", heading, "analysis", heading, "more")
    assert [(s["item"], s["part"], s["title"], s["text"]) for s in got] == [("Item 15", "PART IV", "Exhibits", "list"), ("Item 7", "PART II", heading, f"analysis\n{heading}\nmore")]
    assert [s["item"] for s in extract(spark, "Item 15. E", "list", heading + " " + "x" * 150, "b")] == ["Item 15"]


def test_flags_and_stats(spark):
    n = nodes(spark, "PART III", "Item 11. Pay", "Incorporated herein by reference to the proxy.", "Item 12. Own", "y" * 600)
    s = sections.extract_sections(n)
    flags = {r["item"]: (r["incorporated_by_reference"], r["oversized"]) for r in sections.flag_oversized(s, 500).collect()}
    assert flags == {"Item 11": (True, False), "Item 12": (False, True)}
    assert [tuple(r) for r in sections.extraction_stats(n, s).collect()] == [("d", ["PART III"], 2, 0, [])]
    late = nodes(spark, "PART IV", "Item 15. E", "list", "Management's Discussion and Analysis", "x", "Signatures", "PART I", "Item 1. No", "y")
    assert [tuple(r) for r in sections.extraction_stats(late, sections.extract_sections(late)).collect()] == [("d", ["PART IV"], 2, 0, ["PART II/Item 7"])]


def test_empty_nodes(spark):
    assert sections.extract_sections(nodes(spark).limit(0)).count() == 0


def test_gaps(spark):
    items = spark.createDataFrame([("f", x) for x in ("Item 1", "Item 1A", "Item 1C", "Item 4", None)], "source_file string, item string")
    assert sorted(r["gap"] for r in validation.item_gaps(items).collect()) == ["Item 1B", "Item 2", "Item 3"]


def test_html_nodes_by_both_ways(spark):
    page = '<html><script>var t="</p>";</script><!-- no --><p>One &amp; two</p><a href="#">link</a><div>  three <b>four</b></div><style>x</style></html>'
    df = spark.createDataFrame([("p", page), ("q", None), ("r", "")], "id string, html string")
    by_regex = [r["text"] for r in html.text_nodes(df, "id", "html").orderBy("node_idx").collect()]
    by_parser = [r["text"] for r in html.parsed_text_nodes(df, "id", "html").orderBy("node_idx").collect()]
    assert by_regex == by_parser == ["One & two", "three", "four"]
    broken = spark.createDataFrame([("p", "<p>a<b>b<br>c")], "id string, html string")
    assert [r["text"] for r in html.parsed_text_nodes(broken, "id", "html").orderBy("node_idx").collect()] == ["a", "b", "c"]


def test_links_that_nobody_closes_and_references(spark):
    cases = {
        "<p><a name='toc'>Item 1. Business</p><p>We sell quills.</p>": ["We sell quills."],
        "<div><a href=x>link <b>bold</b></a> text <a>one<a>two</div>after": ["text", "after"],
        "<td><a>q</td><td>r</td>": ["r"],
        "<a><div>link</div></a>free": ["free"],
        "<p>x<a>lost<div>seen</div></p>tail": ["x", "seen", "tail"],
        "<p>a<b>b</p>c</b>d": ["a", "b", "c", "d"],
        "Item&#160;7. Management&#8217;s &mdash; &#x2014;x&#x1F600;y&#150;": ["Item 7. Management’s — —x😀y–"],
        "<ix:nonNumeric>v</ix:nonNumeric>": ["v"],
        "<b>" * 30_000 + "deep" + "<p>" * 30_000: ["deep"],
    }
    for page, want in cases.items():
        assert html.nodes_of(page) == want, page[:80]
    page = "&#38;lt; &#0;|&#39;&#zz;&#; &rsquo;"
    df = spark.createDataFrame([("p", page)], "id string, html string")
    assert html.text_nodes(df, "id", "html").first()["text"] == html.nodes_of(page)[0] == "&lt; \ufffd|'&#zz;&#; ’"


def test_summary_counts_the_gaps_that_are_listed(spark):
    labels = ["Item 1", "Item 1A", "Item 1C", "Item 1F", "Item 4", "Item 9B", "odd", None]
    s = spark.createDataFrame([("f", "PART I", x, "t", 0) for x in labels] + [("g", None, "Item 3", "t", 1)], "source_file string, part string, item string, text string, duplicates int")
    listed = {r["source_file"]: r["count"] for r in validation.item_gaps(s).groupBy("source_file").count().collect()}
    got = {r["source_file"]: (r["gaps"], r["parts"], r["no_part"], r["dup"]) for r in validation.filing_summary(s).collect()}
    assert got == {"f": (listed["f"], 1, False, 0), "g": (0, 0, True, 1)}


def test_filing_summary(spark):
    s = sections.extract_sections(nodes(spark, "Item 1. A", "x", "Item 3. B", "y")).withColumn("source_file", F.lit("f"))
    assert [tuple(r) for r in validation.filing_summary(s).collect()] == [("f", 1, 2, 1, 2, 0, False)]
