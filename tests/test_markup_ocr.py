import pytest
from pyspark.sql import functions as F

from foliant.operators import layout, markup, ocr


@pytest.mark.parametrize(
    ("djot", "html", "plain"),
    [
        ("a *b* _c_ **d _e_**", "a <b>b</b> <i>c</i> <b>d <i>e</i></b>", "a b c d e"),
        (r"\*not\* <x>", "*not* &lt;x&gt;", "*not* <x>"),
        ("`a*b*`", '<span style="font-family:Courier">a*b*</span>', "a*b*"),
        ("[l\\]x](u&v)", '<a href="u&amp;v">l]x</a>', "l]x"),
        ("lone * and ` and [x", "lone * and ` and [x", "lone * and ` and [x"),
    ],
)
def test_inline(djot, html, plain):
    assert markup.inline(djot, True) == html and markup.inline(djot, False) == plain


def test_blocks(spark):
    body = markup.to_fragment("## T\n\n- a\n- b\np")
    assert body.endswith('<p style="font-weight:bold">T</p><ul><li>a</li><li>b</li></ul><p>p</p></body>')
    assert markup.to_plain("# T\n\n- a\np") == "T\n\n• a\np"
    df = spark.createDataFrame([("x",), (None,)], "djot string")
    assert [r.plain for r in markup.converted(df).collect()] == ["x", None]


def test_engine_errors_and_strategies(spark):
    def make():
        def engine(content):
            if content == b"bad":
                raise ValueError("no page")
            return [(content.decode(), 0.0, 0.0, 10.0, 10.0, len(content) * 20)]

        return engine

    images = spark.createDataFrame([(1, 0, 10, 10, b"ok"), (2, 0, 10, 10, b"bad"), (3, 0, 99999, 10, b"ok"), (4, 0, 10, 10, b"sure!")], "doc_id long, page_no int, width int, height int, content binary")
    first = ocr.recognize(images, "A", make)
    assert {r.doc_id: r.error for r in first.collect()} == {1: None, 2: "ValueError: no page", 3: "too large", 4: None}
    words = first.filter("error IS NULL")
    second = words.withColumn("engine", F.lit("B")).withColumn("confidence", F.lit(95)).withColumn("text", F.upper("text"))
    names = ("A", "B")
    text = lambda s: {r.doc_id: (r.text, r.source_engine) for r in ocr.combined(words, second, s, names).collect()}
    assert text("PrimaryOnly") == {1: ("ok", "A"), 4: ("sure!", "A")}
    assert text("ConfidenceWeighted") == {1: ("OK", "ROVER"), 4: ("sure!", "A")}
    assert text("RoverVote") == {1: ("OK", "ROVER"), 4: ("sure!", "ROVER")}
    with pytest.raises(ValueError):
        ocr.combined(words, second, "other", names)


def test_text_boxes(spark):
    px = [(1, 0, x, y, 0.9) for x in range(10, 20) for y in range(5, 15)] + [(1, 0, 50, 50, 0.1)]
    b = ocr.text_boxes(spark.createDataFrame(px, "doc_id long, page_no int, x int, y int, score double"), F.lit(100), F.lit(100)).collect()
    assert [(r.x, r.y, r.w, r.h, r.area) for r in b] == [(7, 2, 16, 16, 100)]
    assert layout.first_band([0, 3, 40, 5], [10, 10, 10, 10]) == [0, 0, 1, 0]


def test_preview_of_a_tree(spark):
    from foliant.operators import documents

    kind = "doc_id int, page_no int, block int, row_no int, cell_no int, kind string, inlines array<struct<kind: string, texts: array<string>>>"
    rows = [
        (1, 0, 0, 0, 0, "Heading", [("Text", ["a&b"])]), (1, 0, 1, 0, 0, "List", [("Code", ["x", "<y>"]), ("Text", ["!"])]), (1, 0, 1, 1, 0, "List", []),
        (1, 2, 0, 0, 0, "Table", [("Strong", ["h"])]), (1, 2, 0, 1, 0, "Table", None), (1, 2, 0, 1, 1, "Table", [("Emph", ["c"])]), (1, 2, 1, 0, 0, "ListItem", [("Text", ["loose"])]),
    ]
    sections = spark.createDataFrame([(1, 0, None), (1, 1, 'T "1"'), (1, 2, ""), (2, 0, None)], "doc_id int, page_no int, title string")
    got = {r.doc_id: r.html for r in documents.to_preview(spark.createDataFrame(rows, kind), sections).collect()}
    assert got[2] == documents.PREVIEW_OPEN + "</body></html>"
    code, head, cell = documents.PREVIEW_INLINES["Code"][0], documents.PREVIEW_HEAD, documents.PREVIEW_CELL
    want = [
        documents.PREVIEW_BLOCKS["Heading"][0], "a&amp;b</h1>", documents.PREVIEW_BLOCKS["List"][0], f"<li>{code}x&lt;y&gt;</code>!</li><li></li></ul>", documents.PREVIEW_TITLE, "T &quot;1&quot;</h2>",
        documents.PREVIEW_BLOCKS["Table"][0], f"<tr><th style='{head}'><b>h</b></th></tr><tr><td style='{cell}'></td><td style='{cell}'><i>c</i></td></tr></table>loose",
    ]
    assert got[1] == documents.PREVIEW_OPEN + "".join(want) + "</body></html>"


def test_pages_that_failed_are_paragraphs(spark):
    from foliant.operators import documents, forms

    pages = spark.createDataFrame([(1, 0, ""), (1, 1, "no engine"), (2, 0, None)], "doc_id int, page_no int, error string")
    nodes = documents.error_pages(pages).collect()
    assert [(r.doc_id, r.page_no, r.block, r.kind, r.text) for r in nodes] == [(1, 1, 0, "Paragraph", "[OCR error: no engine]")]
    names = spark.createDataFrame([(["Fields", "XFA"],), (["Fields"],), ([],)], "names array<string>")
    assert [r[0] for r in names.select(forms.has_xfa("names")).collect()] == [True, False, False]
