import pytest
from pyspark.sql import functions as F

from foliant.functions import patterns, strings
from foliant.operators import redaction, search


def _one(spark, text):
    return spark.createDataFrame([(1, text)], "id long, text string")


@pytest.mark.parametrize(
    ("name", "text", "n"),
    [
        ("email", "contact: test@example.com today", 1),
        ("email", "Hello World", 0),
        ("phone-us", "Call us at (555) 123-4567 for details", 1),
        ("phone-intl", "dial +44 20 79460958 now", 1),
        ("ssn", "SSN: 123-45-6789", 1),
        ("credit-card", "Card: 4111 1111 1111 1111", 1),
        ("ipv4", "from 10.0.0.1 to 10.0.0.2", 2),
        ("ipv6", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", 1),
        ("iban", "pay DE89370400440532013000 now", 1),
        ("uk-postcode", "at SW1A 1AA", 1),
        ("us-zip", "NY 10001-1234 and 94105", 2),
        ("date-iso", "on 2024-02-29", 1),
        ("date-us", "on 2/29/2024", 1),
        ("ssn", "ß123-45-6789", 1),
    ],
)
def test_named_patterns(spark, name, text, n):
    row = _one(spark, text).select(patterns.count(F.col("text"), patterns.named_pattern(name)).alias("n"), patterns.matches(F.col("text"), patterns.named_pattern(name)).alias("m")).first()
    assert row.n == n == len(row.m)


def test_catalog_and_unknown_name(spark):
    assert patterns.available_patterns(spark).count() == 12
    with pytest.raises(ValueError):
        patterns.named_pattern("nothing")
    for bad in ("", "(", "[a"):
        with pytest.raises(ValueError):
            patterns.checked_pattern(bad)


def test_custom_pattern_and_nulls(spark):
    df = _one(spark, "Reference: ACME-2026-ALPHA approved").union(_one(spark, None))
    got = [r.m for r in df.select(patterns.matches(F.col("text"), r"\bACME-\d{4}-[A-Z]+\b").alias("m")).collect()]
    assert got == [["ACME-2026-ALPHA"], []]


def test_match_spans(spark):
    s = _one(spark, "a 10.0.0.1, b 10.0.0.2.").select(patterns.match_spans(F.col("text"), patterns.NAMED["ipv4"]).alias("s")).first().s
    assert [(x.start, x.stop, x.match) for x in s] == [(2, 10, "10.0.0.1"), (14, 22, "10.0.0.2")]


def test_redacted_text_is_gone(spark):
    df = _one(spark, "mail a@b.co, card 4111-1111-1111-1111")
    out = redaction.redact_patterns(df, "text", ["email", "credit-card"], "#").first().text
    assert out == "mail #, card #"
    log = redaction.audit(df, "id", "text", ["email", "credit-card", "ipv4"], "#").first()
    assert log.operations == "email:1,credit-card:1"
    assert redaction.audit(_one(spark, "clean"), "id", "text", ["email"]).count() == 0


def test_search_options(spark):
    df = spark.createDataFrame([(1, "The cat. the Catalog"), (2, "dog")], "id long, text string")
    n = lambda **o: [r.n_hits for r in search.search(df, "text", "cat", **o).collect()]
    assert n() == [2] and n(match_case=True) == [1] and n(whole_word=True) == [1]
    assert [r.n_hits for r in search.search(df, "text", "c.t", is_regex=True).collect()] == [2]
    assert search.search(df, "text", "c.t").count() == 0
    assert df.select(search.positions(F.col("text"), "at").alias("p")).first().p == [5, 14]


def test_replace(spark):
    df = _one(spark, "aXbXc")
    assert search.replace_all(df, "text", "X", "--").first().text == "a--b--c"
    assert search.replace_first(df, "text", "X", "--").first().text == "a--bXc"
    assert search.replace_first(df, "text", "Q", "--").first().text == "aXbXc"


def test_strings(spark):
    df = _one(spark, "a*b_[c]")
    row = df.select(
        strings.djot_escape(F.col("text")).alias("d"),
        strings.xml_escape(F.lit("<a href='x'>&\"")).alias("x"),
        strings.csv_row(F.array(F.lit('say "hi"'), F.lit(None).cast("string"))).alias("c"),
        strings.padded_number(F.lit(1234567), 6).alias("long"),
        strings.padded_number(F.lit(42), 6).alias("short"),
        strings.base_font(F.lit("/ABCDEF+Helvetica-Bold")).alias("f"),
        strings.byte_size(F.lit(1536)).alias("b"),
        strings.file_stem(F.lit("/x.y/report.final.pdf")).alias("s"),
    ).first()
    assert row.d == r"a\*b\_\[c\]"
    assert row.x == "&lt;a href=&#39;x&#39;&gt;&amp;&quot;"
    assert row.c == '"say ""hi""",""'
    assert (row.long, row.short, row.f, row.b, row.s) == ("1234567", "000042", "Helvetica", "1.5 KB", "report.final")


def test_plans_of_many_patterns_grow_by_a_constant(spark):
    from foliant.functions import patterns
    from foliant.operators import redaction

    df = spark.range(1).selectExpr("id", "'call 555-123-4567 or a@b.co' AS text")
    names = list(patterns.NAMED)

    def plan(out):
        return out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace")

    for k in (3, 12):
        assert plan(redaction.redact_patterns(df, "text", names[:k])) == k
        assert plan(redaction.audit(df, "id", "text", names[:k])) == k
    row = redaction.audit(df, "id", "text", names, "[X]").collect()[0]
    assert row["operations"] == "email:1,phone-us:1"


def test_literal_strings_there_and_back(spark):
    from foliant.functions import strings

    cases = {"a(b)c": r"a\(b\)c", "x\\y": r"x\\y", "\n\r\t\b\f": r"\n\r\t\b\f", "é\x01": r"\303\251\001", r"\(\n done": r"\(\n done", "": "", "\\": r"\\", "\\q": r"\\q"}
    df = spark.createDataFrame(list(cases.items()), "t string, want string").withColumn("e", strings.literal_escape(F.col("t")))
    for r in df.select("*", strings.literal_escape(F.col("e")).alias("again"), strings.literal_unescape(F.col("e")).alias("back")).collect():
        assert r.e == r.want and (r.again == r.e or r.t == "é\x01")
        if "\\" not in r.t or r.t in ("x\\y", "\\", "\\q"):
            assert r.back == r.t
    odd = spark.createDataFrame([(r"\101\7\60a\0053\z\\" + "\\",)], "t string").select(strings.literal_unescape(F.col("t"))).first()[0]
    assert odd == "A\x070a\x053z\\\\"
    assert spark.createDataFrame([(None,)], "t string").select(strings.literal_escape(F.col("t"))).first()[0] is None


def test_many_hits_in_one_text(spark):
    import time

    from foliant.functions import patterns
    from foliant.operators import search

    n = 100_000
    df = spark.createDataFrame([("ab 1.2.3.4, " * n,), ("",), (None,), ("1.2.3.4",)], "text string")
    began = time.time()
    rows = df.select(patterns.match_spans(F.col("text"), patterns.NAMED["ipv4"]).alias("s"), search.positions(F.col("text"), "1.2").alias("p")).select(
        F.transform("s", lambda x: x["start"]).alias("s"), "p").collect()
    assert rows[0].s == rows[0].p == [12 * i + 3 for i in range(n)] and [list(r.s or []) for r in rows[1:]] == [[], [], [0]] and [list(r.p) for r in rows[1:]] == [[], [], [0]]
    assert time.time() - began < 60
