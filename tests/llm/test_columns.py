"""Extra columns come back unchanged, whatever they are called."""

import pytest
from pyspark.sql import functions as F

from foliant.llm import byte_bpe, line_dedup, mixing, ngram_join, quality_rules, url_filters
from tests.llm.helpers import docs

#: Names that operators use on the way, or for their results.
NAMES = (
    "_h _th _lines _gone _id _removed _n_lines _place _bucket _aim _aim_source _size _times _target _source_size _i _rule _host _path _terms pattern n_words n_symbols "
    "kept base_failed posterior ids n_tokens ids_sha256 id th key uid root first host path rule verdict n_strict n_soft soft_weight caller_0 caller_1 caller_9 one _r _n"
).split()
TEXTS = ["one two three four five six seven eight nine ten " * 12, "alpha beta gamma delta epsilon zeta eta\n" * 3 + "other words in this line here now", None, ""]


def _wide(spark):
    d = docs(spark, TEXTS)
    return d.select("*", *[F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")).alias(n) for n in NAMES if n not in d.columns])


def _unchanged(out, results=()):
    for r in out.collect():
        for n in NAMES:
            if n not in results:
                assert r[n] == f"{n} of {r['doc_id']}"


@pytest.mark.parametrize("stage", [quality_rules.stage, line_dedup.stage, ngram_join.stage, mixing.stage])
def test_stages(spark, stage):
    wide = _wide(spark)
    out = stage(spark, wide, "")
    assert out.columns == wide.columns
    _unchanged(out)


def test_operators(spark):
    wide = _wide(spark)
    plain = docs(spark, TEXTS)
    for f, made in (
        (line_dedup.line_dedup, ["_n_lines", "_removed"]),
        (mixing.mix, ["_size", "_source_size", "_target", "_times"]),
        (quality_rules.quality_rules, [*quality_rules.COUNTS, "base_failed", "posterior", "kept"]),
        (byte_bpe.encode, ["ids", "n_tokens", "ids_sha256"]),
        (lambda d: url_filters.url_filter(d, "text"), ["host", "path", "rule", "verdict", "n_strict", "n_soft", "soft_weight"]),
    ):
        got = f(wide)
        _unchanged(got, made)
        own = ["doc_id", "text", *made]
        assert sorted(map(str, got.select(own).collect())) == sorted(map(str, f(plain).select(own).collect()))
