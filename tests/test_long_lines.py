"""Queries against their SQL on tables that the small scales do not have: lines of over a thousand words, values halfway between numbers, tall images."""

import datetime

import pytest

from foliant.plans.catalog import ORACLES, QUERIES
from tests.parity import compare, connect


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    long_line = " ".join(f"w{i % 23}" for i in range(1010))
    docs = [(1, f"{long_line}\n{' '.join('abcdefghijkl')}\n\nlast"), (2, "a b\nc d")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    # Places from 0 to 1500 rows down, and values whose halves round to the even number.
    events = [(i * 1500 + k, i % 3, datetime.datetime(2024, 1, 1), "click", (i % 90) + 0.5) for i in range(1201) for k in (0, 151, 450)]
    events.append((4351, 9, datetime.datetime(2024, 1, 1), "click", 226.5))
    spark.createDataFrame(events, "event_id long, user_id long, ts timestamp, event_type string, value double").write.parquet(f"{d}/events.parquet")
    for t in "region nation customer supplier part orders lineitem embeddings pages benchmark labels conversations".split():
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(1).write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.mark.parametrize("name", ["row_groups", "export_text", "export_csv", "export_html", "rover_merge", "word_order", "element_order", "rover_candidates", "pixel_diff", "mrc_layers"])
def test_query(spark, tables, name):
    compare(QUERIES[name](spark, tables), ORACLES[name], connect(tables))
