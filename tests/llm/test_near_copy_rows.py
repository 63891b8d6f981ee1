"""The near-copy stage on rows without an id, with an id that is used twice, and on repeated rows."""

import corpus_pipeline as pipeline
import pytest

from tessera.llm import simhash

BASE = " ".join(f"word{i}" for i in range(80))
OTHER = " ".join(f"thing{i}" for i in range(80))
ROWS = [
    (5, BASE), (7, BASE + " end"), (None, BASE), (None, "start " + BASE),  # one group
    (1, OTHER), (1, "a text of its own, with an id that is there twice"), (1, OTHER),  # an id of two texts, one of them repeated
    (None, "nobody else says this"), (None, "nobody else says this"),  # a group without ids
    (9, None), (8, ""),  # alike: no words
]


@pytest.fixture
def table(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1, 2) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long, kept int")


def test_one_row_of_each_group_stays(spark, table):
    left = [(r.doc_id, r.text) for r in pipeline.no_near_copies(spark, table, "").collect()]
    assert sorted(left, key=str) == sorted([(5, BASE), (1, OTHER), (1, ROWS[5][1]), (None, ROWS[7][1]), (8, "")], key=str)


def test_groups(table):
    found = {(r.doc_id, r.text_hash): (r.component_id, r.kept) for r in simhash.similar_groups(table).collect()}
    assert sorted(found.values(), key=str).count((5, True)) == 1 and (None, True) in found.values()
    assert {c for c, _ in found.values()} == {5, 1, 8, None}
