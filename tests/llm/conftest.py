import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty, long, tied and repeated rows; extra columns with clashing names."""
    long_text = " ".join(f"word{i % 977} of,the.\n" for i in range(30_000))
    rows = [(5, None), (3, ""), (9, " \t\n "), (7, "one"), (8, "one two"), (1, long_text), (2, long_text),
            (4, "same words here again and again"), (6, "same words here again and again"),
            (None, "a text without an id"), (10, "two  spaces   and\n\nlines \x1c é ß 漢字 it's 12"),
            (11, "a text told twice"), (11, "a text told twice")]
    clash = ("fp", "id", "bits", "u", "score", "shard", "slice", "component_id", "place", "is_toxic", "want", "labelled",
             "spans", "key", "n_best")
    return spark.createDataFrame([(*r, *(["x"] * len(clash))) for r in rows],
                                 "doc_id long, text string, " + ", ".join(f"{c} string" for c in clash))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
