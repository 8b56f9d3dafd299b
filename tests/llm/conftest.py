"""Small documents with every odd case, and the given tables where they are."""

import os

import pytest
from pyspark.sql import types as T

from scorewatch.llm import common

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def shared(spark, tmp_path_factory):
    """The session, with a shared folder that goes with the test run."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        common._OWN[:] = [str(tmp_path_factory.mktemp("shared"))]
    return spark


def frame(spark, texts, **columns):
    """Documents of these texts with ids from 0; further columns by name."""
    rows = [(k, t, "en", "s", None if t is None else len(t), *(c[k] for c in columns.values())) for k, t in enumerate(texts)]
    schema = T._parse_datatype_string(DOC)
    for name, values in columns.items():
        schema = schema.add(name, T.LongType() if isinstance(values[0], int) else T.StringType())
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def given(spark):
    if not os.path.isdir(DATA):
        pytest.skip("test tables are not here")
    return DATA


ODD = [None, "", " \n\t ", "a", "word " * 3, "é😀 中文\x00\x0b", "x" * 5000, "long words here " * 4000]
