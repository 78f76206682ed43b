import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from packetcheck import llm


#: Names that the operators use inside, taken from their code.
CLASHES = sorted({
    name for path in Path(llm.__path__[0]).glob("*.py")
    for name in re.findall(r"""alias\("(\w+)"\)|withColumn\("(\w+)\"""", path.read_text()) for name in name
} - {"", "doc_id", "text", "lang", "source", "n_chars"})


@pytest.fixture
def docs_of(spark):
    """Documents from texts (doc_id by position) or from (doc_id, text) rows, with the
    other columns of the table and some whose names clash with those used inside."""
    def make(rows):
        rows = [(i, x) if not isinstance(x, tuple) else x for i, x in enumerate(rows)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        extra = {x: F.lit(1) for x in CLASHES}
        return df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text"), **extra})
    return make


@pytest.fixture
def awkward():
    """Null, empty, blank, short, long, repeated and odd texts; null and repeated ids."""
    long = " ".join(f"word{i % 7919}x" for i in range(60_000))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, long), (6, long), (7, "same text here"), (7, "same text here"),
        (7, "other text of the same id"), (None, "text without an id"), (None, None), (8, "<|endoftext|> x  y"),
        (9, "É H̱ 日本語 \U0001f600 \x00 end"), (10, "a" * 3000),
    ]
