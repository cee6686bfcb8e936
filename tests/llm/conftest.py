import zlib

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A frame of documents from (doc_id, text, lang)."""

    def make(rows):
        return spark.createDataFrame([(i, t, lang, "s", len(t) if t is not None else None) for i, t, lang in rows], DOCS)

    return make


@pytest.fixture
def stored(spark, tmp_path):
    """A folder with the tables given as name=frame."""

    def make(**tables):
        for name, frame in tables.items():
            frame.write.mode("overwrite").parquet(f"{tmp_path}/sf/{name}.parquet")
        return f"{tmp_path}/sf"

    return make


@pytest.fixture
def crc():
    return lambda i, n: zlib.crc32(str(i).encode()) % n


@pytest.fixture
def clash():
    """Extra columns under the names that operators use inside."""
    return lambda df: df.withColumns({c: F.lit("x") for c in ("_id", "_text", "_words", "_hash", "_keys", "score", "spans", "level")})
