import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


def prose(seed: int, n: int, vocabulary: int = 400) -> list[str]:
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None, **extra):
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in
                zip(ids if ids is not None else range(len(texts)), texts)]
        df = spark.createDataFrame(rows, DOCS)
        from pyspark.sql import functions as F
        for name, value in extra.items():
            df = df.withColumn(name, F.lit(value))
        return df
    return make


EDGE_TEXTS = [None, "", "  \n\t ", "word", "ümlaut ñandú 中文 😀 word", " ".join(prose(1, 300)), " ".join(prose(1, 300)),
              " ".join(prose(2, 30000, 5000)), "\n".join(["same line here"] * 40), "a" * 5000, "x\n" * 50]
EDGE_IDS = [0, 1, 2, 3, 4, 5, 5, 6, None, 7, 7]
CLASHES = {"node": 1, "label": "x", "word": "y", "row": 2, "hit_words": 3, "pii_found": 4, "part": 5, "block": 6, "n": 7}
