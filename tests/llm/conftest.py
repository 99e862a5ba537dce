import pytest
from pyspark.sql.types import StructType

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(500_000))
TEXTS = [
    None,
    "",
    " \t\n",
    "one",
    "The the cat sat on the mat",
    "a b c d e a b c d e f g h i j\nx y\nx y\n\n \nx  y",
    "Ünï çødé ß Straße\x0bvertical\x0ctab\r\nline",
    "a b c d e a b c d e f g h i j\nx y\nx y\n\n \nx  y",
    "word " * 40,
    "#tag *** $$$ %%% a|b <c> & " * 7,
    LONG,
]


@pytest.fixture
def documents(spark):
    """Awkward rows: NULLs, empty and very long texts, repeated rows and ids, columns with
    names that the operators use themselves."""

    def make(texts=TEXTS, extra=True, ids=None):
        ids = ids or list(range(10, 10 + len(texts)))
        rows = [(i, t, "en" if k % 3 else None, f"s{k % 4}" if k % 5 else None, 7) for k, (i, t) in enumerate(zip(ids, texts))]
        if extra:
            rows += [rows[4], rows[4], (None, "one two three", "de", "s1", None), (11, "clash of ids", "de", "s1", 3)]
        df = spark.createDataFrame(rows, StructType.fromDDL(DOCS))
        clash = ["size", "kept", "shard", "slot", "_node", "_words", "target", "score", "start", "length", "label"]
        return df.selectExpr("*", *[f"'c' as `{c}`" for c in clash])

    return make
