"""Small documents with the awkward cases that every operator has to take."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])
# clashes with names that operators add
CLASHES = ["score", "key", "ids", "_drop", "size", "n", "root", "_copies", "kept_text",
           "cls", "_lang", "_kept_id", "_size", "_id", "_t", "_turn", "_version", "slice", "counts", "place", "bits"]


def words(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append("w" + format(x % 5000, "x"))
    return " ".join(out)


def awkward_rows():
    base = words(1, 120)
    line = "The same line stands in many documents."
    rows = [
        (0, None, None, None, None), (1, "", "en", "b", 0), (2, " \t\n ", "en", "b", 4),
        (3, base, "en", "a", len(base)), (4, base, "en", "a", len(base)),
        (5, base + " tail", "en", "a", None), (6, base.replace("w", "W", 3), "de", None, None),
        (7, words(2, 30_000), "de", "a", None), (8, "one two three", "fr", "é", None),
        (9, f"{line}\nown line of document nine\n{line}", "en", "a", None),
        (10, f"  {line.upper()}\t\nshort", "en", "a", None), (11, f"{line}\n\n", "en", "b", None),
        (12, f"x\n{line}", "en", None, None), (12, f"x\n{line}", "en", None, None),
        (None, "a row without an id", "en", "a", None), (13, "ÉÀ İΣ ſ 日本 👍\x1c\xa0x", "ja", "日", None),
        (14, "<|endoftext|> a  b\n \n  c <|startoftext|>", None, "a", None),
    ]
    return rows + [(20 + i, words(40 + i, 50 + i), "en", "hot", None) for i in range(30)]


def awkward(spark, clashes: bool = True):
    df = spark.createDataFrame(awkward_rows(), DOCS)
    if clashes:
        from pyspark.sql import functions as F
        df = df.withColumns({c: F.lit(1) for c in CLASHES})
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)
