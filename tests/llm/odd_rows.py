"""Small documents with everything that may go wrong in them, and what the given tables hold."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use inside
    T.StructField("_key", T.StringType()), T.StructField("_text", T.LongType()), T.StructField("size", T.StringType()),
    T.StructField("_row", T.StringType()), T.StructField("_name", T.LongType()), T.StructField("_id", T.StringType()),
])
LONG = " ".join(f"word{i % 977} the of and" for i in range(9000))
TEXTS = [
    (1, "The cat sat on the mat and the dog lay on the rug by the old door.", "en", "a"),
    (2, "the CAT sat on the mat and the dog lay on the rug by the old door.", "en", "b"),
    (3, "", "en", "a"), (4, None, None, None), (5, "   \n\t ", "de", "b"), (6, "one two", None, "c"),
    (7, LONG, "en", "a"), (8, LONG + " tail", "en", None), (9, "É è ü ß 你好 世界 🙂🙂 naïve", "fr", "b"),
    (9, "É è ü ß 你好 世界 🙂🙂 naïve", "fr", "b"), (10, "a b c d e " * 40, "en", "a"),
    (None, "no id here but some words to count in it", "en", "a"), (None, "another row that has no id at all", "de", "c"),
    (None, "another row that has no id at all", "de", "c"), (11, "| a | b |\n| c | d |\n| a | b |\nline\nline", "es", "c"),
    (12, "x", "en", "b"), (-3, "minus three is an id too", "en", "b"), (13, "\x1c\x85 odd\xa0spaces　here\x0bthere", "fr", "a"),
    (12, "same id, other text", "en", "b"),
]


def rows_of(texts):
    return [(i, t, lang, s, 0, "clash", 7, "clash", "clash", 8, "clash") for i, t, lang, s in texts]
