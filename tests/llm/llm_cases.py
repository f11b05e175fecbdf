"""Documents with every oddity the operators must stand."""

EMPTY_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int"

BODY = "the quick brown fox jumps over the lazy dog near the river bank on a sunny day"


def odd_documents(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, clashing names."""
    words = BODY.split()
    long_text = "\n".join(" ".join(words[i % 7 :] + [f"w{i}"]) for i in range(4000))
    rows = [
        (1, BODY, "en", "s1"), (2, BODY, "en", "s2"), (2, BODY, "en", "s2"),
        (3, BODY + " indeed", "en", "s3"), (4, "", "en", "s1"), (5, None, "en", "s1"),
        (6, "   \n \n", None, "s2"), (7, "one", "en", None), (8, "One  ", "fr", "s4"),
        (None, BODY, "en", "s5"), (None, "alone and without an id", None, None),
        (9, long_text, "en", "s1"), (10, "ñandú <|im_end|> 日本 \\ <\\| tail\n", "es", "s1"),
        (11, "x " * 3000, "en", "s6"), (11, "another text of the same id", "en", "s6"),
    ]
    schema = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(rows, schema).repartition(3)
    extra = ("kept", "score", "row", "hash", "key", "c0", "n_removed", "Tokens", "a.b")
    return df.selectExpr("*", "length(text) AS n_chars", *[f"1 AS `{c}`" for c in extra])
