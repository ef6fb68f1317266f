"""Small tables with the awkward rows that every operator has to take."""

import re

SF = "/root/testdata/sf0.001"


def awkward(spark):
    """Nulls, blanks, ties, repeats, a very long text and columns with clashing names."""
    rows = [
        (1, "one two three four five six", "en", "a", 27),
        (2, "One  two three\tfour five six", "en", "a", 28),
        (3, None, None, None, None),
        (4, "", "de", "b", 0),
        (5, " \n\t ", None, "b", 4),
        (6, "short text", "en", None, 10),
        (6, "short text", "en", None, 10),
        (7, "word " * 30_000, "en", "a", 150_000),
        (8, "!!! ??? 123", "fr", "a", 11),
        (None, "a row that has no id at all", "es", "c", 27),
        (9, "日本語 текст éàü 🤖 mixed", "en", "c", 20),
        (10, "a" * 5000, "de", "c", 5000),
    ]
    cols = "doc_id long, text string, lang string, source string, n_chars int"
    df = spark.createDataFrame(rows, cols)
    for name in ("id", "fp", "sha", "keep", "ids", "score", "rep", "root", "_id", "n", "label", "words", "pos"):
        df = df.selectExpr("*", f"'x' as {name}")
    return df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int")


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
