"""Small tables that every operator must take: nulls, empties, ties, repeats, extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, fp string, node string, shard string, size long, key string"

LONG = " ".join(f"word{i % 977} and thing{i}" for i in range(6000))


def rows():
    texts = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
        (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
        (3, "", "en", None),
        (4, None, None, "b"),
        (5, LONG, "en", "a"),
        (6, LONG + " end", None, "b"),
        (7, "el perro come la comida en la casa con los otros perros de la calle", "es", "c"),
        (8, "12345 67890 !!!", "es", "c"),
        (9, "line one here\nline one here\nline one here\nline one here\nother", "en", ""),
        (9, "line one here\nline one here\nline one here\nline one here\nother", "en", ""),
        (None, "a text without any id at all but with words", None, None),
        (11, "Ünïcödé wörds — naïve café, 日本語 テキスト and emoji 😀 mixed in one línea", "fr", "d"),
        (12, " \t\n\r\x0b\x0c ", "de", "d"),
    ]
    return [(i, t, lang, s, len(t or ""), "x", "y", "z", "w", 7, "k") for i, t, lang, s in texts]


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
