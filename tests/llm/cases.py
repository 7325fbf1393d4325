"""Small tables that hold the awkward cases: nulls, empty and very long texts, repeats, clashing extra columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, word string, fp string, key string"


def awkward(spark, texts=None):
    prose = " ".join(f"Word{i % 37} thing{i % 11}, over the {i}" for i in range(60))
    texts = texts if texts is not None else [None, "", " \n\t ", prose, prose, prose + " tail", "a b", "x" * 5000 + " y", "Ünḯ ’s don't\x1c <|endoftext|> 42!!  é z\r\n", "word " * 3000, "naïve tabs\tand\u0085lines"]
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else "src0", None, -1, "w", "f", "k") for i, t in enumerate(texts)]
    rows.append((3, texts[3] if len(texts) > 3 else None, "en", "src0", 1, -1, "w", "f", "k"))  # a repeated row
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
