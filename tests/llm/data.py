"""Small awkward tables: nulls, empty and long texts, ties, repeated rows, clashing columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, rank int, part int"
LONG = " ".join(f"wort{i % 977} langes{i % 31}" for i in range(6000))


def documents(spark):
    passage = "\n".join(f"A shared line number {i} of the passage." for i in range(6))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf today.", "en", "a", 0),
        (2, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf today.", "en", "a", 0),
        (3, "the QUICK brown fox jumps over the lazy dog and runs away from the big bad wolf today", "en", None, 0),
        (4, None, "en", "a", 0),
        (5, "", None, "b", 0),
        (6, "   \n\t ", "de", "b", 0),
        (7, "12345 !!! ???", "en", "b", 0),
        (8, LONG, "de", "a", 0),
        (9, LONG + " ende", "de", "a", 0),
        (10, f"Own start.\n{passage}\nOwn end of ten.", "en", "a", 0),
        (11, f"Another start, longer.\nAnd more.\n{passage}\nIts own end.", "en", "c", 0),
        (12, "Ein kurzer deutscher Satz über den schönen Sommer.", "de", "c", 0),
        (12, "Ein kurzer deutscher Satz über den schönen Sommer.", "de", "c", 0),
        (13, "naïve café 😀 déjà vu", "fr", "c", 0),
        (None, "A document without an id.", "en", "c", 0),
    ]
    rows += [(100 + i, f"Document {i} has some words of its own: {' '.join(str((i * 7919 + j * 104729) % 9973) for j in range(40))}", "en", "a" if i % 3 else "d", 0) for i in range(60)]
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], DOCS)


def nothing(spark):
    return spark.createDataFrame([], DOCS)
