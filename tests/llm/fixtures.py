"""Small hostile document tables."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, node string, gram string, m int, label int"


def docs(spark, rows, schema=DOCS):
    """rows: (doc_id, text, source); the other columns clash with names used inside operators."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 0.5, 1, "n", "g", 1, 7) for i, t, s in rows], schema)
