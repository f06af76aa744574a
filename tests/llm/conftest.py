import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents frame from (doc_id, text) pairs or dicts, with extra columns whose names operators use inside."""

    def make(rows, extra=True):
        full = [{"doc_id": r[0], "text": r[1], "lang": r[2] if len(r) > 2 else "en", "source": r[3] if len(r) > 3 else "s", "n_chars": len(r[1] or "")} for r in rows]
        if extra:
            full = [r | {"row": 1, "size": 2, "id": 3, "bucket": 4, "part": 5, "u": 6, "v": 7, "rank": 8} for r in full]
        names = "doc_id long, text string, lang string, source string, n_chars long" + (", row int, size int, id int, bucket int, part int, u int, v int, rank int" if extra else "")
        return spark.createDataFrame([tuple(r.values()) for r in full], names) if full else spark.createDataFrame([], names)

    return make


ODD = [(None, "a row without an id"), (1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "word"), (6, "two words"), (6, "two words"), (7, "é" * 30 + " 日本語 🙂 ß"), (8, "x" * 5000), (9, "A b\x0bC\x1cd e"), (10, "a b c " * 400)]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
