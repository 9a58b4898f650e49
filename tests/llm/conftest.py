import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, cls long, score double, kept string, size string, id string, v string"

PROSE = (
    "The river moves slowly past the old mill and the children watch it from the bridge every evening. "
    "Nobody remembers who built the wall behind the orchard, yet all of them repair it in spring. "
    "When the rain comes early the farmers move their sheep to the higher field near the chapel. "
    "A letter arrived on Tuesday, and it was read aloud in the kitchen while the bread was baking."
)


def row(doc_id, text):
    """A document with extra columns whose names clash with the operators' own."""
    return (doc_id, text, "en", "src0", None if text is None else len(text), 1, 2, 0.5, "no", "x", "y", "z")


@pytest.fixture
def frame(spark):
    def make(pairs):
        return spark.createDataFrame([row(i, t) for i, t in pairs], SCHEMA)

    return make


@pytest.fixture
def awkward():
    """Nulls, empty, wordless and long texts, ties and repeated rows."""
    words = PROSE.split()
    long = " ".join(words[(i * 7) % len(words)] + str(i % 97) for i in range(30_000))
    return [
        (0, None),
        (1, ""),
        (2, " \n\t "),
        (3, "one two three"),
        (4, PROSE),
        (5, PROSE),
        (5, PROSE),
        (6, PROSE + " And then they left."),
        (7, long),
        (8, "x" * 300_000),
        (9, "same line here now\n" * 40),
        (10, "Ünïcode ñandú 中文 text – with “quotes” and emoji 😀 here\r\nnext\x0bline"),
        (None, "a row without an id"),
        (11, "#*$%& | <> ### $$$ ... !!!"),
    ]
