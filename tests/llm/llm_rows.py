"""Rows that operators must survive."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size int, score double, key long, `a.b` string"
LONG = " ".join(f"word{i % 977} of{i}" for i in range(40_000))
PASSAGE = "The quick brown fox jumps over the lazy dog while seven wizards quietly mix nine jugs of old wine."


def rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows and odd white space."""
    def row(doc_id, text, lang="en", source="a", extra="x"):
        return (doc_id, text, lang, source, None if text is None else len(text), extra, 1, 0.5, 7, extra)

    return [
        row(1, PASSAGE), row(2, PASSAGE), row(2, PASSAGE), row(3, None), row(4, ""), row(5, " \t\n "), row(None, PASSAGE, None, None, None),
        row(None, None, None, None), row(6, LONG), row(7, LONG + " tail"), row(8, "été ß 漢字\x1c end\x00 \x85x"), row(9, "l1\nl2\nl3\nl4"),
        row(10, "l1\nl2\nl3\nother", "fr", "b"), row(11, "one two", None, "b"), row(11, "one two three four five", None, "b"), row(-5, "12 !! 34", "fr", None),
    ]
