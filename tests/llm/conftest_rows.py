"""Rows with all that operators have to bear."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls in every column, empty and blank texts, a long one, ties, repeated rows, clashing extra columns come on top.
ODD = [
    (1, "one two three four five six seven", "en", "a", 33),
    (1, "one two three four five six seven", "en", "a", 33),
    (2, "One  two\tthree four five\nsix seven", None, None, None),
    (None, "one two three four five six seven", "en", "a", 33),
    (None, None, None, None, None),
    (3, None, "en", "b", None),
    (4, "", "en", "b", 0),
    (5, " \t\n\x0b ", "fr", "b", 5),
    (6, "word", "fr", "b", 4),
    (7, "lorem ipsum dolor sit amet " * 6000, "fr", "c", 162000),
    (8, "x" * 50000, "fr", "c", 50000),
    (9, "été 😀 naïve ß 中文 \x00 end", "fr", "c", 20),
]
