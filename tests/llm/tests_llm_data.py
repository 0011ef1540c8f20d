"""Rows that every operator must stand."""

#: What every operator must stand: nulls, blanks, ties, repeats, a very long text, one word.
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (5, "one"), (6, "ONE two, three four five six"), (7, "one two, three four five six"),
    (8, "é ß 中文 😀\x00 x\x1cy"), (9, "word " * 30_000), (None, "no id"), (10, "..."),
]
