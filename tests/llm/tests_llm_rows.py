"""Rows with everything that can be odd about documents."""

#: Nulls, empty and very long texts, ties and repeated rows.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (None, "alpha beta gamma delta epsilon " * 9, "en", "a", 9),
    (3, "alpha beta gamma delta epsilon " * 9, "en", "b", 9),
    (3, "alpha beta gamma delta epsilon " * 9, "en", "b", 9),
    (4, "one", "en", None, 3),
    (5, "mail a.b@c.org or +1 (414) 555-7134 " + "word " * 40_000, "en", "b", 1),
    (6, " \t\n ", None, "a", 4),
]
