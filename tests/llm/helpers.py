"""Small tables with every odd case: nulls, empty and long texts, ties, repeated rows, clashing names."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    state, out = seed * 7919 + 1, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % 2**31
        out.append(WORDS[state >> 16 & 15] + WORDS[state >> 20 & 7])
    return " ".join(out)


def odd_rows() -> list[tuple]:
    base = prose(1, 120)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base.replace("alpha", "omega", 1), "en", "b"), (4, None, "en", None), (5, "", None, "b"), (6, "   \n ", "de", "b"),
        (7, prose(2, 90), "de", "c"), (7, prose(2, 90), "de", "c"), (8, prose(3, 20000), "fr", "c"), (9, "one two three", "xx", "a"), (10, "tag <|endoftext|> Ärger ǅ ﬁ 漢字 x  y", "en", "a"),
        (None, prose(4, 60), "en", "a"), (11, prose(5, 60) + " " + base, "es", "d"), (12, "# $ % & | < > *" * 40, "en", "d"),
    ]
    return [(*r, 0, 0.5, "x") for r in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node string"


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark):
    rows = [(n, int(n % 3 > 0), int(n % 4 == 0)) for n in range(1, 13)] + [(None, 1, 1), (50, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
