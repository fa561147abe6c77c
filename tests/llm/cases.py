"""Documents that every operator has to stand: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, first long, block long, bucket long, key string"


def words(rng, n, size=4000):
    return [f"w{rng.randrange(size)}x" for _ in range(n)]


def tricky_rows():
    rng = random.Random(5)
    base = words(rng, 300)
    near = list(base)
    near[150] = "changed"
    texts = [
        None,
        "",
        "   \n\t\n ",
        "one",
        "one two three four",
        " ".join(base),
        " ".join(base),
        " ".join(near),
        "\n".join([" ".join(words(rng, 8)) for _ in range(30)]),
        " ".join(words(rng, 30_000, 200_000)),
        "ÀÉ ß 日本語 emoji \U0001f600 " * 20,
        "same line of text\nsame line of text\nSAME LINE OF TEXT  ",
        "\t same line of text\nother words here",
        "a" * 50_000,
        "<|endoftext|> <|ENDOFTEXT|> x\x00y\x01z",
    ]
    rows = [(i, t, "en" if i % 3 else None, "src0" if i % 4 else None, len(t or ""), "doc", 1, 2, 3, "key") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, " ".join(base), None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    rows += [(8, "another text under an id that is taken", "en", "src0", 1, "", 0, 0, 0, "")]
    return rows


def tricky(spark):
    return spark.createDataFrame(tricky_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
