"""Small tables with nulls, empty and long texts, repeated rows and clashing column names."""

import random

SCHEMA = "doc_id bigint, text string, lang string, fp bigint, spans string, bucket int, length string"


def prose(rng: random.Random, words: int) -> str:
    made = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7))) for _ in range(60)]
    return " ".join(rng.choice(made) for _ in range(words)).capitalize() + "."


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    plain = [prose(rng, 80) for _ in range(6)]
    passage = prose(rng, 70)
    copy = prose(rng, 90)
    return [
        (1, plain[0]),
        (2, copy),
        (3, copy),
        (4, copy + " One more word here."),
        (5, f"{plain[1]} {passage} {plain[2]}"),
        (6, f"{plain[3]}\n{passage}\n{plain[4]}"),
        (7, ""),
        (8, None),
        (9, "two words"),
        (10, " \t\n "),
        (11, "é" * 150 + " ж😀 ascii " + "é" * 150),
        (12, "a" * 900),
        (13, prose(rng, 30_000)),
        (14, plain[5]),
        (14, plain[5]),
        (15, "It's 12's <|endoftext|> </s> [INST] naïve ﬁ Å Å İ ẞ ΑΣ."),
        (None, plain[5]),
        (None, None),
    ]


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame(
        [(i, t, "en", 7, "x", 3, "y") for i, t in rows], SCHEMA
    )
