"""Documents that every operator has to take: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, block int, word string, n_replaced int, row string, score double"


def texts(seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    words = ["the", "thble", "ond", "Ànd", "naïve", "Straße", "日本語", "x.", "is,", "\U0001f642", "a▁b", "erea!!", "<|endoftext|>"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) + rng.choice([".", "", "\n", " "]) for _ in range(12)]
    long = " ".join(rng.choice(["re", "the", "onble.", "tion"]) + str(k % 97) for k in range(6000))
    return [None, "", " ", "\n\t \x0b", "one", "one two three four", "  lead  and trail  ", "tab\tand\nline\r\n", "x" * 400, long, *made, made[0], made[0], made[1].upper()]


def rows(ids: bool = True) -> list[tuple]:
    """ids: with a null id and a repeated row."""
    out = [(k * 3, t, "en" if k % 2 else None, "s", 1, 5, 6, "w", 7, "r", 0.5) for k, t in enumerate(texts())]
    if ids:
        out += [(None, "null id text here", "en", None, None, None, None, None, None, None, None), out[5], out[5]]
    return out


def frame(spark, ids: bool = True):
    return spark.createDataFrame(rows(ids), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
