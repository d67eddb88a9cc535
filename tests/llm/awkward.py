"""Rows that operators on texts have to bear, and plain re-computations to compare with."""

import random
import re

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, shard STRING, component STRING, __copies INT, size INT"

CLEAN = "the river runs past old stone houses and a mill where people bake bread for the town every morning"
VOCABULARY = (CLEAN + " with some more words about weather trains music letters gardens winter light and roads").split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "", "s", "ed", "ing", str(seed)]) for _ in range(n))


def texts() -> list:
    return [
        None,
        "",
        " \t\n ",
        "word",
        "two words",
        CLEAN,
        CLEAN,  # a copy
        CLEAN.upper() + "!",
        "a b " * 400,
        "\n".join([CLEAN] * 5),
        prose(1, 60_000),  # very long
        "x" * 200_000,  # one very long word
        "naïve café Straße İstanbul K     日本語 テキスト \U0001f600 end",
        "#*$%&|<> # * $ % & | < >",
        "\x00 zero \x1f units \x85 next",
        *(prose(i, 30 + i) for i in range(2, 40)),
    ]


def rows() -> list[tuple]:
    """Null and repeated ids, repeated rows, null sources and languages, clashing extra columns."""
    made = []
    for i, text in enumerate(texts()):
        lang = None if i % 5 == 0 else ("en", "de")[i % 2]
        source = None if i % 7 == 0 else f"s{i % 4}"
        made.append((i, text, lang, source, None if text is None else len(text), "taken", "taken", 3, 9))
    made.append(made[5])
    made.append(made[5])
    made.append((5, "another text under the same id as one before", "en", "s1", 1, "x", "y", 0, 0))
    made.append((None, CLEAN, "en", "s1", 1, "x", "y", 0, 0))
    made.append((None, None, None, None, None, None, None, None, None))
    made.append((None, None, None, None, None, None, None, None, None))
    return made


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(4)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
