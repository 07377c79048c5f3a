from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return re.findall(r"\w+", (text or "").lower())


def made_text(rng: random.Random, n: int) -> str:
    sounds = "ka lo mi tu re sa no vi pe da gu hi zo be fa ri".split()
    return " ".join("".join(rng.choice(sounds) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents(spark, rows):
    """A table of documents from (doc_id, text) or (doc_id, text, source)."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", None if r[1] is None else len(r[1])) for r in rows], DOCS)


#: Rows that every operator must bear: nulls, empty and wordless texts, repeated rows, a very long text.
ODD = [(None, "a row without an id has some words in it too"), (900, None), (901, ""), (902, "   \n \n"), (903, "?!… ()"), (904, "same row twice over and over"), (904, "same row twice over and over"), (905, "é日本語 👍🏽 ça"), (906, "lorem ipsum dolor sit amet " * 20_000), (907, "x" * 300_000), (908, "one")]
