"""Small tables with every awkward case, for all operator tests."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside, to see that they don't clash.
EXTRA = DOCS + ", hash long, size long, key long, score double, ids string, tokens string, place long, n long, vid long"
LONG = " ".join(f"w{i}" for i in range(30_000))


def awkward_docs(spark, schema=EXTRA):
    rows = [
        (1, "a b c d e f g", "en", "s1", 13), (2, "a b c d e f g", "en", "s1", 13), (2, "a b c d e f g", "en", "s1", 13), (3, None, None, None, None),
        (None, "no id here at all", "en", "s2", 5), (None, None, "en", None, None), (4, "", "en", "s2", 0), (5, " \n\t ", "en", "é", 4),
        (6, LONG, "en", "s2", len(LONG)), (7, "▁ é 日本 \U0001f600 \x00 x", "fr", "s3", 9), (8, "Mixed CASE words\r\nand\x0blines", "de", "s1", 3),
    ]
    pad = (None,) * (len(schema.split(",")) - 5)
    return spark.createDataFrame([r + pad for r in rows], schema)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def sentence(rng: random.Random, n: int, vocabulary: int = 3000) -> list[str]:
    return [f"word{rng.randrange(vocabulary)}" for _ in range(n)]
