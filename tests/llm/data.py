"""Small tables with every awkward row, for the operators' tests."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use inside; columns of the input may have them too.
CLASHING = ("row", "k1", "k2", "n", "digest", "copy", "cdf", "keep_runs", "text_hash", "node", "cluster", "component", "code", "sketch", "l", "t", "u", "g", "rate", "language", "item_id", "distance", "a", "b", "kind", "target_id", "gumbel_key", "d", "h1", "pos", "new_text")

WORDS = {
    "en": "the of and that with from this have which would there their people because river stone window market morning between garden letter never always under something".split(),
    "de": "der die und das nicht werden eine auch wenn zwischen straße können wieder schon immer garten morgen fenster brücke über während niemand etwas darum gewesen".split(),
    "fr": "les des une dans pour avec cette sont mais était entre jamais toujours fenêtre jardin matin où été quelque chose pendant lettre marché pierre rivière".split(),
}


def prose(lang: str, n: int, seed: int) -> str:
    rng = random.Random(f"{lang}-{seed}")
    out, line = [], []
    for i in range(n):
        line.append(rng.choice(WORDS[lang]))
        if i % 12 == 11:
            out.append(" ".join(line))
            line = []
    return "\n".join([*out, " ".join(line)] if line else out)


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of (doc_id, text, lang, source); n_chars follows."""
    return spark.createDataFrame([(i, t, l, s, None if t is None else len(t)) for i, t, l, s in rows], DOCUMENTS)


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, repeated rows, one id with two texts."""
    long = prose("en", 60_000, 99)
    return [
        (1, prose("en", 200, 1), "en", "web"), (2, prose("de", 200, 2), "de", "web"), (3, prose("fr", 200, 3), "fr", "books"),
        (None, prose("en", 150, 4), "en", "web"), (5, None, "en", "web"), (6, "", "de", "books"), (7, " \n\t ", None, None), (8, long, "en", None),
        (9, prose("en", 120, 9), None, "web"), (9, prose("en", 120, 9), None, "web"), (10, prose("de", 90, 10), "de", "web"), (10, prose("de", 90, 11), "de", "web"),
        (None, None, None, None), (None, None, None, None), (11, "?!…--", "fr", "odd"), (12, "x", "en", "odd"), (13, "é" * 3000, "fr", "odd"),
    ]


def with_clashes(df: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING if c not in df.columns})
