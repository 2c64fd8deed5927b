"""Small tables with the awkward rows that every operator must take."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", "."]) for _ in range(n))


def edge_rows() -> list[tuple]:
    base, passage = prose(1, 120), prose(2, 60)
    out = [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 2),  # a copy
        (3, prose(3, 80) + " " + passage, "en", "b", 3),
        (4, passage + "\n" + prose(4, 90), None, "b", 4),  # shares a passage
        (5, None, "en", "a", None),
        (6, "", None, None, 0),
        (7, " \n\t ", "de", "a", 4),
        (8, "one", "en", "c", 3),
        (9, "Ünïcödé ßtraße naïve café " * 6, "de", "c", 9),
        (10, prose(5, 9000), "en", "a", 10),  # very long
        (11, base.replace("alpha", "beta", 1), "en", "a", 11),  # a near copy
        (12, "x" * 5000, "en", "d", 12),  # one long word
        (12, "x" * 5000, "en", "d", 12),  # the row again
        (None, base, "en", "a", 13),
        (13, "日本語 の テキスト です", None, "e", 5),
        (14, "12 34 !! ??", "en", "e", 5),
    ]
    return out + [(100 + k, prose(100 + k, 40), "en", "a" if k % 3 else "f", k) for k in range(30)]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """Further columns, named as the operators' own."""
    from pyspark.sql import functions as F

    extra = ["rep", "same", "fp", "root", "score", "pack", "spans", "kept", "n_bytes", "bucket", "mix_slot", "mix_source", "position", "rank", "cell", "label", "t", "k", "_size", "_order", "_gone", "shard"]
    return df.withColumns({c: F.lit(f"own {c}") for c in extra})
