"""Small tables with the awkward cases every operator must take."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa la mu nu xi omi pi rho sigma tau ups phi chi psi omega".split()


def prose(rng: random.Random, n: int) -> str:
    out = []
    while n > 0:
        k = min(n, rng.randint(4, 9))
        out.append(" ".join(rng.choice(WORDS) for _ in range(k)).capitalize() + ".")
        n -= k
    return " ".join(out)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def odd_rows(seed: int = 0, n: int = 40):
    """Plain rows, nulls in every column, empty and blank texts, equal rows, copies and a very long text."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = prose(rng, rng.randint(1, 120))
        rows.append((i, text, "en", "hot" if i % 3 else f"src{i % 5}", len(text)))
    long = prose(rng, 9000)
    copy = prose(rng, 80)
    rows += [
        (100, None, "en", "src1", None), (101, "", "en", "src2", 0), (102, " \t\n \r\n", None, "src2", 6),
        (103, long, "en", None, len(long)), (104, copy, "en", "src1", len(copy)), (105, copy, "en", "hot", len(copy)),
        (106, copy, None, None, None), (106, copy, None, None, None), (None, copy, "en", "src1", None),
        (None, None, None, None, None), (107, "x", "en", "src9", 1), (108, copy + " end", "en", "hot", None),
    ]
    return rows


def folder_of(df, root: str, name: str = "documents") -> str:
    df.write.parquet(f"{root}/{name}.parquet")
    return root
