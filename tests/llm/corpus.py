"""A small corpus with nulls, ties, repeated rows, copies and clashing column names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _digest string, slot string, size string"


def rows(seed: int = 1, n: int = 120) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("al", "be", "cor", "dan", "ev") for b in ("ta", "no", "ri", "su", "lem", "po")]
    sentence = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = ["This line is long enough to count and is shared widely.", "Another shared line that is well over forty code points é."]
    texts: list[str | None] = [None, "", "  \t\n", "one", "one two", "Same text", "Same text", "é " * 60]
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.2 and len(texts) > 10:
            old = rng.choice([t for t in texts if t and len(t) > 200] or [sentence(80)])
            parts = old.split(" ")
            parts[rng.randrange(len(parts))] = "changed"
            texts.append(" ".join(parts))
        elif kind < 0.3:
            texts.append(rng.choice([t for t in texts if t]))
        else:
            lines = [sentence(rng.randint(3, 60)) for _ in range(rng.randint(1, 5))]
            if rng.random() < 0.4:
                lines.insert(rng.randrange(len(lines) + 1), rng.choice(shared) if rng.random() < 0.5 else f"  {shared[0].upper()}\t")
            texts.append("\n".join(lines))
    made = [
        (i, t, rng.choice(["en", "fr", None]), rng.choice(["web", "web", "web", "books", "Code", None]), len(t) if t else None, "x", "y", "z")
        for i, t in enumerate(texts)
    ]
    made.append(made[30])  # a repeated row
    made.append((None, "a text without an id " * 5, "en", "web", 1, "x", "y", "z"))
    return made


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
