"""A small corpus with nulls, empty and long texts, ties, copies and near copies, and clashing columns."""

import random
import re

WORDS = [f"w{i:03d}" for i in range(300)] + ["été", "straße", "naïve", "the", "of"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(seed=0, n=60):
    """(doc_id, text, source) rows."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.choice([1, 2, 3, 5, 20, 60, 120, 200])) for _ in range(n)]
    rows = [(i, t, f"s{i % 4}" if i % 9 else None) for i, t in enumerate(base)]
    passage, shared = sentence(rng, 70), "\n".join(sentence(rng, 6) for _ in range(4))
    for i in range(n, n + 12):
        rows.append((i, f"{sentence(rng, 15)} {passage} {sentence(rng, 10)}", "s0"))
    for i in range(n + 12, n + 20):
        rows.append((i, f"{sentence(rng, 5)}\n{shared}\n{sentence(rng, 4)}", "s1"))
    copy = sentence(rng, 150).split()
    for i in range(n + 20, n + 30):
        near = list(copy)
        if i % 3:
            near[i % 150] = f"x{i}"
        rows.append((i, " ".join(near), "s2"))
    rows += [(n + 30, None, "s0"), (n + 31, "", "s1"), (n + 32, " \n\t", None), (n + 33, "repeat me " * 40, "s3"), (n + 34, "A\x0bB\xa0C d", "s3")]
    rows += [(n + 35, sentence(rng, 30000), "s0"), (5, base[5], "s1"), (5, base[5], "s1"), (7, sentence(rng, 80), "s2"), (None, base[8], "s3"), (None, sentence(rng, 60), None)]
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id bigint, text string, source string, size string, n_words string, h int, key int, row int, block int, `a.b` int, `x``y` int"


def frame(spark, rows):
    """The rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "keep", "me", 1, 2, 3, 4, 5, 6) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
