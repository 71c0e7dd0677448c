"""Small documents with every awkward case, made from words by a fixed rule."""

import random

WORDS = "amber birch cedar delta ember fjord grove heath inlet jetty knoll ledge marsh".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(n))


def awkward():
    """(doc_id, text) with NULLs, empty and long texts, ties and repeated rows."""
    base = prose(1, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    far = " ".join([*words[:60], *prose(2, 60).split()])
    return [
        (1, base),
        (2, base.upper()),
        (3, near),
        (4, far),
        (5, prose(5, 5000)),
        (6, ""),
        (7, None),
        (8, "two words"),
        (9, "Two  words"),
        (10, "  \n\t "),
        (11, prose(11, 80)),
        (11, prose(11, 80)),
        (12, prose(11, 80) + " tail"),
        (None, prose(13, 40)),
        (None, base),
        (14, "é" * 60 + " ünï 日本 " + prose(14, 20)),
    ]


def frame(spark, rows=None, extra=True):
    rows = awkward() if rows is None else rows
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    # Columns whose names the operators use inside.
    schema = "doc_id long, text string, row long, score double, key string, bucket int, lang string"
    return spark.createDataFrame([(*r, 1, 0.5, "k", 3, None) for r in rows], schema)


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def sort(rows):
    return sorted((tuple(r) for r in rows), key=repr)
