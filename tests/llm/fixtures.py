"""Small documents with the awkward cases: nulls, empty and long texts, copies, near copies, repeated rows, clashing columns."""

import random

SPACE = " \t\n\x0b\x0c\r"


def sentence(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(n))


def documents(seed=0):
    r = random.Random(seed)
    passage, line = sentence(r, 90), sentence(r, 14)
    rows = [(i, "\n".join(sentence(r, r.randint(1, 60)) for _ in range(r.randint(1, 6)))) for i in range(40)]
    rows += [(100 + i, rows[3][1]) for i in range(6)]
    rows += [(200 + i, f"{sentence(r, 30)}\n{passage}\n{sentence(r, 20)}") for i in range(5)]
    rows += [(300 + i, f"{line}\n  {line.upper()} \n{sentence(r, 20)}\n\nshort") for i in range(12)]
    rows += [(400, None), (401, ""), (402, " \n \t"), (403, "one"), (404, "one two"), (405, "é" * 500 + " ß 日本 🙂\x00 end"), (406, "ab" * 700), (407, sentence(r, 6000)), (408, "A. b, c.\r\nA. b, c.\r\n")]
    rows += [(409, rows[5][1] + " x"), (410, rows[5][1]), (410, rows[5][1]), (None, "no id here at all"), (None, None)]
    return rows


def frame(spark, rows=None, extra=True):
    """With columns that the operators use as names of their own."""
    rows = documents() if rows is None else rows
    schema = "doc_id long, text string" + (", lang string, source string, n_chars long, fp string, score string, digest string, n_lines string, kept string" if extra else "")
    tail = lambda i, t: ([None, "en", "de"][(i or 0) % 3], [None, "a", "b", "é"][(i or 0) % 4], len(t or ""), "fp", "score", "digest", "n", "k") if extra else ()
    return spark.createDataFrame([(i, t, *tail(i, t)) for i, t in rows], schema).repartition(3)


def labels(spark, rows=None):
    rows = documents() if rows is None else rows
    seen = [(i, (i // 2) % 2, 0) for i, _ in rows if i is not None and i % 3]
    return spark.createDataFrame([*seen, (None, 1, 0), (2, None, None), (4, 1, 0), (4, 0, 1), (99999, 1, 0)], "doc_id long, quality int, toxic int")
