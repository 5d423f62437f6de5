"""Small document tables with copies, near copies, ties, nulls, empty and long texts."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, key string"


def words(r, n):
    return [r.choice(("the", "of", "and")) if r.random() < 0.3 else "".join(r.choice(("th", "er", "on", "an", "ti", "es", "ou", "é")) for _ in range(r.randint(1, 4))) for _ in range(n)]


def documents(seed=1, n=40):
    r = random.Random(seed)
    rows = []
    shared = " ".join(words(r, 70))
    line = "Shared LINE of every text here"
    for i in range(n):
        w = words(r, r.choice((3, 60, 200, 400)))
        text = "\n".join(" ".join(w[k : k + 12]) for k in range(0, len(w), 12))
        if i % 5 == 0:
            text += f"\n  {line.lower() if i % 2 else line}\t\nshort\nshort"
        if i % 6 == 1:
            text += " " + shared
        rows.append((i * 3, text, "en", f"src{i % 3}", len(text), 0.5, "k"))
    rows.append((200, rows[2][1], "en", "src0", 1, 0.1, "k"))  # exact copy
    near = rows[3][1].split(" ")
    for k in range(4):
        near = [*near]
        near[k * 7 % len(near)] = f"new{k}"
        rows.append((201 + k, " ".join(near), "de", "src0", 1, 0.1, None))
    rows += [(300, None, None, None, None, None, None), (301, "", "en", "src1", 0, 0.0, "k"), (302, " \t\n ", "en", "src1", 4, 0.0, "k"), (303, "one", "en", "src1", 3, 0.0, "k"), (304, "two words", "en", "src1", 9, 0.0, "k"), (None, "nobody knows this id", "en", "src1", 20, 0.0, "k")]
    rows.append((400, " ".join(words(r, 9000)), "en", "src2", 9, 0.0, "k"))
    rows.append(rows[5])  # repeated row
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, DOC)


def empty(spark):
    return spark.createDataFrame([], DOC)
