"""Small documents with every kind of edge: nulls, empties, long texts, copies, near copies, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, k string, h long, pos int, th long, spans string, row long, u long, key long, predicted string, label int"


def words(rnd, n):
    return ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 7))) for _ in range(n)]


def texts(seed=3):
    rnd = random.Random(seed)
    base = " ".join(words(rnd, 80))
    near = base.split()
    near[40] = "changed"
    lines = "\n".join(" ".join(words(rnd, 4)) for _ in range(9))
    some = lines.split("\n")
    long = " ".join(words(rnd, 4000))
    out = [
        None, "", "   ", "one", "one", "One", "two words", base, base, " ".join(near), base.upper(), base + " and a tail", lines, "top\n" + "\n".join(some[2:7]) + "\nend", "\n".join(some[:3]), lines, long, long[:9000] + " x " + long[9000:],
        "é" * 300, "é" * 301, "日本語 の 文 です ね " * 40, "a a a a a a a a a a a a a a a a a a a a", "a\n" * 40, "\n\n\n\n", "\t x \x0b y \x0c z\r\n", "THE!! END!! OF!! IT!!", " ".join(words(rnd, 30)), "x" * 450,
    ]
    out += [" ".join(words(rnd, rnd.randint(5, 60))) for _ in range(12)]
    return out


def rows(ts=None):
    ts = texts() if ts is None else ts
    made = [(i, t, ("en", "de", None)[i % 3], f"s{i % 2}", len(t) if t is not None else None, 0.5, "x", 1, 2, 3, "y", 4, 5, 6, "z", 7) for i, t in enumerate(ts)]
    return made + [(None, ts[7] if len(ts) > 7 else "n", None, None, None, None, None, None, None, None, None, None, None, None, None, None)] + made[-1:]


def frame(spark, ts=None):
    return spark.createDataFrame(rows(ts), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
