"""Small document tables with everything that operators must stand."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep long, token string, _row string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def rows(seed=1):
    """Copies, near copies, shared passages, null, empty and blank texts, a long text, repeated rows, null ids."""
    rng = random.Random(seed)
    base = words(rng, 120)
    texts = [" ".join(base), " ".join(base), " ".join(base[:60] + ["Changed"] + base[61:]), " ".join(base[:-3])]
    for k in range(6):  # a chain of near copies
        base = base[:]
        base[rng.randrange(len(base))] = f"x{k}"
        texts.append(" ".join(base))
    passage = " ".join(words(rng, 70))
    texts += [f"{' '.join(words(rng, 40))} {passage} {' '.join(words(rng, 30))}" for _ in range(3)]
    texts += [None, "", "  \t\n", "one", "two words", "one", "A b C d", "a B c D", "la " * 300, "la " * 200, "é" * 120 + " ñandú Straße", "日本語 " * 40]
    texts += [" ".join(words(rng, 3000)), " ".join(words(rng, 80))]
    texts += [" ".join(words(rng, rng.randrange(5, 90), 30)) for _ in range(20)]
    out = [(i, t, "en", f"s{i % 3}", len(t or ""), i, "x", "y") for i, t in enumerate(texts)]
    return out + [out[2], out[2]]  # repeated rows


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
