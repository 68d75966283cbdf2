"""Small tables with every awkward case, and plain-Python counterparts."""

import random

WORDS = [f"w{i}" for i in range(400)]


def text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(t, seed, rate):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) if r.random() < rate else w for w in t.split(" "))


def awkward(spark, rows, id_col="doc_id", text_col="text"):
    """``rows`` of (id, text) with further columns whose names the operators use inside."""
    full = [(i, t, "x", 1, [1], "m") for i, t in rows]
    df = spark.createDataFrame(full, f"{id_col} long, {text_col} string, label string, n long, keys array<long>, bucket string")
    return df.withColumnRenamed("n", "id") if "id" not in (id_col, text_col) else df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def words(t):
    return (t or "").encode().lower().split()


def shingle_set(t, size):
    w = words(t)
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def smallest_reachable(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}
