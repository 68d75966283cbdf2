"""Operators 11 to 13 against plain-Python versions."""

import hashlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemill.llm import merkle, mixing, queries
from telemill.llm.whitening import Spectrum, rank_one, secular_roots, whiten
from tests.llm.helpers import awkward, empty, text, words

# operator 11

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shares(sizes, weights, budget, most):
    """Exact water-filling."""
    full, target = set(), {}
    while True:
        left = budget - sum(most * sizes[s] for s in full)
        total = sum(weights[s] for s in sizes if s not in full)
        target = {s: Fraction(most * sizes[s]) if s in full else Fraction(left * weights[s], total) if total else Fraction(0) for s in sizes}
        over = {s for s in sizes if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def corpus(spark):
    rows = [(i, text(i, 3 + i % 40), "en", "hot", 0) for i in range(300)]  # a third of all
    rows += [(1000 + i, text(i, 5), "en", f"s{i % 7}", 0) for i in range(50)]
    rows += [(2000, None, None, None, None), (2001, "", None, None, 0), (2002, " \t\n", "en", "blank", 0), (None, "a b c", "en", None, 5), (None, "a b c", "en", None, 5)]
    rows += [(2003, "x " * 30_000, "en", "long", 0), (2004, "été \U0001f600", "en", "ü", 0)] + [(7, "same words here", "en", "copies", 0)] * 40
    return rows, spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("budget", [None, 100, 10**9])
def test_mix_meets_targets(spark, budget):
    rows, docs = corpus(spark)
    weights = mixing.cyclic_weights(docs, [1, 2, 3])
    names = sorted({r[3] for r in rows if r[3] is not None}, key=lambda s: s.encode()) + [None]
    given = {s: [1, 2, 3][i % 3] for i, s in enumerate(names)}
    assert {r["source"]: r["weight"] for r in weights.collect()} == given
    got = mixing.plan_mix(docs, weights, budget=budget, carry=("doc_id", "text", "source")).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == sorted((r[0] or 0, r[1] or "") for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = shares(dict(sizes), given, budget or sum(sizes.values()), 3)
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == len(words(r["text"])) and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - float(want[r["source"]])) < 1e-6
        n = r["whole"] * r["size"] + r["part"]
        assert 0 <= n <= 3 * r["size"] and 0 <= r["part"] < max(1, r["size"])
        taken[r["source"]] += n
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.5
    if budget is None:
        again = mixing.plan_mix(docs.repartition(5), weights, carry=("doc_id", "text", "source")).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_narrows_the_seeded_order(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BATCH", 2)
    docs = spark.createDataFrame([(i, text(i, 9), "en", "a" if i % 3 else "b", 0) for i in range(400)], DOCS)
    weights = spark.createDataFrame([("a", 1.0), ("b", 9.0)], "source string, weight double")
    per = mixing.plan_mix(docs, weights, carry=("doc_id", "source")).groupBy("source", "target").agg(F.sum(F.col("whole") * F.col("size") + F.col("part")).alias("n"))
    assert all(abs(r["n"] - r["target"]) <= 0.5 for r in per.collect())


def test_mix_odd_weights_clashes_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d", "s", 9, 9), (2, "e f", "t", 9, 9), (3, "g", "u", 9, 9)], "doc_id long, text string, source string, size long, key long")
    weights = spark.createDataFrame([("s", 1.0), ("s", 1.0), ("t", -4.0), ("zz", 5.0)], "source string, weight double")
    got = {r["doc_id"]: r for r in mixing.plan_mix(docs, weights, carry=("doc_id", "text", "size", "key")).collect()}
    assert [got[i]["size"] for i in (1, 2, 3)] == [4, 2, 1] and got[1]["key"] == 9
    assert got[1]["target"] == 7.0 and got[2]["target"] == got[3]["target"] == 0.0
    assert (got[1]["whole"], got[1]["part"]) == (1, 3)
    whole = mixing.materialise(mixing.plan_mix(docs, weights)).orderBy("doc_id", "copy").collect()
    assert [(r["doc_id"], r["text"], r["copy"]) for r in whole] == [(1, "a b c d", 0), (1, "a b c", 1)]
    assert mixing.plan_mix(empty(spark), weights).count() == 0 and mixing.plan_mix(docs, weights.where("false")).agg(F.sum("whole")).first()[0] == 0


# operator 12


def h(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def item(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def climb(tree, at):
    out = []
    for nodes in tree[:-1]:
        run = at - at % 3
        out.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 3])))
        at //= 3
    return out


def manifest(rows):
    """Leaves of equal digest are told apart by nothing, so results are compared as multisets."""
    groups, out = defaultdict(list), []
    for i, t, lang, source, n in rows:
        leaf = h("".join(map(item, (i, source, lang, n, t))))
        even = i is not None and __import__("zlib").crc32(str(i).encode()) % 2 == 0
        other = h("".join(map(item, (i, source, lang, n, t.replace("\n", "") if even and t is not None else t))))
        groups[source].append((i is not None, i or 0, leaf, other, i))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda x: x[:3])
        trees[s] = levels([x[2] for x in groups[s]])
    top = levels([trees[s][-1][0] for s in order])
    for k, s in enumerate(order):
        for at, (_, _, leaf, other, i) in enumerate(groups[s]):
            steps = climb(trees[s], at) + climb(top, k)
            x = other
            for a, b in steps:
                x = h(a + x + b)
            out.append((i, leaf, trees[s][-1][0], top[-1][0], h("".join(a + b for a, b in steps)), x, x == top[-1][0]))
    return sorted(out, key=str)


def proven(spark, rows, schema=DOCS):
    fields = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    docs = spark.createDataFrame(rows, schema)
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    now = {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    got = merkle.proofs(merkle.leaves(docs, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "source", now)).withColumnRenamed("id", "doc_id")
    return sorted((tuple(r[f] for f in fields) for r in got.collect()), key=str)


def test_manifest_equals_brute_force(spark):
    rows = [(i, text(i, 4) + "\n" * (i % 3), "en", "hot", i) for i in range(800)]  # more than one slot array
    rows += [(i * 7919 - 40_000, text(i, 3), None, f"s{i % 4}", None) for i in range(40)]
    rows += [(2**62 + i, "x\ny", "en", "far", 1) for i in range(3)] + [(-(2**63), "low", "en", "far", 1), (2**63 - 1, None, "en", "far", 1)]
    rows += [(None, "no id", "en", None, 1), (None, "no id\n", "en", None, 1), (None, "no id", "en", None, 1), (5, "ü\n", "de", "", 2), (6, "a" * 200_000 + "\n", "en", "s0", 3)]
    rows += [(12, "same\n", "en", "hot", 1)] * 9 + [(12, f"other {i}", "en", "hot", 1) for i in range(5)]
    assert proven(spark, rows) == manifest(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 729, 730])
def test_manifest_sizes(spark, n):
    rows = [(i, f"t\n{i}", "en", "one", i) for i in range(n)]
    assert proven(spark, rows) == manifest(rows)


def test_manifest_of_many_sources_and_none(spark):
    rows = [(i, "t\n", "en", f"src{i:04}", i) for i in range(900)]
    assert proven(spark, rows) == manifest(rows)
    assert proven(spark, []) == []


def test_bitmap_ranks(spark):
    ids = sorted({(i * i * 2654435761) % (1 << 60) - (1 << 59) for i in range(500)} | set(range(300)))
    rows = spark.createDataFrame([("g", i, b"x", None) for i in ids], "grp string, id long, leaf binary, other binary")
    got = dict(merkle.positions(rows).select("id", "pos").collect())
    assert got == {i: k for k, i in enumerate(ids)}


# operator 13


@pytest.mark.parametrize("seed", range(6))
def test_rank_one_updates(seed):
    r = np.random.default_rng(seed)
    k = int(r.integers(1, 12))
    d = np.sort(r.normal(size=k) * 10.0 ** r.integers(-6, 6, k)) if seed % 2 else np.repeat(np.sort(r.normal(size=k)), 2)
    q = np.linalg.qr(r.normal(size=(len(d), len(d))))[0]
    v = r.normal(size=len(d)) * (r.random(len(d)) < 0.7)
    rho = float(10.0 ** r.integers(-3, 4))
    values, basis = rank_one(d, q, v, rho)
    want = q @ np.diag(d) @ q.T + rho * np.outer(v, v)
    size = max(np.abs(want).max(), 1e-300)
    assert np.abs(basis @ np.diag(values) @ basis.T - want).max() < 1e-12 * size
    assert np.abs(basis.T @ basis - np.eye(len(d))).max() < 1e-12 and (np.diff(values) >= 0).all()


def test_secular_roots_interlace():
    d, z = np.array([0.0, 1e-12, 1.0, 1.0 + 1e-9, 5.0]), np.array([1.0, 1e-6, 0.3, 2.0, 1e-5])
    roots, diff = secular_roots(d, z, 0.5)
    assert (roots >= d).all() and (roots[:-1] <= d[1:]).all()
    assert np.allclose(roots.sum(), d.sum() + 0.5 * (z * z).sum(), rtol=1e-14) and (np.sign(diff[0]) <= 0).all()


def test_spectra_merge_as_one():
    x = np.random.default_rng(1).normal(size=(60, 7)) + 50
    parts = [Spectrum(7) for _ in range(3)]
    for i, v in enumerate(x):
        parts[i % 3].add(v)
    for p in (parts[1], Spectrum(7), parts[2]):
        parts[0].merge(Spectrum.of(*p.row()))
    c = x - x.mean(0)
    assert parts[0].n == 60 and np.allclose(parts[0].mean, x.mean(0)) and np.allclose(parts[0].values, np.linalg.eigvalsh(c.T @ c))


def dense(rows, width, top):
    keep = [(i, [*v, *[0.0] * (width - len(v))]) for i, v in rows if v is not None and all(e is not None and np.isfinite(e) for e in v)]
    x = np.clip(np.floor(1024 * np.array([v for _, v in keep])), -(2.0**40), 2.0**40).astype(np.int64) + 100_000
    n, sums = len(x), [sum(map(int, c)) for c in x.T]
    c = np.array([[float(Fraction(int(e) * n - s, n)) for e, s in zip(r, sums)] for r in x])
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1][:top], q[:, ::-1][:, :top]
    return [i for i, _ in keep], n, [sum((int(v) * n - s) ** 2 for v, s in zip(r, sums)) for r in x], c @ q / np.sqrt(e), e / np.trace(c.T @ c / n)


def test_whitening_equals_dense(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(np.float32(v)) for v in r.normal(size=6) * [5, 3, 2, 1, 0.5, 0.2] + 7]) for i in range(400)]
    rows += [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (902, [float("nan")] * 6), (903, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (904, [1.0, 2.0]), (905, []), (906, [0.0] * 6)]
    rows += [(7, rows[7][1])] * 30
    df = awkward(spark, [(i, "") for i, _ in rows], "vec_id").join(spark.createDataFrame(rows, "vec_id long, embedding array<float>").dropDuplicates(), "vec_id")
    ids, n, deviation, w, explained = dense([(r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect()], 6, 4)
    got = whiten(df.repartition(7), components=4).collect()
    assert len(got) == 4 * n and {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-10
    table = {}
    for i, d, row in zip(ids, deviation, w):
        table[i] = (d, row)
    for r in got:
        d, row = table[r["vec_id"]]
        k = r["component"] - 1
        assert r["deviation"] == d and abs(abs(r["whitened"]) - abs(row[k])) < 1e-9 and abs(r["explained"] / explained[k] - 1) < 1e-10


def test_whitening_without_variance(spark):
    one = lambda rows: whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert one([]) == [] and one([(1, None)]) == [] and one([(1, [1.0, 2.0])]) == [] and one([(1, [3.0]), (None, [3.0])]) == [] and one([(1, [])]) == []
    line = one([(i, [float(i), 2.0 * i, 5.0]) for i in range(10)] + [(None, [1e38, 1.0, 1.0])])
    assert {r["component"] for r in line} <= {1, 2} and any(r["vec_id"] is None for r in line) and max(r["identity_error"] for r in line) < 1e-4
    flat = one([(i, [float(i), 2.0 * i, 5.0]) for i in range(10)])
    assert {r["component"] for r in flat} == {1}


def test_new_queries_are_registered():
    assert {"op11_water_filling_mix", "op12_merkle_manifest", "op13_whitening"} <= set(queries.QUERIES) and "op12_merkle_manifest" in queries.ORACLES
