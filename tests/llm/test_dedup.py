import random

import numpy as np
import pytest

from telemill.llm import itq, line_dedup, minhash
from telemill.llm.common import components
from tests.llm.helpers import awkward, edited, empty, shingle_set, smallest_reachable, text


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (5, 5), (None, 3)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == smallest_reachable(range(61), edges[:60]) | {100: 100, 101: 100}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    base = [text(s, 150) for s in range(4)]
    rows = list(enumerate(edited(base[k % 4], k, 0.06 * (k % 5) / 4) for k in range(120)))
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "Hello"), (204, "hELLO"), (205, text(9, 30_000)), (206, text(9, 30_000)), (None, base[0]), (0, base[0])]
    got = {r.doc_id: r for r in minhash.near_duplicates(awkward(spark, rows), size=size).collect()}
    sets = {i: shingle_set(t, size) for i, t in rows[:-1] if i is not None}
    one = got.pop(0)  # two rows of one id: one of its texts counts
    sets[0] = max((shingle_set(t, size) for i, t in rows if i == 0), key=lambda s: abs(len(s) - one.n_shingles) == 0)
    links = [(a, b) for a in sets for b in sets if a < b and a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = smallest_reachable([i for i in sets if i], links)
    # id 0 belongs to the first family whichever text is taken
    assert {i: len(sets[i]) for i in got} == {i: r.n_shingles for i, r in got.items()}
    same = lambda m, a, b: m[a] == m[b]
    mine = {i: r.component_id for i, r in got.items()}
    assert all(same(mine, a, b) for a in want for b in want if same(want, a, b))
    assert mine[200] == 200 and mine[201] == 201 and mine[203] == mine[204] == 203 and mine[205] == mine[206]
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_large_bucket_gives_the_same_components(spark, monkeypatch):
    base = text(1, 200)
    rows = list(enumerate(edited(base, k, 0.01 + 0.11 * (k % 7) / 6) for k in range(150)))
    docs = awkward(spark, rows)
    sets = {i: shingle_set(t, 2) for i, t in rows}
    want = smallest_reachable(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    monkeypatch.setattr(minhash, "SMALL", 4)
    monkeypatch.setattr(minhash, "TILE", 16)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, size=2).collect()} == want


def test_pruning_keeps_what_its_bound_allows():
    # exact tail of Beta(m + 1, n - m + 1) by numeric integration
    n, t, miss = 32, 0.8, 1e-3
    least = minhash.least_matches(n, t, miss)
    x = np.linspace(0, 1, 200_001)
    for m, above in ((least, True), (least - 1, False)):
        d = x**m * (1 - x) ** (n - m)
        assert (d[x >= t].sum() / d.sum() >= miss) == above


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0


def _line_oracle(rows):
    """Keep the first of every repeated chunk, by plain loops over the operator's own line and chunk rules."""
    import pyarrow as pa

    at = {}
    found = []
    for i, t in sorted(rows):
        for _, a, n, w, _ in zip(*line_dedup.chunks(pa.array([t]))):
            if n >= 2 and w >= line_dedup.LEAST_WORDS:
                own = [x.rstrip() for x in line_dedup._split(t.encode())]
                key = tuple(own[a : a + n])
                found.append((i, int(a), int(n), key))
                at.setdefault(key, (i, int(a)))
    texts, out = dict(rows), {}
    for i, t in rows:
        own = line_dedup._split(t.encode())
        gone = set()
        for j, a, n, key in found:
            if j == i and at[key] != (i, a):
                src, sa = at[key]
                other = [x.rstrip() for x in line_dedup._split(texts[src].encode())]
                bare = [x.rstrip() for x in own]
                gone |= set(range(a, a + n))
                for step, x, y, k in ((-1, a - 1, sa - 1, 0), (1, a + n, sa + n, 0)):
                    while 0 <= x < len(bare) and 0 <= y < len(other) and bare[x] == other[y] and k < line_dedup.SPAN:
                        gone.add(x)
                        x, y, k = x + step, y + step, k + 1
        out[i] = b"".join(x for k, x in enumerate(own) if k not in gone).decode()
    return out


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(5)
    sentence = lambda: " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(r.randrange(99)) for _ in range(7)) + "."
    passage = [sentence() for _ in range(9)]
    rows = []
    for i in range(30):
        own = [sentence() for _ in range(12)]
        if i % 2:
            own[4:4] = passage
        rows.append((i, ("\n" if i % 3 else " ").join(own)))
    rows.append((40, rows[0][1]))
    rows += [(41, "Of.\nIn."), (42, "Of.\nIn.")]
    got = {x.doc_id: x for x in line_dedup.remove_repeats(awkward(spark, [*rows, (50, None), (51, ""), (60, rows[1][1]), (60, rows[1][1]), (None, rows[1][1])])).collect() if x.doc_id not in (60, None)}
    want = _line_oracle(rows)
    assert {i: got[i].text for i in want} == want
    assert got[50].text is None and got[50].n_lines == 0 and got[51].text == ""
    assert got[40].text == "" and got[41].n_removed == 0 and got[42].n_removed == 0
    kept = " ".join(x.text or "" for x in got.values()).replace("\n", " ")
    assert all(kept.count(s) == 1 for s in passage[2:-2])  # inner sentences stay exactly once
    assert {"doc_id", "text", "label", "id", "keys", "bucket", "n_lines", "n_removed"} == set(line_dedup.remove_repeats(awkward(spark, rows)).columns)


def test_line_dedup_of_nothing_and_repeated_ids(spark):
    assert line_dedup.remove_repeats(empty(spark)).count() == 0
    t = "\n".join(f"line {i} with quite a few words of its own {i}." for i in range(9))
    out = line_dedup.remove_repeats(awkward(spark, [(7, t), (7, t)])).collect()
    assert [x.text for x in out] == [t, t]


def test_line_dedup_finds_every_short_passage(spark):
    # passages of 51 words in 1 to 5 lines and of 12 to 20 words in 2, each in two texts only, between other lines
    r = random.Random(8)
    rows, planted = [], []
    line = lambda n: " ".join(f"u{r.randrange(10**9)}" for _ in range(n)) + "."
    for k in range(120):
        n = k % 6
        sizes = [r.randrange(6, 11), r.randrange(6, 11)] if n == 0 else [51 // n + (i < 51 % n) for i in range(n)]
        planted.append([line(m) for m in sizes])
        for i in (2 * k, 2 * k + 1):
            before, after = [line(r.randrange(3, 18)) for _ in range(r.randrange(4))], [line(r.randrange(3, 18)) for _ in range(1 + r.randrange(4))]
            rows.append((i, "\n".join([*before, *planted[-1], *after]), len(before) + len(after)))
    got = {x.doc_id: x for x in line_dedup.remove_repeats(awkward(spark, [x[:2] for x in rows])).collect()}
    for k, lines in enumerate(planted):
        first, second = got[2 * k], got[2 * k + 1]
        assert first.text == rows[2 * k][1] and first.n_removed == 0
        assert not any(x in second.text for x in lines), f"{len(lines)} lines"
        assert second.n_removed == len(lines) and second.text.count(".") == rows[2 * k + 1][2]


def test_joined_chunks_cover_what_their_parts_cover():
    found = [{"a": a, "n": n} for a, n in [(40, 2), (5, 3), (6, 4), (41, 30), (90, 2)]]
    got = line_dedup._pieces(found, 5)
    assert [i for a, b in got for i in range(a, b)] == [*range(5, 10), *range(40, 71), *range(90, 92)]
    assert all((a - 5) // line_dedup.PIECE == (b - 1 - 5) // line_dedup.PIECE for a, b in got)


def test_chunk_boundaries_resist_shifts():
    import pyarrow as pa

    t = [f"sentence number {i * 37 % 101} of the text." for i in range(60)]
    a = line_dedup.chunks(pa.array(["\n".join(t)]))
    b = line_dedup.chunks(pa.array(["\n".join(["A new first line.", *t])]))
    assert len(set(a[4]) & set(b[4])) >= len(a[4]) - 3


def _brute_vectors(rows, threshold):
    unit = {}
    for i, v, lab in rows:
        if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            unit[i] = np.array(v, float) / np.linalg.norm(v)
    label = {i: (lab, len(v or [])) for i, v, lab in rows}
    links = [(a, b) for a in unit for b in unit if a < b and label[a] == label[b] and unit[a] @ unit[b] >= threshold]
    degree = {i: 0 for i, _, _ in rows}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    return degree, smallest_reachable([i for i, _, _ in rows], links)


def test_vectors_equal_brute_force(spark):
    g = np.random.default_rng(2)
    rows = []
    for c in range(6):
        centre = g.normal(size=24)
        spread = (0.02, 0.1, 0.2, 0.25, 0.3, 0.0)[c]
        rows += [(len(rows) + k, (centre + spread * g.normal(size=24) * np.sqrt(1 / 2)).tolist(), c % 2) for k in range(40)]
    rows += [(1000, None, 0), (1001, [0.0] * 24, 0), (1002, [float("nan")] + [1.0] * 23, 0), (1003, [None] + [1.0] * 23, 0), (1004, rows[0][1], None), (1005, rows[0][1][:5], 0), (1006, [1e-200] * 24, 1), (1007, [2e-200] * 24, 1)]
    df = spark.createDataFrame([(*r, "z", 3) for r in rows], "vec_id long, embedding array<double>, label int, code string, unit int")
    got = {r.vec_id: r for r in itq.near_duplicates(df).collect()}
    degree, comp = _brute_vectors(rows[:-2], 0.93)
    assert got[1006].n_links == got[1007].n_links == 1 and got[1007].component_id == 1006
    found, real = sum(got[i].n_links for i in degree), sum(degree.values())
    assert all(got[i].n_links <= degree[i] for i in degree) and found >= 0.99 * real
    assert sum(got[i].component_id != comp[i] for i in comp) <= 2


def test_vectors_of_nothing(spark):
    assert itq.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    only = spark.createDataFrame([(1, None, None)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in itq.near_duplicates(only).collect()] == [(1, 0, 1, True)]


def _chunk_records(seed, n, frequent):
    g = np.random.default_rng(seed)
    rec = np.zeros(n, line_dedup.CHUNK)
    rec["h"] = g.integers(0, 1 << 64, n // 2, dtype=np.uint64)[g.integers(0, n // 2, n)]
    rec["h"][g.permutation(n)[:frequent]] = rec["h"][0]
    rec["id"], rec["a"], rec["n"] = g.integers(-40, 40, n), g.integers(0, 90, n), 2
    return rec


@pytest.mark.parametrize("frequent", [0, 400])
def test_dealt_chunks_find_every_later_occurrence(frequent):
    from telemill.llm.common import by_shard, records

    parts = [_chunk_records(s, 900, frequent) for s in (1, 1, 2)]
    first, want = {}, []
    rows = [tuple(map(int, x)) for x in np.concatenate(parts)]
    for h, i, a, _ in rows:
        first[h] = min(first.get(h, (i, a)), (i, a))
    want = sorted((i, a, *first[h], n) for h, i, a, n in rows if (i, a) != first[h])
    dealt = [b for p in parts for b in line_dedup._dealt(p)]
    kind = lambda b: b.column(1)[0].as_py()
    shards = sorted((r["shard"], r["data"]) for b in dealt if kind(b) == 0 for r in b.to_pylist())
    import pyarrow as pa

    mixed = [pa.RecordBatch.from_pydict({"shard": [s for s, _ in shards[k : k + 7]], "data": [d for _, d in shards[k : k + 7]]}) for k in range(0, len(shards), 7)]
    each = [line_dedup._repeats(rec) for rec in by_shard(iter(mixed), line_dedup.CHUNK)]
    got = [tuple(int(x[c]) for c in ("id", "a", "sid", "sa", "n")) for hits, _ in each for x in hits]
    told = {int(x["h"]): (int(x["id"]), int(x["a"])) for _, hot in each for x in hot}
    rest = np.concatenate([records(b.column(2), line_dedup.CHUNK) for b in dealt if kind(b) == 1] or [np.zeros(0, line_dedup.CHUNK)])
    assert len(told) == (2 if frequent else 0) and (len(rest) > 0) == (frequent > 0)
    got += [(int(x["id"]), int(x["a"]), *told[int(x["h"])], int(x["n"])) for x in rest if (int(x["id"]), int(x["a"])) != told[int(x["h"])]]
    assert sorted(got) == want
    # a frequent chunk sends one row of what a worker holds to its shard
    assert sum(len(d) for _, d in shards) + rest.nbytes == sum(p.nbytes for p in parts)


def test_frequent_passage_equals_brute_force(spark):
    r = random.Random(3)
    line = lambda: " ".join(f"w{r.randrange(500)}" for _ in range(7)) + "."
    passage = [line() for _ in range(40)]
    rows = [(i, "\n".join([line(), *passage[i % 3 :], line()])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {x.doc_id: x.text for x in line_dedup.remove_repeats(docs).collect()} == _line_oracle(rows)


def test_frequent_chunks_are_asked_for_once_a_blob(spark, monkeypatch):
    r = random.Random(4)
    passage = [" ".join(f"w{r.randrange(500)}" for _ in range(7)) + "." for _ in range(40)]
    rows = [(i, "\n".join(passage)) for i in range(200)]
    asked = []
    join = line_dedup.salted_join
    monkeypatch.setattr(line_dedup, "salted_join", lambda left, *more: asked.append(left.count()) or join(left, *more))
    out = line_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {x.doc_id: x.text for x in out} == {i: t if i == 0 else "" for i, t in rows}
    assert 39 <= asked[0] <= 39 + 199 * 39 // 1024 + 1  # of 199 * 39 later occurrences


def test_pipeline_asks_for_frequent_chunks_once_a_blob(spark, monkeypatch):
    import corpus_pipeline

    r = random.Random(6)
    t = "\n".join(" ".join(f"w{r.randrange(500)}" for _ in range(7)) + "." for _ in range(40))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i in range(200)], "doc_id long, text string, lang string, source string, n_chars long")
    asked = []
    join = line_dedup.salted_join
    monkeypatch.setattr(line_dedup, "salted_join", lambda left, *more: asked.append(left.count()) or join(left, *more))
    assert [tuple(x) for x in corpus_pipeline.line_dedup(spark, docs.coalesce(1), "").collect()] == [(0, t, "en", "s", len(t))]
    assert asked[0] <= 39 + 199 * 39 // 1024 + 1  # of 199 * 39 later occurrences


def test_each_text_passes_python_once_at_the_end(spark):
    plan = line_dedup.remove_repeats(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    kept = plan[: plan.index("MapInArrow rewrite") if "MapInArrow rewrite" in plan else plan.index("RepartitionByExpression")]
    assert kept.count("untouched") == 1 and "run(" not in kept
