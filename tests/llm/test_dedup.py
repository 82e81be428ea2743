import hashlib
import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from shoal.llm import embedding_dedup, exact_dedup, graph, jaccard, scratch, simhash

DOCS = "doc_id long, text string, keep_id string, _id int, fp string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS)


def test_exact_nulls_ties_and_clashing_columns(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (None, "a"), (None, None), (6, "é" * 100_000), (7, "é" * 100_000)]
    got = exact_dedup.classes(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    for r in got:
        group = next(v for k, v in by.items() if hashlib.sha256(k.encode()).hexdigest() == r["text_sha256"])
        assert r["keep_id"] == max((i for i in group if i is not None), default=None) and r["group_size"] == len(group)
    assert sum(r["kept"] for r in got) == len(by)


def test_exact_hot_group_takes_the_broadcast_path(spark):
    rows = [(i, "hot" if i % 3 else f"t{i % 300}") for i in range(3000)]
    got = exact_dedup.classes(docs(spark, rows), counters=64).collect()
    hot = [r for r in got if r["group_size"] == 2000]
    assert len(hot) == 2000 and {r["keep_id"] for r in hot} == {2999} and sum(r["kept"] for r in got) == 1 + 100


def test_exact_dedup_keeps_columns_and_one_row(spark):
    rows = [(1, "a"), (2, "a"), (5, "b"), (5, "b"), (None, "c"), (None, "c"), (3, None), (4, "")]
    out = exact_dedup.dedup(docs(spark, rows))
    assert out.columns == ["doc_id", "text", "keep_id", "_id", "fp"]
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in out.collect()) == [(-1, "c"), (2, "a"), (4, ""), (5, "b")]


def test_empty_tables(spark):
    none = docs(spark, [])
    assert exact_dedup.classes(none).count() == 0 and exact_dedup.dedup(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0 and simhash.dedup(none).count() == 0


def plain_fingerprint(text, words):
    toks = (text or "").encode().lower().split()
    if not toks:
        return 0
    grams = [b" ".join(toks[k : k + words]) for k in range(max(1, len(toks) - words + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(n, linked):
    comp = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j) and comp[i] != comp[j]:
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return comp


def test_simhash_equals_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 400))) for _ in range(40)]
    rows = [None, "", " \t\n", "One", "one", "A b", "a  B", "x\x1cy z"] + base
    for b in base[:20]:
        for _ in range(4):
            w = b.split()
            w[rng.randrange(len(w))] = "other"
            rows.append(" ".join(w))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, list(enumerate(rows))), words=3).collect()}
    fp = [plain_fingerprint(t, 3) for t in rows]
    comp = closure(len(rows), lambda i, j: bin(fp[i] ^ fp[j]).count("1") <= 2)
    assert [got[i]["fingerprint"] for i in range(len(rows))] == [f"{x:016x}" for x in fp]
    assert [got[i]["component_id"] for i in range(len(rows))] == comp
    assert len({*comp}) < len(rows) - 20


def test_simhash_links_at_most_two_bits_in_a_crowd(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {centre} | {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))) for _ in range(400)}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    parts = {r["node"]: r["component"] for r in graph.components(simhash.links(df)).collect()}
    comp = closure(len(fps), lambda i, j: bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= 2)
    assert [parts.get(x, x) for x in fps] == [fps[c] for c in comp]


def test_simhash_dedup_keeps_smallest(spark):
    text = " ".join(f"w{k}" for k in range(300))
    rows = [(9, text), (4, text), (7, text.replace("w150", "q")), (1, "alone here"), (None, text), (None, "other words altogether")]
    kept = {r["doc_id"] for r in simhash.dedup(docs(spark, rows)).collect()}
    assert {1, 4} <= kept and 9 not in kept and None in kept


def plain_jaccard(a, b, words=5):
    def grams(t):
        w = (t or "").encode().lower().split()
        return {b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))}

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def test_near_copies_of_a_similarity_of_0_8_are_linked(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)  # cells and components are dealt out in blocks
    rng = random.Random(11)
    rows = [None, "", "One", "one", "a b c"]
    for size in (40, 120, 400):
        for _ in range(4):
            base = [f"w{rng.randrange(5000)}" for _ in range(size)]
            rows.append(" ".join(base))
            for edits in range(1, 1 + size // 20):
                w = list(base)
                for at in rng.sample(range(size), edits):
                    w[at] = f"new{rng.randrange(10**6)}"
                rows.append(" ".join(w))
    like = {(i, j): plain_jaccard(rows[i], rows[j]) for i in range(len(rows)) for j in range(i)}
    far = [p for p, s in like.items() if 0.8 <= s <= 0.95 and bin(plain_fingerprint(rows[p[0]], 5) ^ plain_fingerprint(rows[p[1]], 5)).count("1") > 2]
    assert len(far) > 20 and sum(0.5 < s < 0.8 for s in like.values()) > 20
    comp = closure(len(rows), lambda i, j: like[i, j] >= 0.8)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs(spark, list(enumerate(rows)))).collect()}
    assert [got[i] for i in range(len(rows))] == comp
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs(spark, list(enumerate(rows))), "").collect()} == set(comp)
    assert jaccard.dedup(docs(spark, [])).count() == 0


def test_long_text_fingerprint():
    text = " ".join(f"w{k * k % 7919}" for k in range(70_000))
    assert simhash.fingerprint(text.encode(), 5) == plain_fingerprint(text, 5)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 10), (5, 5), (None, 6), (7, None)] + [(100, k) for k in range(101, 400)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10} | {k: 100 for k in range(100, 400)}
    chain = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long")
    assert {r["component"] for r in graph.components(chain).collect()} == {0}


VEC = "vec_id long, embedding array<float>, label int, key string, cid int, n_links int"


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows, i = [], 0
    for label in (1, 2, None):
        for _ in range(12):
            c = rng.normal(size=16)
            for _ in range(rng.integers(1, 6)):
                rows.append((i, [float(np.float32(x)) for x in c + rng.normal(size=16) * 0.25], label, "k", 1, 1))
                i += 1
    rows += [(i + k, v, 1, "k", 1, 1) for k, v in enumerate([None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] * 16, [1.0], [2.0], rows[0][1], rows[0][1]])]
    rows.append((None, rows[0][1], 1, "k", 1, 1))
    x = [np.array(r[1], float) if r[1] and r[2] is not None and None not in r[1] and np.isfinite(np.array(r[1], float)).all() and any(r[1]) else None for r in rows]

    def linked(i, j):
        a, b = x[i], x[j]
        return i != j and a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.93

    df = spark.createDataFrame(rows, VEC)
    comp = closure(len(rows), linked)
    for block, direct in ((2048, 16_384), (7, 16_384), (5, 12)):
        got = embedding_dedup.near_duplicates(df, block=block, direct=direct).collect()
        assert len(got) == len(rows)
        for r in got:
            at = next(k for k, row in enumerate(rows) if row[0] == r["vec_id"])
            assert r["n_links"] == sum(linked(at, j) for j in range(len(rows)))
            assert r["component_id"] == rows[comp[at]][0] or r["vec_id"] is None
            assert r["kept"] == (r["vec_id"] == r["component_id"])


def test_a_label_above_the_bound_for_one_bucket(spark):
    """20,000 vectors of one label go through the buckets of the production defaults; links are counted by brute force."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(5000, 32))
    x = np.repeat(centres, 4, axis=0) + rng.normal(size=(20_000, 32)) * rng.choice([0.1, 0.2, 0.28], size=(20_000, 1))
    x = x.astype(np.float32).astype(float)
    assert len(x) > embedding_dedup.DIRECT
    unit, want = x / np.linalg.norm(x, axis=1)[:, None], np.zeros(len(x), int)
    for k in range(0, len(x), 2000):
        want[k : k + 2000] = (unit[k : k + 2000] @ unit.T >= 0.93).sum(axis=1) - 1
    import pyarrow as pa

    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x)), "label": pa.array(["one"] * len(x))}))
    got = embedding_dedup.near_duplicates(df).toArrow().sort_by("vec_id").column("n_links").to_numpy()
    assert want.sum() > 5000 and (got == want).mean() > 0.9999 and (got <= want).all()


def test_estimate_is_unbiased_and_bounds_hold():
    rng = np.random.default_rng(2)
    o, q = rng.normal(size=(2, 3000, 64))
    q = o + 0.3 * q
    o, q = (v / np.linalg.norm(v, axis=1)[:, None] for v in (o, q))
    packed, a = embedding_dedup.codes(o)
    sign = (np.unpackbits(packed, axis=1) * 2.0 - 1) / 8
    got = ((q @ embedding_dedup.rotation(64)) * sign).sum(axis=1)
    true = (o * q).sum(axis=1)
    assert abs((got / a - true).mean()) < 0.01
    assert (got[true >= 0.93] >= embedding_dedup.least_product(a, 64, 0.93)[true >= 0.93]).all()


def test_no_vectors(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], VEC)).count() == 0


def test_near_copies_are_found_by_fingerprints(spark, monkeypatch):
    """Without cells, those within two bits are still linked: by the grid, and only if their shingles are alike."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(jaccard, "_met", lambda groups: groups.select("k", F.lit(0).alias("grp"), F.lit(0).cast("long").alias("b")).limit(0))
    rng = random.Random(5)
    rows = []
    for size in (300, 900, 2000):
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        for k in range(9):
            rows.append(" ".join([*base, *(f"end{k}" for _ in range(k % 3))]))
    prints = [simhash.majority(jaccard.shingles(t.encode())) for t in rows]
    like = lambda i, j: plain_jaccard(rows[i], rows[j]) >= 0.8
    comp = closure(len(rows), lambda i, j: like(i, j) and bin(prints[i] ^ prints[j]).count("1") <= 2)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs(spark, list(enumerate(rows)))).collect()}
    assert len(set(comp)) < len(rows) - 6 and [got[i] for i in range(len(rows))] == comp
    all_met = lambda once: once.select(F.col("k").alias("a")).crossJoin(once.agg(F.min("k").alias("b"))).where("a <> b")
    monkeypatch.setattr(jaccard, "_by_fingerprint", all_met)
    links = jaccard.near_duplicates(docs(spark, [(0, rows[0]), (1, "quite another text " * 9)])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in links} == {(0, 0), (1, 1)}


def test_texts_are_not_shuffled_for_their_sets(spark, monkeypatch):
    """Only marked texts are made sets of, where they lie; with few marks some are made in vain, and the links are the same."""
    plans, real = [], scratch.stage

    def stage(df, name, **kw):
        if name == "sets":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name, **kw)

    monkeypatch.setattr(scratch, "stage", lambda df, name, codec="zstd": stage(df, name, codec=codec))
    monkeypatch.setattr(jaccard, "MARKS", 1 << 15)
    rng = random.Random(3)
    rows = [" ".join(f"w{rng.randrange(300)}" for _ in range(12)) for _ in range(400)]
    rows += [t + " x" for t in rows[:150]]
    for more in ([], rows[:40]):  # with copies, a text still has one set
        plans.clear()
        got = [r["component_id"] for r in sorted(jaccard.near_duplicates(docs(spark, list(enumerate(rows + more)))).collect())]
        assert got == [k % 400 for k in range(550)] + list(range(len(more)))
        assert plans and ("Exchange" in plans[0]) == bool(more)


def test_marks_keep_all_keys(spark):
    keys = np.random.default_rng(2).integers(-(1 << 63), (1 << 63) - 1, 3000)
    keys[:4] = -1, 0, jaccard.MARKS, jaccard.MARKS - 1
    bits = jaccard._marks(spark.createDataFrame([(k,) for k in keys.tolist()], "k long")).value
    assert jaccard._marked(bits, keys).all() and np.unpackbits(bits).sum() == len(set((keys % jaccard.MARKS).tolist()))
