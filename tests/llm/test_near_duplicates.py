import random

import numpy as np
import pytest
from cases import documents, prose

from skylag.llm import embed_dedup, hyperminhash
from skylag.llm.common import connected_components
from skylag.llm.registry import Q


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {n: root(n) for n in nodes}


def shingles(t):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ")
    for c in "\n\x0b\x0c\r":
        ws = ws.replace(c, " ")
    ws = [w for w in ws.split(" ") if w]
    return set(zip(ws, ws[1:], strict=False)) if len(ws) > 1 else {tuple(ws)} if ws else set()


def brute(docs):
    sets = {}
    for i, t in docs:
        if i is not None:
            sets.setdefault(i, set()).add(frozenset(shingles(t)))
    flat = [(i, s) for i, ss in sets.items() for s in ss if s]
    links = [(a, b) for n, (a, x) in enumerate(flat) for b, y in flat[n + 1:]
             if a != b and 100 * len(x & y) >= 80 * len(x | y)]
    return components(sets, links)


def check(spark, tables, docs):
    rows = Q["op2_hyperminhash"][0](spark, tables(documents=docs)).collect()
    comp = brute(docs)
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in rows)) == sorted(
        (i is None, i or 0, len(shingles(t)), comp.get(i, 0), i is not None and comp[i] == i) for i, t in docs)


def test_op2_equals_brute_force(spark, tables):
    check(spark, tables, documents(140))


def test_op2_chain_and_large_group(spark, tables, monkeypatch):
    """A drifting chain (ends unlike each other) and a group of near copies with stragglers."""
    monkeypatch.setattr(hyperminhash, "BLOCK", 7)
    rng = random.Random(3)
    chain, ws = [], prose(rng, 80).split()
    for _ in range(25):
        ws = list(ws)
        ws[rng.randrange(len(ws))] = prose(rng, 1)
        ws[rng.randrange(len(ws))] = prose(rng, 1)
        chain.append(" ".join(ws))
    base, group = prose(rng, 90).split(), []
    for k in range(60):
        ws = list(base)
        for _ in range(k % 9 + 1):
            ws[rng.randrange(len(ws))] = prose(rng, 1)
        group.append(" ".join(ws))
    check(spark, tables, [(i, t) for i, t in enumerate(chain + group)])


def test_op2_without_broadcasts(spark, tables, monkeypatch):
    """Beyond the size at which tables are broadcast, the result is the same;
    two rounds of pivots, so that merged components are carried over."""
    from skylag.llm import common
    for m in (common, hyperminhash):
        monkeypatch.setattr(m, "is_small", lambda df, most=0: False)
    monkeypatch.setattr(hyperminhash, "LEFT_PER_DOC", 0)
    rng = random.Random(8)
    docs = []
    for k in range(6):
        base = [f"g{k}w{i}" for i in range(80)]
        for _ in range(9):
            t = list(base)
            for _ in range(rng.randrange(5)):
                t[rng.randrange(80)] = f"x{rng.randrange(10 ** 6)}"
            docs.append((len(docs) * 7 % 101, " ".join(t)))
    docs += [(200, docs[0][1]), (201, docs[0][1]), (201, docs[0][1]), (202, None), (203, " ")]
    check(spark, tables, docs)


def test_op2_expands_the_pairs_once(spark, tables, monkeypatch):
    """The ids of the compared pairs are written before their size is checked and they are joined."""
    written = {}
    keep = hyperminhash.materialize

    def noted(df, name, *args, **kwargs):
        written.setdefault(name, []).append(out := keep(df, name, *args, **kwargs))
        return out
    monkeypatch.setattr(hyperminhash, "materialize", noted)
    Q["op2_hyperminhash"][0](spark, tables(documents=documents())).count()
    assert len(written["hmh-ids"]) == len(written["hmh-pairs"])
    for ids, pairs in zip(written["hmh-ids"], written["hmh-pairs"], strict=True):
        assert sorted(r.doc_id for r in ids.collect()) == sorted({i for r in pairs.collect() for i in (r.a, r.b)})


def test_op2_same_id_and_empty(spark, tables):
    check(spark, tables, [(1, "a b c d"), (1, "x y z w"), (2, "x y z w"), (3, "a b c d"), (4, ""), (5, None), (6, " ")])
    assert Q["op2_hyperminhash"][0](spark, tables(documents=[])).count() == 0


@pytest.mark.parametrize("n", [4, 10, 200, 3000])
def test_registers_estimate_and_bands(n):
    rng, hits, est, far = np.random.default_rng(n), 0, [], []
    for _ in range(150):
        u = rng.integers(0, 2**64, 2 * n, dtype=np.uint64)
        c = int(round(1.6 * n / 1.8))  # common of two sets of n: Jaccard c / (2n - c)
        a, b = np.unique(u[:n]), np.unique(np.concatenate([u[:c], u[n:2 * n - c]]))
        x, y = hyperminhash.registers(a), hyperminhash.registers(b)
        est.append(hyperminhash.estimate(x, y, n, n) - c / (2 * n - c))
        if c / (2 * n - c) >= 0.8:
            hits += (x.reshape(-1, hyperminhash.ROWS) == y.reshape(-1, hyperminhash.ROWS)).all(1).any()
            d = hyperminhash.signature(x) ^ hyperminhash.signature(y)
            far.append(sum(int(v).bit_count() if v >= 0 else int(v + 2**64).bit_count() for v in d.tolist()))
    assert abs(np.mean(est)) < 0.012
    if far:
        assert hits == 150 and max(far) <= hyperminhash.FAR_BITS


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 8), (8, 9), (9, 7), (3, 3)]
    links += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for e in links if e[0] != e[1] for x in e}
    assert got == components(nodes, [e for e in links if e[0] != e[1]])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op2_pairs_of_several_buckets_are_made_once(spark):
    """Of documents left in shared buckets each near pair is made once; a doc_id with two texts meets by either of them."""
    mark = lambda n: (n, *[0] * hyperminhash.SIGNATURE)
    schema = ("key long, id long, mark struct<n_shingles: long, " + ", ".join(f"s{i}: long" for i in range(hyperminhash.SIGNATURE))
              + ">, comp long, major long, n_major long")
    rows = [(k, i, mark(100), i, 1 if k < 6 else 9, 1 if k < 6 else 3) for k in range(8) for i in (1, 2, 3, 4)]
    # 6 has a text of another size in bucket 20, of this size in bucket 21; both buckets hold 5
    rows += [(20, 5, mark(100), 5, 9, 3), (21, 5, mark(100), 5, 9, 3), (20, 6, mark(900), 6, 9, 3), (21, 6, mark(100), 6, 9, 3)]
    got = [tuple(r) for r in hyperminhash._cross(spark.createDataFrame(rows, schema), 80).collect()]
    assert sorted(got) == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (5, 6)]


def vectors(n=120, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    for i in range(0, n - 6, 5):
        x[i + 1] = x[i] + rng.standard_normal(dim).astype(np.float32) * np.float32(0.02 + 0.6 * rng.random())
        x[i + 2] = x[i] * 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900 + i, x[7].tolist()) for i in range(20)] + [rows[3]]
    return rows + [(800, None), (801, [0.0] * dim), (802, []), (803, [float("nan")] * dim), (804, [1.0, None] * 8),
                   (805, [float("inf")] + [1.0] * (dim - 1)), (806, [1.0, 2.0]), (807, [2.0, 4.0]), (None, x[7].tolist())]


def check8(spark, tables, rows):
    usable = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v):
            usable[i] = np.array(v, np.float32).astype(np.float64)
    unit = {i: v / np.linalg.norm(v) for i, v in usable.items()}
    ids = list(unit)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    deg = {i: 0 for i in ids}
    for a, b in links:
        deg[a] += 1
        deg[b] += 1
    comp = components({i for i, _ in rows if i is not None}, links)
    got = Q["op8_embedding_dedup"][0](spark, tables(embeddings=rows)).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == sorted(
        (i is None, i or 0, deg.get(i, 0), comp.get(i, 0), i is not None and comp[i] == i) for i, _ in rows)


def test_op8_equals_brute_force(spark, tables, monkeypatch):
    monkeypatch.setattr(embed_dedup, "FILL", 10)   # several code bits on this small table
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)  # and buckets of several blocks
    monkeypatch.setattr(embed_dedup, "HOT", 20)
    check8(spark, tables, vectors())


def test_op8_keeps_doubles(spark):
    """Pairs that floats would put on the other side of the threshold, and components beyond their range."""
    c = 0.9
    rows = [(1, [1.0, 0.0]), (2, [c + 1e-10, (1 - (c + 1e-10) ** 2) ** 0.5]), (3, [-1.0, 0.0]),
            (4, [-(c - 1e-10), -(1 - (c - 1e-10) ** 2) ** 0.5]), (5, [0.0, 1e300]), (6, [0.0, -1e300]), (7, [1e-300, -1e300])]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, raw string, n int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), 4: (0, 4, True), 5: (0, 5, True),
                   6: (1, 6, True), 7: (1, 6, False)}


def test_op8_hot_group_and_copies(spark, tables, monkeypatch):
    """A third of the rows are near copies of one vector, many of them exact; one row is twice in the table."""
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    monkeypatch.setattr(embed_dedup, "HOT", 16)
    rng = np.random.default_rng(12)
    x = rng.standard_normal((180, 12)).astype(np.float32)
    x[:60] = x[0] + rng.standard_normal((60, 12)).astype(np.float32) * np.float32(0.05)
    x[20:40] = x[0]
    order = rng.permutation(180)
    rows = [(int(i), x[i].tolist()) for i in order]
    check8(spark, tables, rows + [rows[5]])


def test_op8_empty(spark, tables):
    assert Q["op8_embedding_dedup"][0](spark, tables(embeddings=[])).count() == 0


def test_rotated_codes_are_unbiased_within_their_bounds():
    rng, dim, width = np.random.default_rng(4), 32, 96
    y = rng.standard_normal((400, dim))
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    u = rng.standard_normal((400, dim))
    u -= (u * y).sum(1, keepdims=True) * y
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    x = 0.9 * y + np.sqrt(1 - 0.81) * u
    s, f = embed_dedup._code(y, width)
    back = (np.where(s, 1, -1) / np.sqrt(width)) @ embed_dedup.rotation(dim, width)
    est = (x * back).sum(1) / f
    sigma = np.sqrt(0.19) * np.sqrt((back * back).sum(1) - f * f) / f / np.sqrt(dim - 1)
    z = (est - 0.9) / sigma
    assert abs(est.mean() - 0.9) < 0.01 and 0.8 < z.std() < 1.2 and abs(z).max() < embed_dedup.SIGMAS
