import random
import re

import numpy as np
import xxhash

from noticelake.llm import simhash


def brute_fingerprint(text, n):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    parts = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps, ids, bits):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for k, i in enumerate(ids):
        r = find(k)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [least.get(find(k)) for k in range(len(fps))]


def test_fingerprint_of_pieces(monkeypatch):
    rng = random.Random(1)
    texts = [None, "", " \t\n", "One", "a B c", "a b c d", "é É a b c\x0bd\x0c e"]
    texts += [" ".join(rng.choice(["Ab", "c", "ß", "xyz"]) for _ in range(300))]
    monkeypatch.setattr(simhash, "PIECE", 16)
    for n in (1, 4, 5):
        for t in texts:
            assert simhash.fingerprint(None if t is None else t.encode(), n) == brute_fingerprint(t, n)


def test_trie_join_equals_all_pairs():
    rng = np.random.default_rng(3)
    for budget in (0, 2, 4, 9):
        base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
        keys = np.concatenate([base] + [base ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(c)) for b, c in rng.integers(0, 63, (20, 2))])
        groups = rng.integers(0, 3, len(keys))
        order = np.lexsort((keys, groups))
        keys, groups = keys[order], groups[order]
        found = {(int(a), int(b)) for i, j in simhash.close_pairs(keys, groups, budget, leaf=2, width=8) for a, b in zip(i, j, strict=True)}
        want = {(a, b) for b in range(len(keys)) for a in range(b) if groups[a] == groups[b] and int(keys[a] ^ keys[b]).bit_count() <= budget}
        assert found == want


def test_blocks_find_every_pair_within_budget():
    rng = random.Random(5)
    for distinct in (10, 10**7, 10**10):
        agree, masks = simhash.blocks(distinct, 4)
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 4):
                b ^= 1 << bit
            assert any((a & m) == (b & m) for m in masks)


def test_components(spark):
    rng = random.Random(2)
    words = ["w%d" % k for k in range(50)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(120))) for k in range(30)]
    rows += [(100 + k, rows[k][1] + " tail") for k in range(10)] + [(7, rows[7][1]), (7, rows[7][1])]
    rows += [(300, None), (301, ""), (302, " "), (None, rows[3][1]), (None, "only here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "'x' AS id")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.components(docs, n=4, max_bits=4, mins=0).collect()), key=str)
    fps = [brute_fingerprint(t, 4) for _, t in rows]
    roots = brute_groups(fps, [i for i, _ in rows], 4)
    assert got == sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, roots, strict=True)), key=str)
    assert simhash.components(docs.limit(0), n=4, max_bits=4, mins=0).count() == 0


def test_large_shards_are_dealt_by_node_pairs_and_chunks(spark):
    rng = random.Random(4)
    base = rng.getrandbits(63)
    fps = {base ^ (1 << a) ^ (1 << b) for a in range(0, 40, 3) for b in range(a)}
    fps |= {base ^ sum(1 << b for b in rng.sample(range(63), 9)) for _ in range(60)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = brute_groups(fps, fps, 4)
    for limit in (8192, 64, 16):
        edges = {r.node: r.root for r in simhash.connected(simhash.links(nodes, 4, shard_limit=limit)).collect()}
        assert [edges.get(f, f) for f in fps] == want


def test_node_pairs_hold_every_pair_within_budget(spark):
    rng = random.Random(8)
    mask = ((1 << 13) - 1) << 40
    fps = [rng.getrandbits(63) & ~mask for _ in range(60)]
    fps += [f ^ sum(1 << b for b in rng.sample([x for x in range(63) if not mask >> x & 1], 3)) for f in fps]
    rows = spark.createDataFrame([(f, 0, 0, 6) for f in fps], "fp long, trie int, key long, levels int")
    met = {}
    for r in simhash.node_pairs(rows, [mask], 4).collect():
        met.setdefault((r.low, r.high), set()).add(r.fp)
    together = {(a, b) for found in met.values() for a in found for b in found}
    assert all((a, b) in together for a in fps for b in fps if (a ^ b).bit_count() <= 4)
    assert all((low ^ high).bit_count() <= 4 for low, high in met)


def test_the_walk_drops_pairs_of_the_tables_own_shards(monkeypatch):
    rng = np.random.default_rng(5)  # as many fingerprints as a shard of 95,000 texts has
    keys = np.sort(rng.integers(0, 1 << 51, 13 * 500, dtype=np.uint64))
    groups = np.repeat(np.arange(500), 13)
    order = np.lexsort((keys, groups))
    seen = []
    compare = simhash._compare
    monkeypatch.setattr(simhash, "_compare", lambda k, a0, a1, b0, b1, *x: seen.append(int(((a1 - a0) * (b1 - b0)).sum())) or compare(k, a0, a1, b0, b1, *x))
    assert list(simhash.close_pairs(keys[order], groups, 4)) == []
    assert sum(seen) < 0.8 * 500 * 13 * 13


def test_near_copies_by_shared_least_hashes(spark):
    rng = random.Random(9)
    words = ["w%d" % k for k in range(500)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(200))) for k in range(40)]
    rows += [(1000 + k, t.replace(" ", "  ", 3) + " end") for k, t in rows[:20]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.components(docs).collect()}
    assert all(got[1000 + k] == k for k in range(20)) and all(got[k] == k for k in range(40))


def brute_alike(sets, cosine=False):
    near = lambda a, b: 25 * len(a & b) ** 2 >= 16 * len(a) * len(b) if cosine else 5 * len(a & b) >= 4 * len(a | b)
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if near(sets[i], sets[j])]
    label = list(range(len(sets)))
    for _ in sets:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    return label


def test_alike_joins_what_all_pairs_join():
    rng = random.Random(6)
    for _ in range(60):
        sets = []
        for _ in range(rng.randint(2, 40)):
            one = set(rng.choice(sets)) if sets and rng.random() < 0.8 else set(rng.sample(range(5000), rng.randint(1, 60)))
            for _ in range(rng.randint(0, 5)):
                one ^= {rng.randrange(5000)}
            sets.append(one or {1})
        for cosine in (False, True):
            for pairs in (None, np.ones((len(sets), len(sets)), bool)):
                forest = simhash.alike([np.array(sorted(s), np.uint64) for s in sets], pairs=pairs, cosine=cosine)
                label = np.arange(len(sets))
                simhash.merge(label, *np.array(forest or [(0, 0)]).T)
                assert label.tolist() == brute_alike(sets, cosine) and len(forest) == len(sets) - len(set(label.tolist()))


def test_near_copies_are_those_of_four_fifths_and_no_others(spark, monkeypatch):
    rng = random.Random(12)
    rows = []
    for k in range(60):  # one changed run of words in each of many texts, so shares lie on both sides of 0.8
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        rows.append((k, " ".join(words)))
        at, size = 30, 1 + k % 24
        words[at : at + size] = [f"x{rng.randrange(10**6)}" for _ in range(size)]
        rows.append((1000 + k, " ".join(words)))
    rows += [(5000, None), (5001, " "), (5002, rows[0][1].upper()), (5002, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [{p for part in simhash.shingles((t or "").encode(), 5) for p in part} for _, t in rows]
    for mass, cosine in ((simhash.MASS, False), (50, False), (simhash.MASS, True)):
        label = brute_alike([s or {b""} for s in sets], cosine)
        least = {}
        for (i, _), g in zip(rows, label, strict=True):
            least[g] = min(least.get(g, i), i)
        want = sorted((i, least[g]) for (i, _), g in zip(rows, label, strict=True))
        assert 20 < sum(1 for k in range(60) if least[label[2 * k + 1]] == k) < 60
        monkeypatch.setattr(simhash, "MASS", mass)
        assert sorted((r.doc_id, r.component_id) for r in simhash.components(docs, cosine=cosine).collect()) == want
