import collections
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import edit_embedding as ee
from palimpsest.llm import simhash


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fp):
    """fp: {node: fingerprint}; the smallest node reachable by 3 or fewer differing bits."""
    nodes, parent = sorted(fp), {n: n for n in fp}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if bin(fp[a] ^ fp[b]).count("1") <= 3:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {n: find(n) for n in nodes}


def test_simhash_against_brute_force(docs, texts):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fp = {d: brute_fingerprint(t) for d, t in texts.items()}
    comp = brute_components(fp)
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (f"{fp[d]:016x}", comp[d]) for d in texts}


@pytest.mark.parametrize("hot,small", [(4096, 24), (16, 4)])
def test_links_of_dense_groups(spark, monkeypatch, hot, small):
    """Fingerprints a few bits from each other: chains, stars and unlinked neighbours; also with cells dealt out in chunks."""
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "SMALL", small)
    draw = random.Random(3)
    fp = set()
    for _ in range(4):
        base = draw.getrandbits(64)
        fp.add(base)
        for _ in range(60):
            x = draw.choice(sorted(fp)[-20:])
            for _ in range(draw.randint(1, 6)):
                x ^= 1 << draw.randrange(64)
            fp.add(x)
    fp |= {0, 1, 7, 15, (1 << 64) - 1, (1 << 64) - 8}
    signed = [x - (1 << 64) if x >> 63 else x for x in fp]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    label = {r.node: r.label for r in simhash.components(edges).collect()}
    want = brute_components({s: s & ((1 << 64) - 1) for s in signed})
    assert {s: label.get(s, s) for s in signed} == want


def test_manhattan_distance_bounds_hamming_distance():
    draw = random.Random(4)
    for _ in range(500):
        a = draw.getrandbits(64)
        b = a
        for _ in range(draw.randint(0, 10)):
            b ^= 1 << draw.randrange(64)
        count = lambda x: [bin(x >> 2 * s & 3).count("1") for s in range(32)]
        assert sum(abs(x - y) for x, y in zip(count(a), count(b))) <= bin(a ^ b).count("1")


@pytest.mark.parametrize("together", [500_000, 40])
def test_components(spark, together):
    """A long chain, and random graphs, in one part and in several."""
    chain = [(i + 1, i) for i in range(150)]
    draw = random.Random(8)
    loose = [(1000 + draw.randrange(200), 1000 + draw.randrange(200)) for _ in range(120)]
    edges = spark.createDataFrame(chain + loose, "a long, b long")
    parent = {x: x for e in chain + loose for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in chain + loose:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.label for r in simhash.components(edges, together).collect()}
    assert {x: got.get(x, x) for x in parent} == {x: find(x) for x in parent}
    assert simhash.components(edges.filter("false"), together).count() == 0


def test_simhash_awkward(awkward, nothing):
    got = collections.defaultdict(set)
    for r in simhash.near_duplicates(awkward).collect():
        got[r.doc_id].add((r.fingerprint, r.component_id))
    zero = "0" * 16
    assert got[2] == got[3] == got[4] == {(zero, 2)} and len(got[1]) == 1 and next(iter(got[1]))[1] == 1
    assert (zero, 2) in got[None]
    assert simhash.near_duplicates(nothing).count() == 0


def brute_classes(ids, links):
    low = {d: d for d in ids}
    root = lambda d: d if low[d] == d else root(low[d])
    for a, b in links:
        p, q = root(a), root(b)
        low[max(p, q)] = min(p, q)
    return {d: root(d) for d in ids}


def test_edit_embedding_rows(docs, texts):
    import hashlib

    got = {r.doc_id: r for r in ee.fingerprint(docs).collect()}
    ids = sorted(texts)
    assert sorted(got) == ids
    bits, steps = ee.walk_bits(), ee.sampled_steps()
    alone = dict(zip(ids, ee.fingerprints([texts[d] for d in ids], bits, steps)))
    for d, after in zip(ids, ids[1:] + ids[:1]):
        e = ee.edited(texts[d], texts[after])
        r = got[d]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(texts[d]), hashlib.sha256(e.encode()).hexdigest(), alone[d].hex())
        assert r.near_next == pytest.approx(ee.likeness(alone[d], alone[after]))
        shared = set(ee.band_keys(alone[d])) & set(ee.band_keys(alone[after]))
        assert r.bands_next == len(shared) and (texts[d] != texts[after] or r.bands_next >= ee.BANDS)
    links = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if ee.likeness(alone[a], alone[b]) >= 0.8}
    low = brute_classes(ids, links)
    assert any(low[d] != d for d in ids) and {d: r.class_id for d, r in got.items()} == low
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.97
    assert np.mean([r.bands_edited for r in got.values()]) > 1 > np.mean([r.bands_next for r in got.values()])


def test_edits_change_little_and_strangers_are_far():
    draw = random.Random(5)
    bits, steps = ee.walk_bits(), ee.sampled_steps()
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(3000))
    near, far = [], []
    for _ in range(20):
        a = word()
        b = list(a)
        for _ in range(6):
            k = draw.randrange(len(b))
            b[k : k + draw.randint(0, 1)] = [draw.choice("xyz")] * draw.randint(0, 1)
        fa, fb, fc = ee.fingerprints([a, "".join(b), word()], bits, steps)
        near.append(ee.likeness(fa, fb))
        far.append(ee.likeness(fa, fc))
    assert min(near) > max(far) and np.mean(near) > 0.8 and np.mean(far) < 0.1


def test_walks_don_t_depend_on_their_company():
    bits, steps = ee.walk_bits(), ee.sampled_steps()
    a = ["", "a", "ab" * 500, "日本" * 30, "x" * 20_000]
    together = ee.fingerprints(a, bits, steps)
    assert together == [ee.fingerprints([t], bits, steps)[0] for t in a] and together[0] == b""


@pytest.mark.parametrize("hot", [2048, 8])
def test_near_pairs_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(ee, "HOT", hot)
    draw = random.Random(6)
    bits, steps = ee.walk_bits(), ee.sampled_steps()
    texts = []
    for _ in range(8):
        base = "".join(draw.choice("abcdefgh ") for _ in range(draw.randint(300, 1500)))
        for _ in range(6):
            k = draw.randrange(len(base))
            texts.append(base[:k] + draw.choice("abc") + base[k + 1 :])
    raw = ee.fingerprints(texts, bits, steps)
    prints = sorted({f.hex() for f in raw})
    classes = {p: p for p in prints}

    def find(x):
        while classes[x] != x:
            x = classes[x]
        return x

    for r in ee.near_pairs(spark.createDataFrame([(f.hex(),) for f in raw], "fingerprint string"), 0.8).collect():
        assert ee.likeness(bytes.fromhex(r.a), bytes.fromhex(r.b)) == pytest.approx(r.likeness) and r.likeness >= 0.8
        classes[find(r.a)] = find(r.b)
    wanted = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if ee.likeness(bytes.fromhex(a), bytes.fromhex(b)) >= 0.8]
    assert wanted and np.mean([find(a) == find(b) for a, b in wanted]) >= 0.95


def test_recall_of_single_pairs_at_the_threshold():
    """Pairs of a likeness of 0.8 to 0.85, of texts of all lengths: the share that meets in a bucket."""
    draw, bits, steps = random.Random(12), ee.walk_bits(), ee.sampled_steps()
    found, at, texts = [], [], []
    for _ in range(2500):
        n = int(8 * 1.9 ** draw.uniform(0, 10))
        a = [draw.choice("eeetaoinshr dlu  ") for _ in range(n)]
        b = list(a)
        for _ in range(draw.randint(1, max(1, n // 80))):
            k = draw.randrange(len(b))
            b[k : k + draw.randint(0, 1)] = [draw.choice("xyz")] * draw.randint(0, 1)
        texts += ["".join(a), "".join(b)]
    prints = ee.fingerprints(texts, bits, steps)
    for x, y in zip(prints[::2], prints[1::2]):
        if x != y and 0.8 <= (v := ee.likeness(x, y)) <= 0.85:
            found.append(bool(set(ee.band_keys(x)) & set(ee.band_keys(y))))
            at.append(v)
    print("pairs:", len(found), "mean likeness:", np.mean(at), "recall:", np.mean(found))
    assert len(found) > 100 and np.mean(found) > 0.95


def test_many_ranges_within_one_doc_id(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(ee, "RANGE", 20_000)
    whole = {r.doc_id: tuple(r) for r in ee.fingerprint(docs).collect()}
    assert len(whole) == len(texts)
    rows = ee.fingerprint(docs.withColumn("doc_id", F.when(F.col("doc_id") > 150, F.col("doc_id")))).collect()
    assert len(rows) == len(texts) and sorted(r.fingerprint for r in rows) == sorted(r[3] for r in whole.values())
    ids = sorted(d for d in texts if d > 150)
    assert all(tuple(next(r for r in rows if r.doc_id == d))[1:9] == whole[d][1:9] for d in ids[:-1])
    follows = collections.Counter(r.edited_sha256 for r in rows)
    assert max(follows.values()) < 5


def test_edit_embedding_awkward(spark, awkward, nothing):
    rows = ee.fingerprint(awkward).collect()
    assert len(rows) == awkward.count() and {r.doc_id for r in rows} == {None, *range(1, 10)}
    assert len({r.fingerprint for r in rows if r.doc_id == 1}) == 1
    assert ee.fingerprint(nothing).count() == 0
    one = ee.fingerprint(spark.createDataFrame([(4, "abcd")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.n_chars == 4
