import random
from fractions import Fraction

import pytest

import corpus_pipeline
from palimpsest.llm import near_copies, simhash


def brute_components(texts):
    """The smallest id that each text reaches through pairs of five-word Jaccard similarity 0.8 or more."""
    sets, low = {}, {d: d for d in texts}
    for d, t in texts.items():
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def root(d):
        while low[d] != d:
            d = low[d]
        return d

    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and min(len(x), len(y)) * 5 >= max(len(x), len(y)) * 4:
                common = len(x & y)
                if 5 * common >= 4 * (len(x) + len(y) - common):
                    p, q = root(a), root(b)
                    low[max(p, q)] = min(p, q)
    return {d: root(d) for d in texts}


def edited(words, n, draw):
    words = list(words)
    for _ in range(n):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
    return " ".join(words)


def made(seed):
    """Groups of near copies on both sides of the threshold, one line common to all, short and wordless texts."""
    draw = random.Random(seed)
    line, out = "a line that very many of these texts have in common", ["", " ", "one two", "one two", "One two three four", "one two three four five"]
    for g in range(6):
        base = [f"w{draw.randrange(500)}" for _ in range(draw.choice([30, 80, 200]))]
        out += [edited(base, draw.randint(0, 6), draw) + (f" {line}" if g % 2 else "") for _ in range(15)]
    draw.shuffle(out)
    return dict(enumerate(out))


@pytest.mark.parametrize("sampled", [(20_000, 20_000), (0, 0)])
def test_components_of_near_copies_against_all_pairs(spark, monkeypatch, sampled):
    monkeypatch.setattr(near_copies, "SAMPLED", sampled)  # the order of the shingles decides no link
    texts = made(3)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(df).collect()}
    again = simhash.near_duplicates(df, words=5, like=Fraction(4, 5)).collect()
    assert {r.doc_id: r.component_id for r in again} == got == brute_components(texts) and len(texts) / 4 < len(set(got.values())) < len(texts) - 10


def test_other_widths_and_similarities_against_all_pairs(spark):
    texts = {k: t for k, t in made(5).items() if k % 2}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = {d: set(zip(w, w[1:])) if len(w := t.lower().split()) > 1 else {tuple(w)} if w else set() for d, t in texts.items()}
    low = {d: d for d in texts}
    root = lambda d: d if low[d] == d else root(low[d])
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and 2 * len(x & y) >= len(x | y):
                p, q = root(a), root(b)
                low[max(p, q)] = min(p, q)
    got = near_copies.near_copies(df, words=2, like=Fraction(1, 2)).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: root(d) for d in texts}


def test_stage_drops_near_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, None).select("doc_id").collect()]
    assert len(kept) == len(set(kept)) and set(kept) == set(brute_components(texts).values())
