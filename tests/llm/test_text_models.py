import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate as dc
from palimpsest.llm import langid, lm_scoring, toxicity


# -- decontamination ---------------------------------------------------------------


def words(n, draw):
    return ["".join(draw.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]


def brute_overlap(doc, item):
    """Words of ``item`` that agree with ``doc`` on any diagonal, in windows where enough do."""
    n = len(item)
    span, least = min(8, n), 6 if n >= 8 else n if n < 4 else n - 1
    covered = set()
    for begin in range(1 - n, len(doc)):
        same = [0 <= begin + k < len(doc) and doc[begin + k] == item[k] for k in range(n)]
        for k in range(n - span + 1):
            if sum(same[k : k + span]) >= least:
                covered |= {j for j in range(k, k + span) if same[j]}
    return len(covered)


def planted(seed, vocabulary):
    """Items of 1 to 60 words, and documents with a copy of one, some words of it replaced, at either end or inside."""
    draw = random.Random(seed)
    some = words(vocabulary, draw)
    items = [draw.choices(some, k=n) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 16, 18, 25, 40, 60)]
    docs = []
    for _ in range(220):
        leak = list(draw.choice(items))
        for _ in range(draw.choice([0, 0, 1, 1, 2, 3, len(leak) // 4])):
            leak[draw.randrange(len(leak))] = draw.choice(some)
        if draw.random() < 0.2:
            del leak[draw.randrange(len(leak))]
        body = draw.choices(some, k=draw.randint(0, 60))
        at = draw.choice([0, len(body), draw.randint(0, len(body))])
        docs.append(body[:at] + leak + body[at:])
    return items, docs


@pytest.mark.parametrize(("vocabulary", "block"), [(4000, None), (30, None), (4000, 0), (30, 0)])
def test_decontamination_against_brute_alignment(spark, monkeypatch, vocabulary, block):
    if block is not None:  # the way of a benchmark that is not held in memory
        monkeypatch.setattr(dc, "BLOCK", block)
    items, docs = planted(vocabulary, vocabulary)
    want = {}
    for d, w in enumerate(docs):
        for i, x in enumerate(items):
            m, n = brute_overlap(w, x), len(x)
            if m >= 12 or m >= 0.6 * n and m >= (n if n < 4 else 3 if n == 4 else 4):
                want[d, i] = m
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    table = spark.createDataFrame([(d, ". ".join(x.upper() for x in w)) for d, w in enumerate(docs)], "doc_id long, text string").repartition(3)
    assert len(want) > 100 and {(r.doc_id, r.item_id): r.matched_words for r in dc.overlaps(table, bench).collect()} == want
    assert {r.doc_id for r in dc.flag_contaminated(table, bench).filter("contaminated").collect()} == {d for d, _ in want}


def test_masks_ignore_any_words_that_may_differ():
    for n in range(4, 12):
        span, masks = dc.masks_of(n)
        for left in itertools.combinations(range(span), span - dc.agree(n)):
            assert any(not set(m) & set(left) for m in masks)


def test_repeated_words_take_bounded_memory():
    import tracemalloc

    h, owner = dc.Hasher()(["ha " * 8000])
    alternating, _ = dc.Hasher()(["ha ho " * 4000])
    tracemalloc.start()
    for doc, item in ((h, h[:800]), (alternating, alternating[:801])):
        assert dc.Benchmark([7], [item]).matches(doc, owner, 1) == [(0, 0, len(item))]
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    for a, b in ((np.arange(5), np.array([3, 9])), (np.arange(0, 900, 3), np.arange(1, 500, 2))):
        assert dc.differences(a, b).tolist() == sorted({x - y for x in a.tolist() for y in b.tolist()})


def test_decontamination_of_exact_passages(spark, sf_dir, docs, texts):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    norm = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    body = {d: norm(t) for d, t in texts.items()}
    want = {(d, r.item_id) for r in bench.collect() for d, b in body.items() if norm(r.text) in b}
    got = {(r.doc_id, r.item_id) for r in dc.overlaps(docs, bench).collect()}
    assert want and got == want


def test_a_benchmark_that_is_not_held_in_memory(spark, sf_dir, docs, monkeypatch):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = sorted(map(tuple, dc.overlaps(docs, bench).collect()))
    monkeypatch.setattr(dc, "BLOCK", 2000)
    monkeypatch.setattr(dc, "FILTER", 16)  # a filter that lets much through
    assert sorted(map(tuple, dc.overlaps(docs, bench).collect())) == whole
    flagged = {r.doc_id for r in dc.flag_contaminated(docs, bench).filter("contaminated").collect()}
    assert flagged == {r[0] for r in whole}


@pytest.mark.parametrize("block", [None, 0])
def test_decontamination_awkward(spark, awkward, nothing, monkeypatch, block):
    if block is not None:
        monkeypatch.setattr(dc, "BLOCK", block)
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "two words"), (None, "alpha beta gamma delta epsilon zeta eta theta"), (4, "alpha beta gamma delta epsilon zeta eta theta")], "item_id long, text string")
    rows = sorted((r.doc_id, r.item_id or 0, r.matched_words) for r in dc.overlaps(awkward, bench).collect())
    assert rows == [(1, 0, 8), (1, 0, 8), (1, 4, 8), (1, 4, 8)]
    assert dc.overlaps(nothing, bench).count() == 0 and dc.overlaps(awkward, bench.filter("false")).count() == 0
    flagged = dc.flag_contaminated(awkward, bench)
    assert flagged.columns == [*awkward.columns, "contaminated"] and flagged.count() == awkward.count()
    again = dc.flag_contaminated(awkward, bench, "score")
    assert sorted(again.columns) == sorted(awkward.columns) and again.filter("score").count() == 2


# -- toxicity ----------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


TERMS = [("idiot", "seed", 1), ("loser", "seed", 1), ("worthless", "seed", 2), ("scum", "seed", 0), ("bad", "word", 0), ("terrib", "word", 1), ("abcd", "stem", 0), ("zzyxwo", "stem", 1), ("achkeite", "stem", 2)]


def brute_find(w, terms=TERMS):
    """(term number, edits) by edit distances; a stem is held against all beginnings but the whole word."""
    found = []
    for n, (t, kind, most) in enumerate(terms):
        d = min((distance(w[:k], t) for k in range(len(w))), default=99) if kind == "stem" else distance(w, t)
        found += [(d, n)] * (d <= most)
    return min(found)[::-1] if found else None


def tried(draw, n):
    out = ["closer", "abcd", "abcde", "zzyxwo", "zzyxwoa", "bad", "bade", "", "achkeitea", "achketa", "achkeitt", "x" * 70 + "idiot", "achkeite" + "y" * 90]
    for _ in range(n):
        w = list(draw.choice([t for t, *_ in TERMS] + ["closer", "these"])) + [draw.choice("aeiost")] * draw.randint(0, 2)
        for _ in range(draw.randint(0, 4)):
            k = draw.randrange(len(w) + 1)
            w[k : k + draw.randint(0, 1)] = [draw.choice("abcdeiklostuwxyz")] * draw.randint(0, 1)
        out.append("".join(w))
    return out


def test_automaton_against_edit_distance():
    lex = toxicity.Lexicon(TERMS)
    for w in tried(random.Random(2), 5000):
        assert lex.find(w) == brute_find(w), w
    assert lex.find("achketa") and lex.find("achkeitt") and not lex.find("closers")


def brute_features(text, forms):
    """Of the text's hits, found by edit distances, word by word."""
    low = (text or "").lower()
    spans = [m.span() for m in re.finditer(r"\w+", low)]
    sums, best = dict.fromkeys(("abuse", "quoted", "addressed"), 0.0), {"seed": 0.0, "learned": 0.0}
    for k, (a, z) in enumerate(spans):
        hit = brute_find(low[a:z])
        s = 0.0 if hit is None else (1.0, 0.85, 0.7)[hit[1]] * (forms.get(low[a:z], 1.0) if hit[1] else 1.0)
        if not s:
            continue
        near = {low[b:e] for b, e in spans[max(0, k - 6) : k + 7]}
        line = lambda t, part: t.split("\n")[part]
        marks = set('"“”„«»')
        quoted = bool(marks & set(line(low[max(0, a - 60) : a], -1)) and marks & set(line(low[z : z + 60], 0))) or bool(near & toxicity.SAYING)
        sums["quoted" if quoted else "abuse"] += s
        if not quoted:
            kind = "seed" if TERMS[hit[0]][1] == "seed" else "learned"
            best[kind] = max(best[kind], s)
        sums["addressed"] += s * bool(near & toxicity.ADDRESS)
    total = sums["abuse"] + sums["quoted"]
    return [best["seed"], best["learned"], *(float(np.log1p(sums[k])) for k in ("abuse", "quoted", "addressed")), 10 * (total / max(1, len(spans))) ** 0.5 if total else 0.0]


def test_features_against_brute_force():
    draw, forms = random.Random(8), {"closer": 0.0, "idoit": 0.6, "looser": 0.5}
    pool = tried(draw, 300) + ["said", "you", "the", "and", "closer", "looser", '"', "«", "»", "\n", "wrote", "du"]
    lex = toxicity.Lexicon(TERMS, forms)
    for _ in range(150):
        text = " ".join(draw.choices(pool, k=draw.randint(0, 40)))
        assert toxicity.features(text, lex, {}) == pytest.approx(brute_features(text, forms)), text
    assert toxicity.features(None, lex, {}) == toxicity.features("", lex, {}) == [0.0] * 6


def test_context_separates_quotation_from_abuse():
    lex = toxicity.Lexicon([(t, "seed", toxicity.edits(t)) for t in toxicity.SEED])
    f, g = (dict(zip(toxicity.FEATURES, toxicity.features(t, lex, {}))) for t in ('She said the word "idiot" twice.', "you are a looser"))
    assert f["quoted"] > 0 and f["abuse"] == f["seed"] == 0 and g["abuse"] > 0 and g["addressed"] > 0 and g["seed"] == toxicity.STRENGTH[1]


def test_evidence_silences_forms_and_edits_but_not_by_one_document():
    terms = [("loser", "seed", 1), ("pathetic", "seed", 2), ("abcdefgh", "stem", 2)]
    seen = [(0, 1, "closer", 0, 9), (1, 2, "atheti", 0, 1), (1, 1, "pathetc", 3, 0), (2, 2, "abxxefghi", 0, 1), (2, 2, "abyyefghi", 0, 1), (2, 2, "abzzefghi", 0, 1)]
    got, forms = toxicity.evidence(terms, seen, 100, 800)
    assert got == [terms[0], terms[1], ("abcdefgh", "stem", 1)] and forms["closer"] == 0 and forms["atheti"] == 0.5 and "pathetc" not in forms


def test_edits_carry_misspelled_abuse(spark):
    """Held-out toxic texts, every hit in them misspelled by one or two letters: found with edits, missed without."""
    base = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    sample = toxicity.sample(docs, labels, toxicity.held_out, 8000)
    held = docs.join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).select("doc_id", "text", "toxic").toPandas()
    draw, recall, clear = random.Random(3), {}, {}
    changed = {}
    for most in (2, 0):
        model = toxicity.train(sample, most)
        lex = toxicity.Lexicon(*model.lexicon)
        if most:
            exact = {t for t, kind, _ in model.lexicon[0] if kind != "stem"}
            stems = tuple(t for t, kind, _ in model.lexicon[0] if kind == "stem")

            def misspell(m):
                w = m[0]
                low = w.lower()
                term = low if low in exact else next((t for t in stems if low.startswith(t)), None)
                if not term:
                    return w
                for _ in range(toxicity.edits(term)):
                    k = draw.randrange(1, len(term) - 1)
                    w = w[:k] + draw.choice(["", w[k] * 2, "x"]) + w[k + 1 :]
                return w

            changed = {r.doc_id: re.sub(r"\w+", misspell, r.text) for r in held.itertuples() if r.toxic == 1}
            fuzzy = sum(1 for t in docs.select("text").toPandas()["text"] if t for e in [h[1] for h in toxicity.hits_of(set(re.findall(r"\w+", t.lower())), lex, {}).values()] if e)
            assert fuzzy > 50  # misspelled hits among all documents
        table = spark.createDataFrame(list(changed.items()), "doc_id long, text string")
        recall[most] = toxicity.score(table, model).filter("score >= 0.5").count() / len(changed)
        clean = spark.createDataFrame([(r.doc_id, r.text) for r in held.itertuples() if r.toxic == 0], "doc_id long, text string")
        clear[most] = toxicity.score(clean, model).filter("score < 0.5").count() / clean.count()
    print("recall of misspelled toxic texts, with and without edits:", recall, "clean texts left alone:", clear)
    assert recall[2] > recall[0] + 0.2 and recall[2] > 0.6 and clear[2] > 0.99


def test_toxicity_of_held_out_rows(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxic_documents(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(toxic[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in toxic]
    assert np.mean([a == b for a, b in held]) > 0.93
    # Labels of held-out rows never matter.
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.toxic_documents(docs, other).collect()} == {r.doc_id: r.score for r in rows}


def test_misspelled_abuse_is_caught(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(toxicity.sample(docs, labels, toxicity.held_out, 8000))
    text = "you idoit the of anre thion pathetc loosers in the onre worthles moronn"
    got = toxicity.score(spark.createDataFrame([(1, text), (2, "the of anre thion in the onre")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert got[0].score > 0.5 > got[1].score


def test_toxicity_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, 0), (3, None), (7, 0)], "doc_id long, toxic int")
    rows = toxicity.toxic_documents(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxic_documents(awkward, labels.filter("false")).count() == awkward.count()
    assert toxicity.toxic_documents(nothing, labels).count() == 0


# -- languages ---------------------------------------------------------------------


def brute_grams(text):
    s = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    return {s[i : i + n] for n in langid.ORDERS for i in range(len(s) - n + 1)}


def test_presence_kernel_against_sets():
    a, b = "The quick; brown fox, 12 times!", "Über den Fluß — the brown Ähre"
    rows = langid.presence([a, b, "12 !?", None, ""])
    assert rows[0].sum() == len(brute_grams(a)) and rows[0] @ rows[1] == len(brute_grams(a) & brute_grams(b)) and not rows[2:].any()


def test_scoring_is_the_kernel_ridge_prediction():
    draw = random.Random(4)
    texts = ["".join(draw.choice("abcdef " if i % 2 else "defghi ") for _ in range(60)) + " x" for i in range(40)]
    model = langid.fit(texts, ["odd" if i % 2 else "even" for i in range(40)], landmarks=12)
    assert [n == ("odd" if i % 2 else "even") for i, n in enumerate(model.predict(texts)[0])].count(True) >= 38
    assert model.predict([None, "", "123 !!"]) == (["und"] * 3, [0.0] * 3)


def test_decisions_against_kernel_ridge_by_hand():
    """Every text a landmark: presence kernels of sets, their inverse root as the map, weighted ridge regression with an intercept."""
    draw = random.Random(7)
    texts = ["".join(draw.choice("abc " if i % 3 else "bcé ") for _ in range(25)) + " x" for i in range(24)]
    langs = ["en" if i % 3 else "de" for i in range(24)]
    asked = texts[:5] + ["".join(draw.choice("abcé ") for _ in range(40)) + "x" for _ in range(20)]
    grams = [brute_grams(t) for t in texts]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    value, vector = np.linalg.eigh([[kernel(a, b) for b in grams] for a in grams])
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    mapped = lambda found: np.column_stack([np.array([[kernel(a, b) for b in grams] for a in found]) @ root, np.ones(len(found))])
    x, y = mapped(grams), np.array([[lang == n for n in ("de", "en")] for lang in langs], float)
    weight = np.array([1 / langs.count(lang) for lang in langs])
    w = np.linalg.solve(x.T @ (x * weight[:, None]) + 1e-2 * np.eye(x.shape[1]), x.T @ (y * weight[:, None]))
    model = langid.fit(texts, langs, landmarks=1000, ridge=1e-2)
    assert model.languages == ["de", "en"]
    assert model.decide(asked)[0] == pytest.approx(mapped([brute_grams(t) for t in asked]) @ w, abs=2e-3)


def test_every_language_is_learned(spark):
    rows = [(k, chr(97 + k % 26) * 3 + chr(97 + k // 26) * 3, f"l{k:03d}") for k in range(400)]
    rows += [(1000 + k, t, lang) for k, t, lang in rows] + [(2000 + k, t, lang) for k, t, lang in rows]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) > 390


def test_identify_keeps_other_columns(spark, awkward):
    model = langid.fit(["the of and", "der die das"] * 4, ["en", "de"] * 4)
    got = langid.identify(awkward, model)
    assert sorted(got.columns) == sorted({*awkward.columns, "lang_pred", "score"}) and {r.found for r in got.collect()} == {"clash"}


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.languages(docs).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in rows if r.held_out]) > 0.97


def test_languages_awkward(spark, awkward, nothing):
    rows = langid.languages(awkward).collect()
    assert len(rows) == awkward.count()
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3, 4, 6)} == {"und"}
    unlabelled = awkward.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.languages(unlabelled).collect()} == {"und"}
    assert langid.languages(nothing).count() == 0


# -- cross-entropy difference ------------------------------------------------------


def brute_losses(texts, targets, classes):
    """{doc: (words, target loss, background loss)} by the definition, every document scored by models without it, and the
    sums of probabilities of all words of the vocabulary and an unknown one after each context seen."""
    body = {d: re.findall(r"[0-9A-Za-zé]+|[^0-9A-Za-zé\s]+", t or "") for d, t in texts.items()}
    everything = collections.Counter(w for b in body.values() for w in b)
    number = lambda w: int(lm_scoring.Hasher(marks=True)([w])[0].view(np.int64)[0])
    own_class = sorted(everything, key=lambda w: (-everything[w], number(w)))[:classes]
    of = lambda w: w if w in own_class else "*"
    size, sums = len(everything), []
    matched = sum(len(body[d]) for d in body if d in targets) / max(1, sum(map(len, body.values())))
    out = {}
    for d in body:
        found = []
        for scale, members in ((1.0, [x for x in body if x in targets and x != d]), (matched, [x for x in body if x != d])):
            words = collections.Counter(w for x in members for w in body[x])
            pairs = collections.Counter(p for x in members for p in zip(["<", *map(of, body[x])], map(of, body[x])))
            kind, after = collections.Counter(), collections.Counter()
            for w, n in words.items():
                kind[of(w)] += n
            for (a, _), n in pairs.items():
                after[a] += n
            total = sum(words.values())
            each = 0.5  # added to the count of every word of the vocabulary and of the unknown word
            shares = dict.fromkeys(own_class, each) | {"*": (size + 1 - len(own_class)) * each}

            def p(w, before):
                c = of(w)
                share = (kind[c] * scale + shares[c]) / (total * scale + each * (size + 1))
                chance = (pairs[before, c] * scale + 4 * share) / (after[before] * scale + 4)
                return chance * (1 if c != "*" else (words[w] * scale + each) / (kind["*"] * scale + shares["*"]))

            found.append(-sum(np.log(p(w, a)) for w, a in zip(body[d], ["<", *map(of, body[d])])) / max(1, len(body[d])))
            sums += [sum(p(w, a) for w in [*everything, "never seen"]) for a in ("<", "*", *own_class[:2])]
        out[d] = (len(body[d]), *found)
    return out, sums


@pytest.mark.parametrize(("classes", "head"), [(5, 12), (300, 1 << 18), (0, 0)])
def test_cross_entropy_difference_against_brute_force(spark, monkeypatch, classes, head):
    monkeypatch.setattr(lm_scoring, "CLASSES", classes)
    monkeypatch.setattr(lm_scoring, "HEAD", head)
    monkeypatch.setattr(lm_scoring, "SPAN", 300)
    draw = random.Random(5)
    pools = [["".join(draw.choice("abcdé,;" if k else "xyzé0;") for _ in range(draw.randint(1, 3))) for _ in range(40)] for k in (0, 1)]
    texts = {d: " ".join(draw.choices(pools[d % 2], range(40, 0, -1), k=draw.randint(0, 60))) for d in range(30)}
    texts |= {30: None, 31: "", 32: texts[2], 33: "only here,; Once..."}
    targets = {d for d in texts if d % 2}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    rows = lm_scoring.score(df, spark.createDataFrame([(d,) for d in targets] + [(1,), (None,)], "doc_id long")).collect()
    in_head = classes if head >= 1 << 18 else min(classes, head)
    want, sums = brute_losses(texts, targets, in_head)
    assert np.allclose(sums, 1.0)
    if classes != 5:  # bands of frequency may hold fewer words than HEAD: then fewer are a class
        for r in rows:
            n, t, b = want[r.doc_id]
            assert r.n_tokens == n and r.target_loss == pytest.approx(t, abs=1e-9) and r.background_loss == pytest.approx(b, abs=1e-9)
    assert all(r.score == pytest.approx(r.background_loss - r.target_loss) for r in rows)
    assert np.mean([(r.score > 0) == (r.doc_id in targets) for r in rows if r.n_tokens > 20]) == 1


def test_any_number_of_frequent_words_gives_the_same_scores(spark, docs, sf_dir, monkeypatch):
    targets = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    monkeypatch.setattr(lm_scoring, "CLASSES", 20)
    whole = {r.doc_id: r.score for r in lm_scoring.score(docs, targets).collect()}
    monkeypatch.setattr(lm_scoring, "HEAD", 60)
    monkeypatch.setattr(lm_scoring, "TARGETS", 0)
    some = {r.doc_id: r.score for r in lm_scoring.score(docs, targets).collect()}
    assert some == pytest.approx(whole) and len(some) == docs.count()


def test_scores_tell_targets_from_others(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    # Half of the target documents are held out of the model.
    seen = labels.filter("quality = 1 and crc32(cast(doc_id as string)) % 2 = 0").select("doc_id")
    got = lm_scoring.score(docs, seen).join(labels, "doc_id").filter("crc32(cast(doc_id as string)) % 2 = 1").select("score", "quality").toPandas().sort_values("score")
    rank = np.arange(1, len(got) + 1)
    good = (got["quality"] == 1).to_numpy()
    area = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    print("area under the curve on held-out documents:", area)
    assert area > 0.95


def test_cross_entropy_awkward(spark, awkward, nothing):
    targets = spark.createDataFrame([(1,), (1,), (None,), (99,)], "doc_id long")
    rows = lm_scoring.score(awkward, targets).collect()
    assert len(rows) == awkward.count() and all(np.isfinite(r.score) for r in rows)
    assert {(r.n_tokens, r.score) for r in rows if r.doc_id in (2, 3)} == {(0, 0.0)}
    assert lm_scoring.score(awkward, targets.filter("false")).count() == awkward.count()
    assert lm_scoring.score(nothing, targets).count() == 0
