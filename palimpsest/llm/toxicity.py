"""Toxicity: a lexicon found by Levenshtein automata, scored in context.

The lexicon is a trie of seed terms and of words and stems learned from labelled documents.  The automaton that accepts
every word within a term's number of edits is intersected with the trie into one deterministic automaton, built as words
ask for it; a stem, misspelled or not, takes any ending of one letter or more.  A misspelled hit counts as its term does,
less a part for every edit.  What the labelled documents say of a misspelled form, or of all forms of a term, lowers its
strength: forms at home in documents that aren't toxic are correct words that happen to be near.
Hits near quotation marks or verbs of saying count as quotations, hits near forms of address as abuse; a logistic
regression over the strengths gives the score.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from array import array
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import drop, worker_cache, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Seed terms, forms of address and verbs of saying in the four languages.
SEED = ("idiot", "moron", "stupid", "loser", "clown", "scum", "trash", "pathetic", "worthless", "disgusting", "imbecile", "dumbass", "bastard", "asshole")
ADDRESS = frozenset("you your youre yourself u tu te toi vous votre du dich dir ihr dein tú usted vosotros eres".split())
SAYING = frozenset("said says say saying wrote writes called calls quote quoted quoting word term dit écrit appelle sagte sagt schrieb genannt dijo dice escribió llamó".split())
WORD = re.compile(r"\w+")
WINDOW = 6
QUOTES = '"“”„«»'
#: Words whose verdict a worker keeps, and the longest it keeps.  Words of any length are looked up.
CACHE, KEPT = 100_000, 64
#: States of the automaton that a worker keeps between words.
STATES = 50_000
#: Toxic documents that must have a learned stem, and other documents, as a share of those, that may: labels err.
LEAST, NOISE = 7, 0.12
#: Letters of the shortest stem; beginnings are counted in levels of so many more letters, as long as any is in question.
SHORTEST, LEVEL = 4, 6
#: Strength of a hit by its number of edits.
STRENGTH = (1.0, 0.85, 0.7)
#: A misspelled form, and all those of a term, keep the share of toxic documents among those that have it (one more is
#: granted); under this share they are silent.
SILENT = 0.5
FEATURES = ("seed", "learned", "abuse", "quoted", "addressed", "dense")


def edits(term: str, most: int = 2) -> int:
    """Edits allowed in a term: none below five letters, one below eight, else two; at most ``most``."""
    return min(most, 0 if len(term) < 5 else 1 if len(term) < 8 else 2)


class Lexicon:
    """``terms`` are (text, kind, edits) with a kind of ``seed``, ``word`` or ``stem``; ``forms`` maps misspelled words to a
    share of their strength.  ``find(word)`` gives (term number, edits) of the hit with the fewest edits, of the first term
    among several, or None."""

    def __init__(self, terms, forms=None):
        self.terms, self.forms = list(terms), dict(forms or {})
        self.children: list[dict[str, int]] = [{}]
        #: Terms that end at a node, and the most edits of any term below it: positions beyond that are dropped.
        self.ends: list[list[int]] = [[]]
        self.reach: list[int] = [0]
        for number, (text, _, most) in enumerate(self.terms):
            node = 0
            self.reach[0] = max(self.reach[0], most)
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], most)
            self.ends[node].append(number)
        self.clear()

    def clear(self) -> None:
        """Forget the states built so far."""
        #: States by their positions, each a trie node and the edits spent in four bytes.
        self.states: dict[bytes, int] = {}
        self.positions: list[bytes] = []
        self.moves: list[dict[str, int]] = []
        #: (edits, term) of the best whole term that a state accepts, and of the best stem that any letter completes.
        self.whole: list[tuple | None] = []
        self.stems: list[tuple | None] = []
        self.start = self._state({0: 0})

    def _state(self, best: dict[int, int]) -> int:
        """The state that stands at the nodes, each with the fewest edits spent, closed under letters that the word leaves out."""
        todo = list(best)
        while todo:
            node = todo.pop()
            spent = best[node] + 1
            for child in self.children[node].values():
                if spent <= self.reach[child] and spent < best.get(child, 99):
                    best[child] = spent
                    todo.append(child)
        key = array("I", sorted(node << 2 | spent for node, spent in best.items())).tobytes()
        if key not in self.states:
            self.states[key] = len(self.moves)
            self.positions.append(key)
            self.moves.append({})
            found = [(spent, number) for node, spent in best.items() for number in self.ends[node] if spent <= self.terms[number][2]]
            self.whole.append(min((x for x in found if self.terms[x[1]][1] != "stem"), default=None))
            self.stems.append(min((x for x in found if self.terms[x[1]][1] == "stem"), default=None))
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        best: dict[int, int] = {}
        for code in array("I", self.positions[state]):
            node, spent = code >> 2, code & 3
            if spent < self.reach[node] and spent + 1 < best.get(node, 99):
                best[node] = spent + 1  # a letter too many
            for letter, child in self.children[node].items():
                cost = spent + (letter != c)
                if cost <= self.reach[child] and cost < best.get(child, 99):
                    best[child] = cost
        self.moves[state][c] = to = self._state(best) if best else -1
        return to

    def find(self, word: str) -> tuple[int, int] | None:
        if len(self.moves) > STATES:
            self.clear()
        state, best = self.start, (99, 0)
        for c in word:
            best = min(best, self.stems[state] or best)
            moves = self.moves[state]
            state = moves[c] if c in moves else self._move(state, c)
            if state < 0:
                break
        else:
            best = min(best, self.whole[state] or best)
        return (best[1], best[0]) if best[0] < 99 else None

    def strength(self, word: str, number: int, spent: int) -> float:
        return STRENGTH[spent] * (self.forms.get(word, 1.0) if spent else 1.0)


def hits_of(words, lexicon: Lexicon, verdicts: dict) -> dict[str, tuple[int, int]]:
    """The hit of every distinct word that has one."""
    if len(verdicts) > CACHE:
        verdicts.clear()
    out = {}
    for w in words:
        if w in verdicts:
            hit = verdicts[w]
        else:
            hit = lexicon.find(w)
            if len(w) <= KEPT:
                verdicts[w] = hit
        if hit:
            out[w] = hit
    return out


def features(text: str | None, lexicon: Lexicon, verdicts: dict) -> list[float]:
    """The document's FEATURES; null, empty and wordless texts have none.

    seed and learned: the greatest strength of such a hit outside quotations; abuse, quoted and addressed: the logarithm of
    1 and the sum of strengths of hits outside quotations, inside them, and near a form of address; dense: of all a word.
    """
    lower = (text or "").lower()
    words = WORD.findall(lower)
    hits = {w: (lexicon.terms[n][1], s) for w, (n, e) in hits_of(set(words), lexicon, verdicts).items() if (s := lexicon.strength(w, n, e))}
    if not hits:
        return [0.0] * len(FEATURES)
    seed = learned = abuse = quoted = addressed = 0.0
    order = [k for k, w in enumerate(words) if w in hits]
    for k, m in zip(order, (m for m in WORD.finditer(lower) if m[0] in hits)):
        kind, strength = hits[m[0]]
        near = words[max(0, k - WINDOW) : k + WINDOW + 1]
        left, right = lower[max(0, m.start() - 60) : m.start()].split("\n")[-1], lower[m.end() : m.end() + 60].split("\n")[0]
        if (any(q in left for q in QUOTES) and any(q in right for q in QUOTES)) or not SAYING.isdisjoint(near):
            quoted += strength
        else:
            abuse += strength
            if kind == "seed":
                seed = max(seed, strength)
            else:
                learned = max(learned, strength)
        if not ADDRESS.isdisjoint(near):
            addressed += strength
    return [seed, learned, math.log1p(abuse), math.log1p(quoted), math.log1p(addressed), 10 * math.sqrt((abuse + quoted) / len(words))]


def stems_of(pos: Counter, neg: Counter) -> tuple[list[str], list[str]]:
    """(stems, words): the shortest beginnings (``x+``), and the words no such stem covers (``x$``), that at least LEAST toxic
    documents have and, but for NOISE of as many, no other."""
    stems: set[str] = set()
    words = []
    for mark in sorted((m for m, n in pos.items() if n >= LEAST and neg[m] <= NOISE * n), key=lambda m: (m[-1] == "$", len(m), m)):
        text = mark[:-1]
        if any(text[:k] in stems for k in range(1, len(text))):
            continue
        if mark[-1] == "+":
            stems.add(text)
        else:
            words.append(text)
    return sorted(stems), words


def evidence(terms: list[tuple], seen: list[tuple], toxic: int, others: int) -> tuple[list[tuple], dict[str, float]]:
    """(terms, forms) after what labelled documents show: ``seen`` has (term number, edits, form, toxic documents without a term
    as written, other documents) of every misspelled form, out of ``toxic`` and ``others`` documents.

    A form's strength shrinks to the share of toxic documents among those that have it, at equal numbers of both kinds and
    with one more toxic one; below SILENT it is 0.  The same share over all remaining forms of a term and a number of
    edits, if below SILENT, takes that number of edits from the term.  One document alone silences nothing.
    """
    ratio = max(1.0, others / max(1, toxic))
    share = lambda p, q: (p * ratio + 1) / (p * ratio + 1 + q)
    forms, sums = {}, {}
    for number, spent, form, p, q in seen:
        forms[form] = share(p, q) if share(p, q) >= SILENT else 0.0
        if forms[form]:
            at = sums.setdefault((number, spent), [0, 0])
            at[0] += p
            at[1] += q
    most = {}
    for (number, spent), (p, q) in sums.items():
        if share(p, q) < SILENT:
            most[number] = min(spent - 1, most.get(number, 99))
    return [(t, kind, min(m, most.get(k, 99))) for k, (t, kind, m) in enumerate(terms)], {f: s for f, s in forms.items() if s < 1}


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Logistic regression by Newton's method; the last weight is the intercept.  Without both classes, only the lexicon speaks."""
    if len(set(y.tolist())) < 2:
        return np.array([3.0, 3.0, 1.0, -1.0, 0.3, 0.5, -3.5])
    x = np.column_stack([x, np.ones(len(x))])
    shrink = np.array([ridge] * len(FEATURES) + [1e-9])
    w = np.zeros(len(shrink))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink) + 1e-9 * np.eye(len(w)), x.T @ (p - y) + shrink * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """``lexicon`` holds the arguments of a Lexicon."""

    def __init__(self, lexicon: tuple, weight: np.ndarray):
        self.lexicon, self.weight = lexicon, weight


def learned_terms(rows: DataFrame) -> tuple[list[str], list[str]]:
    """Stems and words of ``rows(text, toxic)``, a bounded sample.  Beginnings are counted level by level: longer ones only
    of what many toxic documents have in common and no stem decides yet."""
    pos, neg = Counter(), Counter()
    low, wanted = SHORTEST, None
    while True:
        high = low + LEVEL

        def beginnings(batches, low=low, high=high, wanted=wanted):
            found = Counter()
            for b in batches:
                for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    distinct = set(WORD.findall(text.lower())).difference(SEED)
                    if wanted is not None:
                        distinct = {w for w in distinct if len(w) > low and w[: low - 1] in wanted}
                    marks = {w[:k] + "+" for w in distinct for k in range(low, min(len(w), high))}
                    if wanted is None:
                        marks |= {w + "$" for w in distinct if len(w) >= 3}
                    found.update((m, y) for m in marks)
            out = [(s, y, n) for (s, y), n in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.string(), pa.int32(), pa.int64()))], ["stem", "y", "n"])

        counted = rows.mapInArrow(beginnings, "stem string, y int, n long").groupBy("stem").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 1, 0).otherwise(F.col("n"))).alias("q"))
        got = counted.filter(F.col("p") >= LEAST).filter((F.col("q") <= NOISE * F.col("p")) | (F.length("stem") == high)).collect()
        pos.update({r.stem: r.p for r in got})
        neg.update({r.stem: r.q for r in got})
        stems, words = stems_of(pos, neg)
        # Beginnings of the greatest length so far that are common, but not only in toxic documents, may still grow into a stem.
        wanted = {r.stem[:-1] for r in got if r.stem[-1] == "+" and len(r.stem) == high and not any(r.stem[:k] in stems for k in range(1, high))}
        if not wanted:
            return stems, words
        low = high


def train(labelled: DataFrame, most: int = 2) -> Model:
    """Learn from ``labelled(text, toxic)``, a bounded sample: terms from its word beginnings, then which misspelled forms
    count, then the weights.  A term has at most ``most`` edits.

    Rows of null text or label are left out; equal texts count once, so copies don't make a stem.
    """
    rows = labelled.filter("text is not null and toxic is not null").groupBy("text").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = written(rows, "labelled")  # read several times; the documents it comes from once
    size = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    stems, words = learned_terms(rows)
    terms = [(t, kind, edits(t, most)) for kind, group in (("seed", SEED), ("word", words), ("stem", stems)) for t in group]

    def misspelled(batches):
        lex, verdicts = Lexicon(terms), {}
        for b in batches:
            out = []
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                hits = hits_of(set(WORD.findall(t.lower())), lex, verdicts)
                if y == 1 and any(not e for _, e in hits.values()):
                    continue  # a term as written explains the label: its other words are no evidence
                out += [(n, e, w, y) for w, (n, e) in hits.items() if e]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.int32()))], ["term", "edits", "form", "y"])

    seen = rows.mapInArrow(misspelled, "term int, edits int, form string, y int").groupBy("term", "edits", "form").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 1, 0).otherwise(1)).alias("q"))
    lexicon = evidence(terms, sorted(map(tuple, seen.collect())), size.get(1, 0), sum(size.values()) - size.get(1, 0))

    def measured(batches):
        lex, verdicts = Lexicon(*lexicon), {}
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([features(t, lex, verdicts) for t in b.column(0).to_pylist()], pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    got = rows.mapInArrow(measured, "x array<double>, y int").collect()
    drop(rows)
    if not got:
        return Model(lexicon, fit(np.zeros((0, len(FEATURES))), np.zeros(0)))
    return Model(lexicon, fit(np.array([r.x for r in got]), np.array([float(r.y) for r in got])))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: 0 to 1, higher for toxic; null and empty texts get the score of a text without hits.

    Whole texts of any length are read; rows that repeat have equal scores; a column that is called ``name`` already is
    replaced, all others are kept; an empty table gives no rows.
    """
    lexicon, weight = model.lexicon, model.weight

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        lex = worker_cache(f"lexicon:{lexicon_key}", lambda: (Lexicon(*lexicon), {}))
        x = np.array([features(t, *lex) for t in texts], float).reshape(len(texts), len(FEATURES))
        return pd.Series(1 / (1 + np.exp(-np.clip(x @ weight[:-1] + weight[-1], -500, 500))))

    lexicon_key = zlib.crc32(repr(lexicon).encode())
    return docs.withColumn(name, of(F.col(text).cast("string")))


def sample(docs: DataFrame, labels: DataFrame, held_out, most: int) -> DataFrame:
    """About ``most`` rows of (text, toxic) among the labelled rows that are not ``held_out(doc_id column)``, chosen by a hash of doc_id.

    The bound covers the training of the classifier alone; every document is scored.
    """
    usable = labels.select(F.col("doc_id").cast("bigint"), F.col("toxic").cast("int")).filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    share = max(1, min(1 << 20, (most << 20) // max(1, usable.count())))
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 20)) < share).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def toxic_documents(docs: DataFrame, labels: DataFrame, most: int = 8000) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, held_out, score, predicted.

    Labels are learned only from rows that are not held out (crc32 of doc_id as text mod 5 is 0), at most about ``most``
    of them.  Null doc_ids are not held out; null and empty texts have the score of a text without hits; rows that repeat,
    ties and texts of any length are scored each as it is; other columns are ignored; an empty table gives no rows.
    """
    model = train(sample(docs, labels, held_out, most))
    base = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    scored = score(base, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
