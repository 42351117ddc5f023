"""Toxicity from misspelling-tolerant term matching and the words around each match.

Terms and word stems that mark toxic texts are learned from labels and kept in a trie. Levenshtein
automata run over that trie: a state is a set of (trie node, edits so far), made when a word first
needs it, so a word costs one look-up a letter. Each match gets a window of words around it, which tells
quotation from abuse, and a logistic regression turns a text's matches into a score.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, saved, table, text_of

#: Labelled rows that the model is fitted on, about; taken by a hash of their id.
FITTED_ROWS = 12_000
#: Terms of the lexicon at most, the best supported first; and context words.
TERMS, CONTEXT_WORDS = 4_000, 5_000
STEMS = range(4, 11)
WINDOW = 6
THRESHOLD = 0.7
QUOTES = "\"“”„«»"
EDGE = ".,;:!?()[]{}<>'`’‘…-" + QUOTES
FEATURES = 8
#: Log-likelihood that a term must gain over chance, the same for samples of all sizes.
GAIN = 6.0


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class FuzzyTrie:
    """Terms in a trie, and the automaton that reads words against it.

    Terms that end in * are stems: any word that begins with one matches it, without edits.
    """

    #: Each takes about a kilobyte; beyond, all are forgotten and made anew.
    STATES = 60_000

    def __init__(self, terms: dict[str, float]):
        self.weight: dict[int, float] = {}
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]  # edits allowed where a term ends, else -1
        self.stem: list[bool] = [False]
        self.most: list[int] = [0]  # edits allowed by any term below
        for term in terms:
            stem, word = term.endswith("*"), term.rstrip("*")
            allowed, at = (0 if stem else edits_allowed(word)), 0
            for c in word:
                self.most[at] = max(self.most[at], allowed)
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.stem.append(False)
                    self.most.append(0)
                at = self.children[at][c]
            self.most[at] = max(self.most[at], allowed)
            self.weight[at] = terms[term]
            if stem:
                self.stem[at] = True
            else:
                self.ends[at] = max(self.ends[at], allowed)
        self.forget()

    def forget(self) -> None:
        self.sets: list[dict[int, int]] = [{}]  # 0 is the dead state
        self.names: dict[frozenset, int] = {frozenset(): 0}
        self.steps: list[dict[str, int]] = [{}]
        self.found: list[tuple[int, float] | None] = [None]
        self.start = self.name(self.closed({0: 0}))

    def closed(self, nodes: dict[int, int]) -> dict[int, int]:
        """With the nodes that leaving out letters of a term reaches."""
        todo = list(nodes)
        while todo:
            at = todo.pop()
            e = nodes[at] + 1
            for to in self.children[at].values():
                if e <= self.most[to] and e < nodes.get(to, 9):
                    nodes[to] = e
                    todo.append(to)
        return nodes

    def name(self, nodes: dict[int, int]) -> int:
        key = frozenset(nodes.items())
        if key not in self.names:
            self.names[key] = len(self.sets)
            self.sets.append(nodes)
            self.steps.append({})
            ends = [(e, -self.weight[at]) for at, e in nodes.items() if e <= self.ends[at]]
            self.found.append((min(ends)[0], -min(ends)[1]) if ends else None)
        return self.names[key]

    def step(self, state: int, c: str) -> int:
        """The state after one more letter; once a stem has been read, its node below zero."""
        nodes: dict[int, int] = {}

        def reach(at: int, e: int) -> None:
            if e <= self.most[at] and e < nodes.get(at, 9):
                nodes[at] = e

        for at, e in self.sets[state].items():
            reach(at, e + 1)  # a letter too many
            for letter, to in self.children[at].items():
                if letter == c and e == 0 and self.stem[to]:
                    self.steps[state][c] = -to
                    return -to
                reach(to, e if letter == c else e + 1)
        to = self.name(self.closed(nodes)) if nodes else 0
        self.steps[state][c] = to
        return to

    def match(self, word: str) -> tuple[int, float] | None:
        """Least number of edits from word to a term that allows so many, and the term's weight; or None."""
        if len(self.sets) > self.STATES:
            self.forget()
        state, steps = self.start, self.steps
        for c in word:
            to = steps[state].get(c)
            state = self.step(state, c) if to is None else to
            if state <= 0:
                return (0, self.weight[-state]) if state else None
        return self.found[state]


def tokens(text: str) -> list[str]:
    return text.lower().split()


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)  # with their log-odds
    known: set[str] = field(default_factory=set)  # like a term, but seen in texts that aren't toxic
    context: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=list)
    prior: float = 0.5


class Matcher(dict):
    """Word as written to the edits and weight of its match, or None; remembers words."""

    def __init__(self, model: Model):
        super().__init__()
        self.trie, self.known = FuzzyTrie(model.terms), model.known

    def __missing__(self, raw: str) -> tuple[int, float] | None:
        if len(self) >= 200_000:
            self.clear()
        word = raw.strip(EDGE)
        m = self.trie.match(word) if word else None
        m = None if m and m[0] and word in self.known else m
        self[raw] = m
        return m

    def hits(self, words: list[str]) -> list[tuple[int, int, float]]:
        return [(i, *m) for i, m in enumerate(map(self.__getitem__, words)) if m]


def windows(words: list[str], hits: list[tuple[int, int, float]]) -> Iterator[tuple[int, bool, list[str]]]:
    """For each match: its place, if it stands in quotation marks, and the words around it."""
    for i, _, _ in hits:
        before, after = words[max(0, i - WINDOW) : i], words[i + 1 : i + 1 + WINDOW]
        opened = sum(w.count(q) for w in before for q in QUOTES) + sum(words[i].startswith(q) for q in QUOTES)
        closed = sum(w.count(q) for w in after for q in QUOTES) + sum(words[i].endswith(q) for q in QUOTES)
        yield i, opened % 2 == 1 and closed > 0, [w.strip(EDGE) for w in before + after]


def features(words: list[str], match: Matcher, context: dict[str, float]) -> list[float]:
    quoted, n, plain, fuzzy = 0, 0, {}, {}
    around = []
    hits = match.hits(words)
    for (_, e, weight), (i, in_quotes, near) in zip(hits, windows(words, hits), strict=True):
        around.append(sum(context.get(w, 0.0) for w in near) / (1 + len(near)))
        quoted += in_quotes
        if not in_quotes:
            n += 1
            (fuzzy if e else plain)[words[i].strip(EDGE)] = weight
    both = max(0.0, sum(plain.values())) + max(0.0, sum(fuzzy.values()))
    return [1.0, np.log1p(max(0.0, sum(plain.values()))), np.log1p(max(0.0, sum(fuzzy.values()))), float(len(plain) + len(fuzzy) > 1), np.log1p(quoted), min(1.0, 20 * n / (20 + len(words))), float(np.mean(around)) if around else 0.0, min(both, 12.0) / 4]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Logistic regression by Newton's steps."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(len(w)), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def counted(sample: DataFrame, words_of) -> DataFrame:
    """Of what words_of(text) yields, the number of toxic and other texts that have it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            toxic, clean = Counter(), Counter()
            for text, y in zip(b["text"], b["toxic"], strict=True):
                (toxic if y else clean).update(set(words_of(text)))
            both = list(toxic.keys() | clean.keys())
            yield pd.DataFrame({"word": both, "pos": [toxic[w] for w in both], "neg": [clean[w] for w in both]})

    return sample.mapInPandas(run, "word string, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def words_and_stems(sample: DataFrame) -> DataFrame:
    """Words, and stems of words, by the toxic and other texts that have them.

    A word between the same two neighbours counts once, however many texts repeat that: else what near
    copies of one toxic text share would look like a sign of toxicity.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 100):
                rows = []
                for text, y in zip(b["text"][at : at + 100], b["toxic"][at : at + 100], strict=True):
                    words = ["", *(w.strip(EDGE) for w in tokens(text)), ""]
                    rows += [(w, zlib.crc32(f"{words[i - 1]} {words[i + 1]}".encode()), y) for w, i in {w: i for i, w in enumerate(words)}.items() if w]
                yield pd.DataFrame(rows, columns=["word", "between", "toxic"])

    seen = sample.mapInPandas(run, "word string, between long, toxic int").groupBy("word", "between").agg(F.max("toxic").alias("toxic"))
    words = seen.groupBy("word").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
    lengths = F.array(*map(F.lit, STEMS))
    stem = F.explode(F.filter(lengths, lambda n: n < F.length("word"))).alias("n")
    stems = words.select("word", "pos", "neg", stem).groupBy(F.concat(F.expr("substring(word, 1, n)"), F.lit("*")).alias("word")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return words.unionByName(stems)


def lexicon(rows: list, pos: int, neg: int) -> dict[str, float]:
    """Terms and their log-odds, the best first. Of stems that begin alike only the best stays; words stay beside their stem, for their misspellings."""
    kept: dict[str, float] = {}
    below: set[str] = set()  # beginnings of stems that are kept
    for r in rows:
        word, stem = r["word"].rstrip("*"), r["word"].endswith("*")
        if stem and (word in below or any(f"{word[:n]}*" in kept for n in range(1, len(word) + 1))):
            continue
        kept[r["word"]] = float(np.log((r["pos"] + 0.5) / (pos + 1)) - np.log((r["neg"] + 0.5) / (neg + 1)))
        if stem:
            below.update(word[:n] for n in range(1, len(word)))
    return kept


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = FITTED_ROWS) -> Model:
    """A model of about `rows` labelled rows that aren't held out; equal texts count once.

    Rows with a null id, text or label teach nothing; of several labels of one id the largest holds. With
    no label of one of the two kinds the score is the prior alone.
    """
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, rows / max(1, marks.count()))
    marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # About `rows` rows of 12 bytes, so they may be broadcast.
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").join(F.broadcast(marks), "doc_id")
    sample = saved(found.groupBy("text").agg(F.max("toxic").alias("toxic")).select("text", "toxic"), "labelled")
    total = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos")).first()
    n, pos = total["n"], total["pos"]
    model = Model(prior=(pos + 1) / (n + 2))
    if pos == 0 or pos == n:
        return model
    counts = saved(words_and_stems(sample), "word-counts")
    p, q = F.col("pos") / (F.col("pos") + F.col("neg")), F.lit(pos / n)
    gain = F.col("pos") * F.log(p / q) + F.when(F.col("neg") > 0, F.col("neg") * F.log((1 - p) / (1 - q))).otherwise(0.0)
    good = counts.where((F.col("pos") > 1) & (p > 0.5)).withColumn("gain", gain).where(F.col("gain") >= GAIN)
    model.terms = lexicon(good.orderBy(F.col("gain").desc(), "word").limit(TERMS).collect(), pos, n - pos)
    trie_terms = model.terms
    half = F.pmod(F.xxhash64("text"), F.lit(2))

    def like_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = FuzzyTrie(trie_terms)
        for b in batches:
            found = {(w, h) for t, h in zip(b["text"], b["half"], strict=True) for raw in set(tokens(t)) if (m := trie.match(w := raw.strip(EDGE))) and m[0]}
            yield pd.DataFrame(list(found), columns=["word", "half"])

    alike = sample.where("toxic = 0").select("text", half.alias("half")).mapInPandas(like_terms, "word string, half long").distinct().collect()
    # Words of the fitted rows alone. The weights are fitted on one half with what the other half knows, as new texts will be scored.
    model.known = {r["word"] for r in alike if r["half"] == 0}

    def near_matches(text: str, matchers: list = []) -> list[str]:  # noqa: B006  one matcher a worker
        if not matchers:
            matchers.append(Matcher(model))
        words = tokens(text)
        return [w for _, _, near in windows(words, matchers[0].hits(words)) for w in near]

    around = counted(sample, near_matches).where("pos + neg >= 5").orderBy((F.col("pos") + F.col("neg")).desc(), "word").limit(CONTEXT_WORDS).collect()
    if any(r["neg"] for r in around):
        all_pos, all_neg = sum(r["pos"] for r in around) + 1, sum(r["neg"] for r in around) + 1
        model.context = {r["word"]: float(np.log((r["pos"] + 1) / all_pos) - np.log((r["neg"] + 1) / all_neg)) for r in around}

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match = Matcher(model)
        for b in batches:
            rows = []
            for t, y in zip(b["text"], b["toxic"], strict=True):
                words = tokens(t)
                rows.append([*features(words, match, model.context), float(y)])
                if y:  # toxic texts teach once more with their terms misspelled
                    for i, _, _ in match.hits(words):
                        words[i] = words[i][: (k := len(words[i]) // 2)] + words[i][k + 1 :]
                    if match.hits(words):
                        rows.append([*features(words, match, model.context), 1.0])
            yield pd.DataFrame(rows, columns=[f"f{i}" for i in range(FEATURES + 1)])

    data = np.array([tuple(r) for r in sample.where(half == 1).mapInPandas(seen, ", ".join(f"f{i} double" for i in range(FEATURES + 1))).collect()]).reshape(-1, FEATURES + 1)
    if len(set(data[:, -1])) > 1:
        model.weights = fit(data[:, :-1], data[:, -1]).tolist()
    model.known |= {r["word"] for r in alike}
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. Null counts as an empty text, which is scored like any other; a null id is not held out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by TERMS, CONTEXT_WORDS and FITTED_ROWS
    name = ("toxic terms", uuid.uuid4().hex)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        match = held(name, lambda: Matcher(m))
        w = np.array(m.weights)
        for b in batches:
            if m.weights:
                x = np.array([features(tokens(t), match, m.context) for t in b["text"]]).reshape(-1, FEATURES)
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            else:
                p = np.full(len(b), m.prior)
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": p})

    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    scored = texts.mapInPandas(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(docs, labels))


def op7_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
