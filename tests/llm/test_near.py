"""Near duplicates, repeated substrings, passages, leaks, toxicity and WARC against brute force."""

import gzip
import io
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace.llm import chaining, decontamination, graph, simhash, suffix_dedup, toxicity, warc

DATA = "/root/testdata/sf0.001"


def docs_of(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def closure(pairs, nodes):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1001 + i) for i in range(150)]
    rest = [(rng.randrange(3000, 3300), rng.randrange(3300, 3600)) for _ in range(120)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(chain + star + rest, "a long, b long")).collect()}
    want = closure(chain + star + rest, got)
    assert len(set(zip(got.values(), want.values(), strict=True))) == len(set(got.values())) == len(set(want.values()))
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def fp(text):
    words = "".join(c.lower() if c.isascii() else c for c in text).encode().split()
    if not words:
        return 0
    from xxhash import xxh64_intdigest

    runs = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, odd_docs, no_docs):
    for docs in (docs_of(spark), odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        want = {r.doc_id: fp(r.text or "") for r in docs.collect()}
        ids = sorted(want)
        groups = closure([(a, b) for a in ids for b in ids if a < b and bin(want[a] ^ want[b]).count("1") <= 4], ids)
        assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()} == {i: (f"{want[i]:016x}", groups[i]) for i in ids}
    assert simhash.near_duplicates(odd_docs).count() == odd_docs.count() and simhash.near_duplicates(no_docs).count() == 0


def test_golay_keys_miss_nothing():
    golay, rng = simhash.Golay(), np.random.default_rng(1)
    x = rng.integers(0, 1 << 64, 200, dtype=np.uint64)
    for bits in range(5):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(64, bits, replace=False):
                y[i] ^= np.uint64(1) << np.uint64(b)
        left, right = ([set() for _ in x] for _ in "lr")
        for sets, side, values in ((left, 2, x), (right, 3, y)):
            for got in simhash.keys(values.view(np.int64), golay):
                if got[side]:
                    for i, k in zip(got[0], got[1], strict=True):
                        sets[i].add(int(k))
        assert all(a & b for a, b in zip(left, right, strict=True))


def test_keys_of_fingerprints_are_never_broadcast(spark, tmp_path, capsys):
    """The keys of a table far below the broadcast threshold are a hundred times as many: they must not go through the driver."""
    spark.range(1000).select(F.xxhash64("id").alias("fp")).write.parquet(f"{tmp_path}/fps")
    simhash.close_pairs(spark.read.parquet(f"{tmp_path}/fps")).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def removed(rows, length):
    seen = {}
    for _, t in rows:
        b = t.encode()
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    out = []
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket", [5000, 2])
def test_suffix_dedup(spark, odd_docs, no_docs, bucket, monkeypatch):
    monkeypatch.setattr(suffix_dedup.repeated_starts, "__defaults__", (200, 50, bucket, 40_000))
    for docs in (docs_of(spark), odd_docs):
        rows = [(r.doc_id, r.text or "") for r in docs.collect()]
        got = suffix_dedup.suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert sorted(map(tuple, got), key=str) == removed(rows, 200)
    assert suffix_dedup.suffix_dedup(no_docs).count() == 0


def test_suffix_dedup_small_alphabet(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("ab") for _ in range(600))
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(300))) + base[a : a + rng.randrange(150, 260)] + "ab" * rng.randrange(120)) for i, a in enumerate(rng.randrange(300) for _ in range(30))]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept").collect()
    assert sorted(map(tuple, got), key=str) == removed(rows, 200)


def planted(seed=7):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    text = lambda n: [word() for _ in range(n)]
    passage = text(70)
    edited = passage.copy()
    for i in (8, 21, 33, 47, 60):
        edited[i] = word()
    rows = [(i, " ".join(text(150))) for i in range(20)]
    rows += [(100, " ".join(text(80) + passage + text(40))), (101, " ".join(text(30) + passage + text(90))), (102, " ".join(text(55) + edited + text(25)))]
    rows += [(103, " ".join(text(60) + passage[:30] + text(60)))]
    return rows


def test_passages(spark, odd_docs, no_docs):
    rows = planted()
    got = chaining.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert set(got.doc_id) == {100, 101, 102} and set(got.class_id) == {100} and got.similarity.min() >= 0.8
    one = got[got.doc_id == 100].iloc[0]
    assert one.start <= 85 and one.end >= 145
    words = {i: chaining.words_of(t) for i, t in rows}
    alike = {i for i in words for j in words if i != j and chaining.passages(words[i], words[j])}
    assert alike == set(got.doc_id)
    odd = {(r.doc_id, r.partner_id, r.start, r.end, r.similarity) for r in chaining.shared_passages(odd_docs).collect()}
    assert odd == set() and chaining.shared_passages(no_docs).count() == 0


def alike_on_a_diagonal(a, b, words=50, share=0.8):
    """Brute force: whether somewhere `words` words in a row of a and b have that share in common."""
    for d in range(words - len(a), len(b) - words + 1):
        x, y = (a[-d:], b) if d < 0 else (a, b[d:])
        n = min(len(x), len(y))
        sums = np.concatenate(([0], np.cumsum(x[:n] == y[:n])))
        if n >= words and (sums[words:] - sums[:-words]).max() >= share * words:
            return True
    return False


def common_words(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old, row = row, [0]
        for j, y in enumerate(b, 1):
            row.append(max(old[j], row[-1], old[j - 1] + (x == y)))
    return row[-1]


def test_passages_against_all_pairs(spark):
    """Passages of 80 words with every share of words replaced, in large and small groups, beside frequent phrases: all pairs by brute force."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    text = lambda n: [word() for _ in range(n)]
    phrase = text(24)
    rows, number = [], 0
    for edits in (0, 6, 10, 13, 14):
        for _ in range(12):
            passage = text(80)
            for n in range(2):
                edited = passage.copy()
                for i in rng.sample(range(80), edits if n else 0):
                    edited[i] = word()
                rows.append((number, text(20) + (phrase if rng.random() < 0.5 else []) + text(rng.randrange(60)) + edited + text(30), edits))
                number += 1
    rows += [(number + i, text(40) + phrase + text(40), None) for i in range(20)]
    group = text(90)
    for i in range(30):
        edited = group.copy()
        for k in rng.sample(range(90), 4):
            edited[k] = word()
        rows.append((number + 100 + i, text(10) + phrase + text(30) + edited + text(20), None))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w, _ in rows], "doc_id long, text string")
    got = chaining.shared_passages(df).collect()
    texts = {i: w for i, w, _ in rows}
    words = {i: chaining.words_of(" ".join(w)) for i, w in texts.items()}
    pairs = {(a, b) for a in texts for b in texts if a < b and alike_on_a_diagonal(words[a], words[b])}
    want = closure(pairs, texts)
    classes = {r.doc_id: r.class_id for r in got}
    linked = {i for p in pairs for i in p}
    assert set(classes) <= linked
    for edits in (0, 6, 10, 13, 14):
        some = [i for i, _, e in rows if e == edits and i in linked]
        assert len(some) > 20 and sum(classes.get(i) == want[i] for i in some) >= 0.9 * len(some), edits
    assert all(classes.get(number + 100 + i) == number + 100 for i in range(30))
    for r in got:
        assert r.partner_id != r.doc_id and r.end - r.start >= 50 and r.similarity >= 0.8
        assert common_words(texts[r.doc_id][r.start : r.end], texts[r.partner_id]) >= 0.8 * (r.end - r.start) - 1


def test_passages_around_a_frequent_phrase(spark):
    """A phrase too short for a passage in 60 texts; in each two of them edited words go on with it, in which no run is left to tell the two from the rest."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    text = lambda n: [word() for _ in range(n)]
    phrase, rows = text(44), []
    for n in range(30):
        end = text(16)
        for k in range(2):
            own = [word() if k and i % 4 == 2 else w for i, w in enumerate(end)]
            rows.append((2 * n + k, " ".join(text(40) + phrase + own + text(40))))
    got = {r.doc_id: (r.class_id, r.partner_id) for r in chaining.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (i - i % 2, i ^ 1) for i in range(60)}
    a, b = np.array([5, 5, 7, 5, 9], dtype=np.uint32), np.array([5, 9, 5, 8], dtype=np.uint32)
    assert len(set(chaining.bag(a).tolist()) & set(chaining.bag(b).tolist())) == 3 and len(chaining.bag(a[:0])) == 0


def test_passages_take_few_tables(spark, monkeypatch):
    """A long chain of links: each text shares passages with the next one only, one class over all, and the tables written don't follow the chain's length."""
    rng = random.Random(29)
    passages = [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(60)) for _ in range(41)]
    rows = [(i, f"{passages[i]} {passages[i + 1]}") for i in range(40)]
    tags = []
    for module in (chaining, graph):
        monkeypatch.setattr(module, "saved", lambda df, tag, f=module.saved: tags.append(tag) or f(df, tag))
    got = chaining.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == dict.fromkeys(range(40), 0)
    assert {(r.doc_id, r.start) for r in got} == {(i, n) for i in range(40) for n in (0, 60)} - {(0, 0), (39, 60)}
    assert len(tags) <= 25, tags


def test_components_with_last_links(spark):
    rng = random.Random(31)
    edges = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(1, 50)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(200)] + [(-5, 7), (3000, 3000)]
    df = spark.createDataFrame(edges, "a long, b long")
    for last in (0, 40, 10_000):
        roots = {r.node: r.root for r in graph.components(df, last).collect()}
        want = closure([e for e in edges if e[0] != e[1]], roots)
        assert set(roots) == {x for a, b in edges if a != b for x in (a, b)}
        assert len({(roots[x], want[x]) for x in roots}) == len(set(roots.values())) == len(set(want.values())), last


def test_pairs_of_keys_with_the_same_members(spark):
    members = [(k, t) for k in range(30) for t in ((1, 2), (3, 4, 5), tuple(range(10, 18)))[k % 3]] + [(99, 2), (99, 3), (100, 6)]
    df = spark.createDataFrame(members, "key long, stretch long")
    groups = df.groupBy("key").agg(chaining.F.count("*").alias("n"), chaining.F.min("stretch").alias("least"), chaining.F.max("stretch").alias("most"), *chaining.same_members("stretch")).where("least < most")
    got = [tuple(sorted(r)) for r in chaining.pairs_of(df, groups).collect()]
    want = {(1, 2), (2, 3), (3, 4), (3, 5), (4, 5)} | {(10, i) for i in range(11, 18)} | {(i, 17) for i in range(11, 17)}
    assert len(got) == len(set(got)) and set(got) == want


def test_words_in_common_and_what_may_share():
    rng = np.random.default_rng(13)
    for _ in range(300):
        a, b = (rng.integers(0, rng.integers(2, 9), rng.integers(0, 90)).tolist() for _ in range(2))
        assert chaining.matched(a, b) == common_words(a, b)
    for n, same in ((50, 40), (50, 39), (49, 49), (80, 64), (80, 63)):
        a = np.arange(1000, 1000 + n, dtype=np.uint32)
        at = np.sort(rng.permutation(n)[:same])
        known = np.unique(np.concatenate((a[at], np.arange(5, dtype=np.uint32))))
        dense = any(np.isin(a[i:k], known).sum() >= 0.8 * (k - i) for i in range(n) for k in range(i + 50, n + 1))
        words, begin = np.concatenate(([0], a[:30], [0], a, [0], a[:49])).astype(np.uint32), np.array([1, 32, 33 + n])
        assert chaining.may_share(words, begin, known).tolist() == [False, dense, False] and (same < 0.8 * n or n < 50 or dense)
    assert not chaining.may_share(words, begin, known[:0]).any() and chaining.passages(a[:0], a) == chaining.passages(a, a[:0]) == []


def test_many_texts_against_one():
    """Texts compared at once give what they give one by one, runs that either side repeats included."""
    rng = np.random.default_rng(17)
    new = lambda n: rng.integers(0, 1 << 32, n, dtype=np.uint32)
    p, line = new(90), new(6)
    edited = p.copy()
    edited[::9] = new(10)
    texts = [np.concatenate((new(20), p)), p[:3], np.concatenate((edited, new(30), np.tile(line, 20))), new(70), np.tile(line, 15), np.concatenate((p, p)), p[40:], p[:0], np.concatenate((p[45:], p[:45]))]
    for b in (np.concatenate((new(7), p, np.tile(line, 12))), p, np.concatenate((edited, p)), np.tile(line, 30)):
        together = chaining.passages_with(texts, chaining.Side(b))
        assert together == [chaining.passages(a, b) for a in texts] and any(together) and not all(together)


def test_two_passages_of_a_pair_and_repeats():
    rng = np.random.default_rng(3)
    new = lambda n: rng.integers(0, 1 << 32, n, dtype=np.uint32)
    p, q = new(60), new(60)
    a, b = np.concatenate((p, new(20), q)), np.concatenate((p, new(20), q))
    assert chaining.passages(a, b) == [(0, 140, 0, 140, pytest.approx(120 / 140))]
    a, b = np.concatenate((p, new(45), q)), np.concatenate((p, new(45), q))
    assert sorted(x[:4] for x in chaining.passages(a, b)) == [(0, 60, 0, 60), (105, 165, 105, 165)]
    a, b = np.concatenate((p, new(300), q)), np.concatenate((q, new(10), p))
    assert sorted(x[:4] for x in chaining.passages(a, b)) == [(0, 60, 70, 130), (360, 420, 0, 60)]
    line = new(6)
    a = b = np.concatenate((p, np.tile(line, 30), q))
    assert chaining.passages(a, b)[0][:4] == (0, 300, 0, 300)
    assert chaining.passages(np.tile(line, 30), np.tile(line, 40))[0][1] >= 170


def test_passages_of_odd_ids(spark):
    rng = random.Random(9)
    one, two = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80)) for _ in range(2))
    df = spark.createDataFrame([("x", one), ("y", one), (None, one), ("x", one + " more"), ("z", two), (None, two), ("z", two), ("w", one[:100])], "doc_id string, text string")
    got = {(r.doc_id, r.class_id, r.partner_id) for r in chaining.shared_passages(df).collect()}
    assert got == {("x", "x", "y"), ("y", "x", "x"), (None, "x", "x"), (None, "z", "z")}


def test_chain_and_alignment():
    a = np.arange(100, 400, dtype=np.uint32)
    b = np.concatenate((np.arange(900, 950), a[50:90], [7], a[91:150], np.arange(990, 1000))).astype(np.uint32)
    [(i, j, k, m, alike)] = chaining.passages(a, b)
    assert (i, j, k, m) == (50, 150, 50, 150) and alike == pytest.approx(0.99)
    matches = [(0, 10, 20), (5, 60, 8), (30, 40, 20), (60, 0, 12), (60, 70, 15)]
    best = max((sum(m[2] for m in c) - chaining.GAP_COST * sum((n[0] - p[0] - p[2]) + (n[1] - p[1] - p[2]) for p, n in zip(c, c[1:], strict=False)) for s in range(1, 32) if (c := [matches[x] for x in range(5) if s >> x & 1]) and all(n[0] >= p[0] + p[2] and n[1] >= p[1] + p[2] for p, n in zip(c, c[1:], strict=False))), default=0)
    got = chaining.chain(matches)
    assert sum(m[2] for m in got) - chaining.GAP_COST * sum((n[0] - p[0] - p[2]) + (n[1] - p[1] - p[2]) for p, n in zip(got, got[1:], strict=False)) == pytest.approx(best)


def test_decontamination(spark, odd_docs, no_docs):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    items = [(i, [word() for _ in range(rng.randrange(15, 60))]) for i in range(12)] + [(90, ["lone"]), (91, [])]
    rows, want = [], set()
    for d in range(60):
        text = [word() for _ in range(100)]
        if d % 3 == 0:
            item, words = items[d // 3 % 12]
            words = words.copy()
            for x in rng.sample(range(len(words)), len(words) // 6 if d % 2 else 0):
                words[x] = word()
            text[40:40] = words
            want.add((d, item))
        elif d % 3 == 1:
            text[10:10] = items[d % 12][1][: len(items[d % 12][1]) // 2]  # half an item is no leak
        rows.append((d, " ".join(text)))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontamination.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.item_id < 90} == want and all(0.8 <= r.similarity <= 1 and 30 <= r.start <= 50 for r in got if r.item_id < 90)
    assert decontamination.contaminated(odd_docs, bench).count() == 0
    assert decontamination.contaminated(no_docs, bench).count() == 0 and decontamination.contaminated(docs, bench.limit(0)).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_edit_distance():
    rng = random.Random(4)
    terms = {"".join(rng.choice("abcd") for _ in range(rng.randrange(3, 12))): 1.0 for _ in range(40)}
    trie = toxicity.FuzzyTrie(terms)
    for _ in range(2000):
        w = list(rng.choice(list(terms)))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(["", "a", "b", "cc", "d"])
        w = "".join(w)
        want = min((e for t in terms if (e := edits(w, t)) <= toxicity.edits_allowed(t)), default=None)
        got = trie.match(w)
        assert (got and got[0]) == want if want is not None else got is None
    assert toxicity.FuzzyTrie({"abc*": 2.0}).match("abcdef") == (0, 2.0) and toxicity.FuzzyTrie({"abc*": 2.0}).match("ab") is None


def test_toxicity(spark, odd_docs, no_docs):
    rng = random.Random(8)
    clean = ["tree", "river", "stone", "walk", "cloud", "green", "paper", "light", "house", "bread"]
    rows, labels = [], []
    for d in range(600):
        words = [rng.choice(clean) + rng.choice("aeiou") for _ in range(60)]
        if toxic := d % 4 == 0:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["blockhead", "nincompoop", "dunderhead"]) if d % 8 else rng.choice(["blockhed", "nincompop", "dunderhaed"])
        rows.append((d, " ".join(words)))
        labels.append((d, 1, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(docs, marks).toPandas().merge(marks.toPandas(), on="doc_id")
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all() and out.score.between(0, 1).all()
    held = out[out.held_out]
    assert ((held.predicted == 1) == (held.toxic == 1)).mean() > 0.97 and ((out.predicted == 1) == (out.score >= 0.7)).all()
    model = toxicity.learn(docs, marks)
    assert toxicity.score(odd_docs, model).count() == odd_docs.count() and toxicity.score(no_docs, model).count() == 0
    assert toxicity.toxicity(docs, marks.limit(0)).where("score IS NULL").count() == 0


def test_warc(spark, tmp_path):
    rows = [(3, "u3", "<p>same</p>"), (1, "u1", "<p>same</p>"), (2, None, None), (5, "u 5\r\nX: y", ""), (7, "u7", "é" * 100_000), (8, "u8", "<p>other</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = f"file://{tmp_path}/w"
    got = {int(r.record_id.rsplit(":", 1)[1]): r for r in warc.read_warc(warc.write_warc(pages, folder), folder, payloads=True).collect()}
    page = lambda name: name and int(name.rsplit(":", 1)[1])
    assert {i: (r.record_type, page(r.refers_to)) for i, r in got.items()} == {1: ("response", None), 2: ("response", None), 3: ("revisit", 1), 5: ("revisit", 2), 7: ("response", None), 8: ("response", None)}
    assert {r.refers_to for r in got.values() if r.refers_to} <= {r.record_id for r in got.values()}
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), warc.digest(data))
        assert got[i].payload is None if got[i].record_type == "revisit" else bytes(got[i].payload) == data
    assert warc.read_warc(warc.write_warc(pages.limit(0), folder), folder).count() == 0
    assert warc.read_warc(warc.write_warc(pages, folder, least_bytes=1), folder).where("record_type = 'revisit'").count() == 1


def test_warc_of_odd_ids(spark, tmp_path):
    """Null and repeated ids, ties, clashing columns: each row is a record with a name of its own."""
    rows = [(4, "same"), (4, "same"), (None, "same"), (4, "other"), (9, "same"), (None, "lone"), (None, "lone")]
    pages = spark.createDataFrame([(i, f"u{n}", h, n, "x") for n, (i, h) in enumerate(rows)], "page_id long, url string, html string, row long, content string")
    folder = f"file://{tmp_path}/w"
    got = warc.read_warc(warc.write_warc(pages, folder), folder).collect()
    page = lambda name: name and name.rsplit(":", 1)[1]
    assert sorted((page(r.record_id), r.record_type, page(r.refers_to) or "") for r in got) == sorted([("4", "response", ""), ("4", "revisit", "4"), ("", "revisit", "4"), ("4", "response", ""), ("9", "revisit", "4"), ("", "response", ""), ("", "response", "")])
    assert len({r.record_id for r in got}) == 7


def test_warc_of_long_urls(spark, tmp_path):
    """A url of any length is a head that the reader takes; a head without an end is still an error."""
    rows = [(1, "u" * 2_500_000, "one"), (2, "é" * 900_000, "two"), (3, "u3", "one")]
    folder = f"file://{tmp_path}/w"
    archives = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1), folder)
    got = {r.record_id.rsplit(":", 1)[1]: r for r in warc.read_warc(archives, folder).collect()}
    assert [(k, got[k].record_type, got[k].uri == u) for k, (_, u, _) in zip("123", rows, strict=True)] == [("1", "response", True), ("2", "response", True), ("3", "revisit", True)]
    with pytest.raises(ValueError, match="without an end"):
        list(warc.read_archive(io.BytesIO(gzip.compress(b"x" * 3_000_000))))


def test_tiles_of_an_alignment(monkeypatch):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 30, 12), rng.integers(0, 30, 400)
    b[333:343] = a[:10]
    whole = decontamination.align(a, b)
    monkeypatch.setattr(decontamination, "CELLS", 0)
    assert decontamination.align_in_tiles(a, b) == whole and whole[0] >= 10


def test_suffix_dedup_of_odd_ids(spark):
    """String, null and repeated ids with other texts: each row is judged for itself."""
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    one, two = text(500), text(320)
    rows = [("a", one + text(50)), ("a", two[:100]), ("b", text(90) + one), (None, two), (None, text(30) + two), ("c", None), ("a", one + "x")]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id string, text string")).drop("kept").collect()
    assert sorted(map(tuple, got), key=str) == removed([(i, t or "") for i, t in rows], 200)


def test_broken_archives():
    good = warc.page_member(1, "u", b"payload", None) + warc.page_member(2, "u", b"more" * 1000, None)
    assert [r["payload_bytes"] for r in warc.read_archive(io.BytesIO(good))] == [7, 4000]
    plain = gzip.decompress(warc.page_member(1, "u", b"payload", None))
    for bad in (good[:-9], gzip.compress(plain.replace(b"payload\r", b"paylaod\r")), gzip.compress(plain[:-6] + b"\r\n\r\n"), gzip.compress(plain + b"x")):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.read_archive(io.BytesIO(bad)))
