"""What the operators must find at every size of table and group."""

import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from loomtrace.llm import decontamination, similar, simhash, toxicity


def invented(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(n)]


def test_edited_items_in_many_copies(spark):
    """The same edited form of an item in 3,000 documents: the runs it keeps are in all of them, the others in none."""
    rng = random.Random(11)
    items = {1: (invented(rng, 30), 5), 2: (invented(rng, 40), 10), 3: (invented(rng, 12), 12)}
    rows = []
    for item, (words, step) in items.items():
        edited = [w if i % step != step // 2 else "edited" + w for i, w in enumerate(words)]
        rows += [(item * 10_000 + d, " ".join(invented(rng, 8) + edited + invented(rng, 8))) for d in range(3000)]
    rows += [(d, " ".join(invented(rng, 8) + items[2][0][:20] + invented(rng, 8))) for d in range(100)]  # half an item is no leak
    bench = spark.createDataFrame([(i, " ".join(w)) for i, (w, _) in items.items()], "item_id long, text string")
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, d // 10_000) for d, _ in rows if d >= 10_000} and len(got) == 9000
    assert {(r.item_id, round(r.similarity, 3)) for r in got} == {(1, 0.8), (2, 0.9), (3, round(11 / 12, 3))}


def test_parities_never_say_too_far():
    """Parities bound the difference from below, at all sizes; alone they tell unlike sets of one size apart."""
    rng = np.random.default_rng(14)
    for n in [0, 1, 2, 63, 64, 65, 127, 500, 1025, 30_000]:
        a = np.unique(rng.integers(-(2**62), 2**62, n))
        for m in [0, n // 10, n // 2, n, 3 * n]:
            b = np.unique(np.concatenate((a[m:], rng.integers(-(2**62), 2**62, m))))
            apart = similar.least_apart(similar.parities(a), similar.parities(b))
            assert apart == similar.least_apart(similar.parities(b), similar.parities(a)) <= len(np.setxor1d(a, b))
            assert m != n or n < 500 or apart > 0.25 * n


def test_fingerprints_lead_near_duplicates(spark):
    """SimHash gives the first candidates: each set with the least of its fingerprint's component, by brute force."""
    rng = random.Random(6)
    texts = ["", "...", *(" ".join(invented(rng, 60)) for _ in range(20))]
    for n in range(10):
        words = invented(rng, 400)
        for k in range(6):
            words[30 * k] = f"edit{k}"
            texts.append(" ".join(words))
    known = similar.sets_of(spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, h long"), 5, 0.8)
    prints = {r.node: r.fp for r in known.where("n > 0").collect()}
    of_text = {similar.hashed(s): simhash.majority([s], len(s)) for t in texts if len(s := similar.shingles(t, 5))}
    assert {n: f % (1 << 64) for n, f in prints.items()} == of_text
    root = {n: n for n in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if root[a] < root[b] and bin((prints[a] ^ prints[b]) % (1 << 64)).count("1") <= 4:
                    root[b], changed = root[a], True
    want = {(root[n], n) for n in prints if root[n] != n}
    assert len(want) > 30 and {(r.a, r.b) for r in similar.by_fingerprint(known).collect()} == want


def test_near_duplicate_stage(spark):
    """The stage keeps what brute force keeps: copies edited to every similarity, chains of them, a large group, and texts of the tables."""
    rng = random.Random(12)
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    number = 1_000_000
    for n in range(60):
        words = invented(rng, 40 + 3 * n)
        texts[number] = " ".join(words)
        for k in range(1, 6):
            words = words.copy() if n % 2 else texts[number].split()  # chains, or copies of the first
            for _ in range(1 + (n + k) % 5):
                words[rng.randrange(len(words))] = "edited"
            texts[number + k] = " ".join(words)
        number += 10
    base = invented(rng, 200)
    for i in range(250):
        words = base.copy()
        words[rng.randrange(200)] = words[rng.randrange(200)] = f"edit{i}"
        texts[number + i] = " ".join(words)
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, t in texts.items() if (w := (t or "").lower().split()) or True}
    up = {i: i for i in texts}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids, between = sorted(texts), 0
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                between += both < 0.95 * len(sets[a] | sets[b])
                lo, hi = sorted((top(a), top(b)))
                up[hi] = lo
    assert between > 100
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [i for i in ids if top(i) == i]


def test_toxic_terms_of_few_texts_in_a_large_sample(spark):
    """More than 2,000 fitted rows; each toxic term is in about six fitted texts."""
    rng = random.Random(13)
    terms = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(6)) for _ in range(60)]
    clean = [w for w in invented(rng, 150) if len(w) > 4]
    rows = []
    for d in range(4800):
        words = [rng.choice(clean) for _ in range(40)]
        if d % 9 == 0:
            words[rng.randrange(40)] = terms[d // 9 % 60]
        rows.append((d, " ".join(words), int(d % 9 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert table.where(~toxicity.held_out(F.col("doc_id"))).count() > 2000
    held = toxicity.toxicity(table.drop("toxic"), table.drop("text")).where("held_out").join(table, "doc_id").toPandas()
    toxic = held.toxic == 1
    assert (held.predicted[toxic] == 1).mean() > 0.8 and (held.predicted[~toxic] == 1).mean() < 0.02


def test_short_lines_recur_in_the_pipeline(spark):
    docs = spark.createDataFrame([(d, f"Menu\nRead more\n\nword{'abcdef'[d]} of its own\nSign in") for d in range(6)], "doc_id long, text string")
    kept = {r.doc_id: r.text for r in corpus_pipeline.drop_recurring_lines(spark, docs, "").collect()}
    assert kept == {d: t if d == 0 else f"\nword{'abcdef'[d]} of its own" for d, t in ((r.doc_id, r.text) for r in docs.collect())}
