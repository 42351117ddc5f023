"""The pipeline's stages in order, each on what the one before kept."""

import corpus_pipeline
import pytest


def test_stages(spark, odd_docs, no_docs):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.common.saved(stage(spark, docs, data), f"test-{name}")
        assert docs.columns == columns
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0.5 * kept[0]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "packing"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert packed.select("doc_id").distinct().count() == kept[-1]


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_odd_rows(spark, odd_docs, no_docs, stage):
    assert stage(spark, odd_docs, "/root/testdata/sf0.001").count() > 0
    assert stage(spark, no_docs, "/root/testdata/sf0.001").count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    """All stages on planted documents: which rows and texts are left, worked out here without the operators."""
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    text = lambda n: [word() for _ in range(n)]
    rude = ["blockhead", "nincompoop", "dunderhead"]
    item = text(25)
    rows, labels, want = [], [], {}

    def add(number, words, stays, lines=()):
        body = " ".join(words)
        rows.append((number, "\n".join([*lines, body])))
        if stays:
            want[number] = body

    for d in range(400):
        words = text(60)
        toxic = d % 4 == 0
        for _ in range(4 if toxic else 0):
            words[rng.randrange(60)] = rng.choice(rude)
        add(d, words, not toxic, [f"Page {d} of the long list", "Read more"])
        labels.append((d, 1, int(toxic)))
    want[1] = "Page 1 of the long list\nRead more\n" + want[1]  # the first clean document keeps the recurring lines
    for n in range(30):
        base = text(100)
        for k in range(3):
            words = base.copy()
            for _ in range(k):
                words[rng.randrange(100)] = word()
            sets = [{tuple(w[i : i + 5]) for i in range(96)} for w in (base, words)]
            assert len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])
            add(1000 + 10 * n + k, words, k == 0)
    for n in range(20):
        held = item.copy()
        for i in rng.sample(range(25), n % 5):
            held[i] = word()
        add(2000 + n, text(30) + held + text(30), False)
        add(3000 + n, text(30) + item[:12] + text(30), True)
    same = text(70)
    rows += [(None, " ".join(same)), (5000, " ".join(same)), (5001, None), (5002, ""), (2000, " ".join(other := text(50)))]
    want |= {5000: " ".join(same)}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids) + 1
    expected = sorted([(i, size(t)) for i, t in want.items()] + [(5001, 1), (2000, size(" ".join(other)))])
    assert sorted((r.doc_id, r.length) for r in packed) == expected
    fill = {}
    for r in packed:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in fill.values():
        assert all(o == sum(n for p, n in parts if p < o) for o, _ in parts) and sum(n for _, n in parts) <= 2048
    assert len(fill) <= -(-sum(r.length for r in packed) // 2048) + 1
