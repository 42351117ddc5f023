"""Counts and packing against the tokenizers library and a simple packer."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomtrace.llm import packing, token_count

BYTES, WORDS = (str(public_tokenizers.path(x)) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXT = st.text(alphabet=st.one_of(st.sampled_from("ab thein'.,<|>\n\t \x1c éÉßΣσ日🙂0123_-"), st.characters(codec="utf-8")), max_size=200)


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)


def test_counts_of_odd_texts(libraries):
    for t in ["", " ", "a" * 3000, "x<|endoftext|><|endoftext|>y", "don't  stop\n\n x", "日本語 🙂", "abab" * 500]:
        assert token_count.counter(BYTES)(t) == len(libraries[0].encode(t, add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(TEXT, max_size=5))
def test_against_library(libraries, texts):
    for t in texts:
        assert token_count.counter(BYTES)(t) == len(libraries[0].encode(t, add_special_tokens=False).ids)
    ids = packing.word_ids(WORDS).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [libraries[1].encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_of_many_texts(libraries):
    """Capital dotted i, combining marks and special strings in both cases, before stops and between other signs."""
    import random

    rng = random.Random(17)
    parts = ["\u0130", "NAS\u0130", "I\u0307", "J\u030c", "H\u0331", "T\u0308", "e\u0301", "\u0301", ".", ",", ". ", ", ", " ", "\n", "\x1c", "<|endoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|startoftext|>", "<|", "|>", "Word", "the", "\u03a3", "It's", "7", "_", "\u00e9", "\u65e5", "!", "\u00df", "\u212a"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(20_000)]
    ids = packing.word_ids(WORDS).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [e.ids for e in libraries[1].encode_batch(texts, add_special_tokens=False)]


def test_remembered_words_are_bounded_by_a_text(libraries, monkeypatch):
    """Forgetting goes text by text: a batch of new words never stands whole in memory, and identifiers stay the library's."""
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    texts = [" ".join(f"w{i}x{k}," for k in range(20)) for i in range(40)]
    words = packing.WordIds(WORDS)
    library = Tokenizer.from_file(WORDS)
    assert words.encode(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert len(words.known) <= 50 + 21


def test_token_counts_odd(spark, odd_docs, no_docs, libraries):
    out = token_count.token_counts(odd_docs, BYTES, over=1024).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(libraries[0].encode(r.text or "", add_special_tokens=False).ids)) for r in odd_docs.collect()]
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in out), key=key) == sorted(want, key=key)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in out)
    assert token_count.token_counts(no_docs, BYTES).count() == 0


def check_packing(rows, texts, library, room):
    fill = {}
    for r in rows:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= room
    for doc_id, text in texts.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == doc_id)
        assert own == [(k // room, k, len(p := ids[k : k + room]), zlib.crc32(np.array(p, "<u4").tobytes())) for k in range(0, len(ids), room)]
    return len(fill)


def test_packing(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(docs, WORDS).collect()
    n = check_packing(rows, {r.doc_id: r.text for r in docs.collect()}, libraries[1], 2048)
    assert n <= -(-sum(r.length for r in rows) // 2048) * 1.03 + 1


def test_packing_odd(spark, odd_docs, no_docs, libraries):
    rows = packing.pack(odd_docs.where("doc_id > 1"), WORDS, room=64).collect()
    check_packing(rows, {r.doc_id: r.text for r in odd_docs.where("doc_id > 1").collect()}, libraries[1], 64)
    assert packing.pack(odd_docs, WORDS, room=64).select("doc_id").where("doc_id IS NULL").count() == 2
    assert packing.pack(no_docs, WORDS).count() == 0


def best_fit(lengths, room):
    """Number of bins of best fit, longest first."""
    bins = []
    for n in sorted(lengths, reverse=True):
        b = min((b for b in bins if b[0] >= n), default=None)
        if b is None:
            bins.append(b := [room])
        b[0] -= n
    return len(bins)


def filled(matches, room):
    found = {}
    for _, rank, number, first, offset, length in sorted((m[4], m[1], m[2], m[3], m[4], m[0]) for m in matches):
        for s in range(first, first + number):
            assert found.get(s, 0) == offset
            found[s] = offset + length
    assert all(x <= room for x in found.values())
    return found


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_sweep_of_one_range(lengths):
    """With as many empty sequences as best fit opens and the rest of them behind, every piece finds its place and none is lost."""
    counts = [(n, 0, lengths.count(n)) for n in set(lengths)]
    matches, over, gaps = packing.sweep(counts, [(50, 0, len(lengths))], 50)
    assert not over and sum(m[2] for m in matches) == len(lengths)
    assert len(filled(matches, 50)) + sum(n for g, _, n in gaps if g == 50) == len(lengths)
    few, over, _ = packing.sweep(counts, [(20, 0, 3), (30, 3, 2)], 50)
    assert sum(m[2] for m in few) + sum(n for _, _, n in over) == len(lengths) and all(m[0] <= 50 - m[4] for m in few)


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_need_as_few_sequences_as_best_fit(spark, seed):
    import random

    rng = random.Random(seed)
    lengths = [min(2048, int(rng.lognormvariate(5.5, 1.2)) + 1) if seed == 1 else rng.choice([2048, 1500, 700, 600, 340, 33, 5]) for _ in range(3000)]
    counts = spark.createDataFrame(sorted((n, lengths.count(n)) for n in set(lengths)), "length long, number long")
    matches = [(r.length, r.rank, r.number, r.first, 2048 - r.gap) for r in packing.swept(counts).where("kind = 'match'").collect()]
    placed = {n: sorted((m[1], m[2]) for m in matches if m[0] == n) for n in set(lengths)}
    assert all(sum(k for _, k in runs) == lengths.count(n) and all(a + k == b for (a, k), (b, _) in zip(runs, runs[1:])) for n, runs in placed.items())
    assert len(filled(matches, 2048)) <= best_fit(lengths, 2048) * 1.005 + 1
