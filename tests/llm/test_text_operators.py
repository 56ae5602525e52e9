"""Edge rows and brute force for the operators on documents."""

import tracemalloc
import zlib
from collections import Counter
from itertools import groupby

import numpy as np
import pytest
from tokenizers import Tokenizer

from churnlab.llm import binary_ids, licenses, lm_scoring, ngram_join, packing, substring_dedup, toxicity, word_bpe
from churnlab.llm.common import shared_folder, shingle_hashes, words_of

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(9000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
SCHEMA = "doc_id long, text string, _text string, rank int, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, clashing names."""
    near = " ".join(f"base{i}" for i in range(100))
    texts = [
        (1, near), (2, near), (3, near.replace("base50", "other")), (4, None), (5, ""), (6, " \n\t "),
        (7, "one two"), (8, "One TWO"), (9, LONG), (10, f"first words here {PASSAGE} and an end"),
        (11, f"quite another start {PASSAGE} then something else"), (12, "a  b\n\n c <|endoftext|> d\x1c!"),
        (12, "a  b\n\n c <|endoftext|> d\x1c!"), (None, "no id at all"), (13, "Released under the MIT Licence!!\nCopyright 2020 X"),
    ]
    return spark.createDataFrame([(i, t, "x", 1, 7) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_binary_ids_round_trip(spark, docs, empty, tokenizer_file):
    file = tokenizer_file("byte_bpe_50k.json")
    t = Tokenizer.from_file(file)
    manifest = binary_ids.write_ids(docs, file, shared_folder(spark), end_id=2, frame_bytes=4096)
    rows = binary_ids.read_ids(manifest).collect()
    want = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    start = 0
    got = sorted(rows, key=lambda r: r.start)
    assert len(got) == len(want)
    for r, (known, doc_id, text) in zip(got, want):
        ids = [*ids_of(t, text), 2]
        assert (r.doc_id, r.start, r.n_tokens) == (doc_id if known else None, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert [r.doc_id for r in binary_ids.read_ids(manifest, [9]).collect()] == [9]
    assert binary_ids.read_ids(binary_ids.write_ids(empty, file, shared_folder(spark), end_id=2)).count() == 0


def test_packing_holds_every_id_once(docs, empty, tokenizer_file):
    file = tokenizer_file("byte_bpe_50k.json")
    t = Tokenizer.from_file(file)
    rows = packing.pack(docs, file, end_id=1).collect()
    whole = sorted(len(ids_of(t, r.text)) + 1 for r in docs.collect())
    assert sorted(r.doc_tokens for r in rows if r.start == 0) == whole
    assert sum(r.length for r in rows) == sum(whole)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(empty, file, end_id=1).count() == 0


def test_plan_holds_exactly_the_demand():
    rng = np.random.default_rng(0)
    sizes = np.arange(1, 65)
    demand = rng.integers(0, 200, 64)
    plan = packing.plan_sequences(sizes[demand > 0], demand[demand > 0], 64)
    assert (sum(n * p for n, p in plan) == demand[demand > 0]).all()
    assert all((p * sizes[demand > 0]).sum() <= 64 for _, p in plan)
    assert sum(n for n, _ in plan) <= 1.05 * (demand * sizes).sum() / 64 + 1


def test_word_bpe_equals_the_library(docs, empty, tokenizer_file):
    file = tokenizer_file("word_bpe_49k.json")
    t, own = Tokenizer.from_file(file), word_bpe.word_bpe(file)
    t.no_padding(), t.no_truncation()
    texts = [r.text for r in docs.collect()] + ["ΑΣ İstanbul é", "don't we'll <|startoftext|>Hi<|endoftext|>x", "日本語 😀😀", "a" * 3000]
    for text, (ids, decoded, n) in zip(texts, own.texts_of(texts)):
        want = ids_of(t, text)
        assert " ".join(ids) == " ".join(map(str, want)) and n == len(want)
        assert " ".join(decoded) == t.decode(want, skip_special_tokens=False)
    assert word_bpe.encode_and_decode(docs, file).count() == docs.count()
    assert word_bpe.encode_and_decode(empty, file).count() == 0


def test_licenses(spark, docs, empty):
    known = licenses.known_digests(spark)
    assert [(r.doc_id, r.unit, r.license_id) for r in licenses.scan(docs.filter("doc_id = 13"), known).orderBy("unit").collect()] == [
        (13, "document", "mit-notice"), (13, "line", "mit-notice"), (13, "paragraph", "mit-notice")
    ]
    assert licenses.scan(docs, known).count() == 3 and licenses.scan(empty, known).count() == 0


def test_lm_scores(docs, empty):
    rows = lm_scoring.score(docs, chunk_words=2000).collect()
    assert len(rows) == docs.count() and {r.mean_log_score is None for r in rows if r.n_words == 0} == {True}
    one = lm_scoring.score(docs).collect()
    key = lambda r: (str(r.doc_id), r.n_words, None if r.mean_log_score is None else round(r.mean_log_score, 9))
    assert sorted(map(key, rows), key=str) == sorted(map(key, one), key=str)
    assert lm_scoring.score(empty).count() == 0


def test_lm_counts_in_parts_of_whole_documents():
    """The memory for taking a document's own counts off doesn't grow with the chunk."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, n)) for n in (40, 0, 3, 1, 900) * 800] + [None, "a a a"]
    grams = lm_scoring.ChunkGrams(texts)
    for size in (1, 1000, 10**9):
        parts = grams.parts(size)
        assert [x for k in parts for x in range(k.start, k.stop)] == list(range(len(grams.words)))
        assert all(k.start == 0 or grams.doc[k.start - 1] < grams.doc[k.start] for k in parts)
    _, counts = np.unique(grams.grams(2)[1], return_counts=True)
    tracemalloc.start()
    seen = grams.others(2, counts)
    peak = tracemalloc.get_traced_memory()[1] / len(grams.words)
    tracemalloc.stop()
    pairs = [tuple(t.split()[i : i + 2]) for t in texts if t for i in range(len(t.split()) - 1)]
    every = Counter(pairs)
    own = [Counter(zip(t.split(), t.split()[1:])) for t in texts if t]
    want = [x for t, c in zip([t for t in texts if t], own) for x in [0, *(every[p] - c[p] for p in zip(t.split(), t.split()[1:]))]]
    assert seen.tolist() == want and peak < 90, peak


def test_ngram_join(docs, empty):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect()}
    assert {(1, 96, 1), (2, 96, 1), (3, 96, 1), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 1, 7), (8, 1, 7), (None, 1, None)} <= got
    assert ngram_join.join(empty).count() == 0
    kept = ngram_join.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 4, 5, 6, 7, 9, 10, 12, 13, None]))
    assert ngram_join.deduplicated(empty).count() == 0


def test_frequent_and_rare_classes_find_the_same_links(docs, monkeypatch):
    """Whatever is frequent, both sides of every linked pair share a key."""
    rng = np.random.default_rng(3)
    for n in (6, 20, 60, 150, 400):
        x = np.unique(rng.integers(1, 1 << 62, n).astype(np.uint64))
        for _ in range(20):
            gone = rng.choice(len(x), ngram_join.misses(len(x)) // 2, replace=False)
            y = np.unique(np.concatenate([np.delete(x, gone), rng.integers(1, 1 << 62, len(gone)).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            if 100 * both < 80 * (len(x) + len(y) - both) or both == len(x):
                continue
            for share in (0, 0.5, 0.9, 1):
                frequent = np.unique(rng.choice(np.union1d(x, y), int(share * len(np.union1d(x, y))), replace=False))
                kx, ky = (ngram_join.index_keys(s, frequent, rng.permutation(0) if not len(frequent) else np.argsort(frequent)) for s in (x, y))
                assert np.intersect1d(kx[0], ky[0]).size or np.intersect1d(kx[1], ky[1]).size
            assert ngram_join.differ_at_least(ngram_join.parities(x), ngram_join.parities(y)) <= len(x) + len(y) - 2 * both


def test_substring_dedup(docs, empty):
    rows = {(r.doc_id, r.match_id): r for r in substring_dedup.passages(docs).collect()}
    r = rows[11, 10]
    assert (r.start_word, r.end_word, r.match_start, r.match_end) == (3, 63, 3, 63)
    assert {(2, 1), (3, 1), (11, 10)} <= set(rows) and all(a > b for a, b in rows)
    cut = {x.doc_id: x.text for x in substring_dedup.without_repeats(docs).filter("doc_id > 0").collect()}
    assert cut[11] == "quite another start then something else" and cut[2] == "" and cut[9] == LONG
    assert substring_dedup.without_repeats(docs).count() == docs.count()
    assert substring_dedup.passages(empty).count() == 0 and substring_dedup.without_repeats(empty).count() == 0


def test_compact_windows_cover_each_run_once():
    h = np.random.default_rng(1).integers(0, 1000, 200).astype(np.uint64)
    found = substring_dedup.compact_windows(h, 20)
    for a in range(0, 181):
        for b in (a + 19, min(199, a + 50)):
            inside = [(x, c, y) for x, c, y in found if x <= a <= c <= b <= y]
            assert len(inside) == 1 and h[inside[0][1]] == h[a : b + 1].min()


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels.filter(f"NOT ({toxicity.HELD_OUT})"))
    held = docs.join(labels.filter(toxicity.HELD_OUT), "doc_id")
    rows = toxicity.score(held.select("doc_id", "text", "toxic"), model).collect()
    right = np.mean([(r.score >= 0.5) == (r.toxic == 1) for r in rows])
    assert right >= 0.95
    text = next(r.text for r in rows if r.toxic == 1 and r.score > 0.5)
    assert all(text[b:e].strip() and p >= 0.5 for b, e, p in model.spans(text)) and model.spans(text)


def test_toxicity_edges(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    assert {r.score for r in toxicity.score(docs, model, with_spans=True).collect()} == {0.0}
    assert toxicity.keep_below(docs, model, 0.5).columns == docs.columns
    assert toxicity.keep_below(docs, model, 0.5).count() == docs.count()
    assert toxicity.score(empty, model).count() == 0


def test_shingles():
    assert words_of("A b\x1cC\tE") == [b"a", b"b\x1cc", b"e"]
    assert len(shingle_hashes(words_of("a b c d e f"))) == 2 and len(shingle_hashes(words_of("a"))) == 1


def words(rng, n):
    return [f"r{x}" for x in rng.integers(0, 1 << 40, n)]


def test_substring_dedup_around_a_common_run(spark):
    """A passage of two documents of which most is a run that many others hold, ids between theirs."""
    rng = np.random.default_rng(5)
    common = words(rng, 40)
    shared = [words(rng, 10) for _ in range(20)]
    texts = [(i, words(rng, 30) + common + words(rng, 30)) for i in range(0, 400, 2)]
    for p, after in enumerate(shared):
        texts += [(i, words(rng, 30) + common + after + words(rng, 30)) for i in (20 * p + 1, 20 * p + 11)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string").repartition(3)
    rows = {(r.doc_id, r.match_id): r for r in substring_dedup.passages(docs).collect()}
    assert set(rows) == {(20 * p + 11, 20 * p + 1) for p in range(20)}
    assert all((r.start_word, r.end_word, r.match_start, r.match_end) == (30, 80, 30, 80) for r in rows.values())


def test_windows_without_a_partner_are_written_once(spark):
    """Of the windows of large groups only one side is filled: the other took disk for nothing."""
    line = " ".join(f"common{i}" for i in range(60))
    rows = [(i, f"{' '.join(f'own{i}x{k}' for k in range(20))} {line}", None) for i in range(1, 101)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone array<binary>").coalesce(1)
    kinds = {}
    for r in substring_dedup.met(substring_dedup.windows(docs), 4).collect():
        kinds.setdefault(r.kind, []).append(r)
    assert {1, 2, 3, 4} <= set(kinds)
    assert all((r.b, r.cb, r.lb, r.rb) == (0, 0, 0, 0) and r.ra > r.la for r in kinds[1])
    assert all((r.a, r.ca, r.la, r.ra) == (0, 0, 0, 0) and r.rb > r.lb for k in (2, 3) for r in kinds[k])


def test_substring_dedup_of_near_copies(spark):
    """Passages with a word or two changed (Jaccard 0.8 to 0.9), against brute force over all pairs."""
    rng = np.random.default_rng(6)
    texts = []
    for p in range(200):
        one = words(rng, 60 if p % 2 else 100)
        two = list(one)
        for at in [30] if p % 2 else [33, 66]:
            two[at] = "changed"
        texts += [words(rng, 20) + w + words(rng, 20) for w in (one, two)]
    tokens = [shingle_hashes([x.encode() for x in w]) for w in texts]
    holders = {}
    for i, s in enumerate(tokens):
        for x in s.tolist():
            holders.setdefault(x, []).append(i)
    near = {(a, b) for held in holders.values() for a in held for b in held if a < b}
    anchors = lambda a, b: [(i, j) for i, x in enumerate(tokens[a].tolist()) for j in np.flatnonzero(tokens[b] == x).tolist()]
    want = {(b, a) for a, b in near if substring_dedup.verify(tokens[a], tokens[b], anchors(a, b))}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = substring_dedup.passages(docs).collect()
    assert len(want) == 200 and {(r.doc_id, r.match_id) for r in got} == want
    assert all(0.8 <= r.similarity <= 0.9 for r in got)


def test_substring_dedup_of_near_passages_around_a_common_run(spark):
    """20 pairs that share no run of 46 shingles, of which most is a run that 200 others hold."""
    rng = np.random.default_rng(8)
    common = words(rng, 40)
    texts = [(i, words(rng, 30) + common + words(rng, 30)) for i in range(0, 400, 2)]
    for p in range(20):
        before, after = words(rng, 4), words(rng, 40)
        texts += [(i, words(rng, 30) + common + before + words(rng, 1) + after + words(rng, 30)) for i in (20 * p + 1, 20 * p + 11)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string").repartition(3)
    rows = {(r.doc_id, r.match_id): r for r in substring_dedup.passages(docs).collect()}
    assert set(rows) == {(20 * p + 11, 20 * p + 1) for p in range(20)}
    assert all((r.start_word, r.end_word, r.match_start, r.match_end) == (30, 115, 30, 115) for r in rows.values())


@pytest.mark.parametrize("block", [1000, 7])
def test_substring_dedup_of_near_passages_of_common_runs_only(spark, monkeypatch, block):
    """Two runs that 150 others each hold, beside one another in ten documents with
    another word between them: every signature of these passages is of a large group."""
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    rng = np.random.default_rng(9)
    one, two = words(rng, 40), words(rng, 40)
    texts = [(i, words(rng, 30) + (two if i % 4 else one) + words(rng, 30)) for i in range(0, 600, 2)]
    both = [55 * p + 21 for p in range(0, 20, 2)]
    texts += [(i, words(rng, 30) + one + words(rng, 1) + two + words(rng, 30)) for i in both]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string").repartition(3)
    rows = {(r.doc_id, r.match_id): r for r in substring_dedup.passages(docs).collect()}
    assert set(rows) == {(b, a) for a in both for b in both if a < b}
    assert all((r.start_word, r.end_word, r.match_start, r.match_end) == (30, 111, 30, 111) for r in rows.values())


def test_substring_dedup_reports_the_first_of_equal_documents(spark):
    """Rows in descending id order: 2 and 5 are equal, 3 shares a passage with them."""
    rng = np.random.default_rng(7)
    passage, end = words(rng, 60), words(rng, 30)
    whole, other = " ".join(words(rng, 30) + passage), " ".join(passage + end)
    docs = spark.createDataFrame([(5, whole), (3, other), (2, whole)], "doc_id long, text string").coalesce(1)
    rows = [tuple(r)[:6] for r in substring_dedup.passages(docs).collect()]
    assert sorted(rows) == [(3, 0, 60, 2, 30, 90), (5, 0, 90, 2, 0, 90)]
    cut = {r.doc_id: r.text for r in substring_dedup.without_repeats(docs).collect()}
    assert cut == {2: whole, 3: " ".join(end), 5: ""}


def test_whole_licenses_at_two_wrappings(spark):
    """Each whole licence as it is and with other line ends, notices of copyright on lines of their own."""
    import re
    import textwrap

    def wrapped(text, width):
        out = []
        for notice, lines in groupby(text.splitlines(), lambda x: bool(re.match(r"\W*copyright (\(c\)|\[)", x, re.I)) or not x.strip()):
            out += lines if notice else textwrap.wrap(" ".join(lines), width, break_long_words=False, break_on_hyphens=False)
        return "\n".join(out)

    texts = licenses.whole_texts()
    assert len({name for name, _ in texts}) == 18
    rows = [(i, f(text)) for i, (_, text) in enumerate(texts) for f in (lambda t: t, lambda t: wrapped(t, 61), lambda t: wrapped(t, 72))]
    docs = spark.createDataFrame([(3 * i + k % 3, t) for k, (i, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(docs, licenses.known_digests(spark)).filter("unit = 'document'").collect()}
    assert got == {3 * i + k: name for i, (name, _) in enumerate(texts) for k in range(3)}
    isc = licenses.KNOWN["isc"].replace("above copyright", "above\ncopyright")
    one = spark.createDataFrame([(1, f"Copyright 2020 X\n(c) 2021 Y\n{isc}")], "doc_id long, text string")
    assert ("document", "isc") in {(r.unit, r.license_id) for r in licenses.scan(one, licenses.known_digests(spark)).collect()}
