"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, for every operator."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfwise.llm import boosting, bpe_tree, fertility, graph_dedup, licenses, minhash, packing, revisits, sharding, toxicity, vocab

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, block int, key string, n int, hub long, label int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "x", 1, "k", 2, 3, 4) for i, t in rows], SCHEMA)


WORDS = " ".join(f"word{i % 97} some{i % 31}" for i in range(400))
ROWS = [(1, WORDS), (2, WORDS), (2, WORDS), (3, None), (4, ""), (None, "null id text"), (5, " \t\n"), (6, "a"), (7, "x" * 60_000), (8, "naïve café – “quoted” 日本語 <|endoftext|> end"), (9, "double  spaces \n and more '' 's")]


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, ROWS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, []).cache()


def test_sharding(spark, docs, none):
    got = sharding.shuffle_shards(docs, shards=3).collect()
    assert len(got) == len(ROWS) and sharding.shuffle_shards(none).count() == 0
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ROWS}
    again = sharding.shuffle_shards(docs.repartition(7), shards=3).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


@pytest.mark.parametrize("n", [1, 2, 5, 64, 65, 1000])
def test_feistel_is_a_permutation(n):
    assert sorted(sharding.feistel(np.arange(n), n, 3).tolist()) == list(range(n))


def best_bins(lengths, capacity):
    """Exact bin packing for a handful of pieces."""
    best, lengths = [len(lengths)], sorted(lengths, reverse=True)

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] + lengths[k] <= capacity:
                go(k + 1, [*bins[:i], bins[i] + lengths[k], *bins[i + 1 :]])
        go(k + 1, [*bins, lengths[k]])

    go(0, [])
    return best[0]


def test_dominance_keeps_an_optimum():
    rng = np.random.default_rng(0)
    for _ in range(150):
        capacity = int(rng.integers(8, 30))
        lengths = rng.integers(1, capacity + 1, rng.integers(1, 10))
        fixed, rest = packing.reduce_dominant(np.bincount(lengths, minlength=capacity + 1), capacity)
        left = np.repeat(np.arange(capacity + 1), rest).tolist()
        used = sum(t for _, t in fixed)
        assert all(sum(s) <= capacity for s, _ in fixed)
        assert used + (best_bins(left, capacity) if left else 0) == best_bins(lengths.tolist(), capacity)


def test_packing(spark, docs, none):
    got = packing.pack_documents(docs, capacity=64).collect()
    assert packing.pack_documents(none).count() == 0
    full = Tokenizer.from_file(vocab.tokenizer_path("byte_bpe_50k.json"))
    for doc_id, text in ROWS:
        ids = np.array([*full.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = {}
        for r in got:
            if r.doc_id == doc_id:
                own.setdefault(r.piece, []).append(r)
        assert sum(v[0].length for v in own.values()) == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for v in own.values() for r in v)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 64


def test_bpe_tree(spark, docs, none):
    path = vocab.tokenizer_path("word_bpe_49k.json")
    full = Tokenizer.from_file(path)
    for leaf, part in ((50, 1000), (bpe_tree.LEAF, 2048), (bpe_tree.LEAF, bpe_tree.PART)):
        got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_tree.encode_decode(docs, leaf=leaf, part=part).collect()}
        want = set()
        for i, t in ROWS:
            ids = full.encode(t or "", add_special_tokens=False).ids
            want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(full.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert got == want
    assert bpe_tree.encode_decode(none).count() == 0


def test_bpe_joins_decide_tokens():
    """Leaves cut through words: the joins mend them, for any leaf; counted against encoding the leaves alone."""
    path = vocab.tokenizer_path("word_bpe_49k.json")
    full, cache = Tokenizer.from_file(path), bpe_tree._chunks(path)
    rng = np.random.default_rng(5)
    alphabet = list("aabcdeéÄßfgh  '’s12—日本́\n\t\u00a0") + ["<|endoftext|>", "'ll", "\r\n", "  ", " the "]
    mended = 0
    for k in range(300):
        text = "".join(rng.choice(alphabet, int(rng.integers(1, 400)))) if k % 3 else "".join(rng.choice(list("abcdefgh"), 700)) + " x " + "y" * 300
        want = full.encode(text, add_special_tokens=False)
        for leaf in (7, 40, 512):
            items = [x for x in bpe_tree.encode_items(cache, text, leaf) if x[2]]
            assert " ".join(x[0] for x in items) == " ".join(map(str, want.ids)) and " ".join(x[1] for x in items) == full.decode(want.ids, skip_special_tokens=False)
            ends = bpe_tree.cut_points(len(text), leaf)
            alone = [i for a, b in zip([0, *ends[:-1]], ends) for i in full.encode(text[a:b], add_special_tokens=False).ids]
            mended += alone != want.ids
    assert mended > 500


def test_bpe_parts_of_long_texts(spark):
    """Texts over many parts: words, one unsplit run, a run that begins and ends inside parts, white space only."""
    full = Tokenizer.from_file(vocab.tokenizer_path("word_bpe_49k.json"))
    rng = np.random.default_rng(9)
    run = "".join(rng.choice(list("abcdeéß日"), 3000))
    texts = ["\n".join([WORDS, run, WORDS]), run * 2, " " * 5000, WORDS.replace(" ", "\t"), "a" + " " * 3000 + "b " + run[:700], WORDS * 3]
    docs = documents(spark, list(enumerate(texts)))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_tree.encode_decode(docs, leaf=60, part=500).collect()}
    for k, text in enumerate(texts):
        ids = full.encode(text, add_special_tokens=False).ids
        assert got[k] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(full.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_fertility(spark, docs, none):
    got = {r.doc_id: r for r in fertility.quality_rules(docs).collect()}
    assert fertility.quality_rules(none).count() == 0
    assert got[3].n_words == 0 and got[3].base_failed and not got[3].kept and got[7].n_words == 1
    flags = documents(spark, [(1, "a b c d\nx\nx\n\n\n a b c")]).transform(fertility.quality_rules).first()
    assert (flags.n_words, flags.n_dup_lines, flags.n_repeat_words) == (9, 1, 6)
    junk = " ".join(f"{i:x}#$%" for i in range(1000, 1200))
    prose = "The committee has published another report about growth of regional markets since last winter, when farmers and traders met near a small town to discuss prices. Some members said that roads were still too narrow for heavy lorries; others asked why ships could not carry grain instead. By evening nobody had found an answer, yet everyone agreed on one thing: waiting longer would only make matters worse."
    kept = {r.doc_id: r.kept for r in fertility.quality_rules(documents(spark, [(1, junk), (2, prose)])).collect()}
    assert kept == {1: False, 2: True}
    assert [r.doc_id for r in documents(spark, [(1, junk), (2, prose), (3, None)]).where(fertility.keeps()(F.col("text"))).collect()] == [2]


def test_near_duplicates(spark, docs, none):
    how = minhash.Similarity(width=3, percent=85, bands=21, rows=6)
    got = minhash.near_duplicates(docs, how).collect()
    assert len(got) == len(ROWS) and minhash.near_duplicates(none, how).count() == 0
    assert {(r.doc_id, r.component_id, r.kept) for r in got if r.doc_id in (1, 2)} == {(1, 1, True), (2, 1, False)}
    assert {(r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None} == {(1, None, True)}
    assert {r.n_shingles for r in got if r.doc_id in (3, 4, 5)} == {0}
    assert sorted(r.doc_id for r in minhash.without_near_duplicates(docs).collect() if r.doc_id) == [1, 3, 4, 5, 6, 7, 8, 9]


@pytest.mark.parametrize("block", [4, 128])
def test_near_duplicates_match_brute_force(spark, block):
    """A family with a common base and random edits, larger than a block, next to unrelated texts."""
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in rng.integers(0, 5000, 150)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.integers(0, len(words), rng.integers(0, 9)):
            words[at] = f"e{rng.integers(1_000_000)}"
        rows.append((i * 3 + 1, " ".join(words)))
    rows += [(1000 + i, " ".join(f"u{x}" for x in rng.integers(0, 5000, 120))) for i in range(30)]
    sets = {i: set(zip(*(t.split()[k:] for k in range(3)))) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    how = minhash.Similarity(width=3, percent=85, bands=21, rows=6, block=block)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, rows), how).collect()}
    assert got == {i: root(i) for i in sets}


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    whole = rng.integers(0, 2**63, 400, dtype=np.uint64)
    a, b = np.unique(whole[:300]), np.unique(whole[100:])
    signatures = minhash.super_minhash(np.concatenate([a, b, a[:1]]), np.repeat([0, 1, 2], [len(a), len(b), 1]), 3, 126)
    assert abs((signatures[0] == signatures[1]).mean() - 0.5) < 0.15
    assert (signatures[2] < np.uint64(2**63)).all() and len(set(signatures[2].tolist())) == 126


def test_licenses(spark, none):
    apache = 'Copyright 2020 Someone\nLicensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
    rows = [(1, apache), (2, "Words.\nReleased under the MIT License.\nMore words. Licensed under CC BY-NC 4.0."), (3, None), (4, "You may obtain a copy of the License at"), (None, "Licensed under the Apache License, Version 2.0.")]
    got = {r.doc_id: (r.rules, r.licenses) for r in licenses.scan_licenses(documents(spark, rows)).collect()}
    assert got == {1: ("apache_header", "Apache-2.0"), 2: ("mit_reference,cc_by_nc_reference", "MIT,CC-BY-NC-4.0"), 3: ("", ""), 4: ("", ""), None: ("apache_reference", "Apache-2.0")}
    assert licenses.scan_licenses(none).count() == 0


def test_revisits(spark):
    schema = "record_id long, target_uri string, captured_at long, record_type string, status int, headers map<string,string>, url string, part int, response string"
    rows = [
        (1, "http://www.Example.com/a/#x", 10, "response", 200, {"ETag": '"1"', "Content-Length": "9", "Cache-Control": "a"}), (2, "https://example.com/a?utm_source=y", 20, "revisit", 304, {"etag": 'W/"1"', "Cache-Control": "b", "Content-Length": "0"}),
        (3, "example.com/a/", 30, "response", 200, {"Last-Modified": "m"}), (4, "example.com/a", 31, "revisit", 304, {"Last-Modified": "n"}), (5, "example.com/a", 31, "revisit", 304, None), (5, "example.com/a", 31, "revisit", 304, None),
        (6, "example.com/b", 5, "revisit", 304, {}), (7, None, 5, "revisit", 304, {}), (8, "example.com/a", None, "response", 200, {}), (9, "example.com/a", 40, "response", 404, {}), (10, "example.com/a", 50, "revisit", 304, {}),
    ]
    got = revisits.resolve_revisits(spark.createDataFrame([(*r, "u", 1, "z") for r in rows], schema)).collect()
    seen = sorted((r.record_id, r.response_id, r.verdict, tuple(sorted((r.merged_headers or {}).items()))) for r in got if r.response_id)
    kept = (("last-modified", "m"),)
    assert seen == [(2, 1, "match", (("cache-control", "b"), ("content-length", "9"), ("etag", 'W/"1"'))), (4, 3, "mismatch", ()), (5, 3, "no_validator", kept), (5, 3, "no_validator", kept), (10, 3, "no_validator", kept)]
    assert sorted(r.record_id for r in got if r.verdict == "no_response") == [6, 7]
    assert revisits.resolve_revisits(spark.createDataFrame([], schema)).count() == 0


def test_revisits_with_empty_urls_and_long_headers(spark):
    many = {f"X-Field-{k}": "v" * 50 for k in range(2000)}
    rows = [(1, "", 1, "response", 200, many), (2, "", 2, "revisit", 304, {"Date": "now", "X-New": "no"}), (2, "", 2, "revisit", 304, {"Date": "now", "X-New": "no"}), (3, "x" * 9000, 3, "revisit", 304, many)]
    got = revisits.resolve_revisits(spark.createDataFrame(rows, "record_id long, target_uri string, captured_at long, record_type string, status int, headers map<string,string>")).collect()
    assert sorted((r.record_id, r.response_id, r.verdict) for r in got if r.response_id) == [(2, 1, "no_validator")] * 2
    assert all(len(r.merged_headers) == 2001 and r.merged_headers["date"] == "now" for r in got if r.response_id)
    assert [r.verdict for r in got if r.record_id == 3] == ["no_response"]


def test_revisits_of_one_hot_url_cross_partitions(spark):
    """Brute force over one URL with many captures, dealt over many partitions."""
    rng = np.random.default_rng(2)
    rows = [(i, "example.com/hot" if i % 3 else f"example.com/{i % 7}", int(rng.integers(0, 200)), "response" if rng.random() < 0.15 else "revisit", 200, {}) for i in range(600)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.record_id: r.response_id for r in revisits.resolve_revisits(spark.createDataFrame(rows, "record_id long, target_uri string, captured_at long, record_type string, status int, headers map<string,string>").repartition(9)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for i, uri, at, kind, *_ in rows:
        if kind == "revisit":
            before = [(a, j) for j, u, a, k, *_ in rows if k == "response" and u == uri and (a, j) < (at, i)]
            assert got[i] == (max(before)[1] if before else None)


def test_vector_graph(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16))
    x[100:160] = x[100] + 0.05 * rng.normal(size=(60, 16))
    x[300:310] = x[300]
    rows = [(i, [float(v) for v in np.float32(v_)], 1, "c", 2) for i, v_ in enumerate(x)] + [(700, None, 1, "c", 2), (701, [0.0] * 16, 1, "c", 2), (702, [float("nan")] * 16, 1, "c", 2), (703, [None] * 16, 1, "c", 2), (704, [1.0, 2.0], 1, "c", 2), (705, [], 1, "c", 2), (None, [1.0] * 16, 1, "c", 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, shard string, n int")
    how = graph_dedup.Graph(shard_rows=60, part_rows=80)
    got = {r.vec_id: r for r in graph_dedup.near_vectors(df, how).collect()}
    unit = np.float32(x).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.9
    np.fill_diagonal(links, False)
    found = np.array([got[i].n_links for i in range(600)])
    assert (found <= links.sum(1)).all() and found.sum() >= 0.95 * links.sum()
    assert len({got[i].component_id for i in range(100, 160)}) == 1 and got[305].component_id == 300 and not got[305].kept
    assert all(got[i].n_links == 0 and got[i].kept for i in (700, 701, 702, 703, 704, 705)) and got[None].component_id is None
    assert graph_dedup.near_vectors(df.limit(0)).count() == 0


def labelled(spark, good, bad, column):
    rows = [(i, good(i)) for i in range(0, 240)] + [(i, bad(i)) for i in range(240, 480)]
    docs = documents(spark, [*rows, (900, None), (None, "some words"), (901, "")])
    labels = spark.createDataFrame([(i, int(i < 240) if column == "quality" else int(i >= 240), int(i >= 240)) for i, _ in rows], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality_forest(spark, none):
    docs, labels = labelled(spark, lambda i: f"plain words of text number {i} with some more of them " * 3, lambda i: f"$$$ BUY!! {i} ### NOW!! " * 9, "quality")
    forest = boosting.fit_quality(docs, labels)
    got = {r.doc_id: r for r in boosting.score_quality(docs, forest).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id is not None and r.doc_id < 480]
    assert held and all(r.predicted == int(r.doc_id < 240) for r in held)
    assert 0 <= got[900].score <= 1 and got[900].score == got[901].score and got[5].held_out == (zlib.crc32(b"5") % 5 == 0)
    assert boosting.score_quality(none, forest).count() == 0
    assert {r.doc_id for r in docs.where(boosting.predicted_quality(forest)(F.col("text")) == 1).collect()} >= set(range(240))
    unlabelled = boosting.fit_quality(docs, labels.limit(0))
    assert {r.predicted for r in boosting.score_quality(docs, unlabelled).collect()} == {1}


def test_toxicity_grammar(spark, none):
    insults = ["grobnik", "snarlow", "vexling"]
    docs, labels = labelled(spark, lambda i: f"Quiet text {i} about rivers. You are out today.", lambda i: f"Quiet text {i} about rivers. You are a {insults[i % 3]} today.", "toxic")
    grammar = toxicity.fit_toxicity(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, grammar).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id is not None and r.doc_id < 480]
    assert held and all(r.predicted == int(r.doc_id >= 240) for r in held)
    assert got[900].predicted == 0 and got[900].score == got[901].score
    kinds = toxicity.score_toxicity(documents(spark, [(1, "you grobnik"), (2, "you are not a grobnik"), (3, "he said grobnik"), (4, "a grobnik"), (5, "i will kill you. you kill")]), grammar)
    seen = {r.doc_id: {k for k in toxicity.KINDS if r[k] > 0} for r in kinds.collect()}
    assert seen == {1: {"insult_at_target"}, 2: {"negated"}, 3: {"reported"}, 4: {"insult"}, 5: {"threat", "threat_at_target"}}
    assert toxicity.score_toxicity(none, grammar).count() == 0
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels.limit(0))).count() == 483
