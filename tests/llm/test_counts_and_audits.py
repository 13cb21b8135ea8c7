"""Token counts by digest, alignment of two vocabularies and the filter audit against brute force, with their edge cases."""

import hashlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from shelfwise.llm import alignment, filter_audit, token_counts
from shelfwise.llm.vocab import piece_model, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, digest string, owner long, n_tokens long, part string, mask int, pairs int"
WORDS = " ".join(f"word{i % 97} some{i % 31}" for i in range(400))
TEXTS = [
    WORDS, WORDS, None, "", " ", "\n", "  a  b", "a▁b c", "<|endoftext|> x", "naïve 日本語 ﬁ <s> </s>\x00 y", "x" * 5000, "a　b  c  \t d", "é" * 300 + " 🙂🙂 ok", "foo ", " " * 50 + "z", "it's  'll don't",
    "ALL CAPITALS HERE " * 30, "one $ sign", WORDS + " the end", "same words " * 300, "日本語" * 400,
]
ROWS = [*enumerate(TEXTS), (3, "third again"), (0, WORDS), (None, WORDS), (None, "no id"), (None, None)]


def documents(spark, rows):
    full = [(i, t, None, None if i is None or i % 3 == 0 else f"s{i % 3}", "d", 1, 2, "p", 3, 4) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, ROWS).cache()


def plain_count(name):
    path = tokenizer_path(name)
    if name.endswith(".model"):
        return lambda t: len(piece_model(path).encode(t or ""))
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)


@pytest.mark.parametrize(("name", "ranks"), [("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"), ("byte_bpe_50k.json", None), ("word_bpe_49k.json", None), ("piece_bpe_32k.model", None)])
def test_counts_with_a_cold_and_a_warm_cache(spark, docs, tmp_path, name, ranks, monkeypatch):
    path, ranks, count, cache = tokenizer_path(name), ranks and tokenizer_path(ranks), plain_count(name), str(tmp_path / "cache")
    want = Counter((i, len((t or "").encode()), count(t), count(t) > 20) for i, t in ROWS)
    for known in (False, True):
        got = token_counts.token_counts(docs, cache, path, ranks, limit=20).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
        assert {r.was_cached for r in got} == {known}
    # new texts alone are encoded and appended, once each
    more = [*ROWS, (50, "a new text"), (51, "a new text"), (52, "another one")]
    sent = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(token_counts, "_encoded", lambda texts, *a, real=token_counts._encoded: (sent.add(texts.count()), real(texts, *a))[1])
    got = {r.doc_id: r for r in token_counts.token_counts(documents(spark, more), cache, path, ranks).collect()}
    assert sent.value == 2 and not got[50].was_cached and got[6].was_cached and got[51].n_tokens == count("a new text")
    stored = spark.read.parquet(f"{cache}/version={token_counts.tokenizer_version(path)}")
    assert stored.count() == stored.select("digest").distinct().count()


def test_a_cache_of_another_version_is_not_used_and_twice_stored_counts_agree(spark, docs, tmp_path):
    cache = str(tmp_path)
    path = tokenizer_path("byte_bpe_50k.json")
    digest = hashlib.sha256(WORDS.encode()).hexdigest()
    spark.createDataFrame([(digest, 1)], token_counts.CACHE_SCHEMA).write.parquet(f"{cache}/version=old")
    rows = token_counts.token_counts(docs, cache, path).collect()
    assert {r.n_tokens for r in rows if r.doc_id in (0, 1)} == {plain_count("byte_bpe_50k.json")(WORDS)}
    version = token_counts.tokenizer_version(path)
    spark.read.parquet(f"{cache}/version={version}").write.mode("append").parquet(f"{cache}/version={version}")
    assert len(token_counts.token_counts(docs, cache, path).collect()) == len(ROWS)
    assert version != token_counts.tokenizer_version(tokenizer_path("word_bpe_49k.json"))


def test_frequent_texts_get_their_counts_too(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "HOT_ROWS", 3)
    monkeypatch.setattr(token_counts, "HOT_TEXTS", 1)
    rows = [(i, f"text number {i % 4}") for i in range(40)] + [(100 + i, None) for i in range(7)]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(documents(spark, rows), str(tmp_path), tokenizer_path("byte_bpe_50k.json")).collect()}
    count = plain_count("byte_bpe_50k.json")
    assert got == {i: count(t) for i, t in rows}


def brute_alignment(rows):
    """The contract of op12 text by text: dictionaries of byte offsets at which tokens end."""
    v = alignment.Vocabularies(*alignment.default_paths())
    a_tokenizer = Tokenizer.from_file(alignment.default_paths()[0])
    a_tokenizer.encode_special_tokens = True
    out, pairs = [], Counter()
    for i, t in rows:
        a = a_tokenizer.encode(" " + (t or ""), add_special_tokens=False).ids
        b = v.pieces.encode(t or "")
        raw = (" " + (t or "")).encode()
        if not t or b"".join(v.a_bytes[x] for x in a) != raw or b"".join(v.b_bytes[x] for x in b) != raw:
            out.append((i, None))
            continue
        ends = []
        for ids, texts in ((a, v.a_bytes), (b, v.b_bytes)):
            at = np.cumsum([len(texts[x]) for x in ids]).tolist()
            ends.append({e: k for k, e in enumerate(at)})
        cuts = sorted(ends[0].keys() & ends[1].keys())
        links = [(a[ends[0][c]], b[ends[1][c]]) for c in cuts]
        from_a, from_b = ([0, *(e[c] + 1 for c in cuts)] for e in ends)
        groups = [(a[p:q], b[r:s]) for p, q, r, s in zip(from_a, from_a[1:], from_b, from_b[1:])]
        pairs.update(links)
        out.append((i, (a, b, groups, links)))
    return out, pairs


def test_alignment_against_offsets(spark, docs):
    found, pairs = brute_alignment(ROWS)
    highest = defaultdict(int)
    for (_, b), n in pairs.items():
        highest[b] = max(highest[b], n)
    want = Counter()
    for i, x in found:
        if x is None:
            want[(i, 0, 0, 0, 0, 0, 0, "")] += 1
        else:
            a, b, groups, links = x
            text = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
            want[(i, len(a), len(b), len(groups), len(links), sum(pairs[p] == highest[p[1]] for p in links), sum(pairs[p] for p in links), hashlib.sha256(text.encode()).hexdigest())] += 1
    rows = alignment.aligned_counts(docs).collect()
    assert Counter(tuple(r)[:8] for r in rows) == want
    assert sum(x is None for _, x in found) == 4 and len(pairs) <= alignment.pair_bound(alignment.Vocabularies(*alignment.default_paths()))
    by = {i: x for i, x in found if x}
    for r in rows:
        if r.doc_id in by and r.doc_id not in (None, 0, 3):
            a, b, groups, _ = by[r.doc_id]
            assert r.n_shared == sum(len(p) * len(q) for p, q in groups)


@pytest.mark.parametrize("kind", alignment.KINDS)
def test_links_of_each_kind(spark, docs, kind):
    v = alignment.Vocabularies(*alignment.default_paths())
    rows = {r.doc_id: r for r in alignment.alignments(documents(spark, [(i, t) for i, t in enumerate(TEXTS) if i != 10]), kind).collect()}
    for i, x in brute_alignment([(i, t) for i, t in enumerate(TEXTS) if i != 10])[0]:
        r = rows[i]
        got = {(k.a, k.b): k.shared for k in r.links}
        if x is None:
            assert not got and not r.a_ids
            continue
        a, b, groups, _ = x
        assert (r.a_ids, r.b_ids) == (a, b)
        spans = [[(e - len(t[k]), e) for k, e in zip(ids, np.cumsum([len(t[k]) for k in ids]).tolist())] for ids, t in ((a, v.a_bytes), (b, v.b_bytes))]
        shared = {}
        j = 0
        for k, (lo, hi) in enumerate(spans[0]):
            while j and spans[1][j - 1][1] > lo:
                j -= 1
            while j < len(b) and spans[1][j][0] < hi:
                if (n := min(hi, spans[1][j][1]) - max(lo, spans[1][j][0])) > 0:
                    shared[k, j] = n
                j += 1
        if kind == "overlap":
            want = shared
        elif kind == "end":
            want = {p: n for p, n in shared.items() if spans[0][p[0]][1] == spans[1][p[1]][1]}
        else:
            want, p, q = {}, 0, 0
            for g, h in groups:
                want |= {(p + k, q + m): shared.get((p + k, q + m), 0) for k in range(len(g)) for m in range(len(h))}
                p, q = p + len(g), q + len(h)
        assert got == want


def test_row_products_equal_dense_ones():
    rng = np.random.default_rng(3)
    for block in (1, 7, 1 << 20):
        dense = [rng.random((n, m)) < 0.3 for n, m in ((9, 13), (13, 6))]
        a, b = (alignment.Csr(np.concatenate([[0], d.sum(1).cumsum()]), np.nonzero(d)[1], d.shape[1]) for d in dense)
        out = np.zeros((9, 6), int)
        for r, c, n in alignment.row_products(a, b, block):
            np.add.at(out, (r, c), n)
        assert (out == dense[0].astype(int) @ dense[1].astype(int)).all()
        assert (alignment.product_terms(a, b) == out.sum(1)).all()
        t = alignment.transposed(a)
        assert all(set(t.indices[t.indptr[k] : t.indptr[k + 1]]) == set(np.flatnonzero(dense[0][:, k])) for k in range(13))


def labels(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, quality int, toxic int, mask int, part string")


def test_audit_step_by_step(spark, docs, tmp_path):
    """Every order applied to the documents one filter after another; and the same rows in SQL."""
    marks = labels(spark, [(0, 1, 0), (1, 1, 1), (2, 0, 1), (16, 1, 0), (16, 0, 1), (17, None, None), (18, 1, 0), (19, 1, 1), (None, 1, 1), (99, 1, 1)])
    good, toxic = {0, 1, 16, 18, 19}, {1, 2, 16, 19}
    rows = [(r.doc_id, r.source or "", r.text or "") for r in docs.collect()]
    failing = []
    for i, part, t in rows:
        words = [w for w in t.encode().split() if w]
        first = min((j for j, _, u in rows if u == t and j is not None), default=None)
        failing.append((i, part, {
            f for f, bad in zip("ABCDE", (
                len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > first,
            )) if bad
        }))
    want, removals = {}, Counter()
    for part in {p for _, p, _ in failing}:
        mine = [x for x in failing if x[1] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                out = [x for x in left if f in x[2]]
                left = [x for x in left if f not in x[2]]
                removals[part, f] += len(out)
                want[part, order, step] = (
                    len(left), len(out), sum(f in x[2] for x in mine) - len(out), sum(x[2] == {f} for x in mine), sum(x[0] in good for x in out), sum(x[0] in toxic for x in out),
                )
    found = filter_audit.filter_audit(docs, marks)
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in found.collect()}
    assert got == {k: (*x, removals[k[0], k[1][k[2] - 1]]) for k, x in want.items()} and len(got) == found.count()
    docs.write.parquet(str(tmp_path / "documents"))
    marks.write.parquet(str(tmp_path / "labels"))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}/*.parquet'")
    con.execute(filter_audit.OP13_SQL)
    assert [d[0] for d in con.description] == found.columns
    assert sorted(con.fetchall()) == sorted(tuple(r) for r in found.collect())


def test_swaps_lead_through_all_orders_and_keep_the_diagram():
    rng = np.random.default_rng(1)
    for n in range(1, 6):
        names = "ABCDE"[:n]
        cells = {int(m): tuple(int(x) for x in rng.integers(0, 9, 3)) for m in rng.choice(1 << n, max(1, (1 << n) // 2), replace=False)}
        diagram, seen = filter_audit.Diagram(cells, names), []
        for at in filter_audit.adjacent_orders(n):
            if at is not None:
                diagram.swap(at)
            seen.append("".join(diagram.order))
            fresh = filter_audit.Diagram({sum((m >> names.index(f) & 1) << k for k, f in enumerate(diagram.order)): c for m, c in cells.items()}, seen[-1])
            assert diagram.all_pass_path() == fresh.all_pass_path() and diagram.weights[diagram.root] == fresh.weights[fresh.root]
        assert sorted(seen) == sorted(map("".join, permutations(names)))


def test_empty_tables(spark, docs, tmp_path):
    none = documents(spark, ROWS).where("doc_id = -1")
    assert token_counts.token_counts(none, str(tmp_path), tokenizer_path("byte_bpe_50k.json")).count() == 0
    assert alignment.aligned_counts(none).count() == 0 and alignment.alignments(none).count() == 0
    assert filter_audit.filter_audit(none, labels(spark, [(1, 1, 1)])).count() == 0
    rows = filter_audit.filter_audit(docs, labels(spark, [])).collect()
    assert len(rows) == 600 * 3 and all(r.good_lost == 0 for r in rows)
