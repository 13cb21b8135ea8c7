"""Queries without SQL against plain Python, row by row, on the smallest tables and small fixtures."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from shelfwise.llm import boosting, fertility, sharding, toxicity, vocab

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    out, word = [], ""
    for c in text or "":
        if c in SPACE:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out + ([word] if word else [])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def mixed(x):
    """splitmix64's finaliser in Python's integers."""
    x = (x + 0x9E3779B97F4A7C15) % 2**64
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
    return x ^ (x >> 31)


def test_shards_and_slots(spark, docs):
    """Every row's shard and slot from its number by a scalar Feistel walk."""
    rows = sorted((r.doc_id, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 16) for r in docs.collect())
    n, bits = len(rows), 1
    while 4**bits < n:
        bits += 1
    want = set()
    for number, (doc_id, crc, size) in enumerate(rows):
        at = number
        while True:
            left, right = at >> bits, at % 2**bits
            for k in range(6):
                left, right = right, left ^ (mixed(right ^ mixed(k + 20240607)) % 2**bits)
            at = left << bits | right
            if at < n:
                break
        want.add((doc_id, size, crc, at % 40, at // 40))
    got = sharding.op5_feistel_shards(spark, SF)
    assert {tuple(r) for r in got.select("doc_id", "size", "text_crc32", "shard", "slot").collect()} == want


def test_fertility_counts_and_measures(spark, docs):
    """Base counts by definition, and the three measures from the public libraries on whole words."""
    pieces = sentencepiece.SentencePieceProcessor(model_file=vocab.tokenizer_path("piece_bpe_32k.model"))
    ranks = vocab.rank_encoding(vocab.tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in fertility.op7_fertility(spark, SF).collect():
        words = words_of(texts[r.doc_id])
        lines = [x for x in (texts[r.doc_id] or "").split("\n") if words_of(x)]
        triples = Counter(zip(words, words[1:], words[2:]))
        repeated = {k + j for k, t in enumerate(zip(words, words[1:], words[2:])) if triples[t] > 1 for j in range(3)}
        symbols = sum(c in "#*$%&|<>" for c in texts[r.doc_id] or "")
        chars = sum(map(len, words))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), chars, symbols, len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(words) < 50 or 100 * len(repeated) > 50 * len(words))
        if not words:
            continue
        ids = [i for w in words for i in pieces.encode(w)]
        counts = Counter(ids)
        entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in counts.values())
        assert r.chars_per_piece == pytest.approx(chars / len(ids))
        assert r.fallback_share == pytest.approx(sum(pieces.is_byte(i) for i in ids) / len(ids))
        assert r.relative_entropy == pytest.approx(entropy / math.log2(min(len(ids), 2048)) if len(ids) > 1 else 1.0, abs=1e-9)
        assert r.chars_per_byte_token == pytest.approx(chars / sum(len(ranks.encode_ordinary(" " + w)) for w in words))


def test_bands_reject_by_each_measure():
    """For each measure a text that fails by it alone, and clean texts of four languages that pass."""
    cache = fertility._cache(vocab.tokenizer_path("piece_bpe_32k.model"), vocab.tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    clean = {
        "en": "The council of the town met at the old hall and agreed that a new bridge should be built over the river, for it was said by many that the ferry is slow. " * 1 + "A plan for this work will be shown to the people in spring, with costs and dates as far as they are known.",
        "es": "El consejo de la ciudad se reunió en una sala del museo y decidió que los puentes más antiguos se cierran por obras, pero las calles de al lado quedan abiertas para el tráfico.",
        "fr": "Le conseil de la ville a décidé dans une réunion que les ponts sur la rivière sont à refaire, mais pas avant le printemps, et nous avons appris que des travaux plus petits commencent au mois de mars.",
        "de": "Der Rat der Stadt hat in einer Sitzung beschlossen, dass die Brücke über den Fluss nicht mehr mit Lastwagen befahren werden darf, und auch für das nächste Jahr ist ein Umbau aus Mitteln des Landes geplant.",
    }
    for (language, text), (_, script, found) in zip(clean.items(), fertility.measured(list(clean.values()), cache), strict=True):
        assert found[4] == language and fertility.within(fertility.BANDS, script, found), text
    emoji = clean["en"] + " \U0001fae0\U0001fae1\U0001fae2" * 14
    cases = {"pieces": "the of qzx wvk jjq and " * 9, "fallback": emoji, "entropy": "international " * 80 + "the of and"}
    seen = {}
    for name, (_, _, (a, b, fallback, entropy, _)) in zip(cases, fertility.measured(list(cases.values()), cache), strict=True):
        low, _, low2, _, most, least = fertility.BANDS["en"]
        seen[name] = (a < low, b < low2, fallback > most, entropy < least)
    assert seen["pieces"][0] and seen["fallback"][2] and seen["entropy"] == (False, False, False, True)


def test_forest_is_walked_tree_by_tree(spark, docs):
    forest = boosting.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    inner = forest.feature.shape[1]
    for r in boosting.op10_quality_forest(spark, SF).collect():
        x, margin = boosting.statistics(texts[r.doc_id]), forest.start
        for feature, threshold, value in zip(forest.feature, forest.threshold, forest.value):
            node = 0
            while node < inner:
                node = 2 * node + 1 + (x[feature[node]] > threshold[node])
            margin += value[node - inner]
        assert r.score == pytest.approx(1 / (1 + math.exp(-margin))) and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_grammar_is_run_machine_by_machine(spark, docs):
    """Scores from the five transducers run one after the other on every clause, without the composed table."""
    grammar = toxicity.fit_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()} | {-1: "You total trash, I will kill you. He said scum! not vermin; such a filth you are"}
    slurs = [(a, whole, w) for a, whole, w in grammar.arcs]
    closed = {w: name for name, found in toxicity.WORDS.items() for w in found.split()}

    def machines():
        return [m() for m in (toxicity.insult_transducer, toxicity.threat_transducer, toxicity.negation_transducer, toxicity.report_transducer, toxicity.target_transducer)]

    extra = spark.createDataFrame([(-1, texts[-1])], "doc_id long, text string")
    for r in toxicity.score_toxicity(docs.select("doc_id", "text").unionByName(extra), grammar).collect():
        words, clauses = words_of(texts[r.doc_id]), [[]]
        for word in words:
            clauses[-1].append(word)
            if word[-1] in ".!?;:":
                clauses.append([])
        sums, largest, matched = dict.fromkeys(toxicity.KINDS, 0.0), 0.0, 0
        for clause in clauses:
            total, own, states, line = 0.0, 0.0, [0] * 5, machines()
            for word in clause:
                bare = word.lower().strip(toxicity._EDGE)
                hit = [w for a, whole, w in slurs if whole and a == bare] or [w for a, whole, w in sorted(slurs, key=lambda x: -len(x[0])) if not whole and bare.startswith(a)]
                symbol, weight = "slur" if hit else closed.get(bare, "other"), 1.0
                if hit or symbol == "harm":
                    own = hit[0] if hit else 1.0
                for k, machine in enumerate(line):
                    states[k], symbol, w = machine.step(states[k], symbol)
                    weight *= w
                if symbol in sums:
                    sums[symbol] += weight * own
                    total += weight * own if symbol not in ("negated", "reported") else 0.0
            largest, matched = max(largest, total), matched + (total > 0)
        values = [*(math.log1p(v) for v in sums.values()), math.log1p(largest), math.log1p(matched)]
        assert [r[k] for k in (*toxicity.KINDS, "largest_clause", "matched_clauses")] == pytest.approx(values)
        margin = grammar.coefficients[0] + sum(b * r[k] for b, k in zip(grammar.coefficients[1:], (*toxicity.KINDS, "largest_clause", "matched_clauses", "matched_share")))
        assert r.score == pytest.approx(1 / (1 + math.exp(-margin)))


@pytest.mark.parametrize("text, kinds", [
    ("I will kill you", {"threat", "threat_at_target"}), ("kill the old lights", {"threat"}), ("they will burn it", {"threat_at_target"}),
    ("I won't kill you", {"negated"}), ("he said I will kill you", {"reported"}), ("nothing here. it is fine", set()),
])
def test_targets_on_either_side(text, kinds):
    found = toxicity.features(text, toxicity.Symbols({}, {}), [])
    assert {k for k, v in zip(toxicity.KINDS, found) if v > 0} == kinds


@pytest.mark.parametrize("column, score, fit", [("quality", boosting.score_quality, boosting.fit_quality), ("toxic", toxicity.score_toxicity, toxicity.fit_toxicity)])
def test_held_out_labels_are_never_learned(spark, docs, column, score, fit):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn(column, F.when(held, 1 - F.col(column)).otherwise(F.col(column)))
    assert turned.exceptAll(labels).count() > 0
    one, two = ({r.doc_id: r.score for r in score(docs, fit(docs, x)).collect()} for x in (labels, turned))
    assert one == two


def test_long_and_repeated_rows(spark):
    long = "plain words " * 20_000
    docs = spark.createDataFrame([(1, long), (1, long), (2, "x" * 100_000), (3, None), (None, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    for got in (boosting.score_quality(docs, boosting.fit_quality(docs, labels)), toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)), fertility.quality_rules(docs)):
        rows = got.collect()
        assert len(rows) == 5 and len({str(r) for r in rows if r.doc_id == 1}) == 1
        assert all(r.doc_id is not None or r.asDict().get("held_out") is None for r in rows)
    assert np.isfinite([r.score for r in boosting.score_quality(docs, boosting.fit_quality(docs, labels)).collect()]).all()
