"""Toxicity: a weighted finite-state grammar over the clauses of a text.

Words become symbols (slur, harm, intent, degree, person, object, deny, say, other). Five weighted transducers rewrite the symbols in turn:
the insult transducer makes insults of slurs, the threat transducer threats of verbs of harm, negation and reported speech take back
the attacks in their scope, and the target transducer marks attacks with an addressed person on either side. They are composed once
into one table of states, symbols out and weights; a clause is scored by its run.

A document's score rests on the matched clauses alone: their weights are never negative, what is denied or reported counts nothing, and
example clauses of every kind, weighed against the labelled documents, settle the kinds that the labels don't show.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, SLICE_ROWS, fit_labels, held_out, label_sample, table, worker_cache
from .vocab import piece_model, tokenizer_path

#: Words of English, Spanish, French and German by their part in a clause. `object` are persons that the verb acts on.
WORDS = {
    "harm": "kill murder hurt harm destroy attack beat burn shoot stab strangle crush choke slaughter smash matar matarte golpear golpearte destruir quemar herir apuñalar asesinar tuer frapper brûler détruire blesser poignarder étrangler töten umbringen schlagen verbrennen zerstören erschießen erstechen verletzen",
    "intent": "will shall going gonna must want i'll we'll voy va vamos quiero vais allons veux dois werde werden wirst wird soll muss",
    "degree": "such so very total complete utter absolute fucking tan muy pura puro très tellement vrai vraie sehr völlig echter totaler",
    "person": "you your yours u they them you're youre tú usted ustedes vosotros eres tu toi vous votre es du ihr bist seid",
    "object": "te ti os dich dir euch",
    "deny": "not never isn't aren't wasn't don't won't no nunca jamás ne pas jamais nicht kein keine nie niemals",
    "say": "said says called calls claims claimed wrote quoted reported dijo dice llamó escribió dit disait appelé écrit sagte sagt nannte schrieb",
}
#: Words that are insults on their own account in these languages, whatever the labels show.
INSULTS = (
    "idiot idiots moron morons imbecile imbeciles stupid scum bastard bastards loser losers pathetic worthless disgusting idiota idiotas imbécil imbéciles estúpido estúpida gilipollas cabrón crétin crétins imbécile abruti connard connasse "
    "trottel vollidiot dummkopf arschloch idioten schwachkopf abschaum"
)
ALPHABET = ("other", "slur", *WORDS)
SLUR, HARM = (ALPHABET.index(x) for x in ("slur", "harm"))
_TARGETS = tuple(ALPHABET.index(x) for x in ("person", "object"))
#: What the composed run tells apart.
KINDS = ("insult", "insult_at_target", "threat", "threat_at_target", "negated", "reported")
_ATTACKS = ("insult", "threat")
#: Every symbol that stands between two transducers.
_SYMBOLS = tuple(dict.fromkeys([*ALPHABET, *KINDS]))
_EDGE = " \t\n.,;:!?\"'()[]{}<>«»“”„…-*#$%&|"
_ENDS = (b".", b"!", b"?", b";", b":")
#: Labelled rows of either class in the fit.
SAMPLE_PER_CLASS = 3000
#: Letters of word beginnings that may be learned, and the least number of different toxic words that go on from one.
BEGINNINGS, LEAST_WORDS = (5, 6, 7), 4
#: Weight of a learned slur that is an ordinary word elsewhere; log odds that a full weight stands for.
ORDINARY, FULL_ODDS = 0.5, 6.0
#: Sums by kind (insult, insult at target, threat, threat at target) and matched clauses of example clauses, and whether
#: they are toxic: an attack is one at somebody, a lone word isn't.
EXAMPLES = (
    ((0, 0, 0, 0), 0, 0), ((0.5, 0, 0, 0), 1, 0), ((1, 0, 0, 0), 1, 0), ((0, 0.5, 0, 0), 1, 0), ((0, 1, 0, 0), 1, 1), ((0, 1.5, 0, 0), 1, 1), ((0, 0, 0.5, 0), 1, 0), ((0, 0, 1.5, 0), 1, 0),
    ((0, 0, 0, 0.5), 1, 0), ((0, 0, 0, 1.5), 1, 0), ((0, 0, 0.5, 0.5), 1, 0), ((0, 0, 1.5, 1.5), 1, 1), ((0, 0, 0, 3), 1, 1),
)
#: Weight of each example, as a share of that of all labelled documents.
EXAMPLE_SHARE = 0.02


class Transducer:
    """Deterministic and weighted: arcs (state, symbol) -> (next state, symbol out, weight); without an arc the symbol passes with
    weight 1 and the state stays."""

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, str, float]]):
        self.arcs = arcs

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol), (state, symbol, 1.0))


def composed(machines: list[Transducer], alphabet: tuple[str, ...]) -> tuple[list[list[int]], list[list[str]], list[list[float]]]:
    """The product of the machines in order, by (state, symbol): next state, symbol out, product of the weights."""
    start = (0,) * len(machines)
    states, queue, after, out, weight = {start: 0}, [start], [], [], []
    for state in queue:
        rows: tuple[list, list, list] = ([], [], [])
        for symbol in alphabet:
            now, product = [], 1.0
            for machine, s in zip(machines, state):
                s, symbol, w = machine.step(s, symbol)
                now.append(s)
                product *= w
            if tuple(now) not in states:
                states[tuple(now)] = len(states)
                queue.append(tuple(now))
            for row, value in zip(rows, (states[tuple(now)], symbol, product)):
                row.append(value)
        for table_, row in zip((after, out, weight), rows):
            table_.append(row)
    return after, out, weight


def _armed(arm: str, reach: int, hits: dict[str, tuple[str, float]]) -> dict:
    """Arcs that `arm` sets to `reach` words, in which the symbols of `hits` become others; every other word counts one down."""
    arcs = {(s, x): (s - 1, x, 1.0) for s in range(1, reach + 1) for x in _SYMBOLS}
    arcs |= {(s, x): (s - 1, *hit) for s in range(1, reach + 1) for x, hit in hits.items()}
    return arcs | {(s, arm): (reach, "other", 1.0) for s in range(reach + 1)}


def insult_transducer(reach: int = 2) -> Transducer:
    """slur -> insult, with more weight after a word of degree."""
    return Transducer(_armed("degree", reach, {"slur": ("insult", 1.5)}) | {(0, "slur"): (0, "insult", 1.0)})


def threat_transducer(reach: int = 4) -> Transducer:
    """harm -> threat, with less weight unless a word of intent comes before."""
    return Transducer(_armed("intent", reach, {"harm": ("threat", 1.5)}) | {(0, "harm"): (0, "threat", 0.5)})


def negation_transducer(scope: int = 3) -> Transducer:
    return Transducer(_armed("deny", scope, {x: ("negated", 1.0) for x in _ATTACKS}))


def report_transducer() -> Transducer:
    """After a verb of saying the clause's attacks are another's."""
    return Transducer({(0, "say"): (1, "other", 1.0), (1, "say"): (1, "other", 1.0)} | {(1, x): (1, "reported", 1.0) for x in _ATTACKS})


def target_transducer(reach: int = 4) -> Transducer:
    """An attack within `reach` words after a person is one at a target, with twice the weight after an object; a person or object
    within `reach` words after an attack says so of it (its run repeats the attack's own weight). States: 0, then those after a
    person, after an object, after an insult and after a threat."""
    arcs = _armed("person", reach, {})
    base = {x: reach * (k + 1) for k, x in enumerate(("object", *_ATTACKS))}
    for at in base.values():
        arcs |= {(at + s, y): (at + s - 1 if s > 1 else 0, y, 1.0) for s in range(1, reach + 1) for y in _SYMBOLS}
    states = range(reach * (len(base) + 1) + 1)
    arcs |= {(s, x): (reach if x == "person" else base[x] + reach, "other", 1.0) for s in states for x in ("person", "object")}
    for x in _ATTACKS:
        arcs |= {(s, x): (base[x] + reach, x, 1.0) for s in states}
        arcs |= {(s, x): (s, f"{x}_at_target", 1.0) for s in range(1, reach + 1)} | {(base["object"] + s, x): (base["object"] + s, f"{x}_at_target", 2.0) for s in range(1, reach + 1)}
        arcs |= {(base[x] + s, y): (reach if y == "person" else base[y] + reach, f"{x}_at_target", 1.0) for s in range(1, reach + 1) for y in ("person", "object")}
    return Transducer(arcs)


_AFTER, OUT, _WEIGHT = composed([insult_transducer(), threat_transducer(), negation_transducer(), report_transducer(), target_transducer()], ALPHABET)
_KIND = [[KINDS.index(x) if x in KINDS else -1 for x in row] for row in OUT]


class Symbols(dict):
    """Cache: word in bytes -> 32 * arc + 2 * symbol + (1 at a clause's end)."""

    def __init__(self, words: dict[str, int], prefixes: dict[str, int]):
        self.words, self.prefixes = words, prefixes
        self.longest = max(map(len, prefixes), default=0)
        self.closed = {w: ALPHABET.index(name) for name, found in WORDS.items() for w in found.split()}

    def __missing__(self, raw: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        word = raw.decode("utf-8", "replace").lower().strip(_EDGE)
        arc = self.words.get(word, -1)
        for k in range(self.longest, 0, -1):
            if arc < 0:
                arc = self.prefixes.get(word[:k], -1) if len(word) >= k else -1
        self[raw] = value = (32 * arc + 2 * SLUR if arc >= 0 else 2 * self.closed.get(word, 0)) + raw.endswith(_ENDS)
        return value


@dataclass(frozen=True)
class Grammar:
    """The learned part: slurs (exact words and word beginnings) with weights, and the weights of the document's features."""

    arcs: tuple[tuple[str, bool, float], ...]  # text, whole word, weight
    coefficients: tuple[float, ...] = ()

    def symbols(self) -> Symbols:
        return _symbols(self.arcs)


def _symbols(arcs: tuple) -> Symbols:
    return worker_cache(("toxicity", arcs), lambda: Symbols({a: k for k, (a, whole, _) in enumerate(arcs) if whole}, {a: k for k, (a, whole, _) in enumerate(arcs) if not whole}))


def features(text: str | None, symbols: Symbols, weights: list[float]) -> list[float]:
    """Of the clauses that the grammar matches: log sums of weights by kind, the largest clause sum, log count, share of clauses."""
    sums, largest, matched, clauses = [0.0] * len(KINDS), 0.0, 0, 1
    words = (text or "").encode("utf-8", "surrogatepass").split()
    codes = np.fromiter(map(symbols.__getitem__, words), np.int64, len(words))
    kinds = (codes >> 1) & 15
    if ((kinds == SLUR) | (kinds == HARM)).any():
        ends = np.flatnonzero(codes & 1) + 1
        clause_of = np.zeros(len(codes), np.int64)
        clause_of[ends[ends < len(codes)]] = 1
        clause_of = clause_of.cumsum()
        clauses = int(clause_of[-1]) + 1
        attacked = np.unique(clause_of[(kinds == SLUR) | (kinds == HARM)])
        starts, stops = np.searchsorted(clause_of, attacked), np.searchsorted(clause_of, attacked, side="right")
        for a, b in zip(starts.tolist(), stops.tolist()):
            state, found, own = 0, 0.0, 0.0
            for code in codes[a:b].tolist():
                symbol = (code >> 1) & 15
                kind, weight = _KIND[state][symbol], _WEIGHT[state][symbol]
                state = _AFTER[state][symbol]
                if kind >= 0:
                    if symbol not in _TARGETS:
                        own = weights[code >> 5] if symbol == SLUR else 1.0
                    worth = weight * own
                    sums[kind] += worth
                    found += worth if kind < 4 else 0.0
            largest = max(largest, found)
            matched += found > 0
    return [*np.log1p(sums).tolist(), float(np.log1p(largest)), float(np.log1p(matched)), matched / clauses]


def _units(label_rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, list[int]] = {}
    for batch in label_rows:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = {w.strip(_EDGE) for w in (text or "").lower().split()}
            own = {w for w in own if 3 <= len(w) <= 40}
            for unit in {f"={w}" for w in own} | {f"^{w[:k]}" for w in own for k in BEGINNINGS if len(w) > k}:
                counts.setdefault(unit, [0, 0])[label] += 1
    yield pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["unit", "clean", "toxic"])


def background_words(piece_path: str) -> frozenset[str]:
    """Ordinary words: the whole words among the pieces of a public vocabulary."""
    model = piece_model(piece_path)
    found = (model.id_to_piece(k) for k in range(model.get_piece_size()))
    return frozenset(p[1:].lower() for p in found if p.startswith("▁") and p[1:].isalpha() and len(p) > 3)


def fit_toxicity(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, least_g: float = 24.0, piece_path: str | None = None) -> Grammar:
    """A grammar from at most per_class labelled documents of either class that are not held out.

    Slurs are the listed insults and words that toxic documents have far oftener (G statistic of at least least_g, which takes about
    17 toxic documents at the least), with less weight if they are ordinary words of a public vocabulary. A word beginning of five
    letters or more is learned only if several different toxic words go on from it and no ordinary word begins so. Counts are made by
    Spark over the sample's documents; the number of slurs and the 2 * per_class rows of features that the driver gets are bounded by
    the sample. Documents weigh by the class share, EXAMPLES beside them. Without labels of both classes the examples alone decide.
    Null labels and null ids, and labels of unknown documents, are ignored; a repeated id counts with each of its rows.
    """
    chosen, share = label_sample(fit_labels(labels, "toxic"), per_class)
    share = share or 0.0
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # bounded by per_class rows of either class
    rows = texts.join(F.broadcast(chosen), "doc_id").select("label", "text")
    total = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n_clean, n_toxic = total.get(0, 0), total.get(1, 0)
    listed = [(w, True, 1.0) for w in INSULTS.split()]
    if not n_clean or not n_toxic:
        return Grammar(tuple(listed), tuple(_fitted(np.empty((0, len(KINDS) + 3)), np.empty(0), np.empty(0))))
    units = rows.mapInArrow(_units, "unit string, clean long, toxic long").groupBy("unit").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    a, b, all_ = F.col("toxic"), F.col("clean"), F.col("toxic") + F.col("clean")
    expect = n_toxic / (n_clean + n_toxic)
    g = 2 * (a * F.log(a / (all_ * expect)) + F.when(b > 0, b * F.log(b / (all_ * (1 - expect)))).otherwise(0.0))
    pure = (a / n_toxic) / (a / n_toxic + b / n_clean)
    going_on = units.where("unit like '=%' and toxic > 0 and clean = 0").select(F.explode(F.array(*(F.concat(F.lit("^"), F.substring("unit", 2, k)) for k in BEGINNINGS))).alias("unit")).groupBy("unit").agg(F.count(F.lit(1)).alias("words"))
    found = units.where(a >= 3).withColumn("g", g).withColumn("pure", pure).where((F.col("g") >= least_g) & (F.col("pure") >= 0.97)).join(going_on, "unit", "left").collect()
    ordinary = background_words(piece_path or tokenizer_path("piece_bpe_32k.model"))
    begun = {w[:k] for w in ordinary for k in BEGINNINGS}
    arcs = list(listed)
    beginnings, whole = set(), {w for w, _, _ in listed}
    for least in (0.99, 0.97):
        for r in sorted(found, key=lambda r: (len(r["unit"]), r["unit"])):
            text, is_word = r["unit"][1:], r["unit"][0] == "="
            if r["pure"] < least or text in whole or any(text[:k] in beginnings for k in range(1, len(text) + 1)):
                continue
            if not is_word and ((r["words"] or 0) < LEAST_WORDS or text in begun):
                continue
            odds = float(np.log((r["toxic"] + 0.5) / (n_toxic + 1)) - np.log((r["clean"] + 0.5) / (n_clean + 1)))
            weight = min(max(odds / FULL_ODDS, 0.1), 1.0)
            (whole if is_word else beginnings).add(text)
            arcs.append((text, is_word, min(weight, ORDINARY) if is_word and text in ordinary else weight))
    grammar = Grammar(tuple(arcs))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, weights = grammar.symbols(), [x[2] for x in grammar.arcs]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t, symbols, weights) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], names=["label", "x"])

    sampled = rows.mapInArrow(measure, "label int, x array<double>").toPandas()
    y, x = sampled["label"].to_numpy(float), np.array(sampled["x"].tolist(), float)
    order = np.lexsort([*x.T, y])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return Grammar(grammar.arcs, tuple(_fitted(x[order], y[order], weight[order])))


def _fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[float]:
    """Coefficients of the constant and of `features`, with EXAMPLES beside the documents; those of what is denied or reported, of the
    largest clause and of the share of clauses are 0, all others are not negative."""
    used = [*(KINDS.index(k) for k in ("insult", "insult_at_target", "threat", "threat_at_target")), len(KINDS) + 1]
    shown = np.array([[*np.log1p(sums), np.log1p(matched)] for sums, matched, _ in EXAMPLES])
    each = EXAMPLE_SHARE * weight.sum() if len(weight) else 1.0
    found = _logistic(np.concatenate([x[:, used], shown]), np.concatenate([y, [label for *_, label in EXAMPLES]]), np.concatenate([weight, np.full(len(EXAMPLES), each)]))
    out = np.zeros(len(KINDS) + 4)
    out[0] = found[0]
    out[[1 + k for k in used]] = found[1:]
    return out.tolist()


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.02, rounds: int = 2000) -> list[float]:
    """Weighted logistic regression with a small ridge, a free constant and no negative coefficient, by one coordinate after another."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, penalty = np.zeros(x.shape[1]), np.array([1e-3, *[ridge] * (x.shape[1] - 1)])
    z = x @ beta
    for _ in range(rounds):
        largest = 0.0
        for k in range(len(beta)):
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            slope = (weight * (p - y)) @ x[:, k] + penalty[k] * beta[k]
            bend = (weight * p * (1 - p)) @ (x[:, k] ** 2) + penalty[k]
            now = beta[k] - np.clip(slope / bend, -1, 1)
            now = now if k == 0 else max(now, 0.0)
            z += (now - beta[k]) * x[:, k]
            largest = max(largest, abs(now - beta[k]))
            beta[k] = now
        if largest < 1e-7:
            break
    return beta.tolist()


def score_toxicity(documents: DataFrame, grammar: Grammar, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted, then the log sums by kind, for every document; a map without a shuffle over whole texts.

    Null or empty text matches nothing and gets the score of no match. Null ids keep their row, with held_out null; repeated rows
    keep a row each. An empty table gives no rows; other columns are ignored.
    """
    names = [*KINDS, "largest_clause", "matched_clauses", "matched_share"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, weights = grammar.symbols(), [x[2] for x in grammar.arcs]
        beta = np.array(grammar.coefficients)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                x = np.array([features(t, symbols, weights) for t in batch.column(1).to_pylist()], float)
                p = 1 / (1 + np.exp(-np.clip(beta[0] + x @ beta[1:], -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([held_out(d) for d in batch.column(0).to_pylist()], pa.bool_()), pa.array(p), pa.array((p >= threshold).astype(np.int32)), *map(pa.array, x.T.copy())],
                    names=["doc_id", "held_out", "score", "predicted", *names],
                )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int, " + ", ".join(f"{n} double" for n in names))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score_toxicity(documents, fit_toxicity(documents, table(spark, sf_dir, "labels")))
