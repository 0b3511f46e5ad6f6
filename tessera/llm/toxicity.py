"""Toxicity (operator 7): a weighted finite-state grammar over clauses.

Words fall into classes: insult (learned from labels, and a short list), threat, target, negation, reported speech, and the
articles and adverbs that negation reaches over.  Small transducers read a clause's classes, each keeping its own state and
naming what the current word is in: a second insult, one after a target, a negated or reported one, a threat that is aimed at
somebody or at nobody.  Their composition multiplies the factors of the names that fire, so a clause scores the sum of its
words' weights under them: `you are not an idiot`, `she said you are an idiot` and `to kill time` give next to nothing, `I will
kill you` more than an insult.  A logistic curve over a document's clause scores, learned from the labelled rows, gives the
score.

The factors are learned too: how often documents are toxic whose scoring words all stand in one context, drawn towards that
context's own factor by as much as `PRIOR` documents would.  The insult lexicon holds word stems (leading bytes) and whole
words that labelled toxic documents hold far more often than others; it is learned on part of the labelled sample, factors and
curve on the rest, so words that only tell the sample's own documents apart don't count.  A listed word keeps its class.

A clause ends at `.!?;` or a line's end, a verb of speaking reaches over `QUOTED` words after it; one that follows what it
quotes isn't seen.

Defined results: null and empty texts have no clauses and get the curve's value for none; repeated rows get equal
scores; labels that are null or name no document are left out; without both classes among the labels only the short
list counts; an empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import text as T
from tessera.llm.labels import fold, labelled_sample
from tessera.llm.store import kept

#: Labelled documents that a fit reads at most; chosen by the hash of doc_id.
MAX_ROWS = 20_000
#: Terms that a lexicon holds at most, the most telling first.
MAX_TERMS = 50_000
STEMS = (4, 5, 6, 7, 8)
#: Toxic documents that hold a term at least, the log of how much oftener they do than others at least, and the one of a
#: full weight.  In three-fold cross-validation over the training folds at sf0.1 a least log of 2 found 0.918 of the toxic
#: ones at a precision of 0.969 (2.5: 0.889 and 0.982; 1: 0.905 and 0.923).
LEAST_DOCS, LEAST_WEIGHT, FULL_WEIGHT = 4, 2.0, 7.0

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORTED, FILLER, THIRD = range(8)
WORDS = {
    INSULT: "idiot idiots moron morons stupid worthless pathetic disgusting scum loser losers trash",
    THREAT: " ".join(f"{stem}{end}" for stem in "kill hurt destroy beat shoot stab burn crush murder strangl slaughter punch".split() for end in ("", "s", "e", "es", "ed", "ing")) + " matar matarte mato mataré töten töte tötet umbringen tuer tue tuerai frapper",
    TARGET: "you your yourself u ur tu toi vous te ton du dich dir euch ihr tú ti usted vosotros",
    NEGATION: "not never no isn aren wasn weren don doesn didn nobody nicht kein keine keinen nie ne pas jamais nunca tampoco",
    REPORTED: "said says quoted wrote writes claimed claims called calls reportedly sagte sagt schrieb behauptete dit écrit dijo escribió",
    THIRD: "they them he him she her il elle ils elles er sie ihn él ella ellos",
    FILLER: "a an the is are was were be been t s really such any so that un une une des ein eine einen einem der die das ist sind bist est sont es son una el la los las",
}
#: Words that a verb of speaking reaches over, words between a threat and whom it is for, documents that a factor's own value weighs.
QUOTED, AIM, PRIOR = 12, 3, 30
#: What a word's weight is multiplied by in each context, before labels are seen.
FACTORS = {"again": 1.2, "targeted": 1.25, "negated": 0.05, "reported": 0.1, "aimed": 1.5, "loose": 0.05}
NAMES = tuple(FACTORS)
_LETTERS = np.zeros(256, bool)
_LETTERS[0x61:0x7B] = _LETTERS[0x80:] = True
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?;\n\r"]] = True


class Transducer:
    """arcs: (state, class) -> (state, name of the context or None); a missing arc goes to `rest`'s state without a name."""

    def __init__(self, start, arcs: dict, rest=lambda state: state) -> None:
        self.start, self.arcs, self.rest = start, arcs, rest

    def step(self, state, kind: int) -> tuple:
        return self.arcs.get((state, kind)) or (self.rest(state), None)


#: A composed arc: the state after it, the factor, and the bits of the names that fired.
Arcs = dict[tuple[int, int], tuple[int, float, int]]


def compose(parts: list[Transducer], factors: dict[str, float]) -> Arcs:
    """All arcs of the product machine, whose states are numbered from 0, the start; factors multiply."""
    numbers = {tuple(p.start for p in parts): 0}
    arcs, queue = {}, [tuple(p.start for p in parts)]
    while queue:
        state = queue.pop()
        for kind in range(8):
            to = [p.step(s, kind) for p, s in zip(parts, state)]
            key, names = tuple(s for s, _ in to), [name for _, name in to if name]
            if key not in numbers:
                numbers[key] = len(numbers)
                queue.append(key)
            arcs[numbers[state], kind] = numbers[key], float(np.prod([factors[n] for n in names])), sum(1 << NAMES.index(n) for n in names)
    return arcs


def transducers() -> list[Transducer]:
    """What reads a clause, each part for itself.  Only insults, threats and targets can score; a target does where a threat
    is aimed at it.  A third person before a threat may be its author, and so is no target of it."""
    scoring = (INSULT, THREAT, TARGET, THIRD)
    # A word that adds to an insult counts more than the first.
    insult = Transducer(0, {(0, INSULT): (1, None), (1, INSULT): (1, "again")})
    # An insult counts more once the clause has a target.
    target = Transducer(0, {(0, TARGET): (1, None), (0, THIRD): (1, None), (1, INSULT): (1, "targeted")})
    # A threat counts once the clause has named whom it is for, or does within a few words; states: named, nothing, waiting.
    threat = {("named", THREAT): ("named", "aimed"), ("named", TARGET): ("named", "loose"), (0, TARGET): ("named", "loose")} | {(s, THREAT): (AIM, "loose") for s in range(AIM + 1)} | {(s, k): ("named", "aimed") for s in range(1, AIM + 1) for k in (TARGET, THIRD)}
    threat |= {(0, THIRD): (0, "loose"), ("named", THIRD): ("named", "loose")}
    threat = Transducer(0, threat, rest=lambda s: s if s == "named" else max(0, s - 1))
    # Negation reaches over articles, forms of to be and adverbs to the next word.
    negation = Transducer(0, {(s, NEGATION): (1, None) for s in (0, 1)} | {(1, FILLER): (1, None)} | {(1, k): (0, "negated") for k in scoring}, rest=lambda s: 0)
    # What follows a verb of speaking is someone else's.
    reported = Transducer(0, {(s, REPORTED): (QUOTED, None) for s in range(QUOTED + 1)} | {(s, k): (s - 1, "reported") for s in range(1, QUOTED + 1) for k in scoring}, rest=lambda s: max(0, s - 1))
    return [insult, target, threat, negation, reported]


def grammar(factors: dict[str, float] = FACTORS) -> Arcs:
    """The composed clause grammar."""
    return compose(transducers(), factors)


class Reader:
    """Words of lower-cased texts with their clauses and the hashes of their stems."""

    def __init__(self, texts: pa.Array) -> None:
        self.words = w = T.words(pc.utf8_lower(texts.cast(pa.large_string())), _LETTERS)
        self.length, self.rows = w.end - w.start, w.rows()
        ends = np.concatenate([[0], np.cumsum(_ENDS[w.data])])
        # A clause is a text's stretch without an end mark.
        self.clause = ends[w.start] + self.rows

    def stems(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, hashes): whole words first, then leading bytes of longer words."""
        yield np.arange(len(self.rows)), self.words.hash
        data = np.append(self.words.data, np.zeros(8, np.uint8))
        for size in STEMS:
            at = np.flatnonzero(self.length > size)
            h = np.zeros(len(at), np.uint64)
            for k in range(size):
                h = h << np.uint64(8) | data[self.words.start[at] + k]
            yield at, T.mix(h + np.uint64(size * 0x9E3779B97F4A7C15 % (1 << 64)))


class Lexicon:
    """Hashes of terms with weights, and of the listed words with classes."""

    def __init__(self, terms: dict[int, float]) -> None:
        listed = T.words(pa.array([w for k in WORDS for w in WORDS[k].split()]))
        kinds = np.repeat(list(WORDS), [len(v.split()) for v in WORDS.values()])
        order = np.argsort(listed.hash)
        self.listed, self.kinds = listed.hash[order], kinds[order].astype(np.int8)
        self.terms = np.array(sorted(terms), np.uint64)
        self.weights = np.array([terms[k] for k in sorted(terms)], float)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[np.concatenate([self.terms, self.listed]) & np.uint64((1 << 20) - 1)] = True

    @staticmethod
    def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
        return at, keys[at] == h if len(keys) else np.zeros(len(h), bool)

    def read(self, reader: Reader) -> tuple[np.ndarray, np.ndarray]:
        """Class and weight of each word."""
        kind, weight = np.zeros(len(reader.rows), np.int8), np.zeros(len(reader.rows))
        for whole, (at, h) in enumerate(reader.stems()):
            near = self.maybe[h & np.uint64((1 << 20) - 1)]
            at, h = at[near], h[near]
            to, hit = self._find(self.terms, h)
            np.maximum.at(weight, at[hit], self.weights[to[hit]])
            if whole == 0:
                to, hit = self._find(self.listed, h)
                kind[at[hit]] = self.kinds[to[hit]]
        kind[(weight > 0) & (kind == OTHER)] = INSULT
        weight[kind != INSULT] = 0
        weight[(weight == 0) & (kind == INSULT)] = 0.5
        weight[(kind == THREAT) | (kind == TARGET) | (kind == THIRD)] = 1.0
        return kind, weight


def read_clauses(texts: pa.Array, lexicon: Lexicon, arcs: Arcs) -> tuple[np.ndarray, np.ndarray]:
    """Per text: log of the clause scores' sum, the highest, the number of scoring clauses, and the sum by length; and the
    bits of the contexts that all its insults and aimed threats stand in (-1 if it has none)."""
    reader = Reader(texts)
    kind, weight = lexicon.read(reader)
    total, best, clauses, inside = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts)), np.full(len(texts), -1)
    loose = 1 << NAMES.index("loose")
    # A clause of targets alone scores nothing.
    scoring = np.unique(reader.clause[(kind == INSULT) | (kind == THREAT)])
    low, high = np.searchsorted(reader.clause, scoring), np.searchsorted(reader.clause, scoring, "right")
    for a, b in zip(low.tolist(), high.tolist()):
        state, score, within = 0, 0.0, -1
        for k, v in zip(kind[a:b].tolist(), weight[a:b].tolist()):
            state, factor, names = arcs[state, k]
            if v and not (k in (TARGET, THIRD) and names & loose):
                score += v * factor
                within &= names
        row = reader.rows[a]
        total[row] += score
        best[row] = max(best[row], score)
        clauses[row] += score > 0.2
        inside[row] &= within
    return np.column_stack([np.log1p(total), np.minimum(best, 4), np.log1p(clauses), np.log1p(100 * total / (reader.words.counts() + 20))]), inside


def learn_factors(inside: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """Each context's factor from the labels of the texts that score in it alone; a context that isn't met keeps its own."""
    out = {}
    for bit, (name, own) in enumerate(FACTORS.items()):
        alone = (inside >= 0) & (inside >> bit & 1 == 1)
        out[name] = own * PRIOR / (alone.sum() + PRIOR) + max(own, 1.0) * y[alone].sum() / (alone.sum() + PRIOR)
    return out


class Scorer:
    """The curve over read_clauses' features, with lexicon and factors."""

    def __init__(self, lexicon: Lexicon, factors: dict[str, float], x: np.ndarray, y: np.ndarray) -> None:
        self.lexicon, self.factors, self.arcs = lexicon, factors, grammar(factors)
        self.shift, self.scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(4), np.ones(4))
        self.beta = np.array([-3.0, 1.0, 1.0, 1.0, 1.0])
        if len(np.unique(y)) == 2:
            z, self.beta = self._z(x), np.zeros(5)
            # Both labels weigh alike, so that the curve doesn't lean towards the commoner one.
            share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
            for _ in range(30):
                p = 1 / (1 + np.exp(-np.clip(z @ self.beta, -30, 30)))
                hess = (z * (share * p * (1 - p))[:, None]).T @ z + np.diag([0.01, *[0.5] * 4])
                step = np.linalg.solve(hess, z.T @ (share * (p - y)) + np.array([0.01, *[0.5] * 4]) * self.beta)
                self.beta -= np.clip(step, -2, 2)
                if np.abs(step).max() < 1e-8:
                    break

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), (x - self.shift) / self.scale])

    def score(self, texts: pa.Array) -> np.ndarray:
        x, _ = read_clauses(texts, self.lexicon, self.arcs)
        return 1 / (1 + np.exp(-np.clip(self._z(x) @ self.beta, -36, 36)))


def _term_counts(sample: DataFrame) -> DataFrame:
    """(term, toxic, clean): the sample's documents of either label that hold each term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y in (0, 1):
                terms = []
                for part in T.slices(batch.filter(pc.equal(batch.column("y"), y)), "text"):
                    reader = Reader(part.column("text"))
                    terms += [T.distinct(reader.rows[at], h, part.num_rows)[0] for at, h in reader.stems()]
                term, n = np.unique(np.concatenate(terms or [np.zeros(0, np.uint64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(T.signed(term)), pa.array(np.full(len(term), y, np.int32)), pa.array(n.astype(np.int64))], ["term", "y", "n"])

    of = lambda y: F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0))
    return sample.select("text", "y").mapInArrow(count, "term long, y int, n long").groupBy("term").agg(of(1).alias("toxic"), of(0).alias("clean"))


def learn_lexicon(sample: DataFrame, max_terms: int = MAX_TERMS) -> Lexicon:
    """Terms of (text, y) rows that toxic texts hold far more often than others; at most max_terms, the most telling."""
    sizes = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Lexicon({})
    weight = F.log((F.col("toxic") + 0.1) / (sizes[1] + 0.2)) - F.log((F.col("clean") + 0.5) / (sizes[0] + 1))
    telling = _term_counts(sample).where(F.col("toxic") >= LEAST_DOCS).select("term", weight.alias("weight")).where(F.col("weight") >= LEAST_WEIGHT)
    return Lexicon({r.term % (1 << 64): min(r.weight / FULL_WEIGHT, 1.0) for r in telling.orderBy(F.desc("weight"), F.desc("term")).limit(max_terms).collect()})


def fit(documents: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, max_rows: int = MAX_ROWS) -> Scorer:
    """Learns from labelled rows outside the held-out fold (crc32 of doc_id as text, modulo `modulus`)."""
    sample = labelled_sample(documents, labels, "toxic", modulus, held_out, max_rows)
    sample = kept(sample, "toxicity-sample")
    curve = F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), F.lit(10)) < 4
    lexicon = learn_lexicon(sample.where(~curve))
    factors = learn_factors(*_measured(sample.where(curve), lexicon, FACTORS)[1:])
    x, _, y = _measured(sample.where(curve), lexicon, factors)
    return Scorer(lexicon, factors, x, y)


def _measured(sample: DataFrame, lexicon: Lexicon, factors: dict[str, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, contexts and labels of a bounded sample."""
    shared, arcs = sample.sparkSession.sparkContext.broadcast(lexicon), grammar(factors)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                x, inside = read_clauses(part.column("text"), shared.value, arcs)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(list(x), pa.list_(pa.float64())), pa.array(inside.astype(np.int64))], ["doc_id", "y", "x", "inside"])

    # In one order, so that the curve doesn't depend on how Spark dealt the rows.
    rows = sorted((r.doc_id, r.y, r.x, r.inside) for r in sample.mapInArrow(measure, "doc_id long, y int, x array<double>, inside long").collect())
    return np.array([r[2] for r in rows]).reshape(len(rows), 4), np.array([r[3] for r in rows], np.int64), np.array([r[1] for r in rows], int)


def score(documents: DataFrame, scorer: Scorer, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted (score >= threshold) of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(scorer)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                s = shared.value.score(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return documents.select("doc_id", "text").mapInArrow(scored, "doc_id long, score double, predicted int")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; labels come from folds 0 and 2 of crc32(doc_id) mod 3 only."""
    documents, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(documents, fit(documents, labels)).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
