"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five transducers read a clause's token classes (insult, threat, target, negation,
reported speech). Their composition is built once as a product automaton: each step
gives a next state and the arcs that are taken, one of each transducer. What a clause
emits at an insult, at a threat and at the target of a threat is a weight times the
weights of the arcs that it was read by; its score is the sum. Clauses without insult or
threat emit nothing and are skipped. The insult lexicon (whole words and word beginnings
with log odds), the weights of threats and arcs, and the calibration from clause scores
to a probability are all learned from labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import spans

# Closed-class words of the grammar in English, German, French and Spanish.
THREATS = "kill hurt destroy beat crush burn shoot stab strangle murder toten töten umbringen schlagen vernichten erschießen tuer frapper détruire brûler matar golpear destruir quemar".split()
TARGETS = "you your yours yourself he she him her they them people everyone du dich dir dein ihr euch sie ihn leute tu toi vous votre ils elles gens tú usted ustedes ellos ellas gente".split()
NEGATIONS = "not no never none nobody don't isn't aren't won't can't nicht kein keine nie niemals pas jamais aucun ne nunca jamás ningún ninguna".split()
REPORTS = "said says say told wrote writes claimed quoted reported according sagte sagt schrieb laut dit écrit selon raconte dijo dice escribió según".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Documented bound of the labelled rows that are learned from.
MOST_LABELLED = 20_000
#: Rows with label 1 that a feature of the lexicon is seen in, at least.
LEAST = 3
PREFIXES = range(3, 10)
#: Standard errors by which the log odds of a feature of the lexicon are above zero, at least.
CLEAR = 2.5
#: Folds of the cross-fitted calibration.
FOLDS = 8
#: Words that a task keeps the weights of: with the whole lexicon, and with each fold's.
KNOWN_BITS, FOLD_BITS = 20, 14
#: Penalty of a squared logarithm of an arc's weight, in units of log loss.
PRIOR = 0.5

#: Transducers: (states, next state by class). Each has two arcs on a class: from its state 0, and from any other.
INSULTED = ([0, 1, 2, 3], lambda s, c: 3 if c == INSULT else max(0, s - 1))
THREATENED = ([0, 1, 2, 3], lambda s, c: 3 if c == THREAT else max(0, s - 1))
TARGETED = ([0, 1, 2, 3, 4], lambda s, c: 4 if c == TARGET else max(0, s - 1))
NEGATED = ([0, 1, 2, 3], lambda s, c: 3 if c == NEGATION else max(0, s - 1))
REPORTED = ([0, 1], lambda s, c: 1 if s or c == REPORT else 0)
PARTS = (INSULTED, THREATENED, TARGETED, NEGATED, REPORTED)
#: What is emitted: the lexicon's weight at an insult; one at a threat, and at a target that follows a threat.
AT_INSULT, AT_THREAT, AT_TARGET = range(3)
COMBINATIONS = 1 << len(PARTS)


def compose(*parts: tuple) -> tuple[list[list[int]], list[list[int]]]:
    """The product automaton, by (state, class): next state, and what is emitted as kind * COMBINATIONS + arcs
    (bit i: arc of part i from another state than 0), or -1. State 0 is the start."""
    states = list(product(*(p[0] for p in parts)))
    number = {s: i for i, s in enumerate(states)}
    step = [[number[tuple(p[1](x, c) for p, x in zip(parts, s, strict=True))] for c in range(6)] for s in states]
    emitted = []
    for s in states:
        arcs = sum((x > 0) << i for i, x in enumerate(s))
        threatened = bool(s[parts.index(THREATENED)])
        kinds = {INSULT: AT_INSULT, THREAT: AT_THREAT} | ({TARGET: AT_TARGET} if threatened else {})
        emitted.append([kinds[c] * COMBINATIONS + arcs if c in kinds else -1 for c in range(6)])
    return step, emitted


_STEP, _EMITTED = compose(*PARTS)


@dataclass
class Arcs:
    """Logarithms of weights: ``base`` of threats and of their targets, ``arcs`` by kind and transducer."""

    base: np.ndarray = field(default_factory=lambda: np.zeros(2))
    arcs: np.ndarray = field(default_factory=lambda: np.zeros((3, len(PARTS))))

    def weights(self) -> np.ndarray:
        """By kind * COMBINATIONS + arcs."""
        taken = np.arange(COMBINATIONS)[:, None] >> np.arange(len(PARTS)) & 1
        return np.exp(np.concatenate([[0.0], self.base])[:, None] + self.arcs @ taken.T).ravel()


def emissions(classes: list[int], weights: list[float]) -> Iterator[tuple[int, float]]:
    """(kind and arcs, weight) that the composed transducer emits over one clause; weights are those of insults."""
    state = 0
    for c, w in zip(classes, weights, strict=True):
        out = _EMITTED[state][c]
        if out >= 0:
            yield out, w if c == INSULT else 1.0
        state = _STEP[state][c]


def _word_class() -> np.ndarray:
    table = np.zeros(256, bool)
    table[0x61:0x7B] = table[0x41:0x5B] = table[0x80:] = True
    table[0x27] = True
    return table


def _breaks() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in ".!?;:\n\r"]] = True
    return table


_WORD, _BREAK = _word_class(), _breaks()
_CLOSED = {w.encode(): c for c, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in words}


def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased (Unicode) bytes and offsets; null: empty."""
    return spans.text_buffer(pa.array([(x or "").lower() for x in column.to_pylist()], pa.large_string()))


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word number, feature hash): whole words, then beginnings that end between characters."""
    every = np.arange(len(starts))
    yield every, spans.hash_spans(data, starts, ends)
    for k in PREFIXES:
        to = starts + k
        fits = np.flatnonzero(to < ends)
        fits = fits[(data[to[fits]] & 0xC0) != 0x80]
        yield fits, spans.hash_spans(data, starts[fits], to[fits]) ^ np.uint64(0x5851F42D4C957F2D)


@dataclass
class Lexicon:
    keys: np.ndarray  # ascending feature hashes
    weights: np.ndarray
    bits: int = KNOWN_BITS
    known: spans.Interner | None = field(default=None, repr=False)
    value: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": None, "value": None}

    def fresh(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Insult weight of words (0: none): the largest of their features'; -1 marks a threat."""
        out = np.zeros(len(starts))
        if len(self.keys):
            for words, keys in _features(data, starts, ends):
                at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                hit = self.keys[at] == keys
                np.maximum.at(out, words[hit], self.weights[at[hit]])
        raw = {spans.hash_spans(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] for w, c in _CLOSED.items() if c == THREAT}
        out[np.isin(spans.hash_spans(data, starts, ends), np.array(sorted(raw), np.uint64))] = -1
        return out

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.known is None:
            self.known = spans.Interner(self.bits)
            self.value = np.zeros(self.known.most)
        keys = spans.hash_spans(data, starts, ends)
        number = self.known.find(keys)
        out = np.where(number >= 0, self.value[number], 0.0)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            fresh, where, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            order = np.argsort(starts[missing[where]])
            first = missing[where][order]
            found = np.empty(len(fresh))
            found[order] = self.fresh(data, starts[first], ends[first])
            base, room = self.known.size, self.known.add(fresh)
            self.value[base : base + room] = found[:room]
            out[missing] = found[back]
        return out


@dataclass
class Found:
    """Words of each document, and the emissions of its clauses with an insult or threat."""

    words: np.ndarray  # by document
    owner: np.ndarray  # document, by clause
    clause: np.ndarray  # by emission
    arc: np.ndarray
    weight: np.ndarray
    text: list[bytes]  # by clause

    def scores(self, arcs: np.ndarray) -> np.ndarray:
        """By clause, with weights of arcs."""
        return np.bincount(self.clause, self.weight * arcs[self.arc], len(self.owner))

    def measures(self, arcs: np.ndarray) -> np.ndarray:
        """Per document: what the calibration reads."""
        n, score = len(self.words), self.scores(arcs)
        total, matched = np.bincount(self.owner, score, n), np.bincount(self.owner, minlength=n)
        most = np.zeros(n)
        np.maximum.at(most, self.owner, score)
        strong = np.bincount(self.owner, score > 2.5, n)
        words = np.log1p(self.words)
        return np.stack([np.log1p(total), np.log1p(most), np.log1p(strong), np.sqrt(total / np.maximum(self.words, 1)), np.log1p(matched) - words, words], axis=1)


def _clauses(column: pa.Array, lexicon: Lexicon) -> Found:
    data, offsets = _lowered(column)
    starts, ends, first = spans.word_spans(data, offsets, _WORD)
    value = lexicon.of(data, starts, ends) if len(starts) else np.zeros(0)
    stops = np.unique(np.concatenate([np.flatnonzero(_BREAK[data]), offsets]))
    clause = np.searchsorted(stops, starts, "right")
    hit = np.unique(clause[value != 0])
    begin, end = np.searchsorted(clause, hit), np.searchsorted(clause, hit, "right")
    raw = data.tobytes()
    number, arc, weight, text = [], [], [], []
    for i, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
        at, to, v = starts[a:b].tolist(), ends[a:b].tolist(), value[a:b].tolist()
        classes = [THREAT if x < 0 else INSULT if x else _CLOSED.get(raw[i:j], OTHER) for x, i, j in zip(v, at, to, strict=True)]
        for out, w in emissions(classes, v):
            number.append(i)
            arc.append(out)
            weight.append(w)
        text.append(raw[at[0] : to[-1]])
    return Found(np.diff(first), np.searchsorted(first, begin, "right") - 1, np.array(number, np.int64), np.array(arc, np.int64), np.array(weight), text)


@dataclass
class Model:
    """Logistic over the measures of texts with a matched clause; ``plain`` is the score of all others."""

    lexicon: Lexicon
    arcs: Arcs
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray
    plain: float

    def score(self, found: Found) -> np.ndarray:
        measures = found.measures(self.arcs.weights())
        z = np.clip((measures - self.mean) / self.scale, -8, 8) @ self.beta[1:] + self.beta[0]
        matched = np.bincount(found.owner, minlength=len(found.words)) > 0
        return np.where(matched, 1 / (1 + np.exp(-np.clip(z, -30, 30))), self.plain)


def is_training(doc_id: str = "doc_id") -> F.Column:
    """Rows whose labels may be learned from: crc32 of the doc_id as text, modulo 5, is not 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0, F.lit(False))


def _once(part: pa.RecordBatch, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, feature) pairs of the given rows of a chunk, each once."""
    data, offsets = _lowered(part.column("text").take(pa.array(rows)))
    starts, ends, first = spans.word_spans(data, offsets, _WORD)
    owner = np.repeat(rows, np.diff(first))
    for words, keys in _features(data, starts, ends):
        if len(keys):
            pairs = np.unique(np.stack([keys, owner[words].astype(np.uint64)], axis=1), axis=0)
            yield pairs[:, 1].astype(np.int64), pairs[:, 0]


def _learn_lexicons(rows: DataFrame) -> list[Lexicon]:
    """Of all folds but one, for each fold; then of all, from ``rows (text, toxic, fold)``.

    First the features of rows with label 1 are counted; those seen in ``LEAST`` rows are
    then counted over all rows, by fold. All whose log odds are clearly above chance are kept.
    """

    def toxic_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.chunks(batch, "text", 4 << 20):
                bad = np.flatnonzero(part.column("toxic").to_numpy(zero_copy_only=False))
                for _, keys in _once(part, bad):
                    key, n = np.unique(keys, return_counts=True)
                    yield pa.record_batch({"key": pa.array(key.view(np.int64)), "t": pa.array(n)})

    sizes = np.zeros((FOLDS, 2))
    for r in rows.groupBy("fold", "toxic").count().collect():  # two rows a fold
        sizes[r.fold, int(r.toxic)] = r["count"]
    counts = rows.select("text", "toxic").mapInArrow(spans.tidy(toxic_only), "key long, t long").groupBy("key").agg(F.sum("t").alias("t"))
    got = counts.filter(F.col("t") >= LEAST).select("key").toArrow()  # of the bounded sample
    keys = np.sort(got.column("key").to_numpy().view(np.uint64))

    def of_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(keys), FOLDS * 2), np.int32)
        for batch in batches:
            for part in spans.chunks(batch, "text", 4 << 20):
                kind = part.column("fold").to_numpy(zero_copy_only=False) * 2 + part.column("toxic").to_numpy(zero_copy_only=False)
                for doc, found in _once(part, np.arange(part.num_rows)):
                    at = np.minimum(np.searchsorted(keys, found), max(0, len(keys) - 1))
                    hit = keys[at] == found if len(keys) else np.zeros(len(found), bool)
                    np.add.at(table, (at[hit], kind[doc[hit]]), 1)
        at, kind = np.nonzero(table)
        yield pa.record_batch({"at": pa.array(at, pa.int32()), "kind": pa.array(kind, pa.int32()), "n": pa.array(table[at, kind].astype(np.int64))})

    got = rows.select("text", "toxic", "fold").mapInArrow(spans.tidy(of_candidates), "at int, kind int, n long").groupBy("at", "kind").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((len(keys), FOLDS * 2))
    table[got.column("at").to_numpy(), got.column("kind").to_numpy()] = got.column("n").to_numpy()
    out = []
    for fold in range(FOLDS + 1):
        own = np.arange(FOLDS) != fold
        good, bad = sizes[own].sum(axis=0)
        n, t = (table[:, i::2][:, own].sum(axis=1) + 0.25 for i in (0, 1))
        w = np.log(t / (bad + 0.5)) - np.log(n / (good + 0.5))
        kept = np.flatnonzero((t >= LEAST * own.mean()) & (w > 1.0) & (w > CLEAR * np.sqrt(1 / t + 1 / n)))
        out.append(Lexicon(keys[kept], np.minimum(w[kept], 6.0), FOLD_BITS if fold < FOLDS else KNOWN_BITS))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, beta: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """mean, scale, coefficients and penalised loss; ``beta`` is where to begin."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    beta, ridge = np.zeros(a.shape[1]) if beta is None else beta.copy(), np.diag([1e-6] + [1e-2] * (a.shape[1] - 1)) * len(x) ** 0.5
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) + ridge, a.T @ (y - p) - ridge @ beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    z = np.clip(a @ beta, -30, 30)
    return mean, scale, beta, float(np.logaddexp(0, z).sum() - y @ z + beta @ ridge @ beta / 2)


def _learn_arcs(found: Found, y: np.ndarray) -> tuple[Arcs, np.ndarray, np.ndarray, np.ndarray]:
    """Weights of arcs and the calibration, both of least penalised loss: each logarithm in turn is moved by steps that
    are halved when none helps. Arcs without a say stay at weight one."""
    arcs = Arcs()
    mean, scale, beta, loss = _logistic(found.measures(arcs.weights()), y)
    used = np.unique(found.arc)
    places = [(arcs.base, (k - 1,)) for k in (AT_THREAT, AT_TARGET) if (used // COMBINATIONS == k).any()]
    for k in range(3):
        mine = used[used // COMBINATIONS == k] % COMBINATIONS
        places += [(arcs.arcs, (k, i)) for i in range(len(PARTS)) if (mine >> i & 1).any() and not (k == AT_TARGET and PARTS[i] is THREATENED)]
    penalty, step = 0.0, 1.0
    while places and step > 0.1:
        moved = False
        for values, at in places:
            for by in (-step, step):
                was = values[at]
                if abs(was + by) > 5:
                    continue
                values[at] = was + by
                extra = penalty + PRIOR * ((was + by) ** 2 - was**2)
                tried = _logistic(found.measures(arcs.weights()), y, beta)
                if tried[3] + extra < loss + penalty - 0.01:
                    (mean, scale, beta, loss), penalty, moved = tried, extra, True
                    break
                values[at] = was
        step = step if moved else step / 2
    return arcs, mean, scale, beta


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Learn from at most ``most`` labelled training rows, in the order of a hash of their ids.

    Rows with null text, id or label are left out; of repeated labels the largest holds.
    Without both labels the model scores every text by the share of label 1.
    """
    known = labels.filter(is_training()).filter("toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    chosen = known.withColumn("order_", F.xxhash64("doc_id", F.lit(7))).orderBy("order_", "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    rows = rows.join(F.broadcast(chosen), "doc_id")  # `most` rows of an id and a flag
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(FOLDS)).cast("int"))
    *others, lexicon = _learn_lexicons(rows)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row by the lexicon that its own fold had no part in."""
        for batch in batches:
            for part in spans.chunks(batch, "text"):
                for i in range(FOLDS):
                    own = part.filter(pa.array(part.column("fold").to_numpy(zero_copy_only=False) == i))
                    f = _clauses(own.column("text"), others[i])
                    bounds = pa.array(np.searchsorted(f.owner[f.clause], np.arange(own.num_rows + 1)), pa.int32())
                    lists = {n: pa.ListArray.from_arrays(bounds, pa.array(x)) for n, x in (("clause", f.clause), ("arc", f.arc), ("weight", f.weight))}
                    yield pa.record_batch({"toxic": own.column("toxic"), "words": pa.array(f.words), **lists})

    # of `most` rows at most, what their matched clauses emit
    got = rows.select("text", "toxic", "fold").mapInArrow(spans.tidy(match), "toxic boolean, words long, clause array<long>, arc array<long>, weight array<double>").toArrow().combine_chunks()
    y, words = got.column("toxic").to_numpy().astype(float), got.column("words").to_numpy()
    clause, arc, weight = (got.column(c).combine_chunks() for c in ("clause", "arc", "weight"))
    owner = np.repeat(np.arange(len(y)), clause.value_lengths().to_numpy().astype(np.int64))
    matched = np.bincount(owner, minlength=len(y)) > 0
    plain = float((y[~matched].sum() + 0.1) / ((~matched).sum() + 0.2 + 10 * (not y.any())))
    lexicon_only = Model(lexicon, Arcs(), np.zeros(6), np.ones(6), np.zeros(7), plain)
    y, words, owner = y[matched], words[matched], (np.cumsum(matched) - 1)[owner]
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.1) / (len(y) + 0.3)
        lexicon_only.beta[0] = np.log(rate / (1 - rate))
        return lexicon_only
    pairs, number = np.unique(np.stack([owner, clause.flatten().to_numpy()], axis=1), axis=0, return_inverse=True)
    found = Found(words, pairs[:, 0], number.ravel(), arc.flatten().to_numpy(), weight.flatten().to_numpy(), [])
    return Model(lexicon, *_learn_arcs(found, y), plain)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``doc_id, score, predicted`` over whole texts. Null and blank texts get the score of a text without clauses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.chunks(batch, "text"):
                p = model.score(_clauses(part.column("text"), model.lexicon))
                yield pa.record_batch({"doc_id": part.column("doc_id"), "score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32))})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(spans.tidy(run), "doc_id long, score double, predicted int")


def clauses(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Matched clauses: ``doc_id, clause, score``."""
    weights = model.arcs.weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.chunks(batch, "text"):
                found = _clauses(part.column("text"), model.lexicon)
                ids = part.column("doc_id").take(pa.array(found.owner))
                yield pa.record_batch({"doc_id": ids, "clause": pa.array([t.decode() for t in found.text], pa.string()), "score": pa.array(found.scores(weights))})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(spans.tidy(run), "doc_id long, clause string, score double")


def toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """Fit, then score every document: ``doc_id, held_out, score, predicted``. A null doc_id isn't held out."""
    model = fit(docs, labels, most)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
