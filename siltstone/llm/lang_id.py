"""Language identification of mixed-language text.

Script ranges narrow each word's candidates to the languages in which that script was
seen; a word's scores are naive-Bayes log likelihoods over its byte n-grams; Viterbi
with a switching penalty labels spans; a document's language is the one whose spans
hold most letters. Counts are taken over every training row and kept for every n-gram
by its own code, so what is collected grows with the distinct n-grams and, for each, the
languages it was seen in. A task's memory grows with the words of a text times languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm import spans

# First code points of script ranges, with a name for each range.
SCRIPT_RANGES = [
    (0x0000, "common"), (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "common"), (0x3040, "kana"),
    (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0x20000, "han"), (0x30000, "other"),
]

GRAMS = (1, 2, 3, 4)
#: Distinct words a worker keeps scores of, and bytes of these scores, at most.
KNOWN_BITS, KNOWN_BYTES = 20, 64 << 20
#: Text bytes that Viterbi steps through side by side, with up to STEP_LANGUAGES languages; with more, fewer bytes.
STEP_BYTES, STEP_LANGUAGES = 2 << 20, 16
#: Words whose n-grams are looked up at once.
PART_WORDS = 1 << 11
#: Above the codes of n-grams: where those of scripts are counted.
_SCRIPT_CODE = 1 << 39
_START, _SCRIPTS = np.array([a for a, _ in SCRIPT_RANGES]), [n for _, n in SCRIPT_RANGES]
SCRIPTS = list(dict.fromkeys(_SCRIPTS))


def _letters() -> np.ndarray:
    table = np.zeros(256, bool)
    table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = True
    return table


_CLASS = _letters()
_LOWER = spans.ascii_lower_table()


def _lead_scripts() -> np.ndarray:
    """Script number by the first two UTF-8 bytes (enough for ranges of two bytes, near enough for others)."""
    names = {n: i for i, n in enumerate(SCRIPTS)}
    table = np.full(1 << 16, names["other"], np.uint8)
    for lead in range(256):
        for second in range(256):
            if lead < 0x80:
                point = lead
            elif 0xC0 <= lead < 0xE0:
                point = (lead & 31) << 6 | second & 63
            elif 0xE0 <= lead < 0xF0:
                point = (lead & 15) << 12 | (second & 63) << 6
            else:
                point = (lead & 7) << 18 | (second & 63) << 12
            table[lead << 8 | second] = names[_SCRIPTS[int(np.searchsorted(_START, point, "right")) - 1]]
    return table


@lru_cache(maxsize=1)
def _script_table() -> np.ndarray:
    return _lead_scripts()


def _words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = spans.text_buffer(part.column("text"))
    data = _LOWER[data]
    return data, *spans.word_spans(data, offsets, _CLASS)


def _scripts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Script of each word, by its last character (accents of Latin words are Latin as well)."""
    last = ends - 1
    for _ in range(3):
        last = np.where((last > starts) & (data[last] >= 0x80) & (data[last] < 0xC0), last - 1, last)
    second = data[np.minimum(last + 1, len(data) - 1)] if len(data) else data
    return _script_table()[data[last].astype(np.int64) << 8 | second]


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (length and bytes, below 2^35) of the n-grams of given words, edges marked, and the word of each."""
    sizes = ends - starts
    at = np.repeat(np.cumsum(sizes + 2) - sizes - 1 - starts, sizes) + _spread(starts, sizes)
    padded = np.full(int((sizes + 2).sum()), 0x20, np.uint64)
    padded[at] = data[_spread(starts, sizes)]
    begin = np.cumsum(sizes + 2) - sizes - 2
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 2)
    end = begin + sizes + 2
    codes, owners = [], []
    for n in GRAMS:
        code = np.full(max(0, len(padded) - n + 1), n, np.uint64)
        for i in range(n):
            code = code << np.uint64(8) | padded[i : i + len(code)]
        fits = np.arange(len(code)) + n <= end[owner[: len(code)]]
        codes.append(code[fits].astype(np.int64))
        owners.append(owner[: len(code)][fits])
    return np.concatenate(codes), np.concatenate(owners)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.cumsum(sizes)
    return np.repeat(starts - (total - sizes), sizes) + np.arange(int(total[-1]) if len(total) else 0)


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # ascending codes
    bounds: np.ndarray  # n-gram i was seen in languages seen[bounds[i]:bounds[i + 1]]
    seen: np.ndarray
    gains: np.ndarray  # log likelihoods of those, above that of an n-gram not seen in the language
    unseen: np.ndarray  # by language
    scripts: np.ndarray  # scripts x languages, whether the script was seen in the language
    switch: float
    known: spans.Interner | None = field(default=None, repr=False)
    scores: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": None, "scores": None}

    def step_bytes(self) -> int:
        return max(1, STEP_BYTES * STEP_LANGUAGES // max(STEP_LANGUAGES, len(self.languages)))

    def fresh_scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Scores of words, some thousands at a time: each has dozens of n-grams."""
        parts = [self._scores(data, starts[i : i + PART_WORDS], ends[i : i + PART_WORDS]) for i in range(0, len(starts), PART_WORDS)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)

    def _scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        gram, word = _grams(data, starts, ends)
        n, m = len(starts), len(self.languages)
        count = np.bincount(word, minlength=n)
        at = np.searchsorted(self.grams, gram)
        hit = np.append(self.grams, -1)[at] == gram
        at, word = at[hit], word[hit]
        many = self.bounds[at + 1] - self.bounds[at]
        place = _spread(self.bounds[at], many)
        sums = np.bincount(np.repeat(word, many) * m + self.seen[place], self.gains[place], n * m).reshape(n, m) + count[:, None] * self.unseen
        means = sums / np.maximum(count, 1)[:, None] * np.minimum(ends - starts, 12)[:, None]  # a long word counts no more than twelve bytes
        return np.where(self.scripts[_scripts(data, starts, ends)], means, means.min(axis=1, keepdims=True) - 8).astype(np.float32)

    def word_scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.known is None:
            self.known = spans.Interner(min(KNOWN_BITS, max(4, (2 * KNOWN_BYTES // (4 * len(self.languages))).bit_length() - 1)))
            self.scores = np.zeros((self.known.most, len(self.languages)), np.float32)
        keys = spans.hash_spans(data, starts, ends)
        number = self.known.find(keys)
        missing = np.flatnonzero(number < 0)
        scores = self.scores
        if len(missing):
            fresh, where, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            first = missing[where]
            found = self.fresh_scores(data, starts[first], ends[first])
            base, room = self.known.size, self.known.add(fresh)
            self.scores[base : base + room] = found[:room]
            out = np.empty((len(keys), len(self.languages)), np.float32)
            out[number >= 0] = scores[number[number >= 0]]
            out[missing] = found[back]
            return out
        return scores[number]

    def label(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Viterbi over each document's words, documents side by side: a label per word."""
        n, m = scores.shape
        number = np.min_scalar_type(max(0, m - 1))  # the narrowest type that numbers all languages
        labels = np.zeros(n, np.int64)
        back = np.zeros((n, m), number)  # whether the best way here came from another language, and which
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        size, start = size[order], first[:-1][order]
        active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
        best = np.zeros((len(size), m), np.float32)
        own = np.arange(m, dtype=number)
        for t in range(len(active)):
            k = active[t]
            rows = start[:k] + t
            if t == 0:
                best[:k] = scores[rows]
                continue
            top = best[:k].argmax(axis=1)
            jump = best[np.arange(k), top] - self.switch
            stay = best[:k] >= jump[:, None]
            back[rows] = np.where(stay, own, top[:, None])
            best[:k] = np.where(stay, best[:k], jump[:, None]) + scores[rows]
        now = best.argmax(axis=1)
        for t in range(len(active) - 1, -1, -1):
            k = active[t]
            rows = start[:k] + t
            labels[rows] = now[:k]
            if t:
                now[:k] = back[rows, now[:k]]
        return labels


def is_training(doc_id: str = "doc_id") -> F.Column:
    """Rows from which may be learned: crc32 of the doc_id as text, modulo 4, is not 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2, F.lit(False))


def fit(rows: DataFrame, switch: float = 6.0) -> Model:
    """Learn from ``rows (text, lang)``, all of them. A count for each n-gram of each language is collected.

    An n-gram weighs the square root of its total count, so that those of rare words have a
    say; totals are sums over all rows, so weights don't depend on the rows' layout.
    """

    def counted(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(language and n-gram or script, count) of a chunk: each distinct word once, by how often it occurs."""
        lang = part.column("lang_").to_numpy().astype(np.int64)
        data, starts, ends, first = _words(part)
        owner = np.repeat(lang, np.diff(first))
        _, at, times = np.unique(spans.mix(spans.hash_spans(data, starts, ends) + owner.astype(np.uint64)), return_index=True, return_counts=True)
        at = at[order := np.argsort(at)]
        times, starts, ends, owner = times[order], starts[at], ends[at], owner[at]
        for i in range(0, len(at), PART_WORDS):
            some = slice(i, i + PART_WORDS)
            gram, word = _grams(data, starts[some], ends[some])
            key, back = np.unique(owner[some][word] << 40 | gram, return_inverse=True)
            yield key, np.bincount(back, times[some][word]).astype(np.int64)
            script = _scripts(data, starts[some], ends[some])
            key, back = np.unique(owner[some] << 40 | _SCRIPT_CODE | script.astype(np.int64), return_inverse=True)
            yield key, np.bincount(back, times[some]).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("lang").dictionary_encode()
            numbered = pa.record_batch({"text": batch.column("text"), "lang_": names.indices})
            keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
            for part in spans.chunks(numbered, "text"):
                found = [(keys, counts), *counted(part)]
                keys, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([n for _, n in found]), len(keys)).astype(np.int64)
            yield pa.record_batch({"lang": names.dictionary.take(pa.array(keys >> 40)), "gram": pa.array(keys & (1 << 40) - 1), "n": pa.array(counts)})

    known = rows.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    got = known.mapInArrow(spans.tidy(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = got.column("lang").combine_chunks().dictionary_encode()
    languages = sorted(names.dictionary.to_pylist())
    lang = np.array([languages.index(x) for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
    gram, n = got.column("gram").to_numpy(), got.column("n").to_numpy().astype(np.float64)
    is_gram = gram < _SCRIPT_CODE
    grams, at = np.unique(gram[is_gram], return_inverse=True)
    order = np.lexsort((lang[is_gram], at))
    at, seen, times = at[order], lang[is_gram][order], np.sqrt(n[is_gram][order])
    total = np.bincount(seen, times, len(languages)) + 0.5 * (len(grams) + 1)  # half a count for each n-gram, and for all others together
    scripts = np.zeros((len(SCRIPTS), len(languages)))
    scripts[gram[~is_gram] - _SCRIPT_CODE, lang[~is_gram]] += n[~is_gram]
    share = scripts / np.maximum(scripts.sum(axis=0, keepdims=True), 1)
    allowed = share > 0.001
    allowed[~allowed.any(axis=1)] = True
    bounds = np.searchsorted(at, np.arange(len(grams) + 1))
    return Model(languages, grams, bounds, seen.astype(np.min_scalar_type(len(languages))), np.log1p(2 * times).astype(np.float32), np.log(0.5 / total), allowed, switch)


def _judged(model: Model, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """lang_pred, score and spans of texts."""
    part = pa.record_batch({"text": texts})
    data, starts, ends, first = _words(part)
    n, m = part.num_rows, max(1, len(model.languages))
    weight = (ends - starts).astype(np.float64)
    owner = np.repeat(np.arange(n), np.diff(first))
    named = len(model.languages) > 0
    labels = model.label(model.word_scores(data, starts, ends), first) if named and len(starts) else np.zeros(len(starts), np.int64)
    share = np.bincount(owner * m + labels, weight, n * m).reshape(n, m)
    total, best = share.sum(axis=1), share.argmax(axis=1)
    plain = np.bincount(owner, data[starts] < 0x80, n) if len(starts) else np.zeros(n)
    lettered = (total > 0) & named
    for i in np.flatnonzero((total > 0) & (plain == 0)).tolist():  # no word begins with an ASCII letter: look closer
        lettered[i] &= any(c.isalpha() for c in texts[i].as_py())
    lang = [model.languages[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
    score = np.where(lettered, share[np.arange(n), best] / np.maximum(total, 1), 0.0)
    change = np.ones(len(labels), bool)
    change[1:] = (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(change)
    names = np.array([*model.languages, "und"], object)
    items = pa.StructArray.from_arrays([pa.array(names[labels[at]], pa.string()), pa.array(np.diff(np.append(at, len(labels))), pa.int64())], ["lang", "words"])
    return pa.array(lang, pa.string()), pa.array(score), pa.ListArray.from_arrays(pa.array(np.searchsorted(at, first), pa.int32()), items)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred, score, spans`` over whole texts, row by row (no shuffle).

    spans lists runs of ``(lang, words)``. score is the share of letters in spans of
    lang_pred. Null texts and texts without letters are ``und`` with score 0. With no
    language learned everything is ``und``. Ties go to the first language by name.
    Columns of these names in ``docs`` are replaced.
    """
    rows = docs.drop("lang_pred", "score", "spans")
    schema = T.StructType([*rows.schema.fields, *T._parse_datatype_string("lang_pred string, score double, spans array<struct<lang:string,words:long>>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.chunks(batch, text_col, model.step_bytes()):
                got = _judged(model, part.column(text_col))
                yield pa.RecordBatch.from_arrays([*part.columns, *got], [*part.schema.names, "lang_pred", "score", "spans"])

    return rows.mapInArrow(spans.tidy(run), schema)


def identify(docs: DataFrame, switch: float = 6.0) -> DataFrame:
    """Fit on training rows with a language, then predict all: ``doc_id, held_out, lang_pred, score, spans``.
    A null doc_id is never trained on and not held out."""
    model = fit(docs.filter(is_training()).select("text", "lang"), switch)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return predict(rows, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "spans")
