import math
import random
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import lang_id, queries, toxicity, url_filter

from .common import DATA, frame

BIG = "/root/testdata/sf0.01"


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_language_held_out_accuracy(spark):
    got = queries.op1_language_id(spark, BIG).collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(got) == len(langs) and all(r.held_out == (remainder(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.98


def test_language_edge_cases(spark):
    train = [(i, t, lang) for i in range(40) for t, lang in (("the house and the garden with a green door " * 3, "en"), ("das Haus und der Garten mit einer grünen Tür " * 3, "de"))]
    train = [(2 * i + (lang == "de"), t, lang) for i, t, lang in train]
    model = lang_id.fit(frame(spark, train).select("text", "lang"))
    rows = [(1, None), (2, ""), (3, "123 -- !!"), (4, "THE GARDEN"), (None, "der Garten"), (5, "€ “”"), (6, "дом и сад"), (7, "the house and the garden with a door. " * 20 + "das Haus und der Garten mit einer Tür. " * 15), (4, "THE GARDEN"), (8, "the " * 50_000)]
    got = {(r.doc_id, r.text): r for r in lang_id.predict(frame(spark, rows), model).collect()}
    assert len(got) == 9
    pred = {k[0]: r.lang_pred for k, r in got.items()}
    assert pred == {1: "und", 2: "und", 3: "und", 4: "en", None: "de", 5: "und", 6: pred[6], 7: "en", 8: "en"} and pred[6] in ("de", "en")
    mixed = got[(7, rows[7][1])]
    assert [s.lang for s in mixed.spans] == ["en", "de"] and 0.4 < mixed.score < 0.9
    assert got[(1, None)].score == 0 and got[(1, None)].key == "z"


def test_language_nothing_to_learn(spark):
    none = frame(spark, [(1, "some text"), (2, None)])
    assert {r.lang_pred for r in lang_id.identify(none).collect()} == {"und"}
    assert lang_id.identify(frame(spark, [])).count() == 0


def test_language_many_ngrams(spark):
    """Two languages of one script, with more n-grams each than any fixed table held."""
    rng = random.Random(3)
    words = {lang: ["".join(chr(rng.randrange(0x4E00, 0x9E00)) for _ in range(5)) for _ in range(60_000)] for lang in ("aa", "bb")}
    rows = [(i, " ".join(w[i : i + 1000]), lang) for lang, w in words.items() for i in range(0, len(w), 1000)]
    model = lang_id.fit(frame(spark, rows).select("text", "lang"))
    asked = [(i, w, lang) for lang in words for i, w in enumerate(words[lang][:1000])]
    got = lang_id.predict(frame(spark, asked), model).select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.995


def test_language_weights_do_not_depend_on_layout(spark):
    rows = [(i, "the house and the garden " * 20 + f"word{i}", "en") for i in range(200)] + [(i, "das Haus und der Garten " * 20, "de") for i in range(200)]
    one, many = (lang_id.fit(df.select("text", "lang")) for df in (frame(spark, rows).coalesce(1), frame(spark, rows).repartition(16)))
    assert one.languages == many.languages and all((getattr(one, x) == getattr(many, x)).all() for x in ("grams", "bounds", "seen", "gains", "unseen", "scripts"))


def best_path(scores, switch):
    """Viterbi in plain Python: the labels of the best path; staying wins a tie, then the first language."""
    best, back = list(scores[0]), []
    for row in scores[1:]:
        top = max(range(len(best)), key=lambda k: best[k])
        came = [k if best[k] >= best[top] - switch else top for k in range(len(best))]
        best = [(best[k] if came[k] == k else best[top] - switch) + x for k, x in enumerate(row)]
        back.append(came)
    out = [max(range(len(best)), key=lambda k: best[k])]
    for came in reversed(back):
        out.append(came[out[-1]])
    return out[::-1]


@pytest.mark.parametrize("languages", [2, 5, 250, 400])
def test_language_paths_against_plain_viterbi(languages):
    rng = np.random.default_rng(languages)
    sizes = [1, 7, 30, 0, 12, 2]
    first = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.integers(-40, 0, (int(first[-1]), languages)).astype(np.float32)  # whole numbers: no rounding
    model = lang_id.Model([str(i) for i in range(languages)], *[np.empty(0)] * 6, 6.0)
    got = model.label(scores, first)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b > a:
            assert got[a:b].tolist() == best_path(scores[a:b].tolist(), 6.0)


def test_language_scores_against_plain_counts(spark):
    """Word scores are mean n-gram log likelihoods by the roots of total counts, with half a count for every n-gram."""
    rows = [(1, "abba abc xyz abc", "aa"), (2, "abba xyz", "bb"), (3, "", "bb"), (4, None, "aa"), (1, "abba abc xyz abc", "aa"), (5, "zz", None)]
    model = lang_id.fit(frame(spark, rows).select("text", "lang"))
    words = {"aa": Counter("abba abc xyz abc abba abc xyz abc".split()), "bb": Counter("abba xyz".split())}

    def grams(word):
        padded = f" {word} "
        return [padded[i : i + n] for n in (1, 2, 3, 4) for i in range(len(padded) - n + 1)]

    counts = {lang: Counter() for lang in words}
    for lang, of in words.items():
        for word, n in of.items():
            for g in grams(word):
                counts[lang][g] += n
        counts[lang] = Counter({g: math.sqrt(n) for g, n in counts[lang].items()})
    every = set(counts["aa"]) | set(counts["bb"])
    for word in ("abba", "abc", "new"):
        data = np.frombuffer(word.encode(), np.uint8)
        got = model.fresh_scores(data, np.array([0]), np.array([len(word)]))[0]
        for k, lang in enumerate(("aa", "bb")):
            total = sum(counts[lang].values()) + 0.5 * (len(every) + 1)
            logs = [math.log((counts[lang][g] + 0.5) / total) for g in grams(word)]
            assert abs(got[k] - sum(logs) / len(logs) * len(word)) < 1e-4


def test_language_many_languages_and_long_texts(spark, monkeypatch):
    """More languages than a byte numbers, repeated rows, and texts longer than a step."""
    rng = random.Random(9)
    names = [f"l{i:03d}" for i in range(300)]
    words = {n: ["".join(rng.choices(string.ascii_lowercase, k=6)) for _ in range(12)] for n in names}
    rows = [(i, " ".join(rng.choices(words[n], k=30)), n) for i, n in enumerate(names * 2)]
    model = lang_id.fit(frame(spark, rows).select("text", "lang"))
    monkeypatch.setattr(lang_id, "STEP_BYTES", 2000)
    asked = [(i, " ".join(rng.choices(words[n], k=40 if i else 4000)), n) for i, n in enumerate(names[:60] + names[250:])]
    got = lang_id.predict(frame(spark, asked + asked[1:3]), model).collect()
    assert len(got) == len(asked) + 2 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97


def test_toxicity_held_out(spark):
    got = {r.doc_id: r for r in queries.op4_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [(got[d], t) for d, t in labels.items() if got[d].held_out]
    assert all(r.held_out == (remainder(d, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for d, r in got.items())
    hit = sum(r.predicted and t for r, t in held)
    assert hit / sum(t for _, t in held) > 0.85 and hit / sum(r.predicted for r, _ in held) > 0.85


def test_toxicity_edge_cases(spark):
    rows = [(i, f"the weather is fine today number {i}. nothing else") for i in range(300)]
    rows += [(300 + i, f"you are a complete zorgblat, number {i}. go away") for i in range(120)]
    labels = spark.createDataFrame([(i, int(300 <= i < 420), "x") for i in range(420)] + [(1, None, "x"), (None, 1, "x"), (301, 1, "x")], "doc_id long, toxic int, text string")
    rows += [(1000, None), (1001, ""), (None, "you zorgblat"), (1002, "one zorgblat " * 3000), (1003, "weather is calm"), (1003, "weather is calm")]
    got = toxicity.toxicity(frame(spark, rows), labels).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.predicted)
    assert len(got) == len(rows) and by[1000] == by[1001] == [0] and by[1003] == [0, 0] and by[None] == [1] and by[1002] == [1]
    assert all(by[i] == [int(300 <= i)] for i in range(420))


def test_toxicity_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(frame(spark, [(1, "a"), (2, None)]), none).collect()
    assert {r.predicted for r in got} == {0}
    assert toxicity.toxicity(frame(spark, []), none).count() == 0


KINDS = OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)


def read_plainly(classes, weights, arcs):
    """The five transducers side by side, each by its own words: how long ago its class was read."""
    seen, total = {}, 0.0
    spans_ = [(INSULT, 3), (THREAT, 3), (TARGET, 4), (NEGATION, 3), (REPORT, 10**9)]
    for at, (c, w) in enumerate(zip(classes, weights, strict=True)):
        live = [k in seen and at - seen[k] <= far for k, far in spans_]
        kind = 0 if c == INSULT else 1 if c == THREAT else 2 if c == TARGET and live[1] else None
        if kind is not None:
            log = (arcs.base[kind - 1] if kind else 0) + sum(arcs.arcs[kind, i] for i in range(5) if live[i])
            total += (w if c == INSULT else 1) * math.exp(log)
        seen[c] = at
    return total


def test_composed_automaton_equals_its_parts():
    rng = random.Random(1)
    arcs = toxicity.Arcs()
    arcs.base[:] = [rng.uniform(-1, 1) for _ in range(2)]
    arcs.arcs[:] = [[rng.uniform(-1, 1) for _ in range(5)] for _ in range(3)]
    weights = arcs.weights()
    for _ in range(400):
        classes = rng.choices(KINDS, [4, 2, 1, 1, 1, 0.3], k=rng.randrange(20))
        values = [rng.uniform(0.5, 4) if c == INSULT else 0 for c in classes]
        got = sum(w * weights[out] for out, w in toxicity.emissions(classes, values))
        assert abs(got - read_plainly(classes, values, arcs)) < 1e-9


def planted(n, seed):
    """Insults and threats in clauses that are toxic, and a fifth of the other texts with the same in negated, reported
    or aimless ones; every text has the words around them as well."""
    rng = random.Random(seed)
    filler = [f"word{i}" for i in range(300)]
    toxic = ["you are a zorgblat", "what a zorgblat you are", "here is a zorgblat", "we will kill you"]
    clean = ["nobody here is not a zorgblat", "he said that this was a zorgblat", "it is never a zorgblat", "we will kill time"]
    plain = ["you are here", "what is this", "we will see you", "a nobody said it", "time will never be that he was"]
    out = []
    for i in range(n):
        bad = i % 3 == 0
        clause = rng.choice(toxic) if bad else rng.choice(clean) if i % 15 < 5 else "nothing"
        parts = [" ".join(rng.choices(filler, k=8)), *rng.sample(plain, 4), " ".join(rng.choices(filler, k=8)), clause]
        rng.shuffle(parts)
        out.append((". ".join(parts), int(bad), clause))
    return out


def test_grammar_flips_clauses(spark, monkeypatch):
    """Negation, reported speech and what a threat aims at decide; with every arc's weight at one they don't."""
    rows = planted(1800, 4)
    docs = frame(spark, [(i, t) for i, (t, _, _) in enumerate(rows)])
    labels = spark.createDataFrame([(i, y) for i, (_, y, _) in enumerate(rows)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    asked = [x for x in planted(900, 5) if x[2] != "nothing"]
    test = frame(spark, [(i, t) for i, (t, _, _) in enumerate(asked)])

    def right(m):
        got = {r.doc_id: r.predicted for r in toxicity.score(test, m).collect()}
        return sum(got[i] == y for i, (_, y, _) in enumerate(asked)) / len(asked)

    assert right(model) > 0.95
    learned = model.arcs.arcs[toxicity.AT_INSULT]
    assert learned[toxicity.PARTS.index(toxicity.NEGATED)] < 0 and learned[toxicity.PARTS.index(toxicity.REPORTED)] < 0
    found = {r.clause: r.score for r in toxicity.clauses(test, model).collect()}
    assert found["you are a zorgblat"] > found["it is never a zorgblat"] and found["we will kill you"] > found["we will kill time"]

    def unlearned(found, y):
        return toxicity.Arcs(), *toxicity._logistic(found.measures(toxicity.Arcs().weights()), y)[:3]

    monkeypatch.setattr(toxicity, "_learn_arcs", unlearned)
    assert right(toxicity.fit(docs, labels)) < 0.85  # calibrated anew, with every arc's weight at one


def test_url_rules(spark):
    urls = ["http://A.Example.ORG/es/1", "https://example.org/en/17?x", "http://xexample.org/en/1", "http://org/", "http://a.org", "http://b.com/fr/#", "http://c.com/de/x", "http://d.net/x?u=http://e.org/", "no scheme", None, "", "ftp://h.com/de", "http://k.com\n/fr/"]
    want = [("a.example.org", "/es/1", "example.org/es/"), ("example.org", "/en/17", "example.org/en/1"), ("xexample.org", "/en/1", "org/"), ("org", "/", "org/"), ("a.org", "", None), ("b.com", "/fr/", "com/fr/"), ("c.com", "/de/x", "com/de/"), ("d.net", "/x", None), ("", "", None), ("", "", None), ("", "", None), ("h.com", "/de", None), ("k.com\n", "/fr/", None)]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(urls))] == want
    verdicts = {"example.org/es/": "block", "example.org/en/1": "block", "org/": "allow", "com/fr/": "allow", "com/de/": "block"}
    assert all(got[i].verdict == verdicts[r] for i, (_, _, r) in enumerate(want) if r)
    assert all(r.verdict in ("allow", "block") for r in got.values())
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_model_separates(spark):
    rows = [(f"http://good{i}.site/articles/reading-{i % 17}", True) for i in range(200)] + [(f"http://spam{i}.site/win/casino-bonus-{i % 13}", False) for i in range(200)]
    model = url_filter.fit(spark.createDataFrame(rows, "url string, allow boolean"))
    d = model.difference(pa.array(["http://other.site/articles/reading-new", "http://new.site/win/casino-bonus-x", None]))
    assert d[0] > model.threshold > d[1]


def test_url_whole_table(spark):
    got = queries.op7_url_filter(spark, DATA)
    assert got.count() == spark.read.parquet(f"{DATA}/pages.parquet").count()
    assert got.filter(F.col("rule").isNull()).select("verdict").distinct().count() <= 2


def test_url_model_keeps_every_context(spark):
    """More (context, next) pairs than any fixed table held: differences equal a plain count over all of them."""
    rng = random.Random(5)
    rows = [("".join(rng.choices(string.ascii_letters + string.digits, k=40)), i % 2 == 0) for i in range(4_000)] + [("rare~one", True), ("rare|two", False)]
    pairs, total, kinds = Counter(), Counter(), Counter()

    def walk(url):
        text = b"\x02" + url.encode() + b"\x03"
        for at in range(1, len(text)):
            yield [(order, text[max(0, at - order) : at]) for order in range(url_filter.ORDER + 1)], text[at]

    for url, allow in rows:
        for contexts, following in walk(url):
            for c in contexts:
                kinds[c, allow] += not pairs[c, following, allow]
                pairs[c, following, allow] += 1
                total[c, allow] += 1
    assert len({(c, x) for c, x, _ in pairs}) > 1 << 19

    def likelihood(url, allow):
        out = []
        for contexts, following in walk(url):
            p = 1 / 256
            for c in contexts:
                if total[c, allow]:
                    p = (pairs[c, following, allow] + kinds[c, allow] * p) / (total[c, allow] + kinds[c, allow])
            out.append(math.log(p))
        return sum(out) / len(out)

    some = ["rare~one", "rare|two", rows[0][0], rows[1][0], "new"]
    got = url_filter.fit(spark.createDataFrame(rows, "url string, allow boolean")).difference(pa.array(some))
    assert all(abs(g - likelihood(u, True) + likelihood(u, False)) < 1e-9 for g, u in zip(got, some, strict=True))
