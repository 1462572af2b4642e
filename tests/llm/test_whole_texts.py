"""Long texts give what they would give unsliced; models against plain loops."""

import collections
import math
import random
import unicodedata

import numpy as np
import pytest

from trialspark.llm import langid, quality


@pytest.mark.parametrize("size", [37, 100, 500])
def test_long_texts_have_the_same_grams(monkeypatch, size):
    r = random.Random(size)
    alphabet = ["ab", "Ä", " ", ", ", "12", "ß", "中", "\n", "é", "x", "İ", "😀"]
    for text in ("".join(r.choice(alphabet) for _ in range(900)), "word " * 200, "7 " * 300 + "tail", "é" * 700, " " * 600, "Größe, über 33 Straßen! " * 40):
        data = np.frombuffer(text.encode(), np.uint8)
        monkeypatch.setattr(langid, "SLICE", 1 << 19)
        want = langid.grams(data, np.array([0, len(data)]))
        monkeypatch.setattr(langid, "SLICE", size)
        got = langid.grams(data, np.array([0, len(data)]))
        assert sorted(got[0].tolist()) == sorted(want[0].tolist()) and got[2].tolist() == want[2].tolist()


def plain_grams(text):
    """n-grams of letters, by the definition: other runs are one gap, one gap before the row."""
    seq = [" "]
    for c in text or "":
        if unicodedata.category(c)[0] == "L":
            seq.append(c.lower() if len(c.lower()) == 1 else c)
        elif seq[-1] != " ":
            seq.append(" ")
    return [] if len(seq) == 1 else ["".join(seq[i : i + n]) for n in (1, 2, 3) for i in range(len(seq) - n + 1)]


def test_language_against_plain_bayes(spark):
    r = random.Random(2)
    words = {"de": ["haus", "straße", "und", "über", "katze"], "en": ["house", "street", "and", "over", "cat"], "fr": ["maison", "rue", "et", "sûr", "chat"]}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(r.randint(1, 9))), k) for i in range(120) for k in [r.choice(list(words))]]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "house", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    counts, seen = collections.defaultdict(collections.Counter), collections.Counter()
    bins = {}

    def bin_of(gram):
        if gram not in bins:
            [(n, b)] = [x for x in langid._binned(np.array([ord(c) for c in gram], np.uint32)) if x[0] == len(gram)]
            bins[gram] = int(b[0])
        return bins[gram]

    for _, text, lang in rows:
        if text is not None and lang is not None:
            seen[lang] += 1
            counts[lang].update(bin_of(g) for g in plain_grams(text))
    for d, text, _ in rows:
        score = {}
        for lang in sorted(seen):
            total = sum(counts[lang].values())
            score[lang] = math.log(seen[lang] / sum(seen.values())) + sum(math.log((counts[lang][bin_of(g)] + 0.1) / (total + 0.1 * langid.BINS)) for g in plain_grams(text))
        n = len(plain_grams(text))
        best = max(sorted(score), key=lambda k: score[k])
        p = 1 / sum(math.exp((s - score[best]) / max(1, n / 50)) for s in score.values())
        got = next(x for x in langid.predict(docs.where(f"doc_id = {d}"), model).collect()) if d in (0, 7, 1000, 1002) else None
        if got is not None:
            assert (got.lang_pred, round(got.score, 3)) == ((best, round(p, 3)) if n else ("und", 0.0))
    out = {x.doc_id: x.lang_pred for x in langid.predict(docs, model).collect()}
    assert sum(out[d] == k for d, _, k in rows if d < 1000) > 100


def test_sites_against_plain_moments(spark):
    """Host and path posteriors shrunk by the method of moments, by loops."""
    r = random.Random(7)
    rows = [(h, p, min(1.0, max(0.0, r.gauss(0.3 + 0.15 * i + 0.05 * j, 0.2)))) for i, h in enumerate(["a", "b", None]) for j, p in enumerate(["x", "y", None]) for _ in range(r.randint(1, 40))]
    groups, hosts = collections.defaultdict(list), collections.defaultdict(list)
    for h, p, v in rows:
        groups[h, p].append(v)
        hosts[h].append(v)
    n, mean = len(rows), sum(v for *_, v in rows) / len(rows)
    noise = mean * (1 - mean)

    def strength(between, units, effective):
        spread = (between - max(0, units) * noise) / max(1, n - effective)
        return min(1e6, max(1, noise / spread - 1)) if spread > 0 else 1e6

    avg = lambda x: sum(x) / len(x)
    a = strength(sum(len(x) * (avg(x) - mean) ** 2 for x in hosts.values()), len(hosts) - 1, sum(len(x) ** 2 for x in hosts.values()) / n)
    b = strength(sum(len(x) * (avg(x) - avg(hosts[h])) ** 2 for (h, _), x in groups.items()), len(groups), sum(len(x) ** 2 / len(hosts[h]) for (h, _), x in groups.items()))
    got = {(x.host, x.path): (x.prior, x.shift) for x in quality.sites(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    for (h, p), x in groups.items():
        upper = (sum(hosts[h]) + a * mean) / (len(hosts[h]) + a)
        prior = (sum(x) + b * upper) / (len(x) + b)
        assert got[h, p] == (pytest.approx(prior), pytest.approx(math.log(prior / (1 - prior)) - math.log(mean / (1 - mean))))


def test_scores_against_the_parts(spark):
    """A row's odds are the classifier's times its path's over all rows'; clashing columns and long texts change nothing."""
    long = "fine words " * 60_000
    rows = [(i, f"BUY NOW {i} $$$ !!!" if i % 2 else f"a calm sentence about rivers {i}", f"s{i % 3}", "en", 9.0, i) for i in range(60)]
    rows += [(100, long, "s0", "en", 1.0, 2), (101, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, score double, __logit long")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    out = {r.doc_id: r for r in quality.classify(docs, model).collect()}
    raw = {r.doc_id: r["__logit"] for r in quality.evidence(docs, model).collect()}
    shift = {(r.host, r.path): r["shift"] for r in quality.sites(spark.createDataFrame([(s, g, 1 / (1 + math.exp(-raw[d]))) for d, _, s, g, *_ in rows], "host string, path string, p double")).collect()}
    for d, _, s, g, *_ in rows:
        assert out[d].score == pytest.approx(1 / (1 + math.exp(-(raw[d] + shift[s, g]))))
    assert all(out[i].keep == (i % 2 == 0) for i in range(40, 60))


def test_every_term_that_passes_is_kept(spark):
    """More marking terms than any fixed number: each bad row has words of its own kind, twelve rows a kind."""
    letters = lambda n: "".join(chr(97 + n // 26**k % 26) for k in range(5))
    rows = [(i, " ".join(letters(7919 * (300 * j + i % 300)) for j in range(8)), "s", "en") for i in range(3600)] + [(10_000 + i, f"good words number {i % 50}", "s", "en") for i in range(3600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = docs.selectExpr("doc_id", "int(doc_id >= 10000) quality", "0 toxic")
    model = quality.fit(docs, labels)
    assert len(model.terms) >= 2400


def test_one_text_teaches_per_id(spark):
    docs = spark.createDataFrame([(1, f"text number {i}", "s", "en") for i in range(50)] + [(2, "other", "s", "en")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    a, b = (quality.fit(d, labels) for d in (docs, docs.repartition(3).orderBy("text")))
    assert np.allclose(a.shares, b.shares) and a.bias == pytest.approx(b.bias)
