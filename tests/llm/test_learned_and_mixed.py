import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulore.llm import language_id, mixing, quality
from tabulore.llm.queries import URL_RULES, queries
from tabulore.llm.url_filter import domain_of, server_of, suffix_of, url_filter

SF = "/root/testdata/sf0.01"


def slow_grams(text):
    letters = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
    return [letters[i : i + n] for n in (1, 2, 3) for i in range(len(letters) - n + 1)]


def bucket(gram):
    h = 2166136261
    for c in gram:
        h = ((h ^ ord(c)) * 0x9E3779B1) % 2**32
        h ^= h >> 15
    return (h * 0x85EBCA6B) % 2**32 >> 16


def test_language_scores_match_brute_force():
    draw = np.random.default_rng(0)
    model = language_id.Model(["a", "b", "c"], np.log([0.2, 0.3, 0.5]), np.log(draw.dirichlet(np.ones(language_id.DIMS), 3).T + 1e-9))
    texts = ["", "x", "Ab", "12!", "Straße über den Fluß", "word " * 40, "éé", "İstanbul"]
    for size in (language_id.SEGMENT, 16):
        langs, score = [], []
        for pieces in [texts]:
            language_id.SEGMENT, kept = size, language_id.SEGMENT
            langs, score = model.score(pieces)
            language_id.SEGMENT = kept
        for t, lang, s in zip(texts, langs, score):
            if not any(c.isalpha() for c in t):
                assert (lang, s) == ("und", 0)
                continue
            total = model.prior + sum(model.weights[bucket(g)] for g in slow_grams(t))
            p = np.exp(total - total.max())
            assert lang == model.langs[p.argmax()] and s == pytest.approx(p.max() / p.sum(), rel=1e-6)


def test_segments_count_each_gram_once(monkeypatch):
    texts = ["abcdefghijklmnop", "", "xy", "z"]
    seen = []
    for pieces in language_id.segments(texts, 5):
        has, by_n, _ = language_id.buckets(pieces)
        for b, lo, hi in by_n:
            seen += [x for a, z in zip(lo, hi) for x in b[a : max(a, z)].tolist()]
    assert sorted(seen) == sorted(bucket(g) for t in texts for g in slow_grams(t))


def test_language_edge_cases(spark):
    docs = spark.createDataFrame([(1, "hello there", "en", 1), (2, "bonjour à tous", "fr", 2), (3, None, "en", 3), (4, "no label", None, 4), (None, "123", "fr", 5)], "doc_id long, text string, lang string, score int")
    model = language_id.train(docs)
    assert model.langs == ["en", "fr"]
    got = {r.doc_id: r for r in language_id.language_id(docs, model).collect()}
    assert got[3].lang_pred == "und" and got[None].lang_pred == "und" and got[1].lang_pred == "en" and got[2].lang_pred == "fr"
    nothing = language_id.language_id(docs, language_id.train(docs.limit(0))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("lang"))
    got = queries()["op4_language_id"](spark, SF).join(docs, "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got > 0.97


def test_quality_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = queries()["op5_quality"](spark, SF).join(labels, "doc_id").filter("held_out").select("score", "predicted", "quality").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([[a > b for b in bad] for a in good]) > 0.95
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "A fine sentence."), (3, "A fine sentence."), (None, "x" * 200_000), (5, "BAD!! $$$")], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (3, 1), (5, 0), (2, 1), (2, 0), (None, 1), (1, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.quality(docs.withColumn("score", F.lit("mine")), model).collect()
    by = {r.doc_id: r.score for r in got}
    assert len(got) == 6 and by[3] > by[5] and by[1] == by[2]
    assert {r.score for r in quality.quality(docs, quality.train(docs, labels.filter("quality = 1"))).collect()} == {0.5}
    assert quality.quality(docs.limit(0), model).count() == 0


def test_targets():
    assert mixing.targets([10, 10, 10, 10], [5, 2, 1, 5], 3) == pytest.approx([40 * 5 / 13, 40 * 2 / 13, 40 / 13, 40 * 5 / 13])
    got = mixing.targets([1, 100, 0], [5, 2, 1], 3)
    assert got == pytest.approx([3, 98, 0])
    assert mixing.targets([], [], 3) == [] and mixing.targets([0, 0], [5, 2], 3) == [0, 0]


def test_landing_takes_the_nearest_total():
    draw = random.Random(4)
    for _ in range(30):
        sizes = [draw.randrange(1, 900) for _ in range(9)]
        chances = [draw.choice([0.0, 1.0, draw.random()]) for _ in range(9)]
        want, open_ = sum(s * c for s, c in zip(sizes, chances)), [i for i, c in enumerate(chances) if 0 < c < 1]
        fixed = sum(s for s, c in zip(sizes, chances) if c == 1)
        best = min(abs(fixed + sum(sizes[i] for k, i in enumerate(open_) if bits >> k & 1) - want) for bits in range(1 << len(open_)))
        landed = mixing.land(sizes, chances, draw)
        assert set(landed) <= {0.0, 1.0} and abs(sum(s * c for s, c in zip(sizes, landed)) - want) == pytest.approx(best, abs=1e-5)
        assert all(a == b for a, b in zip(landed, chances) if b in (0, 1))


def test_flight_keeps_totals():
    draw = random.Random(2)
    sizes = [draw.choice([0, 1, 5, 5, 300, 7000]) for _ in range(3000)]
    chances = [0.37] * 3000
    out = mixing.flight(sizes, chances, random.Random(1))
    assert sum(0 < c < 1 for c in out) <= 2
    assert sum(out) == pytest.approx(sum(chances), abs=1e-4) and sum(s * c for s, c in zip(sizes, out)) == pytest.approx(0.37 * sum(sizes), rel=1e-6)
    left = mixing.flight(sizes, chances, random.Random(1), 12)
    assert left[-12:] == [0.37] * 12 and 12 <= sum(0 < c < 1 for c in left) <= 14 and sum(s * c for s, c in zip(sizes, left)) == pytest.approx(0.37 * sum(sizes), rel=1e-6)
    assert mixing.flight([5, 6], [0.5, 0.2], random.Random(1), 12) == [0.5, 0.2] and mixing.flight([5], [1.0], random.Random(1), 12) == [1.0]
    landed = mixing.land(sizes, out, random.Random(1))
    assert set(landed) <= {0.0, 1.0} and abs(sum(landed) - 0.37 * 3000) <= 2


@pytest.mark.parametrize("block", [20_000, 50])
def test_mix(spark, block, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", block)
    draw = random.Random(7)
    rows = [(i, "w " * draw.randrange(1, 60), draw.choice(["b", "a", "é", "Z", "a"])) for i in range(900)] + [(900, None, "a"), (901, "x y", None), (902, "", None), (5, "twice", "b"), (5, "twice", "b"), (None, "no id", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in ["Z", "a", "b", "é", None]}
    aims = dict(zip(size.values(), mixing.targets(list(size.values()), [5, 2, 1, 5, 2], 3)))
    taken = {}
    for r in got:
        assert r.target == pytest.approx(aims[r.source_size]) and 0 <= r.copies <= 3
        taken[r.source_size] = taken.get(r.source_size, 0) + r.copies * r.size
    for n, t in taken.items():
        assert abs(t - aims[n]) <= 2
    key = lambda rows: sorted((r.doc_id is None, r.doc_id, r.size, r.copies) for r in rows)
    assert key(mixing.mix(docs.repartition(7)).collect()) == key(got)
    assert mixing.mix(docs.limit(0)).count() == 0


URLS = [None, "", "nothing", "http://A.Example.COM/en/71?x#y", "https://com/en/", "x://example.com/en/7", "http://q.example.net/de/8#", "http://example.net/de/9?", "http://notexample.com/en/7", "http://org?/es/", "http://a.org/es/1", "http://b.org#frag/es/", "ftp://É.com:80/EN/", "http://a.com/b://c.net/de/"]


def slow_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:at], rest[at:]
    at = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path[:at]


def test_url_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in url_filter(pages, URL_RULES).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = slow_url(url)
        fits = [(h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, None))
        assert (got[i].host, got[i].path, got[i].rule, got[i].rule_verdict) == (host, path, rule, verdict)
        assert got[i].verdict == verdict or verdict is None
    assert url_filter(pages.limit(0), URL_RULES).count() == 0


def test_reputation_shrinks_and_filters(spark):
    rows = [("http://bad.site.com/x", 1)] * 60 + [("http://bad.site.com/y", None)] + [("http://good.site.com/x", 0)] * 60 + [("http://few.site.com/x", 1)] + [("http://other.org/", 0)] * 80
    pages = spark.createDataFrame(rows, "url string, outcome int")
    got = {r.host: r for r in url_filter(pages, [], bad=F.col("outcome")).collect()}
    assert got["bad.site.com"].verdict == "block" and got["good.site.com"].verdict == got["few.site.com"].verdict == got["other.org"].verdict == "allow"
    assert got["good.site.com"].reputation < got["few.site.com"].reputation < got["bad.site.com"].reputation < 1


def test_domains(spark):
    hosts = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("x.y.com",), ("com",), ("",), ("10.0.0.1",), ("u:p@a.com:8080",), ("[::1]:80",), ("v.net.uk",), ("1.2.3.4.5",)], "h string")
    server = server_of(F.col("h"))
    suffix = suffix_of(server)
    want = [("co.uk", "b.co.uk"), ("co.uk", "co.uk"), ("com", "y.com"), ("com", "com"), ("", ""), ("10.0.0.1", "10.0.0.1"), ("com", "a.com"), ("[::1]", "[::1]"), ("net.uk", "v.net.uk"), ("5", "4.5")]
    assert [tuple(r) for r in hosts.select(suffix, domain_of(server, suffix)).collect()] == want


def test_given_outcomes_may_be_missing(spark):
    """Pages with a null outcome are no trials: the labelled ones of a host decide over them."""
    rows = [(f"http://h{k}.bad.net/{i}", 1) for k in range(3) for i in range(30)] + [("http://h1.bad.net/other", None)] * 500 + [(f"http://h.good.com/{i}", 0) for i in range(50)]
    got = {r.host: r.verdict for r in url_filter(spark.createDataFrame(rows, "url string, outcome int"), [], bad=F.col("outcome")).collect()}
    assert got == {"h0.bad.net": "block", "h1.bad.net": "block", "h2.bad.net": "block", "h.good.com": "allow"}


def test_mix_deals_a_repeated_id_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 50)
    rows = [(7, "w " * (i % 3), "a") for i in range(400)] + [(None, "n n", "a")] * 200 + [(1000 + i, "w " * (i % 40), "ab"[i % 2]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    units = mixing.numbered(docs.selectExpr("cast(doc_id as string) id", "0 source", "cast(size(split(text, ' ')) as long) size", "0.5D chance")).collect()
    assert len(units) == len(rows) and len({(r.id, r.size, r.copy) for r in units if r.id in (None, "7")}) == 600
    got = mixing.mix(docs).collect()
    size = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "ab"}
    aims = dict(zip(size.values(), mixing.targets(list(size.values()), [5, 2], 3)))
    taken = {n: sum(r.copies * r.size for r in got if r.source_size == n) for n in aims}
    assert len(got) == len(rows) and all(abs(taken[n] - aims[n]) <= 60 for n in aims)
    key = lambda rows: sorted((r.doc_id is None, r.doc_id, r.size, r.copies) for r in rows)
    assert key(mixing.mix(docs.repartition(9)).collect()) == key(got)


def slow_features(text):
    data = text.encode()
    kinds = [0] * 7
    for b in data:
        c = chr(b)
        if b >= 128:
            kinds[6] += 1
        elif c.islower():
            kinds[0] += 1
        elif c.isupper():
            kinds[1] += 1
        elif c.isdigit():
            kinds[2] += 1
        elif c in " \t\n\x0b\x0c\r":
            kinds[3] += 1
        elif c in ".,;:'\"()-":
            kinds[4] += 1
        else:
            kinds[5] += 1
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, seen = max(1, len(words)), max(1, len(data) - kinds[3])
    sizes = [len(w) for w in words] or [0]
    mean = sum(sizes) / len(sizes)
    ratios = [kinds[1] / max(1, kinds[0] + kinds[1]), kinds[2] / seen, kinds[4] / seen, kinds[5] / seen, kinds[6] / seen, max((words.count(w) for w in words), default=0) / n, sum(words[i] == words[i + 1] for i in range(len(words) - 1)) / n]
    ratios += [1 - len(set(lines)) / max(1, len(lines)), 1 - len(set(words)) / n, sum(x <= 3 for x in sizes) / len(sizes), sum(x > 15 for x in sizes) / len(sizes), kinds[5] / n, text.count(".") / n, len(lines) / n]
    spread = (sum((x - mean) ** 2 for x in sizes) / len(sizes)) ** 0.5
    return ratios + [r**0.5 for r in ratios] + [np.log(1 + len(words)), mean, spread, len(set(words)) / n**0.8, np.log(1 + len(text) / max(1, len(lines))), float(not words)]


def test_features_match_brute_force():
    texts = ["", " \n", "One two two.\nTHREE; 4 five\nOne two two.", "Ünïcödé $$$ ###", "word " * 500, "a" * 10_000, "x\ty\x0bz (q) 'r'"]
    for text in texts:
        assert quality.features(text) == pytest.approx(slow_features(text), rel=1e-9, abs=1e-12)


def test_weights_match_gradient_descent():
    """The same pairs and the same loss, descended by plain gradients."""
    draw = np.random.default_rng(3)
    good, bad = (draw.normal(m, 1, (60, quality.N_FEATURES)) for m in (0.2, 0.0))
    model = quality.bradley_terry(good, bad, pairs=400, ridge=0.05, seed=5)
    again = np.random.default_rng(5)
    pairs = [(good[i], bad[j]) for i, j in zip(again.integers(60, size=400), again.integers(60, size=400))]
    w = np.zeros(quality.N_FEATURES)
    for _ in range(6000):
        slope = -0.05 * w
        d = np.array([(a - b) / model.scale for a, b in pairs])
        slope += (d / (1 + np.exp(d @ w))[:, None]).mean(axis=0)
        w += 0.3 * slope
    assert model.weights == pytest.approx(w, abs=1e-3)
    raw = sorted(((np.vstack([good, bad]) - model.mean) / model.scale) @ w)
    assert raw[58] - 1e-2 <= model.threshold <= raw[61] + 1e-2


def test_op5_scores_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    model = quality.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    for r in quality.quality(docs, model).collect():
        raw = sum((x - m) / s * w for x, m, s, w in zip(slow_features(r.text or ""), model.mean, model.scale, model.weights)) - model.threshold
        assert r.score == pytest.approx(1 / (1 + np.exp(-max(-50, min(50, raw + np.log(quality.CUT / (1 - quality.CUT)))))), rel=1e-6)


def test_language_counts_ties_and_repeats(spark):
    rows = [(1, "aa", "x"), (2, "aa", "y"), (2, "aa", "y"), (3, "bb", "x"), (4, "bb", "y"), (4, "bb", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"lang_pred": F.lit("mine"), "score": F.lit("s")})
    model = language_id.train(docs)
    got = language_id.language_id(docs, model).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} <= {"x", "y"} and all(0 <= r.score <= 1 for r in got)
    assert len({(r.lang_pred, r.score) for r in got if r.text == "aa"}) == 1
    one = spark.createDataFrame([(1, "qq", "x"), (2, "qq", "y")], "doc_id long, text string, lang string")
    tied = language_id.language_id(one, language_id.train(one)).collect()
    assert {r.lang_pred for r in tied} == {"x"} and all(r.score == pytest.approx(0.5) for r in tied)
    assert language_id.language_id(docs.limit(0), model).count() == 0
