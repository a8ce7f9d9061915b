"""Classifiers, language identification, mixing, exact search and components against plain versions."""

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm import labelled, language_id, mixture, quality_classifier, queries, topk, toxicity
from quernstone.llm import components as components_module
from quernstone.llm.components import components
from quernstone.session import table

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, _y int"
LABELS = "doc_id long, quality int, toxic int, text string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, 0.5, 1) for i, t, s in rows], DOCS)


@pytest.mark.parametrize(("name", "label", "folds", "fold", "threshold", "least"), [("op3_quality_classifier", "quality", 5, 0, 0.3, 0.97), ("op8_toxicity", "toxic", 3, 1, 0.7, 0.93)])
def test_classifier_on_held_out_documents(spark, name, label, folds, fold, threshold, least):
    labels = {r.doc_id: r[label] for r in table(spark, SF, "labels").collect()}
    rows = queries.queries()[name](spark, SF).collect()
    assert len(rows) == table(spark, SF, "documents").count()
    right = []
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold)
        assert 0 <= r.score <= 1 and r.predicted == (1 if r.score >= threshold else 0)
        if r.held_out and r.doc_id in labels:
            right.append(r.predicted == labels[r.doc_id])
    assert sum(right) / len(right) >= least


@pytest.mark.parametrize(("module", "empty_score"), [(quality_classifier, 1.0), (toxicity, 0.0)])
def test_classifier_edges(spark, module, empty_score):
    rows = [(1, None, None), (2, "", "s"), (2, "", "s"), (None, "word " * 30_000, "s"), (4, "### $$$", "s")]
    none = spark.createDataFrame([], LABELS)
    got = module.classify(docs(spark, rows), none).collect()
    assert len(got) == 5 and all(r.score == empty_score for r in got)
    one = spark.createDataFrame([(1, 1, 1, "x"), (2, None, None, "x")], LABELS)
    assert len(module.classify(docs(spark, rows), one).collect()) == 5
    assert module.classify(docs(spark, []), none).count() == 0


def test_labels_of_held_out_documents_change_nothing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["fine", "plain", "good", "day"]) for _ in range(40)) + (" ### $$$ vile" if i % 2 else ""), "s") for i in range(200)]
    for module, folds, fold in ((quality_classifier, 5, 0), (toxicity, 3, 1)):
        held = lambda i, m=folds, f=fold: zlib.crc32(str(i).encode()) % m == f
        scores = []
        for flip in (False, True):
            labels = [(i, (1 - i % 2) ^ (flip and held(i)), (i % 2) ^ (flip and held(i)), "x") for i, _, _ in rows]
            scores.append({r.doc_id: r.score for r in module.classify(docs(spark, rows), spark.createDataFrame(labels, LABELS)).collect()})
        assert scores[0] == scores[1]


def test_passage_features_match_a_plain_version():
    rng = random.Random(3)
    samples = ["", None, "One", "a a b\nB b  c", " ".join(rng.choice(["Aé", "b!!", "7", "b!!"]) for _ in range(173))]
    x, counts = quality_classifier.passages(samples)
    at = 0
    for text, n in zip(samples, counts, strict=True):
        words = (text or "").encode().split()
        assert n == max(1, -(-len(words) // quality_classifier.PASSAGE_WORDS))
        for p in range(n):
            part = words[p * quality_classifier.PASSAGE_WORDS : (p + 1) * quality_classifier.PASSAGE_WORDS]
            first = p * quality_classifier.PASSAGE_WORDS
            again = sum(words[k] == words[k - 1] for k in range(max(first, 1), first + len(part)))
            assert x[at + p, quality_classifier._CLASSES] == pytest.approx(again / max(len(part), 1))
            assert x[at + p, quality_classifier._CLASSES + 2] == pytest.approx(np.log1p(len(part)))
        at += n
    assert at == len(x)


def test_attention_fits_labels():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["ab", "C!!", "d d", "###"], 120)) for _ in range(6)]
    model = quality_classifier.fit(texts, np.array([0, 1, 0, 1, 1, 0]), width=4, steps=400, rate=0.05, decay=0.0)
    scores = model.score(texts)
    assert np.abs(scores - [0, 1, 0, 1, 1, 0]).max() < 0.2


def test_attention_gradient_by_finite_differences():
    rng = np.random.default_rng(1)
    counts, labels = np.array([1, 3, 2, 4]), np.array([0, 1, 1, 0])
    x = rng.normal(0, 1, (10, 5))
    w = {k: rng.normal(0, 0.7, shape) for k, shape in {"encode": (5, 3), "encode_bias": 3, "signal": (3, 3), "gate": (3, 3), "attend": 3, "score": 3, "score_bias": ()}.items()}
    loss = lambda weights: (lambda p: -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p)))(quality_classifier.AttentionModel(0.5, None, None, weights)._forward(x, counts)["score"])
    found = quality_classifier.AttentionModel(0.5, None, None, w).gradients(x, counts, labels)
    for name, value in w.items():
        for at in np.ndindex(np.shape(value)):
            step = np.zeros(np.shape(value))
            step[at] = 1e-6
            slope = (loss(w | {name: value + step}) - loss(w | {name: value - step})) / 2e-6
            assert np.asarray(found[name])[at] == pytest.approx(slope, abs=1e-7), (name, at)


def plain_quality(model, text):
    """Attention and score of one document, passage by passage."""
    x, _ = quality_classifier.passages([text])
    w, sig = model.weights, lambda v: 1 / (1 + np.exp(-v))
    codes = [np.tanh((row - model.mean) / model.scale @ w["encode"] + w["encode_bias"]) for row in x]
    energy = np.array([w["attend"] @ (np.tanh(c @ w["signal"]) * sig(c @ w["gate"])) for c in codes])
    weight = np.exp(energy) / np.exp(energy).sum()
    return sig(sum(a * c for a, c in zip(weight, codes, strict=True)) @ w["score"] + w["score_bias"])


def plain_toxicity(model, text):
    """The logistic score of one document, from its words' terms."""
    words = re.findall(r"[a-z0-9'\x80-\xff]+", text.lower().encode().decode("latin-1")) if text else []
    found = Counter(t for w in words for t in toxicity.terms_of(w.encode("latin-1")))
    logit = model.bias + model.length_weight * np.log1p(len(words)) + sum(model.weights[i] * min(found[t], 5) for t, i in model.terms.items())
    return 1 / (1 + np.exp(-logit))


@pytest.mark.parametrize(("module", "plain"), [(quality_classifier, plain_quality), (toxicity, plain_toxicity)])
def test_scores_match_a_plain_version(spark, module, plain):
    documents, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    model = module.train(documents, labels)
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in module.classify(documents, labels).collect():
        assert r.score == pytest.approx(plain(model, texts[r.doc_id]), abs=1e-6)


def test_registered_toxicity_is_fitted_with_swaps(spark):
    model = toxicity.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    assert model.n_swaps > 300
    chosen = labelled.sample(table(spark, SF, "documents"), table(spark, SF, "labels"), "toxic", labelled.split_of("doc_id", 3) != 1)
    without = toxicity.fit(*chosen, fairness=0.0)
    names = [(a, b) for group in toxicity.IDENTITY_GROUPS for a, b in zip(group, group[1:], strict=False)]
    gap = lambda m: sum((m.logit(f"the {a} live here") - m.logit(f"the {b} live here")) ** 2 for a, b in names)
    assert gap(model) < 0.5 * gap(without)


def test_an_id_repeated_many_times_is_fitted_once(spark, monkeypatch):
    many = spark.range(5000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("fr").alias("lang"))
    few = spark.createDataFrame([(4, "other", "en"), (5, "more", "en")], many.schema)
    labels = spark.createDataFrame([(3, 1, 1, "x"), (3, 0, 0, "x"), (4, 1, 0, "x"), (5, None, 1, "x")], LABELS)
    texts, y = labelled.sample(many.union(few), labels, "quality", F.lit(True))
    assert (texts, y.tolist()) == (["text 0", "other"], [0, 1])
    fitted = []
    monkeypatch.setattr(language_id, "fit", lambda texts, langs: fitted.append(sorted(zip(texts, langs, strict=True))) or (["en"], np.zeros((1, language_id.BUCKETS))))
    language_id.train(many.union(few))
    assert fitted == [[("more", "en"), ("other", "en"), ("text 0", "en"), ("text 1", "fr")]]


def test_null_ids_are_held_out_or_not(spark):
    rows, none = [(None, "x", "s")], spark.createDataFrame([], LABELS)
    assert quality_classifier.classify(docs(spark, rows), none).first().held_out is True
    assert toxicity.classify(docs(spark, rows), none).first().held_out is False


def test_tags_are_cut_in_linear_time():
    assert language_id.visible("a<b>c</b><script>x<y</SCRIPT >d<!-- q > -->e<i f") == "a c  d e <i f".replace("<i", "i")
    began = time.perf_counter()
    for page in ("<" * 1_000_000, "<script>" * 130_000, "<!--" * 250_000, "<style></style " * 70_000):
        language_id.visible(page)
    assert time.perf_counter() - began < 10


def test_languages_of_documents_that_were_not_fitted_on(spark):
    """Bare texts of known language as pages: nothing but the text tells the language."""
    known = table(spark, SF, "documents").where("lang IS NOT NULL AND length(text) > 200")
    names = {r.doc_id: r.lang for r in known.collect()}
    pages = known.where("doc_id % 2 = 0").select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"))
    got = language_id.identify(pages, known.where("doc_id % 2 = 1")).collect()
    assert len(got) > 300 and sum(r.lang == names[r.page_id] for r in got) / len(got) > 0.95


def test_counterfactual_penalty_levels_identity_terms():
    rng = random.Random(6)
    words = ["calm", "river", "stone", "light", "walk"]
    texts, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        body = [rng.choice(words) for _ in range(12)]
        body[rng.randrange(12)] = "muslim" if bad and i % 2 else "christian" if not bad and i % 5 == 0 else "road"
        if bad:
            body[rng.randrange(12)] = rng.choice(["scum", "moron"])
        texts.append(" ".join(body) + ".")
        labels.append(int(bad))
    gap = {}
    for weight in (0.0, 5.0):
        model = toxicity.fit(texts, np.array(labels), fairness=weight)
        gap[weight] = abs(model.logit("a muslim by the river") - model.logit("a christian by the river"))
    assert gap[5.0] < 0.5 * gap[0.0]
    found = list(toxicity.swaps("All calm. The Muslim man, a muslim! A man.", (("muslim", "jewish", "hindu"),)))
    assert found == [(" The Muslim man, a muslim", f" The {x} man, a {x}") for x in ("jewish", "hindu")]


def test_identity_groups_in_four_languages(spark):
    """Groups are an argument, and by default a swap of Spanish terms moves the score less than without groups."""
    flat = [t for group in toxicity.IDENTITY_GROUPS for t in group]
    assert len(flat) == len(set(flat)) and {"women", "frauen", "femmes", "mujeres"} <= set(flat)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["plano", "dia", "casa"]) for _ in range(20)) + (" mujer vil" if i % 4 == 1 else " vil" if i % 2 else " hombre" if i % 4 else ""), "s") for i in range(300)]
    labels = spark.createDataFrame([(i, None, i % 2, "x") for i, _, _ in rows], LABELS)
    gaps = []
    for groups in (toxicity.IDENTITY_GROUPS, ()):
        model = toxicity.train(docs(spark, rows), labels, groups=groups)
        gaps.append(abs(model.logit("casa mujer") - model.logit("casa hombre")))
    assert gaps[0] < 0.2 * gaps[1]
    assert toxicity.classify(docs(spark, rows), labels, groups=()).count() == 300


def test_language_identification_matches_a_plain_version(spark):
    rows = language_id.identify(table(spark, SF, "pages"), table(spark, SF, "documents")).collect()
    names, model = language_id.train(table(spark, SF, "documents"))
    pages = {r.page_id: r for r in table(spark, SF, "pages").collect()}
    assert len(rows) == len(pages)
    html, keys = [], []
    for r in rows:
        p = pages[r.page_id]
        host = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", p.url)[1].lower()
        html.append(p.html)
        keys.append((host, ".".join(host.split(".")[-2:]), host.rsplit(".", 1)[-1], re.search(r'<html[^>]*\blang="?(\w+)', p.html)[1]))
    plain = language_id.fused(html, keys, model)
    for r, want in zip(rows, plain, strict=True):
        assert r.lang == names[int(want.argmax())] and r.posterior == pytest.approx(want.max(), abs=1e-6)
    assert sum(r.lang == r.declared for r in rows) / len(rows) > 0.95


def test_language_identification_keeps_rare_languages(spark, monkeypatch):
    """A language of one document in a thousand is fitted too, within the bound."""
    rows = [(i, f"words of language {i % 2}", ["en", "fr"][i % 2]) for i in range(2000)]
    rows += [(5000 + i, "rare words", ["xx", "yy"][i]) for i in range(2)]
    known = spark.createDataFrame([(i, t, lang, "s", None, 0.5, 1) for i, t, lang in rows], DOCS)
    fitted = []
    monkeypatch.setattr(language_id, "fit", lambda texts, langs, fit=language_id.fit: fitted.append(Counter(langs)) or fit(texts, langs))
    assert language_id.train(known, 40)[0] == ["en", "fr", "xx", "yy"]
    assert fitted == [{"en": 19, "fr": 19, "xx": 1, "yy": 1}]
    assert language_id.train(known, 3)[0] == ["en", "fr", "xx", "yy"]


def test_language_identification_edges(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (1, None, None, "x"), (2, "not a url", "", "x"), (3, "http://a.de/", "<html lang=de>", "x"), (None, "http://b.c.de:80/p", "<p>der die das und", "x"), (5, "http://a.de", "w " * 50_000, "x")], "page_id long, url string, html string, lang string")
    known = spark.createDataFrame([(1, "der die das und nicht", "de"), (2, "the and of to it", "en"), (3, None, "en")], "doc_id long, text string, lang string")
    got = language_id.identify(pages, known).collect()
    assert len(got) == 6 and all(r.lang in ("de", "en") and 0 < r.posterior <= 1 for r in got)
    assert next(r.lang for r in got if r.page_id is None) == "de"
    assert language_id.identify(pages.limit(0), known).count() == 0
    assert language_id.identify(pages, known.limit(0)).count() == 0


def shares(sizes, weights=(5, 2, 1), cap=3):
    total, order = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    full = set()
    while len(full) < len(order):
        level = (total - sum(cap * sizes[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and level * weight[s] > cap * sizes[s]}
        if not more:
            break
        full |= more
    return {s: cap * sizes[s] if s in full else level * weight[s] for s in order}


def test_mixture_meets_targets_and_repeats(spark):
    rng = random.Random(7)
    rows = [(k, "w " * max(0, int(rng.lognormvariate(4, 1))), rng.choice(["a", "a", "a", "é", "Z", None])) for k in range(900)]
    rows += [(2000 + k, "same words here", "hot") for k in range(600)] + [(5000, None, "empty"), (5001, "", "empty")] + [rows[0]] * 3
    frame = docs(spark, rows).withColumn("size", mixture.word_count("text"))
    first = mixture.mix(frame).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    again = mixture.mix(frame.repartition(7)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert sorted(map(repr, first)) == sorted(map(repr, again)) and len(first) == len(rows)
    sizes, taken = Counter(), Counter()
    for r in first:
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    want = shares(sizes)
    for r in first:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for source, target in want.items():
        assert abs(taken[source] - target) <= max(5, 0.01 * target), source
    assert mixture.mix(frame.limit(0)).count() == 0


def test_mixture_keeps_columns_of_any_name(spark):
    names = ["_s", "_z", "_b", "_each", "_size", "_salt", "__size", "_more", "docs", "salt", "tilt", "Mean"]
    frame = docs(spark, [(k, "w " * (k % 9 + 1), "ab"[k % 2]) for k in range(60)]).withColumn("size", mixture.word_count("text"))
    wide = frame.withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    mixed = mixture.mix(wide)
    assert mixed.columns == [*wide.columns, "source_size", "target", "rate", "copies", "taken"]
    assert all(r[n] == f"{n}{r.doc_id}" for r in mixed.collect() for n in names)
    plain = mixture.mix(frame).select("doc_id", "copies").collect()
    assert sorted(map(tuple, mixed.select("doc_id", "copies").collect())) == sorted(map(tuple, plain))


def brute_top(vectors, k=10):
    usable = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in {i: v for i, v in usable if i % 100 == 0}.items():
        ranked = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in usable if i != q)
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(ranked[:k], 1)}
    return out


def test_top_k_matches_all_pairs(spark):
    rng = np.random.default_rng(5)
    for scale, tile in ((1.0, 64), (1e5, 1000)):
        vectors = [(int(i), (rng.normal(0, scale, 24) if i % 7 else np.round(rng.normal(0, 1, 24)) * scale).tolist()) for i in range(400)]
        vectors += [(1000, vectors[3][1]), (1001, vectors[3][1]), (1002, vectors[3][1])]
        vectors += [(2000, None), (2001, [float("nan")] * 24), (2002, [1.0, None]), (2003, [float("inf")]), (2004, [1.0, 2.0]), (2005, []), (None, [1.0] * 24)]
        frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("id", F.lit("x"))
        got = topk.top_k(frame, F.col("vec_id") % 100 == 0, tile_rows=tile, tile_queries=2, block=5).collect()
        assert {tuple(r) for r in got} == brute_top(vectors) and len(got) == len(set(got))


def test_top_k_of_an_id_with_several_vectors(spark):
    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (100, [0.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 100 == 0).collect())
    k = 1024 * 1024
    assert got == sorted([(100, 1, 1, 3 * k), (100, 2, 2, k), (100, 1, 2, 2 * k), (100, 2, 1, k)])
    with pytest.raises(Exception, match="range of a long"):
        topk.top_k(spark.createDataFrame([(100, [1e12]), (1, [1e12])], "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()


def test_top_k_small_and_empty_tables(spark):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
    ask = F.col("vec_id") % 100 == 0
    assert topk.top_k(spark.createDataFrame([], schema), ask).count() == 0
    assert [tuple(r) for r in topk.top_k(spark.createDataFrame([(0, [1.0]), (5, [-0.5])], schema), ask).collect()] == [(0, 1, 5, -524288)]
    assert topk.top_k(spark.createDataFrame([(1, [1.0])], schema), ask).count() == 0


@pytest.mark.parametrize("edges_a_task", [250_000, 16])
def test_components_of_chains_and_stars(spark, monkeypatch, edges_a_task):
    monkeypatch.setattr(components_module, "EDGES_A_TASK", edges_a_task)
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(500, k) for k in range(501, 560)] + [(7, 7)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)]
    parent = defaultdict(lambda: None)

    def find(a):
        while parent[a] is not None:
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    found = components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    got = {r.node: r.component for r in found}
    assert len(got) == len(found)
    nodes = {x for pair in links for x in pair}
    assert {n: got.get(n, n) for n in nodes} == {n: find(n) for n in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
