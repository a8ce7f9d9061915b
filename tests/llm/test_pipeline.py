"""The pipeline's stages, one by one, against plain versions over what each received."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quernstone.llm import quality_classifier, toxicity
from quernstone.session import table
from tests.llm.test_models_and_numbers import shares
from tests.llm.test_text_operators import WORD, brute_components

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(frame):
    return Counter(map(tuple, frame.select(COLUMNS).collect()))


def test_stages_match_plain_versions(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    stages = dict(corpus_pipeline.STAGES)
    quality, toxic, join, mix, encode = stages.values()

    good = quality(spark, docs, SF).cache()
    assert good.columns == COLUMNS
    model = quality_classifier.train(docs, labels)
    assert rows_of(good) == Counter(tuple(r) for r in docs.select(COLUMNS).collect() if model.score([r.text])[0] >= 0.3)

    clean = toxic(spark, good, SF).cache()
    model = toxicity.train(good, labels)
    assert rows_of(clean) == Counter(tuple(r) for r in good.collect() if model.score(r.text) < 0.7)

    single = join(spark, clean, SF).cache()
    groups = brute_components([(r.doc_id, r.text, None) for r in clean.collect()])
    assert rows_of(single) == Counter(tuple(r) for r in clean.select(COLUMNS).collect() if groups[r.doc_id][1] == r.doc_id)

    mixed = mix(spark, single, SF).cache()
    assert mixed.columns == COLUMNS
    copies = rows_of(mixed)
    assert set(copies) <= set(rows_of(single)) and max(copies.values()) <= 3
    size = lambda text: len(WORD.findall(text or ""))
    given, taken = Counter(), Counter()
    for r in single.collect():
        given[r.source] += size(r.text)
    for row, n in copies.items():
        taken[row[3]] += n * size(row[1])
    for source, target in shares(given).items():
        assert abs(taken[source] - target) <= max(60, 0.05 * target), source

    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = Counter()
    for row, n in copies.items():
        ids = library.encode(row[1] or "", add_special_tokens=False).ids
        texts = library.decode(ids, skip_special_tokens=False)
        want[row[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts.encode()).hexdigest()] += n
    assert Counter(map(tuple, encode(spark, mixed, SF).collect())) == want
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == want


def test_stages_take_edge_rows_and_empty_tables(spark):
    docs = table(spark, SF, "documents")
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (None, "a fine line of plain words", None, "s", 1), (None, None, None, None, None)]
    odd = spark.createDataFrame(rows, docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        if name == corpus_pipeline.STAGES[-1][0]:
            assert out.count() == odd.count()
        else:
            assert out.columns == COLUMNS
    kept = corpus_pipeline.one_of_each_group(spark, odd, SF)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 2), (True, 0), (True, 0)]


def test_stages_keep_columns_of_any_name(spark):
    names = ["score", "_score", "h", "row", "key", "first", "words", "_words", "copies", "target", "point", "_size"]
    docs = table(spark, SF, "documents").withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names), name


def test_documents_that_reuse_an_id_stay_unless_near_copies(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join([*base, "more"]), " ".join(f"v{i}" for i in range(30)), " ".join(f"u{i}" for i in range(30))]
    rows = [(5, texts[0], "b"), (5, texts[0], "a"), (5, texts[2], "s"), (7, texts[1], "s"), (7, texts[3], "s"), (8, texts[3], "s"), (None, texts[0], "s")]
    single = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "")
    assert Counter(tuple(r) for r in single.collect()) == Counter([rows[1], rows[2], rows[4], rows[6]])
