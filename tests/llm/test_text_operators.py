"""Operators on texts against plain versions, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quernstone.llm import bpe, jaccard_join, license_scan, quality_rules, token_files
from quernstone.llm.queries import TOKENIZER

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, region string, n long, size string, part string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
PATH = public_tokenizers.path(TOKENIZER)


def frame(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, None, s, None, "r", 1, "z", "p") for i, t, s in rows], SCHEMA)


def texts(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Don't", "ΑΣ", "é", "###", "<|endoftext|>", "the", "THE"]
    out = [None, "", " \n\t", "one", "one two", "One  TWO", "a b c d e", "a b c d e f"]
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(rng.choice([" ", "\n", "  "]).join(copy))
    out.append(" ".join(rng.choice(vocabulary) for _ in range(30_000)))
    return out


def shingle_set(text):
    words = WORD.findall((text or "").translate(LOW))
    return set(zip(*[words[k:] for k in range(5)], strict=False)) if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t, _ in rows}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_matches_all_pairs(spark, seed):
    rows = [(3 * k + 1, t, "s") for k, t in enumerate(texts(seed))]
    random.Random(seed).shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_components(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_jaccard_join_large_regions(spark, monkeypatch):
    """Regions beyond the small size go through elected pivots, Voronoi cells, windows, recursion and tiles of blocks."""
    for name, value in (("SMALL_REGION", 3), ("CELL", 4), ("PIVOTS", 2), ("BLOCK", 5), ("HOT", 2), ("SALTS", 3)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(9)
    words = [f"v{i}" for i in range(60)]
    rows = []
    for k in range(70):
        rows.append((k, " ".join(words), "s"))
        words[rng.randrange(len(words))] = f"x{k}"
    rows += [(100 + k, " ".join(["common line of five words here now"] + [f"y{k}_{i}" for i in range(rng.randint(1, 6))]), "s") for k in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_components(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_jaccard_join_cells_hold_every_link(spark):
    """Two members within the radius meet in a cell, whichever pivots are nearest to them."""
    rng = random.Random(4)
    words = [f"v{i}" for i in range(40)]
    rows = []
    for k in range(60):
        rows.append((k, " ".join(words), "s"))
        words[rng.randrange(len(words))] = f"x{k}"
    sets = jaccard_join._sets(frame(spark, rows).select("doc_id", "text")).cache()
    points = sorted(r.doc for r in sets.collect())
    cells = sets.select(F.lit(7).cast("long").alias("region"), "doc", "n", F.col("doc").alias("part"), F.lit(points[0]).alias("main"), F.lit(len(points)).alias("size"))
    placed, links = jaccard_join._faced(cells, sets, 80)
    # as long as no links are known, every boundary document is of another component
    divided = jaccard_join._divided(cells, placed, spark.createDataFrame([], "node long, component long"), 80).collect()
    held = defaultdict(set)
    for r in divided:
        held[r.doc].add(r.region)
    homes = {(r.region, r.doc) for r in divided if r.home}
    hashes = {r.doc: set(np.frombuffer(r.shingles, np.uint64).tolist()) for r in sets.collect()}
    linked = [(a, b) for a in points for b in points if a < b and 100 * len(hashes[a] & hashes[b]) >= 80 * len(hashes[a] | hashes[b])]
    assert linked and all(any((c, a) in homes or (c, b) in homes for c in held[a] & held[b]) for a, b in linked if (a, b) not in {tuple(sorted(r)) for r in links.collect()} and not {c for c, d in homes if d == a} & {c for c, d in homes if d == b})
    assert len({c for x in held.values() for c in x}) > 1 and any(len(x) == 1 for x in held.values()) and any(len(x) > 1 for x in held.values())
    assert {tuple(sorted(r)) for r in links.collect()} <= set(linked)


def test_jaccard_join_divides_only_where_pairs_become_fewer(spark, monkeypatch):
    """A group whose members are nearly all between r and 2 r apart stays whole, instead of each member in each cell."""
    for name, value in (("SMALL_REGION", 3), ("CELL", 4), ("PIVOTS", 4), ("BLOCK", 16)):
        monkeypatch.setattr(jaccard_join, name, value)
    opened, tiled = [], []
    open_, tile_pairs = jaccard_join._open, jaccard_join._tile_pairs
    monkeypatch.setattr(jaccard_join, "_open", lambda *x: opened.append(open_(*x)) or opened[-1])
    monkeypatch.setattr(jaccard_join, "_tile_pairs", lambda *x: tiled.append(x[0].count()) or tile_pairs(*x))
    rng = random.Random(3)
    base, rows = [f"v{i}" for i in range(150)], []
    for k in range(60):
        copy = list(base)
        for at in rng.sample(range(150), rng.randint(2, 4)):
            copy[at] = f"x{k}_{at}"
        rows.append((k, " ".join(copy), "s"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_components(frame(spark, rows)).collect()}
    assert got == brute_components(rows)
    assert len(tiled) == 1 and 0 < tiled[0] <= opened[0].count()


def test_jaccard_join_cells_that_lessen_pairs(spark):
    # cell 1 falls into 3 and 2 of 4 members, cell 2 into 3 and 3 of 4, of cell 3 nothing is left to compare
    members = [(1, d) for d in range(4)] + [(2, d) for d in range(4)] + [(3, d) for d in range(4)]
    divided = [(1, 11, d, 4) for d in (0, 1, 2)] + [(1, 12, d, 4) for d in (2, 3)] + [(2, 21, d, 4) for d in (0, 1, 2)] + [(2, 22, d, 4) for d in (1, 2, 3)]
    cells, same = jaccard_join._lessened(spark.createDataFrame(members, "region long, doc long"), spark.createDataFrame(divided, "origin long, region long, doc long, whole long"))
    assert Counter(tuple(r) for r in cells.collect()) == Counter(r[1:] for r in divided if r[0] == 1)
    assert sorted(tuple(r) for r in same.collect()) == [m for m in members if m[0] == 2]


def test_jaccard_join_least_shared_weight_in_columns(spark):
    sizes = [*range(1, 300), 1000, 4095, 4096, 100_000]
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", jaccard_join._lowest("n", 80).alias("x")).collect()
    assert {r.n: r.x for r in got} == {n: jaccard_join.shared_at_least(-(-n * 80 // 100), 80) for n in sizes}


def test_jaccard_join_ids_with_two_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(5, a, "s"), (5, b, "s"), (1, a, "s"), (2, b, "s"), (9, a + " more", "s")]
    got = sorted(tuple(r) for r in jaccard_join.join_links(frame(spark, rows)).collect())
    assert got == [(1, 26, 1, 2), (2, 26, 2, 1), (5, 26, 1, 2), (5, 26, 2, 1), (9, 27, 1, 2)]


def test_jaccard_join_threshold_edges():
    """A pair of exactly 0.8 links, one just below does not; linked sets share regions as promised."""
    rng = np.random.default_rng(3)
    for n in (1, 4, 5, 9, 17, 40, 127, 128, 700):
        for _ in range(30):
            x = np.unique(rng.integers(0, 2**63, n, np.int64).astype(np.uint64) * np.uint64(2))
            drop = int(rng.integers(0, len(x) // 5 + 1))
            room = (len(x) - drop) * 100 // 80 - len(x)
            add = rng.integers(0, 2**63, int(rng.integers(0, max(room, 0) + 1)), np.int64).astype(np.uint64)
            y = np.unique(np.concatenate([x[drop:], add]))
            both, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
            if 100 * both >= 80 * union and both:
                shared = len(np.intersect1d(jaccard_join.regions(x, 80), jaccard_join.regions(y, 80)))
                assert shared >= min(jaccard_join.shared_at_least(len(x), 80), jaccard_join.shared_at_least(len(y), 80))


def test_jaccard_join_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(5, "a b c d e f", "s"), (5, "a b c d e f", "s"), (2, "A b c  d e f", None), (None, "a b c d e f", "s"), (None, None, None)]
    got = sorted(tuple(r) for r in jaccard_join.join_components(frame(spark, rows)).fillna(-1).collect())
    assert got == [(-1, 0, -1), (-1, 2, -1), (2, 2, 2), (5, 2, 2), (5, 2, 2)]
    assert jaccard_join.join_components(frame(spark, [])).count() == 0


def brute_links(rows):
    """How many other documents each links with, pair by pair."""
    sets = {i: shingle_set(t) for i, t, _ in rows}
    linked = dict.fromkeys(sets, 0)
    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                linked[i] += 1
                linked[j] += 1
    return {i: (*found, linked[i]) for i, found in brute_components(rows).items()}


@pytest.mark.parametrize("block, common, small", [(1024, 24, 16), (7, 3, 3)])
def test_jaccard_join_counts_every_link(spark, monkeypatch, block, common, small):
    """Links inside a component count too, also where it is cut into blocks; copies count each."""
    monkeypatch.setattr(jaccard_join, "COUNT_BLOCK", block)
    monkeypatch.setattr(jaccard_join, "COMMON", common)
    monkeypatch.setattr(jaccard_join, "SMALL_REGION", small)
    rng = random.Random(12)
    words = [f"u{i}" for i in range(80)]
    rows = [(k, t, "s") for k, t in enumerate(texts(5, 25))]
    for k in range(90):
        copy = list(words)
        copy[rng.randrange(len(words))] = f"x{k % 60}"
        rows.append((1000 + k, " ".join(copy), "s"))
        words[rng.randrange(len(words))] = f"z{k}" if k % 9 == 0 else words[0]
    rows += [(2000 + k, rows[-1 - 7 * k][1], "s") for k in range(9)]
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.join_links(frame(spark, rows)).collect()}
    assert got == brute_links(rows)


def test_jaccard_join_common_shingles():
    """Rare and common shingles, counted by different means, add up to the sizes of intersections."""
    rng = np.random.default_rng(4)
    sets = [np.unique(np.concatenate([rng.integers(0, 30, 15), rng.integers(30, 900, 40)])).astype(np.uint64) for _ in range(90)]
    want = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
    rows = np.repeat(np.arange(90), list(map(len, sets)))
    assert (np.triu(jaccard_join._common(rows, np.concatenate(sets), 90, 90, 90), 1) == np.triu(want, 1)).all()
    assert (jaccard_join._common(rows, np.concatenate(sets), 90, 50, 40) == want[:50, 50:]).all()


def test_jaccard_join_counts_three_mutual_links_nulls_and_repeated_rows(spark):
    base = [f"w{i}" for i in range(60)]
    three = [(k, " ".join([*base, f"end{k}"]), "s") for k in (1, 2, 3)]
    rows = [*three, three[0], (7, three[2][1], "s"), (8, "alone", "s"), (9, None, "s"), (None, three[0][1], "s")]
    got = sorted((r.doc_id or -1, r.component_id, r.n_links) for r in jaccard_join.join_links(frame(spark, rows)).collect())
    assert got == [(-1, None, None), (1, 1, 3), (1, 1, 3), (2, 1, 3), (3, 1, 3), (7, 1, 3), (8, 8, 0), (9, 9, 0)]
    assert jaccard_join.join_links(frame(spark, [])).count() == 0


def brute_rules(text):
    words = WORD.findall(text or "")
    seen, covered = defaultdict(list), set()
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    for places in seen.values():
        if len(places) > 1:
            covered.update(p + o for p in places for o in range(8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_match_a_plain_version(spark):
    rng = random.Random(4)
    samples = texts(6, 20) + ["a b c d e f g h " * 6, "line one here\nline one here\n \nline one here", "x # y z \x1c 😀 | <b>"]
    rows = [(k, t, rng.choice(["good", "bad", None])) for k, t in enumerate(samples)] + [(1000 + k, "too short", "bad") for k in range(300)]
    got = {r.doc_id: r for r in quality_rules.apply_rules(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, text, source in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(text), (i, text)
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and source != "bad")
    assert quality_rules.apply_rules(frame(spark, [])).count() == 0


def test_host_verdicts_match_sql_where_hosts_fail(spark):
    """A host far above the others fails with its sound documents; a small one needs more; chance alone fails none."""
    sound = " ".join(f"w{i}" for i in range(40))
    rates = {"a": (400, 20), "b": (300, 12), "c": (500, 30), "far": (200, 90), "tiny": (2, 1), "most": (30, 28), None: (50, 2)}
    rows = [(1000 * h + k, "short" if k < bad else f"{sound} {k}", host) for h, (host, (n, bad)) in enumerate(rates.items()) for k in range(n)]
    con = duckdb.connect()
    con.register("held", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "source": [r[2] for r in rows]}))
    con.execute("CREATE VIEW documents AS SELECT * FROM held")
    got = quality_rules.apply_rules(frame(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(quality_rules.ORACLE).fetchall())
    hosts = {i: r[2] for i, *r in ((r[0], r[0], r[1], r[2]) for r in rows)}
    dropped = {hosts[r.doc_id] for r in got.collect() if not r.base_failed and not r.kept}
    assert dropped == {"far", "most"}
    even = [(k, "short" if k % 9 == 0 else sound, f"h{k % 40}") for k in range(900)]
    assert all(r.kept != r.base_failed for r in quality_rules.apply_rules(frame(spark, even)).collect())


def test_tokenizers_that_cut_otherwise_are_refused(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = "[a-z]+"
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec), encoding="utf-8")
    for encoder in (bpe.WordBpe, token_files.LibraryEncoder):
        with pytest.raises(ValueError):
            encoder(str(other))


def expected_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_bpe_round_trip_matches_the_library(spark):
    rng = random.Random(8)
    samples = texts(3, 12)[:-1] + ["x\x1cy z\u0085q", "İi Ǆ ß ﬁ é", "ꟁ Ᲊ ೜ 日本語 12٣½", "'s 'sing !'t", "a" * 4000, "<|startoftext|>Hi<|endoftext|>"]
    samples += ["".join(chr(rng.choice([rng.randint(32, 0x24F), rng.randint(0x300, 0x3FF), rng.randint(0x400, 0xD7FF)])) for _ in range(40)) for _ in range(150)]
    rows = [(k, t, "s") for k, t in enumerate(samples)] + [(0, None, "s")]
    got = defaultdict(list)
    library = Tokenizer.from_file(PATH)
    for r in bpe.encode_decode(frame(spark, rows), PATH).collect():
        got[r.doc_id].append(tuple(r)[1:])
    for i, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert want in got[i], (i, text)
    kept = bpe.encode_decode(frame(spark, rows[3:6]), PATH, keep_ids=True).collect()
    assert all(list(r.ids) == library.encode(dict((i, t) for i, t, _ in rows)[r.doc_id], add_special_tokens=False).ids for r in kept)
    assert bpe.encode_decode(frame(spark, []), PATH).count() == 0


def test_bpe_cache_overflow_changes_nothing():
    small, library = bpe.WordBpe(PATH, cache_words=5), Tokenizer.from_file(PATH)
    for text in texts(12, 5):
        assert np.frombuffer(small.encode(text), "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_token_files_match_the_library_and_read_selectively(spark, tmp_path):
    rows = [(7 * k % 101, t, "s") for k, t in enumerate(texts(5, 15)[:-1] + ["é Ā ΑΣ", "<|endoftext|> x", "x\x1cy"])] + [(0, None, "s")]
    path = str(tmp_path / "tokens")
    token_files.write_token_files(frame(spark, rows), PATH, path)
    library = Tokenizer.from_file(PATH)
    start, want = 0, []
    for i, text, _ in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    read = token_files.read_token_files(spark, path)
    assert sorted(tuple(r) for r in token_files.checksums(read).collect()) == sorted(want)
    plan = read.select("doc_id", "start")._jdf.queryExecution().toString()
    assert "tokens:array" not in plan.split("ReadSchema")[-1]
    empty = str(tmp_path / "none")
    token_files.write_token_files(frame(spark, []), PATH, empty)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_library_encoder_with_a_full_cache():
    encoder, library = token_files.LibraryEncoder(PATH, cache_pieces=8), Tokenizer.from_file(PATH)
    samples = texts(14, 6)
    for at in range(0, len(samples), 3):
        part = samples[at : at + 3]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(part)] == [library.encode(t or "", add_special_tokens=False).ids for t in part]


def test_license_scan_finds_notices_within_texts(spark):
    filler = " ".join(f"f{i}" for i in range(300))
    rows = [(k, f"{filler} {t.upper() if k % 2 else t} {filler}", "s") for k, (_, t) in enumerate(license_scan.TEMPLATES)]
    changed = license_scan.TEMPLATES[1][1].replace("charge", "cost", 1)
    rows += [(50, f"{filler}\n{changed}", "s"), (51, filler, "s"), (52, None, "s"), (53, "", "s"), (54, "Released under", "s"), (0, rows[0][1], "s")]
    found = defaultdict(set)
    for r in license_scan.scan(frame(spark, rows)).collect():
        found[r.doc_id].add(r.license)
    for k, (name, _) in enumerate(license_scan.TEMPLATES):
        assert name in found[k], name
    assert found[50] == {"MIT-permission"} and not {51, 52, 53, 54} & set(found)
    assert license_scan.scan(frame(spark, [])).count() == 0


def test_license_scan_stays_in_the_jvm(spark):
    for plan in (license_scan.scan(frame(spark, [(1, "x", "s")])), quality_rules.base_counts(frame(spark, [(1, "x", "s")]))):
        assert not re.search("Python|Pandas|Arrow", plan._jdf.queryExecution().executedPlan().toString())


def test_spread_word_count(spark):
    from quernstone.llm.mixture import word_count

    rows = [(k, t, "s") for k, t in enumerate(texts(2, 3) + ["a b c\x0bd\x1ce"])]
    got = {r.doc_id: r.n for r in frame(spark, rows).select("doc_id", word_count("text").alias("n")).collect()}
    assert got == {i: len(WORD.findall(t or "")) for i, t, _ in rows}
