"""Decontamination, neighbours, toxicity, SimHash, packing and the pipeline against plain Python, with edge cases."""

import pickle
import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tailspark.llm import common, decontamination, neighbours, packing, simhash, toxicity

RNG = np.random.default_rng(5)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)


def words(n, vocab=40):
    return [f"w{k}" for k in RNG.integers(0, vocab, n)]


# -- decontamination ------------------------------------------------------------------------

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(text, items):
    ws, hit, found = split(text), set(), set()
    for item, t in items:
        v = split(t)
        size = min(13, len(v))
        grams = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
        for i in range(len(ws) - size + 1) if v else ():
            if tuple(ws[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                found.add(str(item))
    return len(ws), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(ws)


@pytest.mark.parametrize("max_words", [100_000, 30])
def test_scan_equals_brute_force(spark, max_words):
    items = [(k, " ".join(words(n, 6))) for k, n in enumerate([5, 12, 13, 14, 30, 1, 40])] + [(100, None), (101, ""), (102, "É ünï-code 42 W1"), (103, "w9 w9 w9"), (4, " ".join(words(20, 6)))]
    items.append((50, items[4][1]))
    texts = [None, "", "?!", "É ÜNÏ code 42 w1", "w9 " * 9, *(" ".join(words(300, 6)) for _ in range(20)), *(" ".join(words(200)) + " " + t + " " + " ".join(words(90)) for _, t in items if t), items[4][1].upper()]
    b = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    got = decontamination.scan(docs(spark, texts), b, max_words=max_words).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_words"], r["n_hit"], list(r["item_ids"]), r["contaminated"]) == brute_hits(texts[r["doc_id"]], items), texts[r["doc_id"]]


def test_scan_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.scan(docs(spark, ["a b"]), none).first()["n_hit"] == 0
    assert decontamination.scan(docs(spark, []), none).count() == 0


def test_long_texts_and_repeats(spark):
    item = " ".join(words(20))
    text = " ".join(words(50_000)) + " " + item
    got = decontamination.scan(docs(spark, [text, text], [7, 7]), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert len(got) == 2 and all(r["n_hit"] >= 20 and not r["contaminated"] for r in got)


def test_decontaminate_keeps_clean_documents_as_they_are(spark):
    item = " ".join(words(15))
    long = "Start, " + " ".join(words(900)) + ". " + item + " - END."
    d = docs(spark, ["clean text", item + " few", long, None])
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r["doc_id"]: r["text"] for r in decontamination.decontaminate(d, b).collect()} == {0: "clean text", 2: long, 3: None}
    cut = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(d, b, max_span=10).collect()}
    assert item not in cut[2] and cut[2].startswith("Start, ") and cut[2].endswith("- END.") and cut[0] == "clean text"


@pytest.mark.parametrize("max_words", [100_000, 25])
def test_no_long_span_is_left_in_kept_documents(spark, max_words):
    rng = np.random.default_rng(8)
    some = lambda n: [f"w{k}" for k in rng.integers(0, 3_000, n)]
    items = [(k, " ".join(some(n))) for k, n in enumerate((13, 20, 40, 5, 26))]
    a, b = items[1][1].split(), items[4][1].split()
    long = lambda *parts: " ".join([*some(1_500), *(w for p in parts for w in p), *some(1_500)])
    texts = [long(a), long(a[:10], b, a[10:]), long(items[3][1].split()), long(a, a, b), items[0][1], None, "", "clean words only", long(items[2][1].split()).upper()]
    d = docs(spark, texts).withColumn("cut", F.lit(1)).withColumn("found", F.lit(2))
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.decontaminate(d, bench, max_span=12, max_words=max_words)
    assert out.columns == d.columns
    got = {r["doc_id"]: r for r in out.collect()}
    want = {i for i, t in enumerate(texts) if not brute_hits(t, items)[3]}
    assert set(got) == want and 4 not in want
    whole = [i for i in items if len(split(i[1])) >= 13]
    for i, r in got.items():
        assert brute_hits(r["text"], whole)[1] == 0
        if not brute_hits(texts[i], whole)[1]:
            assert r["text"] == texts[i]
        else:
            assert len(split(r["text"])) == 3_000 and r["n_chars"] == len(r["text"])


# -- neighbours -----------------------------------------------------------------------------


def test_neighbours_equal_brute_force(spark):
    v = RNG.normal(size=(400, 16)).astype(np.float32)
    v[100:140] = v[0]  # ties
    v[200] = 0
    rows = [(int(i), [float(x) for x in r], i % 3) for i, r in enumerate(v)]
    rows[201] = (201, None, 0)
    rows[202] = (202, [float("nan")] * 16, 0)
    rows[203] = (203, [float("inf")] + [1.0] * 15, 0)
    rows[204] = (204, [1.0, 2.0], 0)
    rows[206] = (206, [], 0)
    rows += [(None, [1.0] * 16, 0), (50, rows[50][1], 9), (300, [1e-30 * x for x in rows[300][1]], 0)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), every=50).collect()
    good = list({(i, tuple(e)) for i, e, _ in rows if i is not None and e and len(e) == 16 and all(np.isfinite(e)) and any(e)})
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in {i for i, _ in good if i % 50 == 0}:
        best = []
        for x in (np.array(e) for i, e in good if i == q):
            best += [(-float(neighbours._cosine(x[None], np.array(e)[None])[0]), i) for i, e in good if i != q]
        best = sorted(best)[:5]
        mine = sorted(by[q])
        assert [m[1] for m in mine] == [i for _, i in best] and [m[2] for m in mine] == [-s for s, _ in best] and [m[0] for m in mine] == [1, 2, 3, 4, 5]
    assert 200 not in by


def test_fewer_candidates_than_asked(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(d, 50).collect()] == [(0, 1, 1)]
    assert neighbours.nearest(d.limit(0), 50).count() == 0


def test_quantisation_bound_holds():
    a, b = RNG.normal(size=(50, 32)), RNG.normal(size=(80, 32)) ** 3
    qa, sa, na, ea = neighbours._quantise(a)
    qb, sb, nb, eb = neighbours._quantise(b)
    true = (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T
    off = na[:, None] * eb + ea[:, None] * nb + ea[:, None] * eb
    assert (np.abs((qa @ qb.T) * sa[:, None] * sb - true) <= off + 1e-9).all()


@pytest.mark.parametrize("d", [1_536, 3_000])
def test_long_vectors_are_exact(d):
    rng = np.random.default_rng(d)
    base = rng.normal(size=d)
    cv = base + rng.normal(size=(300, d)) * 1e-7  # nearer to each other than single precision tells
    cv[200:] *= 1e150
    qv = cv[:20] * rng.uniform(1e-160, 1e160, (20, 1))
    q, c, score = neighbours.tile_top(np.arange(20), qv, np.arange(300), cv, 5)
    for i in range(20):
        all_ = neighbours._cosine(np.repeat(qv[i : i + 1], 300, axis=0), cv)
        all_[i] = -2
        best = np.lexsort((np.arange(300), -all_))[:5]
        assert sorted(c[q == i].tolist()) == sorted(best.tolist()) and np.isfinite(score).all()


def test_equal_vectors_take_little_memory():
    import tracemalloc

    cv = np.ones((30_000, 64))
    tracemalloc.start()
    q, c, score = neighbours.tile_top(np.arange(0, 30_000, 50), cv[::50], np.arange(30_000)[::-1].copy(), cv, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    ids = 29_999 - c
    assert peak < 400e6 and len(q) == 3_000 and sorted(ids[q == 7].tolist()) == [0, 1, 2, 3, 4] and sorted(ids[q == 0].tolist()) == [1, 2, 3, 4, 5] and (score == 1).all()


# -- toxicity -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def toxic_world():
    texts, labels = [], []
    for i in range(700):
        bad = i % 7 == 0
        ws = words(int(RNG.integers(5, 60)), 300)
        if bad:
            ws[0] = ["vile", "awful", "nastyish", "nastyous"][i % 4]
        texts.append(" ".join(ws))
        labels.append(int(bad))
    return texts, labels


def test_search_equals_exhaustive_cosine():
    n = 900
    vectors = []
    for _ in range(n):
        fs = np.sort(RNG.choice(60, RNG.integers(1, 9), replace=False))
        w = RNG.random(len(fs))
        vectors.append((fs, w / np.linalg.norm(w)))
    m = toxicity.Model({str(i).encode(): i for i in range(60)}, np.ones(60), RNG.integers(0, 2, n).astype(float), list(range(n)), vectors)
    dense = np.zeros((n, 60))
    for i, (fs, w) in enumerate(vectors):
        dense[i, fs] = w
    for i in range(0, n, 45):
        best, score = m.search(*vectors[i], 15, without=i)
        want = dense @ dense[i]
        want[i] = -1
        order = np.lexsort((np.arange(n), -np.round(want, 12)))[:15]
        assert np.allclose(np.sort(score)[::-1], want[order]) and len(set(best)) == len(best) and i not in best


@pytest.mark.parametrize("n", [3, 127, 900, 1500])
def test_blocks_are_skipped_and_neighbours_stay_exact(n):
    # groups of like examples over 700 features, so that the index has frequent and rare ones and skips blocks
    rng = np.random.default_rng(n)
    vectors = []
    for i in range(n):
        own = (i % 5) * 140
        fs = np.unique(np.minimum(rng.geometric(0.05, rng.integers(2, 40)) - 1, 139) + own)
        w = rng.random(len(fs)) + 0.1
        vectors.append((fs, w / np.linalg.norm(w)))
    vectors[n // 2] = vectors[0]
    m = toxicity.Model({str(i).encode(): i for i in range(700)}, np.ones(700), rng.integers(0, 2, n).astype(float), list(range(n)), vectors)
    dense = np.zeros((n, 700))
    for i, (fs, w) in enumerate(vectors):
        dense[i, fs] = w
    asked = list(range(0, n, 7))
    for (best, score), i in zip(m.search_all([vectors[i] for i in asked], 15, asked), asked, strict=True):
        want = dense @ dense[i]
        want[i] = 0
        order = [e for e in np.lexsort((np.arange(n), -want))[:15] if want[e] > 0]
        assert np.allclose(score, want[order], atol=1e-12) and len(set(best.tolist())) == len(best) and i not in best
    assert n < 900 or m.read < m.seen


def test_votes_and_calibration_by_hand(spark, toxic_world):
    texts, labels = toxic_world
    d, lb = docs(spark, texts), spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    model = toxicity.fit(d, lb)
    rows = {r["doc_id"]: r for r in toxicity.score(d, model).collect()}
    dense = np.zeros((len(model.labels), len(model.vocab)))
    model._index()
    for e in range(len(model.labels)):
        fs, ws = model.example_vector(e)
        dense[e, fs] = ws
    for i in range(0, len(texts), 23):
        counts = {}
        for w in texts[i].split():
            for f in toxicity.expand(w.encode()):
                if f in model.vocab:
                    counts[model.vocab[f]] = counts.get(model.vocab[f], 0) + 1
        q = np.zeros(len(model.vocab))
        q[list(counts)] = [(1 + np.log(c)) * model.idf[f] for f, c in counts.items()]
        sims = dense @ q / np.linalg.norm(q)
        best = np.lexsort((np.arange(len(sims)), -np.round(sims, 12)))[: toxicity.NEIGHBOURS]
        w = sims[best] ** 2
        raw = (w @ model.labels[best] + 0.05 * model.blank) / (w.sum() + 0.05)
        at = max(0, int(np.searchsorted(model.steps[0], raw - 1e-9, "right")) - 1), max(0, int(np.searchsorted(model.steps[0], raw + 1e-9, "right")) - 1)
        assert any(abs(rows[i]["score"] - min(1.0, max(0.0, model.steps[1][k]))) < 1e-9 for k in at)
        assert np.allclose([e["similarity"] for e in rows[i]["evidence"]], sims[best[:3]], atol=1e-9)
    assert (np.diff(model.steps[0]) >= 0).all() and (np.diff(model.steps[1]) >= -0.2).all()


def test_ids_of_any_type_and_texts_of_one_id(spark, toxic_world):
    texts, labels = toxic_world
    names = [f"d{i}" for i in range(len(texts))]
    d = spark.createDataFrame([*zip(names, texts, [7] * len(texts)), ("d1", "zz other", 7), (None, "vile", 7)], "doc_id string, text string, label_id int")
    model = toxicity.fit(d, spark.createDataFrame(list(zip(names, labels)), "doc_id string, toxic int"))
    rows = toxicity.score(d, model).collect()
    assert len(rows) == len(texts) + 2 and all(e["doc_id"] in names for r in rows for e in r["evidence"])
    assert [r["predicted"] for r in rows if r["doc_id"] is None] == [1]


def test_held_out_scores(spark, toxic_world):
    texts, labels = toxic_world
    lb = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)] + [(3, 0, labels[3]), (99_999, 1, 1)], "doc_id long, quality int, toxic int")
    d = docs(spark, texts)
    model = toxicity.fit(d, lb)
    rows = toxicity.score(d, model).withColumn("h", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert {r["doc_id"] for r in rows if r["h"]} == {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0}
    held = [r for r in rows if r["h"]]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.95
    assert any(r["evidence"] for r in held)
    kept = {r["doc_id"] for r in toxicity.drop_toxic(d, model).collect()}
    assert kept == {r["doc_id"] for r in rows if not r["predicted"]}
    named = d.withColumn("code", F.lit("clash"))
    same = toxicity.clean(named, lb)
    assert same.columns == named.columns and {r["doc_id"] for r in same.filter("code = 'clash'").collect()} == kept


def test_labels_of_held_out_rows_do_not_matter(spark, toxic_world):
    texts, labels = toxic_world
    d = docs(spark, texts)
    turned = [1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y for i, y in enumerate(labels)]
    scores = []
    for ys in (labels, turned):
        lb = spark.createDataFrame(list(enumerate(ys)), "doc_id long, toxic int")
        scores.append([r["score"] for r in toxicity.score(d, toxicity.fit(d, lb)).orderBy("doc_id").collect()])
    assert scores[0] == scores[1]


def test_every_word_of_the_examples_is_compared(spark):
    # two toxic examples a word, and common words that say nothing: no count or ratio of evidence leaves a text out
    texts = [f"c{k % 3} c{k % 5} own{k} ugly{k // 2}" if k < 40 else f"c{k % 3} c{k % 5} own{k}" for k in range(200)]
    ids = [i for i in range(2_000) if zlib.crc32(str(i).encode()) % 5][: len(texts)]
    lb = spark.createDataFrame([(i, int(k < 40)) for k, i in enumerate(ids)], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, texts, ids), lb)
    asked = ["ugly3 other", "c1 another", "own150 c2 c4"]
    rows = {r["doc_id"]: r for r in toxicity.score(docs(spark, asked), model).collect()}
    assert all(r["evidence"] for r in rows.values())
    assert rows[0]["evidence"][0]["doc_id"] in ids[6:8] and rows[2]["evidence"][0]["doc_id"] == ids[150]
    assert rows[0]["score"] > max(rows[1]["score"], rows[2]["score"])


def test_examples_that_share_a_passage_all_count(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [f"{passage} a{k} b{k} c{k}" for k in range(40)] * 2
    ids = [i for i in range(2_000) if zlib.crc32(str(i).encode()) % 5][: len(texts)]
    lb = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, texts, ids), lb)
    assert model.ids == ids[:40]  # copies count once, texts that only share a passage each


def test_no_labels_and_odd_texts(spark):
    d = docs(spark, [None, "", "x" * 100_000, "a b"], [None, 1, 2, 3])
    for rows in ([], [(2, None)], [(2, 0)], [(3, 1)]):
        lb = spark.createDataFrame(rows, "doc_id long, toxic int")
        assert toxicity.score(d, toxicity.fit(d, lb)).count() == 4
    assert toxicity.score(d.limit(0), toxicity.fit(d.limit(0), spark.createDataFrame([(3, 1)], "doc_id long, toxic int"))).count() == 0


# -- simhash --------------------------------------------------------------------------------


def brute_fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(set(fps)), 2):
        if (a ^ b).bit_count() <= 4:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return find


def test_triples_cover_every_four():
    assert len(simhash.TRIPLES) == 20
    assert all(any(set(t) <= set(q) for t in simhash.TRIPLES) for q in combinations(range(8), 4))
    assert all((simhash.FIRST[m] >= 0) for m in range(256) if m.bit_count() >= 4)


def test_links_equal_brute_force(spark):
    base = [int(x) for x in RNG.integers(0, 2**63, 20)]
    fps = {0, 1, (1 << 64) - 1}
    for b in base:
        for _ in range(12):
            x = b
            for k in RNG.integers(0, 64, RNG.integers(0, 7)):
                x ^= 1 << int(k)
            fps.add(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {tuple(sorted((r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)))) for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()}
    assert got == {(a, b) for a, b in combinations(sorted(fps), 2) if (a ^ b).bit_count() <= 4}


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)] + [(100, 101), (101, 99), (5, 5)]])
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        if a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_near_duplicates_equal_brute_force(spark):
    texts = [None, "", " \t\n", "A b C", "a B c", "x", *(" ".join(words(80)) for _ in range(15))]
    for t in texts[6:14]:
        ws = t.split()
        ws[40] = "changed"
        texts += [t, t.upper(), " ".join(ws)]
    ids = [None, *range(100, 99 + len(texts))]
    fps = [brute_fingerprint(t) for t in texts]
    find = brute_classes(fps)
    least = {}
    for i, f in zip(ids, fps, strict=True):
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    got = simhash.near_duplicates(docs(spark, texts, ids)).collect()
    assert sorted((str(r["doc_id"]), r["fp"] & (2**64 - 1), r["component_id"]) for r in got) == sorted((str(i), f, least[find(f)]) for i, f in zip(ids, fps, strict=True))
    kept = simhash.deduplicate(docs(spark, texts, ids)).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(set(least.values()))
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_each_text_of_a_repeated_id_is_judged(spark):
    one, two = (" ".join(words(60, 900)) for _ in range(2))
    for texts, ids in (([one, one, two], [3, 5, 5]), ([two, one, one], [5, 5, 3]), ([one, one, two, two], [3, 5, 5, 5])):
        kept = simhash.deduplicate(docs(spark, texts, ids)).collect()
        assert sorted((r["doc_id"], r["text"]) for r in kept) == [(3, one), (5, two)]
    both = {r["text"] for r in simhash.deduplicate(docs(spark, [one, two], [5, 5])).collect()}
    assert both == {one, two}


# -- packing --------------------------------------------------------------------------------


def check_plan(hist, length=1024):
    bins = packing.plan(hist, length)
    used = {}
    for copies, own in bins:
        assert sum(own) <= length and copies > 0 and own
        for s in own:
            used[s] = used.get(s, 0) + copies
    assert used == {k: v for k, v in hist.items() if v}
    return sum(c for c, _ in bins)


@pytest.mark.parametrize("hist", [{}, {1024: 5}, {1: 1}, {1: 5000}, {513: 7}, {512: 7, 511: 3}, {700: 10, 300: 9, 24: 11}, {129: 1, 128: 1}])
def test_plans_hold_everything(hist):
    n = check_plan(hist)
    assert n >= -(-sum(k * v for k, v in hist.items()) // 1024)


def test_plans_are_close_to_the_bound():
    for k in range(6):
        rng = np.random.default_rng(k)
        sizes = np.minimum(1024, np.maximum(1, rng.lognormal(5 + k / 3, 1, 4000).astype(int)))
        hist = {int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True), strict=True)}
        bound = max(-(-int(sizes.sum()) // 1024), int((sizes > 512).sum()))
        assert check_plan(hist) <= bound * 1.02 + 2


def test_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    texts = [None, "", "Hello, world", "é  ñ\n\n x", "日本語 🙂 <|endoftext|>", "a" * 3_000, " " * 2_000 + "x", *(" ".join(words(n)) for n in (10, 700, 2_500, 9, 44, 90))]
    rows = packing.pack_documents(docs(spark, texts + [texts[2]], [*range(len(texts)), 2]), with_ids=True).collect()
    want = {i: [*(tok.encode(t, add_special_tokens=False).ids if t else []), 2] for i, t in enumerate(texts)}
    seqs, by = {}, {}
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] and r["length"] == len(r["ids"])
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["ids"]))
    assert len(by.pop(2)) == 2 * len(range(1))
    for i, p in by.items():
        p.sort()
        assert [x for _, _, ids in p for x in ids] == want[i] and [s for _, s, _ in p] == list(np.cumsum([0, *(len(ids) for _, _, ids in p[:-1])]))
        assert all(len(ids) == 1024 for _, _, ids in p[1:])
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert packing.pack_documents(docs(spark, [])).count() == 0


# -- pipeline -------------------------------------------------------------------------------


def test_stages_and_pipeline(spark, tmp_path):
    clean = [" ".join(words(60, 900)) for _ in range(60)]
    item = " ".join(words(20, 900))
    bad = [" ".join([*words(20, 900), "vile", "vile"]) for _ in range(30)]
    texts = clean + bad + [clean[0], item + " x y", clean[1] + " bob@x.org"]
    d = docs(spark, texts)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(60 <= i < 90)) for i in range(90)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, kept = d, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, str(tmp_path)).collect(), d.schema)
        assert now.columns == d.columns
        kept.append((name, {r["doc_id"] for r in now.collect()}))
    left = dict(kept)
    assert not left["toxicity"] & set(range(60, 90)) and set(range(60)) <= left["toxicity"]
    assert 90 not in left["simhash"] and 0 in left["simhash"] and set(range(1, 60)) <= left["simhash"]
    assert 91 not in left["decontamination"]
    assert {r["text"] for r in now.filter("doc_id = 92").collect()} <= {clean[1] + " [EMAIL]"}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == left["pii"]


def test_the_driver_holds_words_and_examples_packed(spark, toxic_world):
    texts, labels = toxic_world
    model = toxicity.fit(docs(spark, texts), spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int"))
    assert "vocab" not in model.__dict__ and model.feature is None and model.times is None
    sent = pickle.loads(pickle.dumps(pickle.loads(pickle.dumps(model))))
    assert sent.vocab == model.vocab and len(sent.vocab) == len(sent.idf)
    sent._index()
    model._index()
    assert sent.codes is None and model.codes is not None
    for e, x in enumerate(model.codes):
        fs, ns = toxicity._decode(x)
        span = slice(sent.first[e], sent.first[e + 1])
        assert (sent.feature[span] == fs).all() and (sent.times[span] == ns).all() and (model.feature[span] == fs).all()


def test_lists_of_rare_features_are_read_in_parts(monkeypatch):
    monkeypatch.setattr(toxicity, "READ", 7)
    rng, n, v = np.random.default_rng(8), 1_500, 900
    vectors = []
    for _ in range(n):
        fs = np.sort(rng.choice(v, rng.integers(2, 40), replace=False))
        w = rng.random(len(fs))
        vectors.append((fs, w / np.linalg.norm(w)))
    m = toxicity.Model({str(i).encode(): i for i in range(v)}, np.ones(v), rng.integers(0, 2, n).astype(float), list(range(n)), vectors)
    dense = np.zeros((n, v))
    for i, (fs, w) in enumerate(vectors):
        dense[i, fs] = w
    asked = list(range(0, n, 50))
    for (best, score), i in zip(m.search_all([vectors[i] for i in asked], 15, asked), asked, strict=True):
        want = dense @ dense[i]
        want[i] = -1
        order = np.lexsort((np.arange(n), -want))[:15]
        assert best.tolist() == order.tolist() and np.allclose(score, want[order])
    assert len(m.buffer) < len(m.posting)


def test_frequent_words_come_first_and_one_model_is_sent(spark, toxic_world):
    texts, labels = toxic_world
    lb = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    model, coded, shared = toxicity._fit(docs(spark, texts), lb)
    assert len(shared.value.labels) == len(model.labels) and len(model.steps[0])
    often = np.zeros(len(model.idf), dtype=int)
    for x in model.codes:
        often[toxicity._decode(x)[0]] += 1
    assert (np.diff(often) <= 0).all()
    scores = {r["doc_id"]: r["score"] for r in toxicity._scored(coded, shared, model.steps, toxicity.Model.stream_codes).collect()}
    assert scores == {r["doc_id"]: r["score"] for r in toxicity.score(docs(spark, texts), model).collect()}


def test_tables_of_ids_need_no_python_workers(spark, toxic_world, monkeypatch):
    texts, labels = toxic_world
    d, lb = docs(spark, texts), spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    d.count(), lb.count()

    def refuse(*_args, **_kw):
        raise AssertionError("a list went through Python workers")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refuse)
    assert len(toxicity.fit(d, lb).labels)


def test_workers_get_long_texts_in_small_batches(spark, toxic_world):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts, labels = toxic_world
    d, lb = docs(spark, texts), spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    long = spark.range(0, 3_000, 1, 1).selectExpr("id doc_id", "repeat('word ', 2000) text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    spark.conf.unset(key)
    toxicity.fit(d, lb)
    found = [r["n"] for r in long.mapInArrow(sizes, "n long").collect()]
    assert sum(found) > 30_000_000 and max(found) < 1.1 * common.BATCH_BYTES
    spark.conf.set(key, "1m")  # a size that the session has of its own stays
    toxicity.fit(d, lb)
    assert spark.conf.get(key) == "1m"
    spark.conf.unset(key)


def test_workers_drop_the_tokenizer_for_other_work(spark):
    def held(batches):
        import gc

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(type(x).__name__ == "PieceEncoder" for x in gc.get_objects())])], ["n"])

    d = docs(spark, [f"text {i}" for i in range(200)]).repartition(8)
    assert packing.pack_documents(d).count() == 200
    assert {r["n"] for r in spark.range(0, 80, 1, 8).mapInArrow(held, "n long").collect()} == {0}
