"""The language model, the quality classifier and language identification."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pytest

from calyxa.llm import class_lm as M
from calyxa.llm import language_id as L
from calyxa.llm import quality as Q
from calyxa.llm.scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [(10_008, "½ ² Ⅷ ①"), (10_001, None), (10_002, ""), (10_003, " \n"), (10_004, "unseenword"), (10_005, "é" * 5000), (10_006, "a b " * 60_000), (10_007, "12 !!"), (10_007, "12 !!"), (None, "the")]


def corpus(n=160, seed=2):
    rng = random.Random(seed)
    languages = {"en": ("the", "of", "and", "thing", "reason", "there", "with"), "de": ("der", "und", "nicht", "schön", "über", "keit", "auch"), "fr": ("le", "de", "être", "où", "leçon", "que", "pour")}
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(languages))
        w = [rng.choice(languages[lang]) + rng.choice(["", "", "s", "x"]) for _ in range(rng.randrange(5, 60))]
        junk = i % 4 == 0
        rows.append((i, " ".join(x + "%%%" if junk else x for x in w), lang, "s", 1, 0 if junk else 1))
    return rows


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    rows = corpus()
    docs = [r[:5] for r in rows] + [(i, t, None, None, None) for i, t in EDGES]
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(str(d / "documents.parquet"))
    labels = [(r[0], r[5], 0) for r in rows] + [(1, None, None), (None, 1, 0), (2, 7, 0), (99_999, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    return str(d), docs, {r[0]: r for r in rows}


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], DOCS).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    return str(d)


def test_class_lm_counts_and_base_scores(spark, sf):
    d, docs, _ = sf
    tokens = lambda t: [*(t or "").encode().lower().split(), b" "]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = collections.Counter(w for i, t, *_ in docs if not out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), out(i), len(w := tokens(t)), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 4)) for i, t, *_ in docs)
    rows = M.op6_class_lm(spark, d).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == want
    ours = [r for r in rows if r.doc_id is not None and r.doc_id < 10_000]
    assert sum(r.score for r in ours) > sum(r.base_score for r in ours) and all(r.score < 0 for r in rows)


def _hash(w):
    return int(M.signed(np.uint64(M.word_hash(w))))


def _brute_lm(texts, held, kinds, counts, model):
    """score of every text, from classes and counts of words; also log10 of transitions and of emission denominators."""
    tokens = [[*(t or "").encode().lower().split(), M.END] for t in texts]
    of = lambda w: kinds.get(_hash(w), model.unseen)
    between = np.zeros((M.CLASSES, M.CLASSES))
    for w, out in zip(tokens, held, strict=True):
        if not out:
            for a, b in zip([M.END, *w], w, strict=False):
                between[of(a), of(b)] += 1
    transition, emission = M.logs_of(between, model)
    scores = [sum(transition[of(a), of(b)] + math.log10(counts.get(_hash(b), 0) + 1) - emission[of(b)] for a, b in zip([M.END, *w], w, strict=False)) for w in tokens]
    return scores, transition, emission


def test_class_lm_scores_and_classes(spark, monkeypatch):
    monkeypatch.setattr(M, "TOP", 12)
    monkeypatch.setattr(M, "KNOWN", 20)
    rows = corpus(60)
    texts, held = [r[1] for r in rows] + ["", None, "neverseen the neverseen"], [i % 5 == 0 for i in range(63)]
    docs = spark.createDataFrame([(i, h, t or "") for i, (t, h) in enumerate(zip(texts, held, strict=True))], "doc_id long, held_out boolean, text string")
    scratch = Scratch(spark, "lm")
    model, vocabulary = M.fit(docs.where("not held_out"), scratch)
    words = vocabulary.collect()
    kinds, counts = {r.word: r.kind for r in words}, {r.word: r.n for r in words}
    train = collections.Counter(w for t, h in zip(texts, held, strict=True) if not h for w in [*(t or "").encode().lower().split(), M.END])
    assert counts == {_hash(w): n for w, n in train.items()} and len(words) == len(counts) > 40 and model.kind[0] == kinds[_hash(M.END)]
    want, transition, emission = _brute_lm(texts, held, kinds, counts, model)
    got = {r.doc_id: r.score for r in M.score(docs, model, vocabulary, scratch).collect()}
    assert all(abs(got[i] - w) < 1e-6 for i, w in enumerate(want))
    # over all words and one unseen, probabilities after any class sum to 1
    total = np.zeros(M.CLASSES)
    for h, n in counts.items():
        total += 10 ** (transition[:, kinds[h]] - emission[kinds[h]]) * (n + 1)
    total += 10 ** (transition[:, model.unseen] - emission[model.unseen])
    used = np.array([k in kinds.values() or k == model.unseen for k in range(M.CLASSES)])
    assert np.allclose(total, (10**transition)[:, used].sum(axis=1)) and model.types == len(words)


def test_rare_words_go_to_their_likeliest_class(spark):
    """Contexts of occurrences in several rows of a word count together; ties go to the first class."""
    width = M.CLASSES + 1
    rng = np.random.default_rng(1)
    before, behind, mass = rng.random((width, M.CLASSES)), rng.random((width, M.CLASSES)), rng.random(M.CLASSES)
    sides = {w: rng.integers(0, width, (w % 7 + 1, 2)).astype(np.uint8) for w in range(50)}
    rows = [(w, bytearray(x.tobytes())) for w, s in sides.items() for x in np.array_split(s, min(3, len(s)))]
    got = M.assigned(spark.createDataFrame(rows, "word long, sides binary"), before, behind, mass).collect()
    want = sorted((w, len(s), int((before[s[:, 0]].sum(0) + behind[s[:, 1]].sum(0) - len(s) * mass).argmax())) for w, s in sides.items())
    assert sorted((r.word, r.n, r.kind) for r in got) == want


def test_exchange_finds_the_better_classes():
    n = np.zeros((6, 6))
    for a, b in itertools.product((0, 1, 2), (3, 4, 5)):
        n[a, b] = n[b, a] = 10
    kind = M.exchange(n, 2)
    assert len(set(kind[:3])) == 1 and len(set(kind[3:])) == 1 and kind[0] != kind[3]
    assert M.exchange(n, 2, pinned=1)[-1] == 2


def test_models_on_empty_tables(spark, empty):
    for query in (M.op6_class_lm, Q.op7_quality_classifier, L.op9_language_id):
        assert query(spark, empty).count() == 0


def test_quality_on_held_out_rows(spark, sf):
    d, docs, rows = sf
    got = Q.op7_quality_classifier(spark, d).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(r.predicted, rows[r.doc_id][5]) for r in got if r.held_out and r.doc_id in rows]
    assert len(held) > 30 and sum(a == b for a, b in held) / len(held) > 0.95


def test_quality_against_brute_force(spark, sf):
    """The sparse model again with dictionaries: features of a text, updates row by row, logistic scores."""
    d, docs, _ = sf
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{d}/labels.parquet").collect() if r.doc_id is not None and r.quality in (0, 1)]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1
    features = {i: dict(zip(*(a.tolist() for a in Q.features((t or "").encode(), Q.Forms())), strict=True)) for i, t, *_ in docs}
    order = {r.doc_id: r.h for r in spark.sql("select id doc_id, xxhash64(id) h from range(0, 200)").collect()}
    rows = sorted(((order[i], y, i) for i, y in labels if not out(i) and i in features), key=lambda r: (r[0], r[2]))
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(k):
        return 0.0 if abs(z[k]) <= Q.L1 else -(z[k] - math.copysign(Q.L1, z[k])) / ((Q.BETA + math.sqrt(n[k])) / Q.ALPHA + Q.L2)

    def p(i):
        return 1 / (1 + math.exp(-sum(weight(k) * x for k, x in [*features[i].items(), (Q.BUCKETS, 1.0)])))

    for epoch in range(Q.EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            _, y, i = rows[k]
            error = p(i) - y
            for j, x in [*features[i].items(), (Q.BUCKETS, 1.0)]:
                g = error * x
                w, s = weight(j), (math.sqrt(n[j] + g * g) - math.sqrt(n[j])) / Q.ALPHA
                z[j] += g - s * w
                n[j] += g * g
    got = {r.doc_id: r.score for r in Q.op7_quality_classifier(spark, d).collect()}
    assert all(abs(got[i] - p(i)) < 1e-4 for i in features)


def test_long_words_keep_their_whole_form():
    a, b = (Q.features(f"{'ab1' * 5}{tail}".encode(), Q.Forms())[0] for tail in ("x", "%"))
    assert len(set(a) & set(b)) == 0


def test_quality_bound_on_features(spark, sf):
    d, docs, rows = sf
    frame, labels = spark.createDataFrame(docs, DOCS), spark.read.parquet(f"{d}/labels.parquet")
    few = Q.fit(frame, labels, Scratch(spark, "q"), max_features=200)
    assert 0 < np.count_nonzero(few) < np.count_nonzero(Q.fit(frame, labels, Scratch(spark, "q")))


def test_quality_without_labels_and_names(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    w = Q.fit(docs, spark.createDataFrame([], "doc_id long, quality int"), Scratch(spark, "q"))
    assert [r.score for r in Q.score(docs, w).collect()] == [0.5, 0.5]
    with pytest.raises(ValueError):
        Q.score(docs.withColumn("Score", docs.doc_id), w)


def test_language_on_held_out_rows(spark, sf):
    d, docs, rows = sf
    got = L.op9_language_id(spark, d).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    held = [(r.lang_pred, rows[r.doc_id][2]) for r in got if r.held_out and r.doc_id in rows]
    assert len(held) > 20 and sum(a == b for a, b in held) / len(held) > 0.95
    assert {r.lang_pred for r in got if r.doc_id in (10_001, 10_002, 10_003, 10_007, 10_008)} == {"und"}


def segmentations(word, pieces):
    if not word:
        yield []
    for i in range(1, len(word) + 1):
        if word[:i] in pieces:
            for rest in segmentations(word[i:], pieces):
                yield [word[:i], *rest]


@pytest.fixture(scope="module")
def small():
    pieces = ["▁", "a", "b", "ab", "ba", "▁a", "aba", "bab", "é"]
    rng = np.random.default_rng(0)
    return pieces, L.Lattice(*L.prefix_table(pieces)), rng.dirichlet(np.ones(len(pieces) + 1), 2).T


def test_forward_sums_all_segmentations(small):
    pieces, lattice, p = small
    words = ["▁ab", "▁ababab", "▁", "▁bbé", "▁abaab"]
    got = lattice.forward(words, p)
    for w, row in zip(words, got, strict=True):
        for k in range(2):
            total = sum(math.prod(p[pieces.index(x), k] for x in s) for s in segmentations(w, pieces))
            assert abs(math.exp(row[k]) - total) < 1e-12 * max(1, total)
    unknown = lattice.forward(["▁z"], p)[0]
    assert abs(math.exp(unknown[0]) - p[0, 0] * p[lattice.unknown, 0]) < 1e-12
    assert lattice.forward([], p).shape == (0, 2)


def test_expected_counts(small):
    pieces, lattice, p = small
    words, lang, n = ["▁abab", "▁baba", "▁abab"], np.array([0, 1, 1]), np.array([2, 3, 1])
    want = np.zeros(p.shape)
    for w, k, times in zip(words, lang, n, strict=True):
        ways = [(s, math.prod(p[pieces.index(x), k] for x in s)) for s in segmentations(w, pieces)]
        z = sum(q for _, q in ways)
        for s, q in ways:
            for x in s:
                want[pieces.index(x), k] += times * q / z
    assert np.allclose(lattice.expected(words, lang, n, p), want)


def test_vocabulary_and_letters():
    pieces = L.pieces_of(L.VOCABULARY)
    assert 30_000 < len(pieces) < 32_000 and "▁the" in pieces
    assert L._marked("a bc") == ["▁a", "▁bc"] and not any(map(L.has_letter, ["½ ²", "Ⅷ ①", "12 !_", ""])) and all(map(L.has_letter, ["½a", "語", "_é"]))


def test_long_words_are_summed_whole(small):
    """Words longer than what a double's product can hold, against the same sums in exact numbers."""
    from fractions import Fraction

    pieces, lattice, p = small
    rng = random.Random(3)
    word = "▁" + "".join(rng.choice("abé") for _ in range(700))
    got = lattice.forward([word, "▁ab"], p)
    for k in range(2):
        prob = [Fraction(x) for x in p[:, k].tolist()]
        ways = [Fraction(1)] + [Fraction(0)] * len(word)
        for i in range(len(word)):
            for j in range(i + 1, min(len(word), i + 3) + 1):
                if word[i:j] in pieces:
                    ways[j] += ways[i] * prob[pieces.index(word[i:j])]
        log = math.log(ways[-1].numerator) - math.log(ways[-1].denominator)
        assert abs(got[0, k] - log) < 1e-8 * abs(log)


def test_expected_counts_of_long_words(small, monkeypatch):
    pieces, lattice, p = small
    words, lang, n = ["▁abab", "▁baba", "▁aéaba"], np.array([0, 1, 1]), np.array([2, 3, 1])
    want = lattice.expected(words, lang, n, p)
    monkeypatch.setattr(L, "LONG", 2)
    assert np.allclose(lattice.expected(words, lang, n, p), want) and np.allclose(np.exp(lattice.forward(words, p)), np.exp(lattice.forward(words, p)))
    assert abs(lattice.expected(["▁" + "ab" * 400], np.array([0]), np.array([1]), p).sum() - 500) < 300


def test_blocks_of_languages_give_the_same(spark, sf, monkeypatch):
    d, docs, _ = sf
    want = sorted((str(r.doc_id), r.lang_pred, round(r.score, 9)) for r in L.op9_language_id(spark, d).collect())
    monkeypatch.setattr(L, "BLOCK", 2)
    assert sorted((str(r.doc_id), r.lang_pred, round(r.score, 9)) for r in L.op9_language_id(spark, d).collect()) == want


def test_language_query_against_brute_force(spark, sf):
    """Piece probabilities learnt and texts scored again with plain dictionaries."""
    d, docs, _ = sf
    pieces = L.pieces_of(L.VOCABULARY)
    place = {x: i for i, x in enumerate(pieces)}
    known = lambda x: x in place or len(x) == 1
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2
    langs = sorted({g for _, _, g, *_ in docs if g})
    words = {g: collections.Counter("▁" + w for i, t, h, *_ in docs if h == g and not out(i) for w in t.split()) for g in langs}
    size = len(pieces) + 1
    model = {g: collections.defaultdict(lambda: 1 / size) for g in langs}

    def tables(w, p):
        fore, back = [1.0] + [0.0] * len(w), [0.0] * len(w) + [1.0]
        edges = [(i, j, place.get(w[i:j], size - 1)) for i in range(len(w)) for j in range(i + 1, len(w) + 1) if known(w[i:j])]
        for i, j, x in edges:
            fore[j] += fore[i] * p[x]
        for i, j, x in sorted(edges, reverse=True):
            back[i] += p[x] * back[j]
        return fore, back, edges

    for _ in range(L.ROUNDS):
        for g in langs:
            count = collections.defaultdict(float)
            for w, n in words[g].items():
                fore, back, edges = tables(w, model[g])
                for i, j, x in edges:
                    count[x] += n * fore[i] * model[g][x] * back[j] / fore[-1]
            whole = sum(count.values()) + 0.05 * size
            model[g] = collections.defaultdict(lambda z=whole: max(L.FLOOR, 0.05 / z), {x: (c + 0.05) / whole for x, c in count.items()})
    got = {r.doc_id: r for r in L.op9_language_id(spark, d).collect()}
    for i, t, *_ in docs[:160:4]:
        logs = [sum(math.log(tables("▁" + w, model[g])[0][-1]) for w in t.split()) for g in langs]
        best = max(range(len(langs)), key=lambda k: logs[k])
        assert got[i].lang_pred == langs[best] and abs(got[i].score - 1 / sum(math.exp(x - logs[best]) for x in logs)) < 1e-6
