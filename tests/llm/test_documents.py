import random

import numpy as np

from steploom.llm import languages as L
from steploom.llm import leakage as K
from steploom.llm import packing as P


def test_best_fit_and_bound():
    r = np.random.default_rng(2)
    for _ in range(300):
        c = int(r.integers(4, 60))
        sizes = r.integers(1, c + 1, int(r.integers(0, 40)))
        if not len(sizes):
            assert P.lower_bound(sizes, c) == 0
            continue
        b = P.best_fit(sizes, c)
        assert np.bincount(b, weights=sizes).max() <= c and P.lower_bound(sizes, c) <= b.max() + 1
    assert P.lower_bound(np.array([6, 6, 6]), 10) == 3 and P.lower_bound(np.array([4, 4, 4, 4]), 11) == 2


def test_packing_is_whole_and_splits_only_long_texts(spark):
    r = random.Random(4)
    sizes = [(i, r.choice([1, 7, 7, 300, 512, 513, 1500])) for i in range(700)]
    df = spark.createDataFrame(sizes, "doc_id long, tokens long")
    specs = spark.createDataFrame([(1, 512), (2, 64), (3, 0), (None, 5), (4, None), (1, 512)], "spec_id int, capacity_tokens int")
    rows = P.packed(df, specs, per_part=100).collect()
    assert len({(x.spec_id, x.doc_id, x.piece_no) for x in rows}) == len(rows)
    for spec, cap in ((1, 512), (2, 64)):
        total, fill = {}, {}
        for x in (x for x in rows if x.spec_id == spec):
            total[x.doc_id] = total.get(x.doc_id, 0) + x.tokens
            fill[x.container_id] = fill.get(x.container_id, 0) + x.tokens
        assert total == dict(sizes) and max(fill.values()) <= cap
        pieces = {d: sum(1 for x in rows if x.spec_id == spec and x.doc_id == d) for d, _ in sizes[:50]}
        assert all(pieces[d] == -(-t // cap) for d, t in sizes[:50])
    assert {x.spec_id for x in rows} == {1, 2}
    assert P.packed(df.limit(0), specs).count() == 0 and P.packed(df, specs.limit(0)).count() == 0


def test_measuring(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, " \n"), (3, None), (None, "x"), (4, "word " * 40_000)], "doc_id long, text string")
    assert {r.doc_id: r.tokens for r in P.measured(df).collect()} == {1: 2, 4: 40_001}


def _text(r, n):
    return [f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.choice('lmnrst')}{r.randint(0, 60)}x" for _ in range(n)]


def brute(doc, item):
    """Whether 20 or more words of the item in a row stand in the document, by edit distance over every start: a
    stretch begins and ends with a word in common and needs at most one edit in eight of its words."""
    m = len(doc)
    for s in range(len(item) - 19):
        # Edits that turn item[s:i + 1] into words of the document that end with j.
        row = np.array([0 if w == item[s] else 999 for w in doc])
        for j in range(1, m):
            row[j] = min(row[j], row[j - 1] + 1)
        for i in range(s + 1, len(item)):
            same = np.array([w == item[i] for w in doc])
            next_ = row + 1
            next_[1:] = np.minimum(next_[1:], row[:-1] + ~same[1:])
            for j in range(1, m):
                next_[j] = min(next_[j], next_[j - 1] + 1)
            met = np.full(m, 999)
            met[1:] = np.where(same[1:], row[:-1], 999)
            size = i - s + 1
            if size >= 20 and (met * 8 <= size).any():
                return True
            row = next_
    return False


def test_words_ignore_layout():
    want = "the portable probe hands its ticket on".split()
    for t in ("The <b>portable</b> probe, hands its TICKET on.", "// the por-\n// table probe hands\n// its ticket on", "> the port-\n> able probe hands\n* its tic­ket on", "**The** portable `probe` hands its ticket on"):
        assert K.words_of(t) == want, t


def _changed(r, words, places):
    """The words with edits at the places, of which one in three puts a word in, leaves one out or changes one."""
    out = list(words)
    for p in sorted(places, reverse=True):
        kind = r.randrange(3)
        out[p : p + (kind < 2)] = [] if kind == 0 else [f"new{r.randint(0, 999)}"]
    return out


def test_search_against_brute_force(spark):
    r = random.Random(9)
    head = "Read the case below and answer"
    clauses = [_text(r, 9) for _ in range(6)]  # stretches that items and documents share by chance
    bodies = [[*_text(r, 14), *r.choice(clauses), *_text(r, 14), *r.choice(clauses), *_text(r, 10)] for _ in range(12)]
    items = [(i, head + "\n" + " ".join(w)) for i, w in enumerate(bodies)]
    docs = []
    for d in range(90):
        words = [*_text(r, 15), *r.choice(clauses), *_text(r, 10)]
        if d % 3:
            n = r.choice([18, 19, 20, 21, 24, 28, 32, 36, 40, 48])
            a = r.randint(0, len(bodies[0]) - n)
            part = bodies[d % 12][a : a + n]
            k = r.randint(0, n // 8 + 1)
            at = r.randint(1, n - 1 - k)
            # Edits in a row, every second word, or anywhere.
            places = [range(at, at + k), range(1, 2 * k, 2), sorted(r.sample(range(1, n - 1), k))][d % 3 if k < n // 3 else 0]
            words[20:20] = _changed(r, part, [p for p in places if p < n])
        docs.append((d, " ".join(words)))
    docs += [(200, head + " please"), (201, None), (None, items[0][1]), (202, ""), (203, items[1][1]), (204, items[1][1]), (205, "w " * 30_000 + items[2][1])]
    D = spark.createDataFrame(docs, "doc_id long, text string")
    E = spark.createDataFrame([*items, (50, None), (None, "x"), (60, "too short")], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in K.leaks(D, E).collect()}
    want = {(d, i) for d, t in docs if d is not None and d < 205 and t for i, w in enumerate(bodies) if brute(K.words_of(t), w)}
    assert got == want | {(205, 2)} and {(203, 1), (204, 1)} <= got and len(got) > 25
    assert K.leaks(D.limit(0), E).count() == 0 and K.leaks(D, E.limit(0)).count() == 0


def test_index_is_reused_and_whole(spark, monkeypatch):
    r = random.Random(3)
    docs = [(i, " ".join(_text(r, r.randint(0, 60)))) for i in range(60)]
    D = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(K, "SEGMENT_WORDS", 100)
    index = K.built_index(D)
    terms = K.Terms()
    want = {}
    for d, t in docs:
        for p, w in enumerate(K.words_of(t)):
            want.setdefault(terms[w], set()).add((d, p))
    rows = index.collect()
    starts = {x.segment: np.split(np.frombuffer(x.positions, dtype=np.int64), 2) for x in rows if x.term is None}
    got = {}
    for x in (x for x in rows if x.term is not None):
        ids, at = starts[x.segment]
        pos = np.cumsum(K.unpack(np.frombuffer(x.positions, dtype=np.uint8)))
        doc = np.searchsorted(at, pos, side="right") - 1
        assert len(pos) == x.postings and len(set(doc)) == x.docs
        got.setdefault(x.term, set()).update(zip(ids[doc].tolist(), (pos - at[doc]).tolist()))
    assert got == want
    E = spark.createDataFrame([(7, docs[5][1] + " " + docs[6][1])], "item_id long, text string")
    assert {tuple(x) for x in K.leaks(D, E, index).collect()} == {tuple(x) for x in K.leaks(D, E).collect()}


def test_packed_numbers():
    v = np.array([0, 1, 127, 128, 16_383, 16_384, 2_097_151, 2_097_152, 1 << 28, (1 << 35) + 5])
    assert (K.unpack(K.pack(v)[0]) == v).all() and len(K.unpack(np.zeros(0, np.uint8))) == 0


SENTENCES = {
    "en": ["The agent opened the same file again without changing it.", "No one had expected the cache to survive a restart.", "I would rather stop here than try the edit again."],
    "de": ["Der Agent hat dieselbe Datei noch einmal geöffnet.", "Niemand hatte erwartet, dass der Speicher einen Neustart übersteht.", "Wir behalten vorerst das längere Fenster und vergleichen nächste Woche."],
    "es": ["El agente abrió el mismo archivo otra vez sin cambiar nada.", "Nadie esperaba que la memoria sobreviviera a un reinicio.", "De momento dejamos la ventana más larga y luego comparamos."],
}


def test_languages_with_wrong_labels_and_mixed_texts(spark):
    r = random.Random(1)
    text = lambda c, n=4: " ".join(r.choice(SENTENCES[c]) for _ in range(n))
    docs = [(i, text(c), c if r.random() > 0.1 else "en") for i, c in enumerate(["en"] * 60 + ["de"] * 40 + ["es"] * 40)]
    docs += [
        (900, text("de"), "en"), (901, text("es"), None), (902, text("en") + "\n\n" + text("de"), "en"), (903, text("de"), "de-AT"), (904, text("en"), "English"),
        (905, None, "en"), (906, "  ", None), (907, "```\ndef a(b):\n    return 1\n```", "en"), (908, text("es", 4000), "Spanish"), (909, text("en"), "??"), (None, text("de"), "en"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = L.fit_on(df)
    got = {tuple(x) for x in L.issues(L.classified(df, model)).where("doc_id >= 900").collect()}
    assert got == {(900, "wrong", "de"), (901, "missing", "es"), (902, "mixed", "de"), (902, "mixed", "en"), (909, "missing", "en")}
    assert L.classified(df, model).count() == len(docs)
    empty = df.limit(0)
    assert L.issues(L.classified(empty, L.fit_on(empty))).count() == 0


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    x = L.classified(docs, L.fit_on(docs)).where("label_code IN ('en', 'de', 'fr', 'es') AND lang_found IS NOT NULL")
    assert x.where("label_code = lang_found").count() >= 0.85 * x.count()


def test_other_languages_are_rejected(spark, data):
    # The smallest tables have too few sentences for a distance.
    model = L.fit_on(spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet"))
    for t in (
        "Agent ponownie otworzył ten sam plik, ale nic nie zmienił.", "Agenten öppnade samma fil igen utan att ändra något.", "Ajan aynı dosyayı tekrar açtı ama hiçbir şeyi değiştirmedi.",
        "代理再次打开了同一个文件，但没有做任何更改。", "Agentti avasi saman tiedoston uudelleen muuttamatta mitään.",
    ):
        assert not model.classify([t])[0][2], t
    near, far = (model.classify([t])[0] for t in ("The agent opened the same file twice without changing a line.", "The weather in the mountains was cold yesterday and we stayed at home."))
    assert near[0] == far[0] == "en" and near[1] > far[1] and near[2]


def test_words_are_worked_out_alike_with_and_without_memory(monkeypatch):
    r = random.Random(2)
    model = L.fit([(c, s) for c, ss in SENTENCES.items() for s in ss])
    texts = [[r.choice(SENTENCES["de"]).split()[0].lower(), f"w{i}x", "もう一度"] * r.randint(0, 3) for i in range(60)]
    want = model.cosines(texts)
    monkeypatch.setattr(L, "MEMO_WORDS", 3)
    model.memory = None
    assert np.allclose(np.concatenate([model.cosines(texts[i : i + 7]) for i in range(0, 60, 7)]), want, atol=1e-6)
    # Against the definition: counts times idf, products over norms.
    for words, got in list(zip(texts, want))[:20]:
        v = np.zeros(L.BUCKETS)
        for w in words:
            np.add.at(v, L.grams([w])[0], 1)
        v *= model.idf
        assert np.allclose(got, v @ model.centroids / max(np.linalg.norm(v), 1e-9), atol=1e-5)


def test_rejects_what_no_centroid_is_near():
    model = L.fit([(c, s) for c, ss in SENTENCES.items() for s in ss])
    assert not model.classify(["qqq zzxx wvvk kkqz xxjj qwwz zzkq"])[0][2]
    assert L.fit([]).classify(["anything"]) == [(None, 0.0, False)]
