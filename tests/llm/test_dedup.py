import random

import brute
import numpy as np
import pyarrow as pa

import culvert.llm.ngram_join as ngram_join_module
import culvert.llm.substring_dedup as substring_dedup_module
import culvert.llm.suffix_dedup as suffix_dedup_module
from culvert.llm import exchange
from culvert.llm.exact_dedup import exact_dedup
from culvert.llm.ngram_join import ngram_jaccard_components, ngram_jaccard_links
from culvert.llm.passages import Texts
from culvert.llm.substring_dedup import substring_dedup
from culvert.llm.suffix_dedup import suffix_dedup

SCHEMA = "doc_id bigint, text string, set_id int, codes string, kept boolean"


def corpus(n, seed, vocabulary=60):
    """Random texts with copies, near copies, shared passages, empty and null texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("ab") + str(rng.randrange(vocabulary)) + rng.choice(["", ".", "é"])
    passages = [[word() for _ in range(rng.randrange(12, 70))] for _ in range(6)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.4:
            own = (rng.choice(texts) or "").split(" ")
            for _ in range(rng.randrange(1, 4)):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
        elif kind < 0.45:
            texts.append(rng.choice([None, "", " \t\n", "Só", "a b c"]))
        else:
            own = [word() for _ in range(rng.randrange(0, 90))]
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(own) + 1)
                own[at:at] = rng.choice(passages)
            texts.append(rng.choice([" ", "  ", "\n"]).join(own))
    ids = rng.sample(range(10 * n), n)
    return list(zip(ids, texts, strict=True))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", True) for i, t in rows], SCHEMA).repartition(5)


def test_substring_dedup(spark):
    for width, seed in ((13, 1), (4, 2), (1, 3)):
        rows = corpus(150, seed)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(frame(spark, rows), width).collect()}
        assert got == brute.substring_dedup(rows, width)


def test_substring_dedup_edges(spark):
    same = " ".join(map(str, range(20)))
    rows = [(None, same), (3, same), (3, same), (7, same), (8, None)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup(frame(spark, rows)).collect())
    assert got == [(False, 3, 20, 0), (False, 3, 20, 0), (False, 7, 20, 20), (False, 8, 0, 0), (True, 0, 20, 20)]
    assert substring_dedup(frame(spark, [])).count() == 0


def test_substring_dedup_long(spark):
    """Texts of 200,000 words, and one whose words are all the same."""
    rng = random.Random(21)
    long = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[150_000:] + ["own"] * 5)), (3, "same " * 20_000), (4, "same " * 13), (5, "same " * 12)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup(frame(spark, rows)).collect()}
    assert got == {1: (200_000, 0), 2: (50_005, 50_000), 3: (20_000, 0), 4: (13, 13), 5: (12, 0)}


def test_suffix_dedup_tells_words_of_one_code(spark):
    """Two documents that differ in three words, of which the codes for the order are the same: no run of 50
    words is common to them."""
    base = [f"w{k}" for k in range(1000, 1120)]
    other = list(base)
    for at in (20, 60, 100):
        base[at], other[at] = "w220", "w280"
    rows = [(1, " ".join(base)), (2, " ".join(other))]
    got = {r.doc_id: r.n_removed for r in suffix_dedup(frame(spark, rows), 50).collect()}
    assert got == {1: 0, 2: 0} == {i: n for i, (_, n, _) in brute.substring_dedup(rows, 50).items()}


def test_late_runs_of_equal_letters():
    """Edits of one word in 10,000 passages whose letters are all the same: the runs' codes tell them apart."""
    rng = random.Random(31)
    width, left = 12, 12 - suffix_dedup_module.prefix_for(12)
    passage = [f"p{k}" for k in range(24)]
    texts = []
    for _ in range(10_000):
        own = list(passage)
        own[rng.randrange(len(own))] = f"e{rng.randrange(3000)}"
        texts.append(own)
    batch = Texts(pa.array(range(len(texts))), pa.array([" ".join(t) for t in texts]))
    letters = np.full(len(batch.codes), 7, np.uint16)
    places = batch.bounds[:-1] + left  # a suffix in the same place of each
    words = suffix_dedup_module._around(letters, batch.bounds, places, left, width)
    runs = suffix_dedup_module._runs(batch, places, width, left)
    assert (suffix_dedup_module._as_runs(suffix_dedup_module._run_cells(runs)) == runs).all()
    late = suffix_dedup_module.late_runs(words, runs, batch.ids, width)
    for k in range(left + 1):
        seen, expected = {}, []
        for own in texts:
            run = tuple(own[left - k : left - k + width])
            expected.append(run in seen)
            seen[run] = True
        assert late[:, k].tolist() == expected, k


def test_suffix_dedup_with_colliding_letters(spark):
    """Copies whose edits put words in each other's place that share the code for the order."""
    names = [f"w{k}" for k in range(60_000)]
    codes = Texts(pa.array([1]), pa.array([" ".join(names)])).codes >> np.uint64(48)
    order = np.argsort(codes, kind="stable")
    same = [order[i : i + 2] for i in range(len(order) - 1) if codes[order[i]] == codes[order[i + 1]]][:40]
    pairs = [(names[a], names[b]) for a, b in same]
    assert len(pairs) == 40
    rng = random.Random(8)
    passage = [rng.choice(pairs)[0] for _ in range(70)]
    swap = dict(pairs) | {b: a for a, b in pairs}
    rows = []
    for i in range(120):
        own = list(passage)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(own))
            own[at] = swap[own[at]]
        rows.append((i, " ".join(own)))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in suffix_dedup(frame(spark, rows), 30).collect()}
    assert got == brute.substring_dedup(rows, 30)


def test_substring_dedup_dealt_twice(spark, monkeypatch):
    """Small chunks and buckets, more of them than bands: entries are dealt in two steps, and a sender makes no more rows than bands."""
    for module in (substring_dedup_module, suffix_dedup_module):
        monkeypatch.setattr(module, "CHUNK_BYTES", 600)
        monkeypatch.setattr(module, "BUCKET_BYTES", 500)
    monkeypatch.setattr(exchange, "FANOUT", 6)
    rows = corpus(150, 7)
    rows += [(10_000 + k, rows[k][1]) for k in range(10)]
    size = sum(len((t or "").encode()) for _, t in rows)
    sent = []
    monkeypatch.setattr(substring_dedup_module, "dealt", lambda df, to, *kinds: sent.append((df, to)) or exchange.dealt(df, to, *kinds))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(frame(spark, rows)).collect()}
    assert got == brute.substring_dedup(rows, 13)
    chunks = size // 600 + 1 | 1
    assert min(to.width for _, to in sent) > 5 and sent[0][0].count() <= 6 * chunks
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in suffix_dedup(frame(spark, rows), 20).collect()}
    assert got == brute.substring_dedup(rows, 20)


def test_exact_dedup(spark):
    rows = corpus(200, 4)
    for table_bytes in (1 << 20, 2_000):  # the second one spills, more than once
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(frame(spark, rows), table_bytes).collect()}
        assert got == brute.exact_dedup(rows)
    assert exact_dedup(frame(spark, [])).count() == 0
    ties = exact_dedup(frame(spark, [(None, "a"), (5, "a"), (5, "a"), (4, " a")])).collect()
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in ties) == [(0, 4, 4, False), (4, 4, 4, True), (5, 4, 4, False), (5, 4, 4, False)]


def test_jaccard_components(spark):
    for crowd, seed in ((24, 5), (3, 6)):
        rows = corpus(150, seed)
        found = ngram_jaccard_components(frame(spark, rows), crowd=crowd, count_bits=10).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.jaccard_components(rows)


def test_jaccard_edges(spark):
    assert ngram_jaccard_components(frame(spark, []), count_bits=10).count() == 0
    rows = [(None, "A b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, None), (10, " "), (11, "a b"), (12, "A B")]
    found = ngram_jaccard_components(frame(spark, rows), count_bits=10).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in found) == [(0, 2, 4), (4, 2, 4), (4, 2, 4), (9, 0, 9), (10, 0, 10), (11, 1, 11), (12, 1, 11)]


def test_jaccard_families(spark):
    """Families of copies with few to many edits: more pairs nearly link than do."""
    rng = random.Random(9)
    rows = []
    for family in range(3):
        base = [f"f{family}w{k}" for k in range(rng.randrange(40, 160))]
        for _ in range(60):
            own = base[rng.randrange(20) :] if rng.random() < 0.3 else list(base)
            for _ in range(rng.randrange(0, 9)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    for crowd in (4, 24, 1000):
        found = ngram_jaccard_components(frame(spark, rows), crowd=crowd, count_bits=12).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.jaccard_components(rows)


def test_jaccard_large_family(spark, monkeypatch):
    """2,000 texts of one template that share just too little to link, some that do, and copies: no
    pair of them is written to be verified but for a few each."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(90)]
    rows = []
    for k in range(2000):
        own = list(base)
        for _ in range(3 if k % 10 else 1):
            own[rng.randrange(90)] = f"e{rng.randrange(10**9)}"
        rows.append((k, " ".join(own)))
    rows += [(5000 + k, rows[7 * k][1]) for k in range(200)]
    asked = []
    verify = ngram_join_module._verify
    monkeypatch.setattr(ngram_join_module, "_verify", lambda pairs, sets, percent: asked.append(pairs.count()) or verify(pairs, sets, percent))
    found = ngram_jaccard_components(frame(spark, rows), count_bits=14).collect()
    # Brute force on bits of the n-grams.
    code, sets = {}, []
    for _, t in rows[:2000]:
        w = t.split()
        sets.append(sorted({code.setdefault(tuple(w[k : k + 5]), len(code)) for k in range(86)}))
    has = np.zeros((2000, len(code)), np.float32)
    for k, s in enumerate(sets):
        has[k, s] = 1
    both, n = has @ has.T, has.sum(axis=1)
    link = 100 * both >= 75 * (n[:, None] + n - both)
    assert 20 < link.sum() < 0.2 * link.size
    want = np.arange(2000)
    while True:
        new = np.where(link, want[None, :], 9999).min(axis=1)
        if (new == want).all():
            break
        want = new
    assert {r.doc_id: r.component_id for r in found if r.doc_id < 2000} == dict(enumerate(want.tolist()))
    assert {r.doc_id: r.component_id for r in found if r.doc_id >= 5000} == {5000 + k: int(want[7 * k]) for k in range(200)}
    assert sum(asked) < 10 * len(rows)


def test_jaccard_spread(spark, monkeypatch):
    """Small lists, fragments, blocks and salts: the same components."""
    monkeypatch.setattr(ngram_join_module, "FRAGMENT_BYTES", 700)
    monkeypatch.setattr(ngram_join_module, "FEW_BLOCK", 3)
    monkeypatch.setattr(ngram_join_module, "HUB_SLICE", 7)
    monkeypatch.setattr(exchange, "FANOUT", 5)
    monkeypatch.setattr(exchange, "_WARM", 2)
    rows = corpus(150, 8)
    rng = random.Random(9)
    base = [f"f{k}" for k in range(70)]
    for k in range(60):
        own = list(base)
        for _ in range(rng.randrange(0, 7)):
            own[rng.randrange(70)] = f"e{rng.randrange(10**6)}"
        rows.append((20_000 + k, " ".join(own)))
    for crowd in (2, 6):
        found = ngram_jaccard_components(frame(spark, rows), crowd=crowd, count_bits=10).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute.jaccard_components(rows)


def test_jaccard_links(spark):
    """All links between different sets, and their number by document, against brute force."""
    rows = corpus(120, 10)
    rng = random.Random(11)
    base = [f"f{k}" for k in range(60)]
    for k in range(40):
        own = list(base)
        for _ in range(rng.randrange(0, 2)):
            own[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        rows.append((20_000 + k, " ".join(own)))
    rows += [(None, rows[5][1]), (None, None), (30_000, rows[-1][1].upper())]
    found = ngram_jaccard_links(frame(spark, rows), crowd=4, count_bits=10)

    def grams(t):
        w = brute.SPACED.findall(brute.lower(t))
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    first = {}
    for i, t in rows:
        g = grams(t)
        if g:
            first[g] = i if first.get(g) is None else min(first[g], i if i is not None else first[g])
    sets = list(first)
    want = {frozenset((first[a], first[b])) for k, a in enumerate(sets) for b in sets[:k] if 100 * len(a & b) >= 75 * len(a | b)}
    got = [frozenset((r.a, r.b)) for r in found.pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30
    degree = {c: sum(c in p for p in want) for c in first.values()}
    shown = sorted(((r.doc_id, r.class_id, r.n_links) for r in found.members.collect()), key=repr)
    assert shown == sorted([(i, first[grams(t)], degree[first[grams(t)]]) if grams(t) else (i, i, 0) for i, t in rows], key=repr)
    empty = ngram_jaccard_links(frame(spark, []), count_bits=10)
    assert empty.pairs.count() == 0 and empty.members.count() == 0
