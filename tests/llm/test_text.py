import random
import re
import zlib

import brute
import numpy as np
import pytest

import culvert.llm.decontaminate as decontaminate_module
from culvert.llm import language, quality
from culvert.llm import words as wd
from culvert.llm import queries as q

from culvert.llm.decontaminate import decontaminate, index_of, intersections, matched, rarest_of, term_counts, windows_of
from culvert.llm.license_scan import BASE, MAX_GAP, MIN_RUN, MIN_SHARE, TEMPLATES, license_scan
from culvert.llm.line_dedup import HTML_LINES, line_dedup
from culvert.llm.packing import pack, sequences
from culvert.llm.suffix_dedup import suffix_dedup, suffix_order
from test_dedup import corpus, frame
from pyspark.sql import functions as F


def test_suffix_dedup(spark):
    for width, seed in ((50, 11), (12, 12), (2, 13), (1, 14)):
        rows = corpus(120, seed)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in suffix_dedup(frame(spark, rows), width).collect()}
        assert got == brute.substring_dedup(rows, width)
    assert suffix_dedup(frame(spark, [])).count() == 0


def test_suffix_dedup_long(spark):
    """Matches longer than the width, at the ends of texts, inside one document, and a very long text."""
    rng = random.Random(2)
    run = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    own, edge, far = run(300), run(50), run(49)
    rows = [(1, own + run(10)), (2, run(7) + own[20:280]), (3, own[100:149] + run(5)), (4, edge), (5, run(3) + edge), (6, edge + run(3)), (7, far), (8, far + run(2)), (9, own[:60] + own[:60]), (10, run(200_000) + own)]
    rows = [(k, " ".join(w)) for k, w in rows] + [(None, " ".join(own)), (2, " ".join(own)), (11, None), (12, "")]
    got = suffix_dedup(frame(spark, rows)).collect()
    removed = sorted((r.doc_id if r.doc_id is not None else 99, r.n_removed) for r in got)
    assert removed == [(1, 0), (2, 260), (2, 300), (3, 0), (4, 0), (5, 50), (6, 50), (7, 0), (8, 0), (9, 120), (10, 300), (11, 0), (12, 0), (99, 300)]


def test_suffix_order():
    rng = np.random.default_rng(1)
    words = rng.integers(1, 4, (80, 6)).astype(np.uint16)
    words[:20, 4:] = 0
    order, shared = suffix_order(words)
    rows = [tuple(x) for x in words.tolist()]
    assert [rows[k] for k in order] == sorted(rows)
    assert all((shared[i] == 6) == (rows[order[i]] == rows[order[i - 1]]) for i in range(1, 80)) and rows[order[5]][: shared[5]] == rows[order[4]][: shared[5]]


def test_decontaminate(spark):
    rows = corpus(120, 21, vocabulary=9)
    rng = random.Random(3)
    items = [(k, " ".join((rng.choice(rows)[1] or "").split()[5 : 5 + rng.randrange(1, 30)]).upper()) for k in range(40)]
    items += [(3, "A1. b2"), (77, None), (78, "..."), (None, "É a1")]
    rows += [(9001, "é A1"), (9002, None), (9003, ""), (9004, "É\x00a1,x")]
    got = decontaminate(frame(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    named = [("" if i is None else i, t) for i, t in items]
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == brute.decontaminate(rows, named)
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate(frame(spark, rows), none).filter("contaminated or n_hit > 0").count() == 0
    assert decontaminate(frame(spark, []), none).count() == 0
    twice = decontaminate(frame(spark, [(None, "a b"), (1, "a b"), (1, "a b")]), spark.createDataFrame([(5, "b")], "item_id bigint, text string"))
    assert sorted((r.doc_id or 0, r.n_hit, r.n_items) for r in twice.collect()) == [(0, 1, 1), (1, 1, 1), (1, 1, 1)]


def test_positional_index(spark):
    """Lists of the two rarest terms, moved by their offsets and intersected."""
    docs = spark.createDataFrame([(1, 0, "x the rare of y. The rare of"), (2, 0, "of the rare"), (3, 0, "rare x y z w of the"), (4, 0, ".the the rare; of")], "id bigint, mark bigint, text string")
    windows = windows_of(spark.createDataFrame([(9, "the rare of"), (8, "never seen the")], "item_id bigint, text string"), 3)
    rarest = rarest_of(windows, term_counts(docs, windows))
    assert [(r.offset, r.second_offset, r.words) for r in rarest.collect()] == [(1, 2, ["the", "rare", "of"])]
    index = index_of(docs, rarest.select(F.explode(F.array("term", "second")).alias("term")))
    rare = rarest.first().term
    assert {r.id: r.places for r in index.filter(F.col("term") == rare).collect()} == {1: [2, 6], 2: [2], 3: [0], 4: [2]}
    met = {r.id: (r.starts, r.close) for r in intersections(index, rarest).collect()}
    assert met == {1: ([1, 5], [2, 6]), 2: ([], [2]), 4: ([1], [2])}
    found = {r.id: (r.n_words, r.n_hit, len(r.codes), len(r.near_codes)) for r in matched(docs, intersections(index, rarest)).collect()}
    assert found == {1: (8, 6, 1, 1), 2: (3, 0, 0, 1), 3: (7, 0, 0, 0), 4: (4, 3, 1, 1)}


def test_decontaminate_parts(spark, monkeypatch):
    """Terms and windows in many parts, and texts of 20,000 words: the same results."""
    monkeypatch.setattr(decontaminate_module, "BROADCAST_TERMS", 40)
    monkeypatch.setattr(decontaminate_module, "BROADCAST_WINDOWS", 25)
    rng = random.Random(5)
    rows = corpus(60, 22, vocabulary=9)
    long = [f"{rng.choice('ab')}{rng.randrange(12)}" for _ in range(20_000)]
    rows += [(8000, " ".join(long)), (8001, " ".join(long[:9000] + ["b2"] * 3000)), (8002, "b2 " * 20_000)]
    items = [(k, " ".join((rng.choice(rows[:60])[1] or "").split()[5:22])) for k in range(12)] + [(50, "b2"), (51, " ".join(long[19_000:19_015])), (52, "b2 " * 10)]
    docs = frame(spark, rows).withColumns({c: F.lit(7) for c in ("id", "mark", "items", "term", "words")})
    got = decontaminate(docs, spark.createDataFrame(items, "item_id bigint, text string"), near=False).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == brute.decontaminate(rows, items)


def test_decontaminate_near(spark):
    """Words of a window that are reordered, or have one word put in between, are found near."""
    def counted(words):
        return {w: words.count(w) for w in words}

    def near(t, item):  # from the definition, without an index
        w, own = brute.ALNUM.findall(brute.lower(t)), brute.ALNUM.findall(brute.lower(item))
        for k in range(max(1, len(own) - 3) if own else 0):
            window = own[k : k + 4]
            for s in range(len(w)):
                span = w[s : s + len(window) + 1]
                if all(span.count(x) >= n for x, n in counted(window).items()):
                    return True
        return False

    rng = random.Random(9)
    word = lambda: rng.choice("abcdefghijkl")
    rows = [(k, " ".join(word() for _ in range(rng.randrange(25)))) for k in range(150)]
    rows += [(900, "one four THREE, two"), (901, "one two x three four"), (902, "one two x y three four"), (903, "one two three four"), (904, "x one x"), (905, "p q p r"), (906, None), (None, "four three two one")]
    items = [(k, " ".join(word() for _ in range(rng.randrange(1, 9)))) for k in range(20)] + [(90, "One two three four"), (91, "p p q"), (92, None)]
    found = decontaminate(frame(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"), width=4)
    got = {r.doc_id: r for r in found.collect()}
    want = {i: sorted(str(k) for k, t in items if near(text or "", t or "")) for i, text in rows}
    assert {i: r.near_items for i, r in got.items()} == want and all(r.n_near_items == len(r.near_items) for r in got.values())
    assert all(set(r.items) <= set(r.near_items) for r in got.values())
    assert [i for i in (900, 901, 902, 903, None) if "90" in got[i].near_items] == [900, 901, 903, None] and got[900].n_hit == 0
    assert "91" in got[905].near_items and not got[905].contaminated
    assert sum(r.n_near_items > r.n_items for r in got.values()) > 5


def test_line_dedup(spark):
    rng = random.Random(5)
    lines = [f"line {k}" for k in range(30)]
    rows = [(k, rng.choice(["a", "b", "c", None]), "<p>".join(rng.choice(lines[:6] if rng.random() < 0.7 else lines) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(12)))) for k in range(80)]
    rows += [(900, "lonely", "x<br>y"), (901, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, h string, html string").withColumn("drop", F.lit(1))
    got = {r.page_id: (r.n_lines, r.n_dropped, r.kept_text.split("\n") if r.kept_text else []) for r in line_dedup(pages, F.col("h"), "html", HTML_LINES).collect()}
    assert got == brute.line_dedup([(p, h or "", t) for p, h, t in rows], re.compile(HTML_LINES), 0.3, 3)
    assert sum(x[1] for x in got.values()) > 0
    assert line_dedup(pages.limit(0), F.col("h"), "html").count() == 0


def test_line_dedup_shuffled(spark, monkeypatch):
    """A list too long to broadcast, repeated rows, a very long page, and columns named as results are."""
    import culvert.llm.line_dedup as module

    monkeypatch.setattr(module, "BROADCAST_ROWS", 3)
    rows = [(k, "a", "\n".join(["top", f"own {k}", f"part {k % 3}", "end"])) for k in range(9)] + [(3, "a", "top\nown 3\npart 0\nend"), (50, "a", "\n".join(f"line {k}" for k in range(50_000))), (None, None, "top")]
    pages = spark.createDataFrame(rows, "page_id bigint, h string, html string").withColumns({c: F.lit("x") for c in ("host", "n_lines", "kept_text", "line")})
    found = line_dedup(pages, F.col("h"), "html").collect()
    assert len(found) == len(rows) and {r.line for r in found} == {"x"}
    got = sorted((r.page_id if r.page_id is not None else -1, r.n_lines, r.n_dropped) for r in found)
    # Of 11 pages more than 0.3 have a line if 4 do: top and end, and the part that the repeated row is of.
    assert got == sorted([(-1, 1, 0), (50, 50_000, 0), (3, 4, 3), *[(k, 4, 3 if k % 3 == 0 else 2) for k in range(9)]])


def test_line_dedup_keeps_all_columns(spark):
    """Columns with the names of working columns, of other columns' results in other cases, and with odd names."""
    names = ["page", "lines", "drop", "kept", "line", "__host", "__drop", "__lines", "__kept", "pages", "n", "a.b", "c`d"]
    rows = [(k, "h", f"top\nown {k}") for k in range(5)]
    pages = spark.createDataFrame(rows, "page_id bigint, h string, html string").withColumns({c: F.lit(f"<{c}>") for c in names}).withColumn("HOST", F.lit("old"))
    found = line_dedup(pages, F.col("h"), "html")
    assert found.columns == ["page_id", "h", *names, "host", "n_lines", "n_dropped", "kept_text"]
    assert {tuple(r)[2:15] for r in found.collect()} == {tuple(f"<{c}>" for c in names)}
    assert sorted((r.page_id, r.host, r.n_lines, r.n_dropped, r.kept_text) for r in found.collect()) == [(k, "h", 2, 1, f"own {k}") for k in range(5)]
    assert line_dedup(pages.select("html"), F.lit("x"), "html").columns == ["host", "n_lines", "n_dropped", "kept_text"]


def test_license_scan(spark):
    rng = random.Random(6)
    fill = ["the", "of", "license", "MIT", "mit", "apache", "general", "public", "under", "wörter", "any", "software"]
    rows = [(k, " ".join(rng.choice(fill) for _ in range(rng.randrange(40)))) for k in range(150)]
    rows += [(900, "foo " + TEMPLATES["bsd"][0].upper() + " bar"), (901, None), (902, "Redistribution and use"), (903, "mit\x00LICENSE"), (904, TEMPLATES["mit"][1].replace("sublicense", "lend"))]
    got = {r.doc_id: r for r in license_scan(frame(spark, rows)).collect()}
    for i, t in rows:
        w = brute.ALNUM.findall(brute.lower(t))
        places = sorted((k, label) for p, label in BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not places
        assert 0 <= r.score <= 1
    assert (got[900].labels, got[900].score, got[900].spans[0].first_word) == ("bsd", 1.0, 1)
    assert got[901].n_words == 0 and got[901].labels == "" and got[902].labels == ""
    assert "mit" in got[904].labels and got[904].spans[0].last_word == got[904].n_words - 1
    assert license_scan(frame(spark, [])).count() == 0


def test_license_templates(spark):
    """Own labels and scores against the definition: template words with gaps, repeats, other words and turns."""
    rng = random.Random(16)
    templates = {"a": ["one two three four five six seven eight nine ten", "one two three one two three one two three end"], "b": ["five six seven eight one two three", "mit license text here"], "c": ["x y z x y z x y z x y z"]}
    base = {"mit license": "mit"}
    flat = [brute.ALNUM.findall(t) for texts in templates.values() for t in texts]
    rows = []
    for k in range(200):
        own = []
        for _ in range(rng.randrange(1, 9)):
            s = rng.choice(flat)
            i = rng.randrange(len(s))
            own += s[i : i + rng.randrange(1, 9)] + ["q"] * rng.choice([0, 0, 1, 3, 11, 12, 14])
        rows.append((k, " ".join(own)))
    rows += [(900, " ".join(["one two three"] * 40)), (901, " ".join(["x y z"] * 60)), (902, None), (903, "q " * 5000 + "one two three four five six seven eight nine ten"), (None, "mit license"), (0, rows[0][1])]
    got = [(r.doc_id, r.labels, round(r.score, 9)) for r in license_scan(frame(spark, rows).withColumn("spans", F.lit(1)), templates, base).collect()]
    want = [(i, *brute.license_scan(t, templates, base, MIN_RUN, MAX_GAP, MIN_SHARE)) for i, t in rows]
    assert sorted(got, key=repr) == sorted([(i, labels, round(x, 9)) for i, labels, x in want], key=repr)
    assert len({labels for _, labels, _ in want}) > 4


def test_packing_long_words(spark, monkeypatch):
    """Long and many distinct words: a worker's memory of words is bounded by bytes, and the ids are the same."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from culvert.llm import packing

    monkeypatch.setattr(packing, "MEMORY_BYTES", 20_000)
    tokenizer = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdexyz_-é", k=rng.choice([3, 8, 60, 3000]))) for _ in range(60)) for _ in range(20)] + ["z" * 1_000_000, ""]
    ids = list(tokenizer.encode([t.encode() for t in texts], 2))
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [[*tokenizer.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    remembered = [*tokenizer.known, *tokenizer.old]
    assert remembered and max(map(len, remembered)) <= packing.MEMORY_WORD and sum(map(len, remembered)) < 60_000
    rows = [(None, "a b"), (None, "a b"), (1, "A b"), (1, "A b")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, ids int, part int")
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len(pieces) == 4 and len({p.ids_crc32 for p in pieces}) == 1


def test_packing(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = corpus(60, 31) + [(9001, "İstanbul don't IT'S Σας 日本"), (9002, None), (9003, "x" * 40_000)]
    pieces = pack(frame(spark, rows), path, window=512).collect()
    whole = Tokenizer.from_file(path)
    want = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
        assert zlib.crc32(p.ids) == p.ids_crc32 and p.doc_tokens == len(want[p.doc_id])
    for i, own in by_doc.items():
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == list(np.cumsum([0] + [p.length for p in own[:-1]]))
        assert np.frombuffer(b"".join(p.ids for p in own), "<u4").tolist() == want[i]
    sizes = []
    for own in by_sequence.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0] + [n for _, n in own[:-1]]))
        sizes.append(sum(n for _, n in own))
    assert sorted(by_doc) == sorted(want) and max(sizes) <= 512 and sum(s < 512 for s in sizes) <= 1
    assert pack(frame(spark, []), path).count() == 0
    joined = sequences(pack(frame(spark, rows), path, window=512)).collect()
    assert sum(r.n_ids for r in joined) == sum(map(len, want.values())) and all(len(r.ids) == 4 * r.n_ids for r in joined)


def _held_out(i, parts):
    return zlib.crc32(str(i).encode()) % parts


def test_quality(spark):
    rng = random.Random(7)
    good = lambda: " ".join(rng.choice("the of and river moves along green banks slowly".split()) + rng.choice(["", "", "."]) for _ in range(rng.randrange(20, 60)))
    bad = lambda: " ".join(f"w{rng.randrange(99)}" + rng.choice(["$$", "!!", "%%"]) for _ in range(rng.randrange(20, 60)))
    rows, labels = [], []
    for k in range(300):
        y = int(rng.random() < 0.8)
        rows.append((k, good() if y else bad()))
        labels.append((k, y, 0))
    rows += [(900, None), (901, ""), (None, "the river")]
    labels += [(None, 1, 0), (5, None, 1)]
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    out = quality.held_out("doc_id", 5, 0)
    weights = quality.fit(docs.filter(~out), marks)
    got = {r.doc_id: r.score for r in quality.score(docs, weights).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert {r.doc_id for r in docs.filter(out).collect() if r.doc_id is not None} == {i for i, _ in rows if i is not None and _held_out(i, 5) == 0}
    right = [(got[k] >= 0.5) == bool(y) for k, y, _ in labels[:300] if _held_out(k, 5) == 0]
    assert sum(right) >= 0.95 * len(right)
    assert {r.score for r in quality.score(docs, quality.fit(docs.limit(0), marks)).collect()} == {0.5}
    bounded = quality.fit(docs, marks, max_labelled=50)
    assert quality.score(docs.limit(0), bounded).count() == 0


def test_quality_dense(spark):
    """Weights and scores against plain loops over dense vectors."""
    rng = random.Random(17)
    word = lambda: rng.choice(["a", "b", "c", "de", "É1", "!!", "x."])
    rows = [(k, " ".join(word() for _ in range(rng.randrange(30)))) for k in range(60)] + [(60, None), (61, ""), (62, "a " * 3000), (None, "a b"), (3, "a b"), (3, "a b")]
    labels = [(k, k % 3 % 2, 0) for k in range(63)] + [(5, 1, 0), (None, 0, 0), (7, 2, 0)]
    bits = 8

    def features(text):
        w = re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+|[^\sA-Za-z0-9\u0080-\U0010ffff]+", text or "")
        raw = [x.encode() for x in w]
        at = np.cumsum([0] + [len(x) for x in raw])
        codes = wd.word_codes(np.frombuffer(b"".join(raw), np.uint8), at[:-1], at[1:])
        out = [int(wd.window_codes(codes[k : k + n], n)[0] >> np.uint64(64 - bits)) for n in (1, 2) for k in range(len(w) - n + 1)]
        out += [(1 << bits) + d - 1 for d in (1, 2) for k in range(d, len(w)) if w[k] == w[k - d] and re.match(r"[A-Za-z0-9\u0080-\U0010ffff]", w[k])]
        x = np.zeros((1 << bits) + 3)
        np.add.at(x, out, 8.0 / max(1, len(out)))
        x[-1] = 1.0
        return x

    docs = frame(spark, rows).withColumn("score", F.lit("old"))
    weights = quality.fit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), bits=bits)
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, []).append(t)
    examples = sorted([(i, y, t) for i, y, _ in labels if i is not None and y in (0, 1) for t in by_id[i]], key=lambda e: e[:2])
    shard = {r.i: r.s for r in spark.createDataFrame([(i,) for i in range(63)], "i bigint").select("i", F.pmod(F.xxhash64("i", F.lit(1)), F.lit(4)).alias("s")).collect()}
    want = np.zeros((1 << bits) + 3)
    for s in range(4):
        own = [(features(t), y) for i, y, t in examples if shard[i] == s]
        z, n = np.zeros(len(want)), np.zeros(len(want))
        solved = lambda z, n: -np.sign(z) * np.maximum(np.abs(z) - 0.0005, 0) / ((1 + np.sqrt(n)) / 0.3 + 0.001)
        for epoch in range(4):
            for k in np.random.default_rng(epoch).permutation(len(own)):
                x, y = own[k]
                w = solved(z, n) * (x > 0)
                g = (1 / (1 + np.exp(-(w @ x))) - y) * x
                z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / 0.3 * w
                n += g * g
        want += len(own) * solved(z, n) / len(examples)
    assert np.allclose(weights, want, atol=1e-9)
    for r in quality.score(docs, weights).collect():
        assert abs(r.score - 1 / (1 + np.exp(-(features(r.text) @ weights)))) < 1e-9


def test_language_dense(spark):
    """Frequencies, centroids and cosines against plain loops."""
    rng = random.Random(18)
    words = {"en": "the and of with that", "fr": "le la les dans être où", "de": "der die und für über"}
    rows = [(k if k % 9 else None, " ".join(rng.choice(words[lang].split()) for _ in range(rng.randrange(1, 20))), lang) for k in range(90) for lang in [rng.choice(list(words))]]
    rows += [(5, "the and", "en"), (5, "the and", "en"), (900, None, "en"), (901, "1 2", "de"), (902, "le " * 4000, "fr"), (903, "the und le", None)]
    docs = spark.createDataFrame([(*r, 1.0, True) for r in rows], "doc_id bigint, text string, lang string, score double, rejected boolean").repartition(3)
    cells = 64
    model = language.fit(docs, cells=cells, centroids=2)

    def counted(text):
        out, raw = [0] * cells, list((text or "").lower().encode())
        letter = lambda k: raw[k] if 0 <= k < len(raw) and (97 <= raw[k] <= 122 or raw[k] >= 128) else 0
        for k in range(len(raw)):
            if letter(k):
                code = (letter(k - 1) << 16) + (letter(k) << 8) + letter(k + 1)
                out[(code * 0x9E3779B1 % 2**32) >> (32 - 6)] += 1
        return np.array(out, float)

    learned = [(t, lang) for _, t, lang in rows if t is not None and lang is not None]
    df = sum((counted(t) > 0).astype(int) for t, _ in learned)
    idf = np.log((1 + len(learned)) / (1 + df)) + 0.1
    assert np.allclose(model.idf, idf)
    unit = lambda x: x / max(np.linalg.norm(x), 1e-12)
    vector = lambda t: unit(np.log1p(counted(t)) * idf)
    assert sorted(set(model.langs)) == ["de", "en", "fr"] and len(model.langs) == 6
    for lang in words:  # each centroid is the mean direction of the documents nearest to it
        centres = [c for c, name in zip(model.centres, model.langs, strict=True) if name == lang]
        own = [vector(t) for t, name in learned if name == lang]
        near = [int(np.argmax([x @ c for c in centres])) for x in own]
        for k, c in enumerate(centres):
            assert np.allclose(c, unit(sum(x for x, i in zip(own, near, strict=True) if i == k)), atol=1e-9)
    got = sorted(((r.doc_id, r.lang_pred, round(r.score, 9)) for r in language.predict(docs, model).collect()), key=repr)
    want = []
    for i, t, _ in rows:
        cosines = [vector(t) @ c for c in model.centres]
        lettered = bool(re.search(r"[^\W\d_]", t or ""))
        want.append((i, model.langs[int(np.argmax(cosines))] if lettered else "und", round(min(1, max(0, max(cosines))), 9) if lettered else 0.0))
    assert got == sorted(want, key=repr)


def test_language(spark):
    rng = random.Random(8)
    words = {"en": "the and of with which that there", "fr": "le la les avec qui dans être où", "de": "der die und mit nicht über für"}
    rows = [(k, " ".join(rng.choice(words[lang].split()) for _ in range(rng.randrange(4, 30))).title(), lang) for k in range(240) for lang in [rng.choice(list(words))]]
    rows += [(900, None, "en"), (901, "12 .. ", "de"), (902, "", None), (None, "the and of", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    out = quality.held_out("doc_id", 4, 2)
    model = language.fit(docs.filter(~out))
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    held = [(got[i].lang_pred, lang) for i, _, lang in rows[:240] if _held_out(i, 4) == 2]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language.predict(docs, language.fit(docs.limit(0))).collect()} == {"und"}
    assert language.predict(docs.limit(0), model).count() == 0
    odd = language.predict(spark.createDataFrame([(1, "zzzz qqq xxxxx jjj zzqx")], "doc_id bigint, text string"), model).first()
    assert odd.rejected and odd.lang_pred in words


def test_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in q.QUERIES)
    assert numbers == list(range(1, 11)) and set(q.ORACLE_SQL) <= set(q.QUERIES)
