import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from test_dedup import corpus, frame

import culvert.llm.alignment as alignment
from culvert.llm import queries
from culvert.llm.alignment import ByteBpe, PairEncoder, PieceBpe, align_tokens, pieces, segments

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "It's \"quoted\", isn't it? <|endoftext|> </s> <s> <unk> <0x41>", "  two  spaces\tand tabs\n \n  x ", "\n \t leading", "trailing ", "trailing   ", " ", "   ", "\n", "Ünïcödé ñandú ¿qué? £5 µm ª º",
    "日本語のテキスト。 中文　全角 空白", "emoji 👍🏽 family 👩‍👩‍👧", "a  b  c　  d\x85 e\x1c f", "nul \x00 byte ﻿ bom", "low ▁ line", "12 345,678.90 x2y3", "x" * 500, "don't can't WE'LL I'm they've", "é" * 90, "नमस्ते दुनिया", "½ ² ③ Ⅷ", "-- -- ...!? (a) [b] {c}", "a\r\nb\r\n c",
]


@pytest.fixture(scope="module")
def sides():
    return ByteBpe(PATHS[0]), PieceBpe(PATHS[1])


def whole(sides, text):
    """Ids of both sides of a whole text, or None."""
    a = sides[0].tokenizer.encode(" " + text, add_special_tokens=False).ids
    b = sides[1].model.encode(text)
    raw = (" " + text).encode()
    same = b"".join(sides[0].bytes[i] for i in a) == raw == b"".join(sides[1].bytes[i] for i in b)
    return (a, b) if text and same else None


def brute(sides, rows):
    """The rows of the operator, token by token."""
    made, counts = [], Counter()
    for i, text in rows:
        a, b = whole(sides, text or "") or ([], [])
        spans = []
        for ids, table in ((a, sides[0].bytes), (b, sides[1].bytes)):
            at, own = 0, []
            for x in ids:
                own.append((at, at + len(table[x]), x))
                at += len(table[x])
            spans.append(own)
        links = [(x, y) for s, e, x in spans[0] for t, f, y in spans[1] if s < f and t < e] if len(a) * len(b) < 400_000 else None
        if links is None:  # long: as above, by a walk
            links, k = [], 0
            for s, e, x in spans[0]:
                while spans[1][k][1] <= s:
                    k += 1
                m = k
                while m < len(b) and spans[1][m][0] < e:
                    links.append((x, spans[1][m][2]))
                    m += 1
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = []
        at = [0, 0]
        for cut in cuts:
            sets = []
            for side in (0, 1):
                ids = []
                while at[side] < len(spans[side]) and spans[side][at[side]][1] <= cut:
                    ids.append(str(spans[side][at[side]][2]))
                    at[side] += 1
                sets.append(",".join(ids))
            groups.append("|".join(sets))
        counts.update(links)
        made.append((i, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return sorted(
        (str(i), a, b, g, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest) for i, a, b, g, links, digest in made
    )


def got(frame):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in frame.collect())


def test_words_give_whole_texts(sides, monkeypatch):
    """Piece by piece and word by word, with little memory, as by the whole tokenizers."""
    monkeypatch.setattr(alignment, "MEMORY_BYTES", 20_000)
    rng = random.Random(5)
    mixed = [" ".join(rng.choice(ODD) for _ in range(4)) for _ in range(150)]
    mixed += ["".join(rng.choice(" \n\t　aé'1.▁") for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    for piece in (1 << 16, 10):
        monkeypatch.setattr(alignment, "PIECE", piece)
        both = PairEncoder(*PATHS)
        for text in [*ODD, *mixed, *(t for _, t in corpus(60, 3) if t)]:
            found = list(both.encode([segments(p) for p in pieces(text)]))
            both.forget()
            joined = None if None in found else tuple([int(x) for f in found for x in f[side]] for side in (0, 1))
            expected = whole(sides, text)
            assert joined == (expected and (list(expected[0]), list(expected[1]))), repr(text)


def test_faster_vocabulary(sides):
    """Where it is used, the faster encoder gives the ids of the file's own tokenizer: every Latin character in its places."""
    assert sides[0].fast
    for c in map(chr, range(0x250)):
        text = f" a{c}1 {c}b{c}{c} 2{c}  {c}'s{c}"
        assert sides[0].encode(text) == sides[0].tokenizer.encode(text, add_special_tokens=False).ids, repr(c)


def test_align_tokens(spark, sides, monkeypatch):
    rows = corpus(120, 4) + [(10_000 + k, t) for k, t in enumerate(ODD)]
    rows += [(None, "no id"), (None, "no id"), (rows[0][0], "the same id"), (20_000, None), (20_001, "")]
    expected = brute(sides, rows)
    assert got(align_tokens(frame(spark, rows), *PATHS)) == expected


def test_small_lots_and_chunks(spark, sides):
    """A machine that sweeps after every few tokens and begins new numbers often gives the same."""
    rows = [r for r in corpus(40, 9) if r[1]] + [(7_000, " ".join(f"word{k}, Wörter" for k in range(3000)))]
    events = alignment.token_events(frame(spark, rows).coalesce(1), *PATHS).orderBy("key", "at", "side").collect()
    machine = alignment.Machine(alignment.lengths(PATHS[0]), alignment.lengths(PATHS[1]), 0)
    found, pairs = {}, []
    old = alignment.MAX_PAIRS
    alignment.MAX_PAIRS = 50
    try:
        for k, e in enumerate(events):
            machine.add(e.key, e.doc_id, e.side, bytes(e.ids) if e.ids is not None else None)
            if k % 3 == 0 or k == len(events) - 1:
                for kind, row in machine.sweep(k == len(events) - 1):
                    if kind == "doc":
                        found[row[1]] = row[2:]
                    elif kind == "pairs":
                        pairs.append(row)
    finally:
        alignment.MAX_PAIRS = old
    expected = brute(sides, rows)
    assert sorted((str(i), *v) for i, v in found.items()) == [(i, a, b, g, n, digest) for i, a, b, g, n, _, _, digest in expected]
    assert len({p[0] for p in pairs}) > 3
    n = sum(int(alignment.unpacked(p[3], np.int64).sum()) for p in pairs)
    assert n == sum(e[4] for e in expected)


def test_edges(spark, sides):
    assert align_tokens(frame(spark, []), *PATHS).count() == 0
    assert got(align_tokens(frame(spark, [(1, None), (2, "")]), *PATHS)) == [("1", 0, 0, 0, 0, 0, 0, ""), ("2", 0, 0, 0, 0, 0, 0, "")]
    long = " ".join(f"wort{k % 900}" + ("\n " if k % 50 == 0 else "") for k in range(120_000))
    clash = spark.createDataFrame([(1, long, 5, "k", 2), (2, "a b", 6, "l", 3)], "doc_id int, text string, key int, chunk string, n_a int")
    assert got(align_tokens(clash, *PATHS)) == brute(sides, [(1, long), (2, "a b")])


def test_a_table(spark, sides):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    found = queries.op12_alignment(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got(found) == brute(sides, rows)


def ran(plan):
    """Names and output rows of the nodes of a plan that ran."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return ran(plan.executedPlan())
    if name.endswith("QueryStage"):
        return ran(plan.plan())
    metrics, children = plan.metrics(), plan.children().iterator()
    found = [(name, metrics.apply("numOutputRows").value() if metrics.contains("numOutputRows") else 0)]
    while children.hasNext():
        found += ran(children.next())
    return found


def test_joins_do_not_grow_with_tasks(spark, sides):
    """Every one of many tasks asks for the same pairs: no join multiplies pairs of ids by tasks."""
    rows = [(k, f"the same few words, {t}") for k, t in enumerate(["again and again", "once more"] * 60)]
    pairs = {x for _, text in rows[:2] for x in _links(sides, text)}
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(old, ("24", "false"), strict=True):
            spark.conf.set(k, v)
        found = align_tokens(frame(spark, rows), *PATHS)
        assert got(found) == brute(sides, rows)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    made = ran(found._jdf.queryExecution().executedPlan())
    assert any("CoGroups" in name for name, _ in made)
    assert all(n <= len(pairs) for name, n in made if "Join" in name or name == "Generate"), (made, len(pairs))


def _links(sides, text):
    """Pairs of ids whose tokens overlap."""
    spans = []
    for ids, side in zip(whole(sides, text), sides, strict=True):
        ends = np.cumsum([len(side.bytes[i]) for i in ids]).tolist()
        spans.append(list(zip([0, *ends[:-1]], ends, ids, strict=True)))
    return {(x, y) for s, e, x in spans[0] for t, f, y in spans[1] if s < f and t < e}
