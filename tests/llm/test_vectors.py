import math
import random
from collections import defaultdict

import brute
import numpy as np
import pyarrow as pa
from test_dedup import corpus, frame

import culvert.llm.simhash as simhash_module
import culvert.llm.vector_codes as codes_module
from culvert.llm import queries
from culvert.llm.simhash import fingerprints, near_links, near_pairs, simhash_components
from culvert.llm.vector_codes import vector_codes


def expected_components(rows):
    """{row number: (fingerprint, component_id)}"""
    codes = [brute.simhash(t) for _, t in rows]
    root, least = brute.near_components(codes), defaultdict(lambda: math.inf)
    for (i, _), c in zip(rows, codes, strict=True):
        least[root[c]] = min(least[root[c]], math.inf if i is None else i)
    ids = {k: None if v == math.inf else v for k, v in least.items()}
    return sorted((str(i), f"{c:016x}", str(ids[root[c]])) for (i, _), c in zip(rows, codes, strict=True))


def got_components(frame):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in frame.collect())


def test_fingerprints(monkeypatch):
    monkeypatch.setattr(simhash_module, "WORDS", 7)
    texts = [None, "", " \n", "One", "one TWO", "a b c", "É ü ß É ü", "a  b\tc\nd e", "x " * 40, *(t for _, t in corpus(60, 5))]
    got = fingerprints(pa.array(texts), 3, 42)
    assert got.tolist() == [brute.simhash(t) for t in texts]
    assert fingerprints(pa.array([], pa.string()), 3, 42).tolist() == []


def gray(codes):
    def rank(c):
        for s in (1, 2, 4, 8, 16, 32):
            c ^= c >> s
        return c

    return np.array(sorted(codes, key=rank), np.uint64)


def test_near_pairs():
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    for bits in (8, 64):
        many = {centre ^ sum(1 << rng.randrange(bits) for _ in range(rng.randrange(5))) for _ in range(700)} | {rng.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1}
        a = gray(many)
        pairs = {(int(i), int(j)) for lot in near_pairs(a, a, 2, True) for i, j in zip(*lot, strict=True)}
        n = len(a)
        assert pairs == {(i, j) for i in range(n) for j in range(i + 1, n) if (int(a[i]) ^ int(a[j])).bit_count() <= 2}
        x, y = a[: n // 3], a[n // 3 :]
        pairs = {(int(i), int(j)) for lot in near_pairs(x, y, 2, False) for i, j in zip(*lot, strict=True)}
        assert pairs == {(i, j) for i in range(len(x)) for j in range(len(y)) if (int(x[i]) ^ int(y[j])).bit_count() <= 2}


def test_near_links(spark, monkeypatch):
    """Small blocks and a tree of several levels; families, dense and spread, and the ends of the range."""
    monkeypatch.setattr(simhash_module, "BLOCK", 20)
    monkeypatch.setattr(simhash_module, "FAN", 2)
    rng = random.Random(4)
    codes = {rng.getrandbits(64) for _ in range(300)} | {0, 1, 1 << 63, (1 << 64) - 1, (1 << 63) - 1}
    for size in (150, 40, 2):
        c = rng.getrandbits(64)
        codes |= {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for _ in range(size)}
    signed = lambda c: c - (1 << 64) if c >> 63 else c
    links = near_links(spark.createDataFrame([(signed(c),) for c in codes], "code bigint"), 2).collect()
    assert all((r.a & (1 << 64) - 1) in codes and (r.b & (1 << 64) - 1) in codes for r in links)
    near, root = brute.near_components(codes), {c: c for c in codes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        x, y = find(r.a & (1 << 64) - 1), find(r.b & (1 << 64) - 1)
        root[max(x, y)] = min(x, y)
    assert {c: find(c) for c in codes} == near


def test_simhash_components(spark):
    rows = corpus(250, 6)
    rows += [(None, rows[3][1]), (rows[3][0], rows[3][1]), (rows[4][0], "another text of that id"), (None, "alone and without an id at all"), (99_999, "")]
    assert got_components(simhash_components(frame(spark, rows))) == expected_components(rows)


def test_simhash_edges(spark):
    assert simhash_components(frame(spark, [])).count() == 0
    assert got_components(simhash_components(frame(spark, [(None, None)]))) == [("None", "0" * 16, "None")]
    long = " ".join(f"w{k % 5000}" for k in range(250_000))
    clash = spark.createDataFrame([(2, long, 1, 5), (1, long + " end", 2, 6)], "doc_id int, text string, code int, component_id int")
    assert got_components(simhash_components(clash)) == expected_components([(2, long), (1, long + " end")])


def test_simhash_of_a_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    found = queries.op11_simhash(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert got_components(found) == expected_components(rows)


SCHEMA = "vec_id bigint, embedding array<float>, label int, key string, x array<int>, error int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, k, "k", [1], 7) for i, v, k in rows], SCHEMA).repartition(3)


def expected_codes(rows):
    kept = [(i, v, k) for i, v, k in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found, digest = brute.vector_codes([(i, v) for i, v, _ in kept])
    by_label = defaultdict(int)
    for i, _, k in kept:
        by_label[k] += found[i][1]
    return {i: (*found[i], by_label[k], digest) for i, _, k in kept}


def test_vector_codes(spark, monkeypatch):
    monkeypatch.setattr(codes_module, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(8)
    for n, dims in ((400, 8), (30, 12), (1, 4)):
        rows = [(int(i) * 3, rng.normal(size=dims).astype(np.float32).tolist(), int(i) % 3 or None) for i in rng.permutation(n)]
        rows += [(10**6 + k, v, 1) for k, v in enumerate([None, [None] + [0.0] * (dims - 1), [math.nan] * dims, [math.inf] * dims])]
        rows += [(-5, rows[0][1], 2)]  # an equal vector: ties go to the lower index
        got = {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes(vectors(spark, rows)).collect()}
        assert got == expected_codes(rows)


def test_vector_codes_edges(spark):
    assert vector_codes(vectors(spark, [])).count() == 0
    assert vector_codes(vectors(spark, [(1, None, 1), (2, [1.0, 2.0, 3.0], 1), (3, [], 1)])).count() == 0
    same, far = [0.5, -0.5, 0.25, 1.0], [3e38, -3e38, 0.0, 1.0]
    rows = [(1, same, None), (1, same, None), (None, same, 4), (2, far, 4), (3, [1.0] * 8, 4)]
    got = sorted((str(r.vec_id), r.code, r.error) for r in vector_codes(vectors(spark, rows)).collect())
    # Entries 0 and 1 are the two rows of id 1, 2 is of the far vector, 3 of the row without id.
    assert got == [("1", "00000000", 0), ("1", "00000000", 0), ("2", "02020200", 0), ("None", "00000000", 0)]


def test_largest_components():
    """Exact in 64-bit integers at the bound, and in floats below 2^53."""
    most = codes_module.largest_component(16)
    for size in (most, 1 << 20):
        rng = np.random.default_rng(size)
        part, book = rng.integers(-size, size + 1, (40, 4)), rng.integers(-size, size + 1, (9, 4))
        best, error = codes_module.nearest(part, book)
        for k, x in enumerate(part.tolist()):
            assert min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book.tolist())) == (error[k], best[k])
