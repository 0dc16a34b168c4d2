"""Plain Python versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(_LOW)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring_dedup(rows, width):
    """{doc_id: (n_words, n_removed, kept_sha256)}"""
    words = {i: SPACED.findall(t or "") for i, t in rows}
    first = {}
    for i, w in words.items():
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def exact_dedup(rows):
    """{doc_id: (keep_id, group_size, kept, sha)}"""
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    out = {}
    for text, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            out[i] = (keep, len(members), i == keep, sha(text))
    return out


def jaccard_components(rows, width=5, percent=75):
    """{doc_id: (n_shingles, component_id)}"""
    sets = {}
    for i, t in rows:
        w = SPACED.findall(lower(t))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def decontaminate(rows, items, width=10):
    """{doc_id: (n_words, n_hit, n_items, items_sha256, contaminated)}"""
    windows = defaultdict(set)
    for item, t in items:
        w = ALNUM.findall(lower(t))
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[k : k + width])].add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for i, t in rows:
        w = ALNUM.findall(lower(t))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= got
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit))
    return out


def line_dedup(rows, split, ratio, min_pages):
    """rows of (page_id, host, text): {page_id: (n_lines, n_dropped, kept lines)}"""
    lines = {p: [x.strip(" \t\n\x0b\x0c\r") for x in split.split(t or "")] for p, _, t in rows}
    pages, total = Counter(), Counter()
    for p, host, _ in rows:
        total[host] += 1
        pages.update({(host, x) for x in lines[p] if x})
    out = {}
    for p, host, _ in rows:
        own = [x for x in lines[p] if x]
        kept = [x for x in own if not (pages[host, x] >= min_pages and pages[host, x] > ratio * total[host])]
        out[p] = (len(own), len(own) - len(kept), kept)
    return out


def license_scan(text, templates, base, min_run, max_gap, min_share):
    """(labels, score): longest matches word by word, and the best chain of each template, from their definitions."""
    w = ALNUM.findall(lower(text))
    named = [(label, p.split()) for p, label in base.items()]
    labels = {label for label, p in named if any(w[k : k + len(p)] == p for k in range(len(w)))}
    sequences = [(label, ALNUM.findall(lower(t))) for label, texts in templates.items() for t in texts]
    known = {tuple(s[i:j]) for _, s in [*sequences, *named] for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    most = max(map(len, known))
    longest = [max((n for n in range(1, min(e + 1, most) + 1) if tuple(w[e + 1 - n : e + 1]) in known), default=0) for e in range(len(w))] + [0]
    score = 1.0 if labels else 0.0
    for label, s in sequences:
        runs = []
        for e in range(len(w)):
            n = longest[e]
            if n >= min_run and longest[e + 1] <= n:
                runs += [(e - n + 1, e, q - n + 1, q) for q in range(n - 1, len(s)) if s[q - n + 1 : q + 1] == w[e - n + 1 : e + 1]]
        covered = []
        for a, b, p, q in runs:
            best = q - p + 1
            for k, (_, b2, _, q2) in enumerate(runs[: len(covered)]):
                over = max(0, b2 + 1 - a, q2 + 1 - p)
                if over < q - p + 1 and a - b2 <= max_gap and q > q2 and b > b2:
                    best = max(best, covered[k] + q - p + 1 - over)
            covered.append(best)
        share = max(covered, default=0) / len(s)
        score = max(score, min(1.0, share))
        if max(covered, default=0) >= min_share * len(s):
            labels.add(label)
    return ",".join(sorted(labels)), score


def simhash(text, width=3, seed=42):
    """The fingerprint as a number, from its definition."""
    import xxhash

    w = SPACED.findall(lower(text))
    shingles = [" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))] if w else []
    hashes = [xxhash.xxh64(s.encode(), seed).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def near_components(codes, distance=2):
    """{code: smallest code reachable} by all pairs."""
    codes = sorted(set(codes))
    root = {c: c for c in codes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(codes):
        for b in codes[k + 1 :]:
            if (a ^ b).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {c: find(c) for c in codes}


def vector_codes(rows, entries=256, rounds=4, parts=4):
    """{vec_id: (code, error)}, sha256 of the codebooks: rows of (vec_id, whole vector), ids distinct, Python integers throughout."""
    import math

    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    width = len(next(iter(whole.values()))) // parts
    cut = {i: [v[p * width : (p + 1) * width] for p in range(parts)] for i, v in whole.items()}
    books = [[cut[i][p] for i in sorted(cut)[:entries]] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        groups = defaultdict(list)
        for v in cut.values():
            for p in range(parts):
                groups[p, near(p, v[p])[1]].append(v[p])
        for (p, e), members in groups.items():
            books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out = {}
    for i, v in cut.items():
        best = [near(p, v[p]) for p in range(parts)]
        out[i] = ("".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best))
    return out, sha(",".join(str(x) for book in books for c in book for x in c))
