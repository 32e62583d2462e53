"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import xxhash


def words(text):
    return (text or "").encode().lower().split()


def simhash(text, size=3):
    w = words(text)
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + size]) for i in range(len(w) - size + 1)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(rows, size=3, threshold=2):
    """rows: (doc_id, text) -> sorted list of (doc_id, fingerprint, component_id)."""
    fps = [simhash(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= threshold:
                root[find(i)] = find(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        first.setdefault(find(i), []).append(d)
    named = {k: min((d for d in v if d is not None), default=None) for k, v in first.items()}
    return sorted(((d, f"{fps[i]:016x}", named[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def substrings(rows, length=50):
    """rows: (doc_id, text) -> sorted (doc_id, n_bytes, n_removed, n_spans, kept)."""
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1 if d is not None else 0):
            g = b[i:i + length]
            first[g] = min(first.get(g, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1 if d is not None else 0):
            if first[b[i:i + length]] < d:
                gone[i:i + length] = [True] * length
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def line_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def lines(rows, min_chars=40, min_docs=5):
    """rows: (doc_id, text) -> sorted (doc_id, n_lines, n_dropped, kept)."""
    held = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(line_key(line)) >= min_chars:
                held.setdefault(line_key(line), set()).add(d)
    keeper = {k: max(x for x in v if x is not None) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for d, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if line_key(x) not in keeper or d is not None and d >= keeper[line_key(x)]]
        out.append((d, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def bench_words(text):
    import re
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contamination(rows, items, size=10):
    """-> sorted (doc_id, n_words, n_hit, items)."""
    windows = {}
    for item, t in items:
        w = bench_words(t)
        for i in range(max(len(w) - size + 1, 1) if w else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add("" if item is None else str(item))
    out = []
    for d, t in rows:
        w = bench_words(t)
        hit, found = set(), set()
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                if tuple(w[i:i + m]) in windows:
                    hit.update(range(i, i + m))
                    found |= windows[tuple(w[i:i + m])]
        out.append((d, len(w), len(hit), ",".join(sorted(found))))
    return sorted(out, key=str)


def top_k(rows, k=5, every=50):
    """rows: (vec_id, components) -> sorted (query_id, rank, vec_id, score)."""
    import math
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in ok:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
    return sorted(out)
