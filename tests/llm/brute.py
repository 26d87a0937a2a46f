"""Plain single-process versions of the operators' contracts, for small inputs."""

import re

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k=5):
    w = SPACE.findall(low(text))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def near_duplicates(rows, least=75):
    """rows: (doc_id, text) -> {(doc_id, n_shingles): component}"""
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    has = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            has.setdefault(x, []).append(i)
    seen = set()
    for group in has.values():
        for i in group:
            for j in group:
                if i < j and (i, j) not in seen:
                    seen.add((i, j))
                    a, b = sets[i][1], sets[j][1]
                    if 100 * len(a & b) >= least * len(a | b):
                        x, y = sorted((find(sets[i][0]), find(sets[j][0])))
                        parent[y] = x
    return sorted((d, len(s), find(d)) for d, s in sets)


def lm_base(rows, held):
    """rows: (doc_id, text); held(doc_id) -> {doc_id: (tokens, known, N, base)}"""
    import math
    from collections import Counter

    tokens = {d: [*SPACE.findall(low(t)), None] for d, t in rows}
    count = Counter(x for d, ts in tokens.items() if not held(d) for x in ts)
    n, v = sum(count.values()), len(count)
    return {d: (len(ts), sum(count[x] > 0 for x in ts), n, sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in ts)) for d, ts in tokens.items()}


def contamination(docs, items, window=10):
    """{doc_id: (n_words, hit word numbers, item ids)}"""
    wanted = {}
    for name, text in items:
        w = ALNUM.findall(low(text))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wanted.setdefault(tuple(w[i : i + window]), set()).add(str(name))
    sizes = sorted({len(k) for k in wanted})
    out = {}
    for d, text in docs:
        w, hit, found = ALNUM.findall(low(text)), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                names = wanted.get(tuple(w[i : i + n]))
                if names:
                    hit.update(range(i, i + n))
                    found |= names
        out[d] = (len(w), hit, found)
    return out


def phrases(text, table):
    w = ALNUM.findall(low(text))
    return len(w), sorted((i, label) for p, label in table.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())


def secrets(text):
    """(kind, start, end) by start, then kind."""
    text = text or ""
    order = ["assign", "access", "hex"]
    flags = re.IGNORECASE | re.ASCII
    out = [("assign", *m.span()) for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, flags) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda x: (x[1], order.index(x[0])))
