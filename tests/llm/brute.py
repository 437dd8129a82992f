"""Plain Python versions of the operators' definitions."""

import hashlib
import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def measures(text):
    t = text or ""
    w = SPACED.findall(t)
    spots = defaultdict(list)
    for i in range(len(w) - 4):
        spots[tuple(w[i:i + 5])].append(i)
    covered = {i + o for v in spots.values() if len(v) > 1 for i in v for o in range(5)}
    lines = [x for x in t.split("\n") if SPACED.search(x)]
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(covered)


def shingles(text, n=5):
    w = SPACED.findall(low(text))
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def near(rows):
    """{doc_id: (n_shingles, component)} for distinct ids."""
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def cut_lines(rows, least=30):
    """{(doc_id, text): removed line numbers}; every run of every pair of places is tried."""
    docs = sorted({(d is not None, d or 0, t) for d, t in rows if t is not None})
    first, out = {}, defaultdict(set)
    for key in docs:
        v = [(i, tuple(SPACED.findall(low(x)))) for i, x in enumerate(key[2].split("\n"))]
        v = [x for x in v if x[1]]
        for s in range(len(v)):
            n = 0
            for e in range(s, len(v)):
                n += len(v[e][1])
                if n < least:
                    continue
                body = tuple(x[1] for x in v[s:e + 1])
                if body in first:
                    out[key[1] if key[0] else None, key[2]].update(x[0] for x in v[s:e + 1])
                first.setdefault(body, (key, s))
    return out


def benchmark_hits(text, items, size=10):
    windows = defaultdict(set)
    for item, body in items:
        w = ALNUM.findall(low(body))
        k = min(size, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[i:i + k])].add(str(item))
    w, hit, named = ALNUM.findall(low(text)), set(), set()
    for k in {len(x) for x in windows}:
        for i in range(len(w) - k + 1):
            got = windows.get(tuple(w[i:i + k]))
            if got:
                named |= got
                hit |= set(range(i, i + k))
    return len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    t, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def digest(spans, kinds):
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def secrets(text):
    t, out = text or "", []
    assign = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
    for k, (p, ok) in enumerate([(assign, lambda m: len(m[2]) >= 6), (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
                                 (r"[0-9a-f]+", lambda m: len(m[0]) >= 24)]):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, t, re.A) if ok(m)]
    return sorted(out)


def targets(sizes, weights=(5, 2, 1), limit=3):
    """{source: target}: caps are applied one round after another, the excess goes to the others by weight."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        rest, weight = total - sum(capped.values()), sum(w[s] for s in free)
        want = {s: rest * w[s] / weight for s in free}
        over = {s: limit * sizes[s] for s in free if want[s] > limit * sizes[s]}
        if not over:
            return capped | want
        capped |= over


def snapshots(turns):
    """{conv_id: kept} from {conv_id: [(role, text), ...]} in order."""
    out = {}
    for a, x in turns.items():
        longer = any(len(y) > len(x) and y[:len(x)] == x for y in turns.values())
        twin = any(y == x and (b is None or (a is not None and b < a)) for b, y in turns.items() if b != a)
        out[a] = not longer and not twin
    return out


def copies_of(rows):
    return Counter(map(tuple, rows))


def divergence(rows, least=30, top=50):
    """(lang, source, part, item, value, rank) from (text, lang, source) rows, term by term."""
    pattern = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    rows = [(pattern.findall(low(t)), g or "", s or "") for t, g, s in rows]
    out = set()
    for lang in {g for _, g, _ in rows}:
        docs, uses, sources = Counter(), defaultdict(Counter), {s for _, g, s in rows if g == lang}
        for w, g, s in rows:
            if g == lang:
                docs.update(set(w))
                uses[s].update(w)
        kept = [t for t in docs if docs[t] >= least]
        whole = Counter({t: sum(uses[s][t] for s in sources) for t in kept})

        def shares(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: shares(uses[s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources - {s}))
            out |= {(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(pairs, 1)}
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if uses[s][t] and p[s][t] > q[t])
            out |= {(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(terms[:top], 1)}
    return out


def sketch(text, k=64):
    w = SPACED.findall(low(text))
    parts = {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return sorted(hashlib.md5(x.encode()).hexdigest()[:16] for x in parts)[:k]


def likeness(a, b, k=64):
    union = sorted(set(a) | set(b))[:k]
    return len(set(union) & set(a) & set(b)) / len(union) if union else 1.0


def phrases(rows, least=30, top=2000, percent=80):
    """(lang, rank, phrase, a, l, r, n, score) from (text, lang) rows; containment is tried against every longer candidate."""
    count, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, 5):
                count[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = set()
    for lang, f in count.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            inside = (x for q, x in cand.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))))
            if any(100 * x >= percent * a for x in inside):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out |= {(lang, i, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)}
    return out
