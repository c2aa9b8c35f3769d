"""Brute-force versions that the training-data operators are held against."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingle_sets(docs, k=5):
    out = {}
    for i, t in docs:
        w = words(t)
        out[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    return {i: root(i) for i in ids}


def near_duplicates(docs, threshold=0.8):
    """(links per id, class per id) by counting shared shingles of all pairs."""
    sets = shingle_sets(docs)
    inverted = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    shared = Counter()
    for ids in inverted.values():
        for n, b in enumerate(ids):
            for a in ids[:n]:
                shared[a, b] += 1
    links = [(a, b) for (a, b), c in shared.items() if c >= threshold * (len(sets[a]) + len(sets[b]) - c)]
    count = Counter(x for p in links for x in p)
    return {i: count[i] for i in sets}, components(sets, links)


def decontaminated(docs, items):
    """doc_id -> (n_words, n_hit, items) by all windows."""
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[j:j + n])].add(i)
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[j:j + n]))):
                    hit.update(range(j, j + n))
                    found |= own
        out[i] = (len(w), len(hit), sorted(map(str, found)))
    return out


def line_windows(docs):
    """doc_id -> text without later occurrences of three-line windows."""
    first, gone = {}, defaultdict(set)
    split = {i: t.split("\n") for i, t in docs if t is not None}
    for i in sorted(split):
        some = [(n, x.strip(" \t\r\v\f")) for n, x in enumerate(split[i]) if x.strip(" \t\r\v\f")]
        for k in range(len(some) - 2):
            key = tuple(x for _, x in some[k:k + 3])
            at = first.setdefault(key, (i, k))
            if at != (i, k):
                lo = max(k, at[1] + 3) if at[0] == i else k
                gone[i].update(some[j][0] for j in range(lo, k + 3))
    return {i: None if t is None else "\n".join(x for n, x in enumerate(split[i]) if n not in gone[i]) for i, t in docs}


def mix_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets of sources in order by handing out the excess until none is above."""
    cap = [most * s for s in sizes]
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    target, rest = [0.0] * len(sizes), share * sum(sizes)
    open_ = set(range(len(sizes)))
    while open_:
        total = sum(w[i] for i in open_)
        over = [i for i in open_ if rest * w[i] / total > cap[i]]
        if not over:
            for i in open_:
                target[i] = rest * w[i] / total
            break
        for i in over:
            target[i] = cap[i]
            open_.discard(i)
        rest = share * sum(sizes) - sum(target)
    return target
