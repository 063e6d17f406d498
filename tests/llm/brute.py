"""Plain Python statements of the operators' results, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter
from math import exp, log

import numpy as np
import regex

SPACES = re.compile(r"[\x20\x09-\x0D]+")
GRAPH = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


class Sets:
    """Disjoint sets named by their smallest member."""

    def __init__(self, members):
        self.up = {m: m for m in members}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def exact(rows):
    """Sorted (doc_id, keep_id, group_size, kept, sha) of (doc_id, text) rows."""
    norm = [(i, SPACES.sub(" ", t or "")) for i, t in rows]
    size = Counter(t for _, t in norm)
    best, seen, out = {}, set(), []
    for i, t in norm:
        if i is not None:
            best[t] = min(best.get(t, i), i)
    for i, t in norm:
        first = i == best.get(t) and (i, t) not in seen
        seen.add((i, t))
        out.append((i, best.get(t), size[t], first, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def near(rows):
    """{doc_id: (n_shingles, component_id)} of rows with distinct ids."""
    sets = {}
    for i, t in rows:
        w = GRAPH.findall(lowered(t))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    groups, ids = Sets(sets), sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                groups.join(a, b)
    return {i: (len(sets[i]), groups.find(i)) for i in ids}


def contamination(rows, items, window=13):
    """{doc_id: (n_words, n_hit, n_items, items_sha, contaminated)}."""
    windows = {}
    for name, t in items:
        w = ALNUM.findall(lowered(t))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k:k + window]), set()).update([] if name is None else [str(name)])
    lengths = {len(w) for w in windows}
    out = {}
    for i, t in rows:
        w, hit, found = ALNUM.findall(lowered(t)), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (names := windows.get(tuple(w[k:k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= names
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[i] = (len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w))
    return out


def suffixes(rows, length=50):
    """{doc_id: (n_bytes, n_removed, n_spans, sha)} of rows with distinct ids."""
    texts = sorted((i, (t or "").encode()) for i, t in rows)
    first = {}
    for i, b in texts:
        for p in range(len(b) - length + 1):
            first.setdefault(b[p:p + length], i)
    out = {}
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < i:
                gone[p:p + length] = b"\1" * length
        runs = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(gone)))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def lines(rows, least=1):
    """{doc_id: sorted removed line numbers} of rows with distinct ids.

    With ``least`` 1 a blank line goes only with a neighbour that isn't blank.
    """
    first, split = {}, {i: (t or "").split("\n") for i, t in rows}
    gone = {i: set() for i in split}
    for i in sorted(split):
        for n in (least, 2) if least == 1 else (least,):
            for p in range(len(split[i]) - n + 1):
                run = tuple(split[i][p:p + n])
                blank = sum(not GRAPH.search(line) for line in run)
                if (blank == n - 1 or least > 1) and first.setdefault(run, (i, p)) != (i, p):
                    gone[i].update(range(p, p + n))
    return {i: sorted(g) for i, g in gone.items()}


def targets(sizes, weights=(1, 2, 3), cap=3):
    """{source: target} by resharing what stands above the caps, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, held = sum(sizes.values()), {}
    while True:
        rest = total - sum(held.values())
        free = [s for s in names if s not in held]
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s: float(cap * sizes[s]) for s in free if share[s] >= cap * sizes[s]}
        if not over:
            return held | share
        held |= over
        if len(held) == len(names):
            return held


def statistics(text):
    """The statistics of the quality model by name, from the whole text."""
    t = text or ""
    w = GRAPH.findall(t)
    share = lambda count, of: count / of if of else 0.0
    every = lambda pattern: len(regex.findall(pattern, t))
    return {"s_words": float(len(w)), "s_chars_per_word": share(len(t), len(w)), "s_lines_per_word": share(t.count("\n"), len(w)),
            "s_capitals": share(every(r"\p{Lu}"), len(t)), "s_digits": share(sum(c in "0123456789" for c in t), len(t)),
            "s_stops": share(sum(c in ".,;:?" for c in t), len(w)),
            "s_marks": share(sum(not regex.match(r"[\p{L}\p{N}]", c) and c not in " \t\n\x0b\f\r.,;:?'\"()-" for c in t), len(t)),
            "s_bars": share(sum(c in "|!" for c in t), len(w)), "s_distinct_words": share(len(set(w)), len(w)),
            "s_words_again": share(sum(a == b for a, b in zip(w, w[1:], strict=False)), len(w))}


def rule_score(text, intercept, rules):
    s, total = statistics(text), intercept
    for rule, weight in rules:
        if all(s[name] <= x if op == "<=" else s[name] > x for name, op, x in rule):
            total += weight
    return 1 / (1 + exp(-total))


def toxic_words(text):
    out = set()
    for w in re.findall(r"\w+", (text or "").lower()):
        out.add("=" + w)
        out.update(w[:k] for k in range(4, 8) if k <= len(w))
    return out


def severity_sample(rows, labels, limits, most_features, least_g2, ratio):
    """(kept features, their G2, [(present features, grade)]) of the labelled rows that are fitted."""
    marked = {}
    for i, toxic in labels:
        if i is not None and toxic is not None:
            marked[i] = max(marked.get(i, 0), int(toxic != 0))
    chosen = {}
    for toxic, limit in limits.items():
        order = sorted((zlib.crc32(str(i).encode()), i) for i, t in marked.items() if t == toxic)
        chosen.update((i, toxic) for _, i in order[:limit])
    sample = [(toxic_words(t), chosen[i]) for i, t in rows if i in chosen]
    size = [sum(t == k for _, t in sample) for k in (0, 1)]
    seen = [Counter(f for fs, t in sample if t == k for f in fs) for k in (0, 1)]
    n, g2 = len(sample), {}
    for f in seen[1]:
        if seen[1][f] * size[0] < ratio * (seen[0][f] + 0.5) * size[1]:
            continue
        total = 0.0
        for k in (0, 1):
            for count, of in ((seen[k][f], seen[0][f] + seen[1][f]), (size[k] - seen[k][f], n - seen[0][f] - seen[1][f])):
                total += 2 * count * log(count * n / (of * size[k])) if count else 0.0
        g2[f] = total
    kept = sorted((f for f in g2 if g2[f] >= least_g2), key=lambda f: (-g2[f], f))[:most_features]
    have = [(sorted(fs & set(kept)), t) for fs, t in sample]
    low, high = np.quantile([len(fs) for fs, t in have if t], [1 / 3, 2 / 3])
    return kept, g2, [(fs, t and 1 + (len(fs) > low) + (len(fs) > high)) for fs, t in have]
