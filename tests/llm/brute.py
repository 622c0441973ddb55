"""Plain versions of the operators, over lists of rows, for comparison."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def decontamination(docs, items, window=13):
    windows: dict[tuple, set] = {}
    for item_id, text in items:
        words = BENCH_WORDS.findall(lower(text or ""))
        n = min(window, len(words))
        for i in range(len(words) - n + 1) if n else ():
            windows.setdefault(tuple(words[i : i + n]), set()).add(str(item_id))
    sizes = sorted({len(w) for w in windows})
    out = []
    for doc_id, text in docs:
        words = BENCH_WORDS.findall(lower(text or ""))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if (w := tuple(words[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[w]
        out.append((doc_id, len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(words)))
    return out


def base_secrets(text):
    kinds = (
        ("assign", re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
    )
    found = [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for rank, (kind, form, good) in enumerate(kinds) for m in form.finditer(text or "") if good(m)]
    return [name for _, _, name in sorted(found)]


def _root(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def joined(ids, pairs):
    """The least id that each id reaches."""
    parent = {i: i for i in ids}
    for a, b in pairs:
        a, b = _root(parent, a), _root(parent, b)
        parent[max(a, b)] = min(a, b)
    return {i: _root(parent, i) for i in ids}


def near_duplicates(docs, percent=75, shingle=5):
    sets = {}
    for doc_id, text in docs:
        words = SPACE_WORDS.findall(lower(text or ""))
        n = min(shingle, len(words))
        sets[doc_id] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()
    holders: dict[tuple, list] = {}
    for doc_id, held in sets.items():
        for s in held:
            holders.setdefault(s, []).append(doc_id)
    shared: dict[tuple, int] = {}
    for ids in holders.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    pairs = [(a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    component = joined(sets, pairs)
    return [(i, len(held), component[i], component[i] == i) for i, held in sets.items()]


def repeats(docs, window=50):
    words = {i: SPACE_WORDS.findall(text or "") for i, text in docs}
    first: dict[tuple, int] = {}
    for i, held in sorted(words.items()):
        for at in range(len(held) - window + 1):
            first.setdefault(tuple(held[at : at + window]), i)
    out = []
    for i, held in words.items():
        gone = set()
        for at in range(len(held) - window + 1):
            if first[tuple(held[at : at + window])] < i:
                gone.update(range(at, at + window))
        out.append((i, len(held), len(gone), sha(" ".join(w for k, w in enumerate(held) if k not in gone))))
    return out


def near_vectors(rows, cosine=0.98):
    good = [(i, label, np.array(v, float)) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {i: 0 for i, _, _ in rows}
    pairs = []
    for group in {(label, len(v)) for _, label, v in good}:
        held = [(i, v) for i, label, v in good if (label, len(v)) == group]
        unit = np.stack([v / np.linalg.norm(v) for _, v in held])
        near = unit @ unit.T >= cosine
        for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True):
            a, b = held[a][0], held[b][0]
            links[a] += 1
            links[b] += 1
            pairs.append((a, b))
    component = joined([i for i, _, _ in rows], pairs)
    return [(i, links[i], component[i], component[i] == i) for i, _, _ in rows]


TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def search(docs, items, top=10):
    """(item, rank, document, score); documents and items are (id, text) rows."""
    texts = [(i, Counter(TERMS.findall(lower(t or "")))) for i, t in docs]
    filled = sum(bool(c) for _, c in texts)
    total = sum(sum(c.values()) for _, c in texts)
    df = Counter(term for _, c in texts for term in c)
    weight = {t: math.floor(1000 * math.log((2 * filled + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        wanted = Counter(TERMS.findall(lower(text or "")))
        scores = []
        for doc, held in texts:
            m = 25 + 75 * sum(held.values()) * filled // total if total else 0
            score = sum(n * weight[t] * (10**9 * held[t] // (1000 * held[t] + 8 * m)) for t, n in wanted.items() if t in held)
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scores)[:top], 1)]
    return out


def resampling(docs, target, percent=5, min_words=20, buckets=10_000):
    def features(text):
        words = BENCH_WORDS.findall(lower(text or ""))
        runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    held = [(i, *features(t)) for i, t in docs]
    s = Counter(b for _, _, bs in held for b in bs)
    t = Counter(b for _, text in target for b in features(text)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for i, n_words, bs in held:
        weight = sum(gain[b] for b in bs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n_words, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    eligible = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = eligible[: len(eligible) * percent // 100]
    left = [r for r in rows if r[1] < min_words] + eligible[len(drawn) :]
    return [(i, n, w, x, rank) for rank, (i, _, n, w, x) in enumerate(drawn, 1)] + [(i, n, w, x, None) for i, _, n, w, x in left]
