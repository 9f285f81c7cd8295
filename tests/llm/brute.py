"""Plain versions of the operators, over lists of rows (doc_id, text), against which the queries are held."""

import hashlib
import math
import re
from collections import defaultdict

import xxhash

RADIUS = 7


def lines(docs):
    """(doc_id, text) after line deduplication; null ids count as the smallest."""
    first = {}
    for d, t in docs:
        for n, line in enumerate((t or "").split("\n")):
            at = (d is not None, d or 0, n)
            if line.strip(" \t\r") and (line not in first or at < first[line]):
                first[line] = at
    out = []
    for d, t in docs:
        kept = None if t is None else [x for n, x in enumerate(t.split("\n")) if not x.strip(" \t\r") or first[x] == (d is not None, d or 0, n)]
        out.append((d, None if kept is None else "\n".join(kept)))
    return out


def fingerprint(text):
    """128 bits, each the weighted vote of the distinct words' hashes; None without a word."""
    words = set(re.findall(r"\w+", (text or "").lower()))
    votes = [0] * 128
    for w in words:
        h = xxhash.xxh3_128_intdigest(w)
        for k in range(128):
            votes[k] += len(w) if h >> (127 - k) & 1 else -len(w)
    return sum(1 << (127 - k) for k, v in enumerate(votes) if v > 0) if words else None


def spark_hash(text):
    h = xxhash.xxh64_intdigest(text or "", 42)
    return h - 2**64 if h >= 2**63 else h


def near(docs, radius=RADIUS):
    """{(doc_id, text): (doc_id, text) that stays}, of those that go, comparing every pair."""
    known = {t: fingerprint(t) for _, t in docs}
    nodes = [(x, known[x[1]]) for x in {(d, t) for d, t in docs if d is not None} if known[x[1]] is not None]
    root = {x: x for x, _ in nodes}
    order = lambda x: (x[0], spark_hash(x[1]))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, (x, p) in enumerate(nodes):
        for y, q in nodes[:k]:
            if ((p ^ q) >> 64).bit_count() <= radius and ((p ^ q) & (2**64 - 1)).bit_count() <= 2 * radius:
                first, last = sorted((find(x), find(y)), key=order)
                root[last] = first
    return {x: find(x) for x in root if find(x) != x}


def spans(docs, least):
    """{doc_id: [(start, end)]}: the words in windows that a smaller doc_id has too."""
    at = defaultdict(set)
    texts = defaultdict(list)
    for d, t in docs:
        if d is not None and t is not None:
            texts[d].append(t.split())
    for d, many in texts.items():
        for words in many:
            for i in range(len(words) - least + 1):
                at[tuple(words[i : i + least])].add(d)
    out = {}
    for d, many in texts.items():
        covered = set()
        for words in many:
            for i in range(len(words) - least + 1):
                if min(at[tuple(words[i : i + least])]) < d:
                    covered.update(range(i, i + least))
        runs = []
        for i in sorted(covered):
            if runs and runs[-1][1] == i:
                runs[-1][1] = i + 1
            else:
                runs.append([i, i + 1])
        if runs:
            out[d] = [tuple(r) for r in runs]
    return out


def parse(docs, least):
    """{doc_id: [[(start, end)]]}: the greedy parse of each document by the longest match in any smaller doc_id, word by word; ids are unique."""
    texts = {d: t.split() for d, t in docs if d is not None and t is not None}
    out = {}
    for d, words in texts.items():
        reach = {}  # of each start the farthest end of a match of `least` words or more
        for e, other in texts.items():
            if e < d:
                ahead = [0] * (len(other) + 1)
                for i in range(len(words) - 1, -1, -1):
                    ahead = [ahead[j + 1] + 1 if words[i] == other[j] else 0 for j in range(len(other))] + [0]
                    if (n := max(ahead)) >= least:
                        reach[i] = max(reach.get(i, 0), i + n)
        spans, at = [], 0
        for i in range(len(words)):
            if i >= at and i in reach and (not spans or i > at or spans[-1][-1][1] != at):
                spans.append([(i, reach[i])])
                at = reach[i]
            while spans and spans[-1][-1][1] == at and (more := max((e for s, e in reach.items() if s <= at < e), default=0)):
                spans[-1].append((at, more))
                at = more
        if spans:
            out[d] = spans
    return out


def count(text):
    return len(re.findall(r"[^ \t\n\r]+", text or ""))


def copies(docs):
    """(doc_id, source, n_tokens, rate, copies) for rows (doc_id, text, source)."""
    total = defaultdict(int)
    for _, t, s in docs:
        total[s] += count(t)
    held = sum(total.values())
    roots = sum(math.sqrt(t) for t in total.values())
    out = []
    for d, t, s in docs:
        rate = math.sqrt(total[s]) * held / roots / total[s] if total[s] else 1.0
        u = int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:8], 16) / 2**32
        out.append((d, s, count(t), round(rate, 6), math.floor(rate) + (u < rate - math.floor(rate))))
    return out


def bins(lengths, capacity):
    """Remaining capacities of the bins after best-fit decreasing, one piece at a time."""
    room = []
    for n in sorted((p for length in lengths for p in [capacity] * (length // capacity) + [length % capacity] if p), reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(capacity - n)
    return sorted(room)
