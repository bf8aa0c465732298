"""Plain Python versions of the contracts, for small inputs."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_az(s):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), s)


def op2_base(text):
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    marked = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    base = len(w) < 10 or 100 * len(marked) > 20 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(marked), base)


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def op9_base(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def shingles(text):
    w = WORD.findall(lower_az(text or ""))
    if not w:
        return frozenset()
    if len(w) < 5:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def components(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {i: find(i) for i in ids}


def op6(docs, percent=85):
    """docs: {doc_id: text}. {doc_id: (n_shingles, component_id)}"""
    sets = {k: shingles(v) for k, v in docs.items()}
    by = {}
    for k, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(k)
    shared = Counter()
    for ks in by.values():
        for i, a in enumerate(ks):
            for b in ks[i + 1 :]:
                shared[a, b] += 1
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    comp = components(docs, links)
    return {k: (len(sets[k]), comp[k]) for k in docs}


def op5(docs, length=400):
    """docs: list of texts. For each the list of maximal removed runs and the bytes that remain."""
    data = [(t or "").encode() for t in docs]
    seen = Counter(hash(d[i : i + length]) for d in data for i in range(len(d) - length + 1))  # the strings themselves would be gigabytes
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[hash(d[i : i + length])] > 1:
                gone[i : i + length] = b"\1" * length
        runs = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((runs, bytes(c for c, g in zip(d, gone, strict=True) if not g)))
    return out


def op10(docs, least=10):
    """docs: list of texts. For each (n_lines, n_dropped, kept text)."""
    key = lambda line: lower_az(line.strip(" \t\n\x0b\x0c\r"))
    lines = [(t or "").split("\n") for t in docs]
    n = Counter(k for ls in lines for k in {key(x) for x in ls})
    out = []
    for ls in lines:
        kept = [x for x in ls if not (key(x) and n[key(x)] >= least)]
        out.append((len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def op4_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_az(text or ""))
    at = []
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        at += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def shares_passage(docs, words=51):
    """docs: list of texts. For each whether another one has ``words`` of its words in a row."""
    w = [WORD.findall(t or "") for t in docs]
    of = {}
    for i, x in enumerate(w):
        for k in range(len(x) - words + 1):
            of.setdefault(hash(tuple(x[k : k + words])), set()).add(i)
    return [any(len(of[hash(tuple(x[k : k + words]))]) > 1 for k in range(len(x) - words + 1)) for x in w]
