"""Plain Python versions of what the operators compute."""
from collections import Counter

import xxhash

SF = "/root/testdata/sf0.001"
DOCS = "The cat sat on the mat and it was there.\nThe cat sat on the mat and it was there.\nA line of its own stands here too."
SPACES = " \t\n\x0b\x0c\r"


def docs_of(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words(t):
    for c in SPACES:
        t = t.replace(c, " ")
    return [w for w in t.split(" ") if w]


def shingles(t, n=5):
    w = words(lower(t))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def plain_fingerprint(t):
    w = words(lower(t or ""))
    if not w:
        return 0
    grams = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def plain_groups(fps, radius=2):
    """Smallest id that chains of links reach, by id."""
    first = {i: i for i in fps}
    def find(i):
        while first[i] != i:
            i = first[i]
        return i
    ids = sorted(fps)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                first[y] = x
    return {i: find(i) for i in ids}


def line_key(line):
    return lower(line.strip(SPACES))


def keep_lines(docs):
    """{doc_id: text} after line de-duplication."""
    owner = {}
    for i, t in docs.items():
        for line in (t or "").split("\n"):
            k = line_key(line)
            if len(k) >= 10:
                owner[k] = min(owner.get(k, i), i)
    return {i: t if t is None else "\n".join(x for x in t.split("\n") if owner.get(line_key(x), i) == i) for i, t in docs.items()}


def plain_counts(t):
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)
