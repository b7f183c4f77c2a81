"""Plain versions of the operators, for comparison on small tables, and a small table that holds the awkward cases."""

import collections
import hashlib
import random
import re

SPACE = b" \t\n\r\x0b\x0c"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def raw(text):
    return (text or "").encode()


def words(text):
    return raw(text).split()


def corpus(seed=7, n=60):
    """(doc_id, text, lang, source): random prose with copies, near copies, shared passages, repeated lines, and odd rows."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    passage = " ".join(r.choice(vocab) for _ in range(90))
    rows = []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.choice([3, 20, 60, 150, 400]))]
        if i % 3 == 0:
            at = r.randint(0, len(w))
            w[at:at] = passage.split()[r.randint(0, 5) :]
        text = " ".join(w)
        if i % 4 == 0:
            text += "\nAll pages carry this line.\n" + r.choice(vocab)
        rows.append((i + 1, text, "en" if i % 5 else None, f"s{i % 4}" if i % 7 else None))
    for i in range(12):  # copies and near copies
        base = rows[r.randrange(n)][1].split(" ")
        for _ in range(r.randint(0, 3)):
            base[r.randrange(len(base))] = "CHANGED"
        rows.append((100 + i, " ".join(base), "fr", "s1"))
    rows += [(200, rows[0][1], "en", "s0"), (200, rows[0][1], "en", "s0"), (201, rows[3][1].upper(), "de", "s2"), (None, rows[1][1], "en", "s1"), (None, None, None, None)]
    rows += [(202, None, "en", "s0"), (203, "", "en", "s0"), (204, " \n\t ", "en", "s0"), (205, "one two", "es", "s3"), (206, "One TWO", "es", "s3"), (207, "ab " * 900, "en", "s3"), (208, "x" * 3000, "en", "s3")]
    rows += [(209, "Ünï — 日本語 テキスト 😀 " * 40, "ja", "s9"), (210, "nul \x00 byte \x0b and \x1f unit", "en", "s9"), (3, "same id, other text " * 30, "en", "s1")]
    return rows


def table(spark, rows):
    """With extra columns whose names the operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, n int, size long, tkey string, marks int, words string"
    return spark.createDataFrame([(*row, len(row[1] or ""), 1, 2, "k", None, "w") for row in rows], schema)


def windows10(rows, width=50):
    first = {}
    for i, text, *_ in rows:
        w = words(text)
        for s in range(len(w) - width + 1 if i is not None else 0):
            key = tuple(w[s : s + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text, *_ in rows:
        w = words(text)
        gone = set()
        for s in range(len(w) - width + 1 if i is not None else 0):
            if first[tuple(w[s : s + width])] < i:
                gone |= set(range(s, s + width))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return out


def bytes5(rows, width=400):
    count = collections.Counter()
    for _, text, *_ in rows:
        b = raw(text)
        count.update(b[s : s + width] for s in range(len(b) - width + 1))
    out = []
    for i, text, *_ in rows:
        b = raw(text)
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if count[b[s : s + width]] > 1:
                gone[s : s + width] = b"\1" * width
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def shingles(text, n=5):
    w = raw(text).translate(LOWER).split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < n else frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def jaccard9(rows):
    """Rows with equal ids are one document."""
    sets = [shingles(text) for _, text, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            alike = sets[a] and sets[b] and 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o)
            if alike or (rows[a][0] is not None and rows[a][0] == rows[b][0] and sets[a] and sets[b]):
                parent[find(a)] = find(b)
    best = {}
    for a, (i, *_) in enumerate(rows):
        if i is not None and sets[a]:
            root = find(a)
            best[root] = min(best.get(root, i), i)
    return [(i, len(sets[a]), best.get(find(a)) if sets[a] else i) for a, (i, *_) in enumerate(rows)]


def base2(text):
    w = words(text)
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for i, g in enumerate(zip(w, w[1:], w[2:])):
        if grams[g] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed


def key(row):
    return tuple((x is None, 0 if x is None else x) for x in row)


def same(got, want):
    return sorted(map(key, got)) == sorted(map(key, want))


def collocations11(rows, least=10, most=3, inside=50, top=2000):
    """rows: (text, lang)."""
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER_TEXT)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + m]) for m in range(1, most + 1) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longer = collections.Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        found = []
        for p, a in candidates.items():
            if not longer[p] or 100 * longer[p] < inside * a:
                score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return out


LOWER_TEXT = {c: c + 32 for c in range(65, 91)}


def vectors12(rows, cosine=0.93):
    """rows: (vec_id, vector, label); compares all pairs."""
    import math

    def unit(v, label):
        if v is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        most = max(map(abs, v))
        v = [x / most for x in v]
        norm = math.sqrt(sum(x * x for x in v))
        return [x / norm for x in v]

    units = [unit(v, label) for _, v, label in rows]
    links = [[] for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if units[a] and units[b] and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and sum(x * y for x, y in zip(units[a], units[b])) >= cosine:
                links[a].append(b)
                links[b].append(a)
    out = []
    for a in range(len(rows)):
        seen, queue = {a}, [a]
        while queue:
            for b in links[queue.pop()]:
                if b not in seen:
                    seen.add(b)
                    queue.append(b)
        least = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        out.append((rows[a][0], len(links[a]), least, least == rows[a][0]))
    return out
