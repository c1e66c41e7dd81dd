"""Plain Python forms of the operators, for tests on small tables."""

import hashlib
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def near_components(rows, percent=80):
    """{id: (size, component)} of distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    where, parent = {}, {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in sets.items():
        common = Counter(j for x in s for j in where.get(x, ()))
        for j, k in common.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            where.setdefault(x, []).append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def secrets(text):
    text, out = text or "", []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 32]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def repetition(text):
    text = text or ""
    w, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    covered = {i + d for i, g in enumerate(grams) if count[g] > 1 for d in range(3)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


def spelling(rows):
    """(word, form, root, n, n_near, form_n) of (id, text) rows."""
    count = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            count[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    known = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    cut = lambda w: {w[:k] + w[k + 1 :] for k in range(len(w))}
    near = lambda a, b: a != b and (sum(x != y for x, y in zip(a, b)) == 1 if len(a) == len(b) else b in cut(a) or a in cut(b))
    where = {}
    for w in known:
        for k in {w, *cut(w)}:
            where.setdefault(k, []).append(w)
    out = {}
    for w, n in known.items():
        found = {x for k in {w, *cut(w)} for x in where[k] if near(w, x)}
        best = min(found, key=lambda x: (-known[x], x), default=None)
        out[w] = (best if best and known[best] >= 10 * n else None, n, len(found))
    def root(w):
        return root(out[w][0]) if out[w][0] else w

    return [(w, form, root(w), n, k, known[form] if form else None) for w, (form, n, k) in out.items()]


def repeated(rows, length=50):
    """(id, bytes, removed, spans, what is left) of (id, text) rows."""
    first, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1 if i is not None else 0):
            first[b[p : p + length]] = min(i, first.get(b[p : p + length], i))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1 if i is not None else 0):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def collocations(rows, least=100):
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text) rows."""
    f, n = Counter(), Counter()
    for lang, t in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", (t or "").translate(LOWER)):
            w = re.findall("[^\\x20\\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    good = {p: a for p, a in f.items() if a >= least}
    dead = {(lang, w[i : i + k]) for (lang, w), a in good.items() for k in range(1, len(w)) for i in range(len(w) - k + 1) if a >= f[lang, w[i : i + k]]}
    scored = {}
    for (lang, w), a in good.items():
        if len(w) > 1 and (lang, w) not in dead:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            scored.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return [(lang, rank, p.decode(), -a, x, y, n[lang], -s) for lang, rows in scored.items() for rank, (s, a, p, x, y) in enumerate(sorted(rows)[:2000], 1)]
