"""Plain versions of the operators, over all rows of a small table at once."""

import hashlib
import re
import zlib
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def licence(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    at = [(i, k) for k, p in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({k for _, k in at}))


def near(rows, percent=85):
    """doc_id -> (shingles, component) for distinct ids."""
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    post = {}
    for i, s in sets.items():
        for x in s:
            post.setdefault(x, []).append(i)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in post[x] if j > i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in sets}


def pii(text):
    text = text or ""
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[ -]", "", m)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    out = [(m.start(), k, m.end(), name) for k, (name, (p, good)) in enumerate(kinds.items()) for m in re.finditer(p, text) if good(m.group())]
    spans = ",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(out))
    return (*(sum(x[1] == k for x in out) for k in range(4)), sha(spans), spans)


def luhn(digits):
    odd = [int(x) for x in digits[-1::-2]]
    even = [sum(divmod(2 * int(x), 10)) for x in digits[-2::-2]]
    return (sum(odd) + sum(even)) % 10 == 0


def exact(rows):
    """One tuple for each row."""
    whole = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), t in zip(rows, whole):
        groups.setdefault(t, []).append(i)
    low = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return [(i, low[t], len(groups[t]), i == low[t], sha(t)) for (i, _), t in zip(rows, whole)]


def passages(rows, size=35):
    words = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[k : k + size]) for w in words for k in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - size + 1):
            if count[tuple(w[k : k + size])] > 1:
                gone.update(range(k, k + size))
        left = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), sha(" ".join(left))))
    return out


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
