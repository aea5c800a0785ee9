"""Small documents with the awkward cases, and brute-force versions of the operators."""

import hashlib
import re
from collections import Counter, defaultdict

DDL = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {k: k + 32 for k in range(65, 91)}

_BASE = " ".join(f"w{k}" for k in range(60))
_LONG = " ".join(f"word{k % 977} x{k}" for k in range(9000))


def rows():
    """(doc_id, text, lang, source, n_chars): nulls, empties, ties, repeated rows, near copies, one very long text."""
    texts = [
        (1, _BASE),
        (2, _BASE),  # exact copy
        (3, _BASE.replace("w30", "changed")),  # near copy
        (4, _BASE.replace("w5 ", "other ").replace("w50", "another")),
        (5, None),
        (6, ""),
        (7, " \n\t "),
        (8, "one two three"),
        (9, "One TWO three"),
        (10, "café 中文 \U0001f600 naïve " * 8 + "tail of its own"),
        (11, "a b a b a b a b " * 30),
        (12, _LONG),
        (13, "head " + _LONG[:3000] + " tail"),
        (14, "mail me at jo.doe@mail.example.com or +1 (555) 123-4567, card 4111 1111 1111 1111, host 10.0.0.1 " + _BASE),
        (14, "mail me at jo.doe@mail.example.com or +1 (555) 123-4567, card 4111 1111 1111 1111, host 10.0.0.1 " + _BASE),  # repeated row
        (None, _BASE + " and more without an id " + " ".join(f"z{k}" for k in range(40))),
        (15, "x" * 70000),
        (16, "line one is here\nline one is here\n\nline two\nline one is here\n"),
        (17, "<|endoftext|> special strings inside texts <|endoftext|>"),
        (18, "\x00nul\x1funit \x85next line\xa0hard"),
    ]
    langs = ["en", "fr", None]
    return [(i, t, langs[k % 3], "s" if k % 4 else None, len(t or "")) for k, (i, t) in enumerate(texts)]


def words(text):
    return WORD.findall(text or "")


def quality(text):
    text = text or ""
    w = words(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    mark = set()
    for k in range(len(w) - 2):
        if seen[w[k], w[k + 1], w[k + 2]] > 1:
            mark |= {k, k + 1, k + 2}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    failed = len(w) < 50 or 100 * len(mark) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(mark), failed


def shingles(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(docs):
    """{row number: (n, least id reachable)}"""
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        r = find(k)
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [(len(sets[k]), least.get(find(k), i)) for k, (i, _) in enumerate(docs)]


def repeats(docs, length=50):
    """For each row: bytes, removed, spans, hash of what is kept."""
    first = {}
    top = 2**63 - 1
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            first[s] = min(first.get(s, top), top if i is None else i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < (top if i is None else i):
                gone[k : k + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def luhn(d):
    v = [int(c) for c in d][::-1]
    return (sum(v[::2]) + sum(sum(divmod(2 * x, 10)) for x in v[1::2])) % 10 == 0


def pii(text):
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, lo, hi in (("card", r"[0-9]([\x20-]?[0-9])+", 13, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if lo <= len(d) <= hi and (kind == "phone" or luhn(d)):
                out.append((kind, *m.span()))
    return out


def base_score(docs, held):
    """For each row: tokens, known, N, base score."""
    import math

    toks = [[*words((t or "").translate(LOWER)), None] for _, t in docs]
    count = Counter(x for (i, _), ts in zip(docs, toks) if not held(i) for x in ts)
    n, v = sum(count.values()), len(count)
    return [(len(ts), sum(count[x] > 0 for x in ts), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in ts)) for ts in toks]


def by_id(result):
    out = defaultdict(list)
    for r in result:
        out[r["doc_id"]].append(r)
    return out
