"""Plain restatements of the operators' contracts, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOLD = str.maketrans(UPPER, UPPER.lower())
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text, pattern=SPACED, fold=False):
    text = text or ""
    return pattern.findall(text.translate(FOLD) if fold else text)


def substring_dedup(docs, window=20):
    """[(doc_id, n_words, n_removed, kept)] for distinct ids."""
    seen, gone = set(), defaultdict(set)
    for doc, text in sorted(docs):
        w = words(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[doc].update(range(i, i + window))
            seen.add(key)
    out = []
    for doc, text in docs:
        w = words(text)
        out.append((doc, len(w), len(gone[doc]), " ".join(x for i, x in enumerate(w) if i not in gone[doc])))
    return sorted(out)


def line_dedup(docs, min_chars=40, min_docs=5):
    """[(doc_id, n_lines, n_dropped, kept)] for distinct ids."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    holders = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [line for line in lines if len(holders[key(line)]) < min_docs or doc == max(holders[key(line)])]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def shingles(text, width):
    w = words(text, fold=True)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) or frozenset([tuple(w)])


def near_dedup(docs, width, percent):
    """{doc_id: (n_shingles, component)} for distinct ids."""
    sets = {doc: shingles(text, width) for doc, text in docs}
    parent = {doc: doc for doc in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {doc: (len(sets[doc]), find(doc)) for doc in ids}


def decontaminate(docs, items, window=10):
    """[(doc_id, n_words, n_hit, items)]."""
    windows = defaultdict(set)
    for item, text in items:
        w = words(text, ALNUM, True)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[i : i + k])].add(str(item))
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w = words(text, ALNUM, True)
        hit, found = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if names := windows.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    found |= names
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out)


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def pii(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                (kind == "ip" and any(int(p) > 255 for p in m[0].split(".")))
                or (kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)))
                or (kind == "phone" and not 9 <= len(digits) <= 15)
            ):
                continue
            out.append((kind, *m.span()))
    return out


def secret_candidates(text):
    """Candidate spans, character by character: values of telling names first, then long runs that touch none of them."""
    runs, named = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", []
    names = ("password", "passwd", "passphrase", "pass", "pwd", "secret", "token", "apikey", "api_key", "credential", "auth", "private_key")
    for i, c in enumerate(text):
        if c not in "=:" or (named and i < named[-1][1]):
            continue
        before = text[max(0, i - 40) : i].lower()
        cut = [before[: len(before) - k] for k in range(3) if set(before[len(before) - k :]) <= set(" \t") and k <= len(before)]
        cut += [b[:-1] for b in cut if b[-1:] in ("'", '"')]
        tails = {b[len(b) - k :] for b in cut for k in range(len(b) + 1)}
        if not any(t.startswith(n) and len(t) - len(n) <= 16 and all(x == "_" or (x.isascii() and x.isalnum()) for x in t[len(n) :]) for t in tails for n in names):
            continue
        for skip in (2, 1, 0):
            at = i + 1 + skip
            if at > len(text) or set(text[i + 1 : at]) - set(" \t"):
                continue
            quote = text[at : at + 1]
            if quote and quote in "'\"":
                end = at + 1
                while end < len(text) and text[end] != quote and not text[end].isspace():
                    end += 1
                if text[end : end + 1] == quote and 6 <= end - at - 1 <= 128:
                    named.append((at + 1, end))
                    break
            else:
                end = at
                while end < len(text) and end - at < 128 and not text[end].isspace() and text[end] not in "\"',;":
                    end += 1
                if end - at >= 6:
                    end = at + len(text[at:end].rstrip(".)]}>"))
                    if end - at >= 6:
                        named.append((at, end))
                    break
    out, i = list(named), 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in runs:
            j += 1
        if j - i >= 12 and not any(a < j and i < b for a, b in named):
            start, end, body = i, j, text[i:j].rstrip("=")
            while "=" in body and 2 <= body.index("=") <= 20 and all(x in "_-" or x.isalpha() for x in body[: body.index("=")]):
                start, body = start + body.index("=") + 1, body[body.index("=") + 1 :]
            while end > start and text[end - 1] in "-_/":
                end -= 1
            if end - start >= 12:
                out.append((start, end))
        i = max(j, i + 1)
    return sorted(out)


def spot_signatures(text, anchors, chain=2):
    """Tuples (anchor, content words) of a text, before hashing."""
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if x]
    content = [i for i, x in enumerate(w) if x not in anchors]
    out = set()
    for j, i in enumerate(content):
        if i and w[i - 1] in anchors and j + chain <= len(content):
            out.add((w[i - 1], *[w[k] for k in content[j : j + chain]]))
    if out:
        return out
    return {("words", " ".join(w))} if w else ({("text", (text or "").lower())} if text else set())


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def counts(rows):
    return Counter(map(tuple, rows))
