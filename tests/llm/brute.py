"""Plain versions of the operators, one text at a time."""
import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring_dedup(rows, length=20):
    """rows: (doc_id, text) -> {(doc_id, text): (n_words, n_removed, kept_sha256)}"""
    first = {}
    texts = {(i, t): WORD.findall(t or "") for i, t in rows}
    order = sorted(texts, key=lambda k: (k[0] is None, k[0] or 0))
    for key in order:
        w = texts[key]
        place = (key[0] is None, key[0] or 0)
        for s in range(len(w) - length + 1):
            win = tuple(w[s:s + length])
            first[win] = min(first.get(win, (place, s)), (place, s))
    out = {}
    for key in order:
        w = texts[key]
        place = (key[0] is None, key[0] or 0)
        gone = set()
        for s in range(len(w) - length + 1):
            if first[tuple(w[s:s + length])] < (place, s):
                gone.update(range(s, s + length))
        out[key] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


CONTAM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def decontaminate(rows, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        w = CONTAM.findall((text or "").translate(LOWER))
        size = min(window, len(w))
        for s in range(len(w) - size + 1 if size else 0):
            windows[tuple(w[s:s + size])].add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for key in rows:
        w = CONTAM.findall((key[1] or "").translate(LOWER))
        hit, found = set(), set()
        for size in sizes:
            for s in range(len(w) - size + 1):
                got = windows.get(tuple(w[s:s + size]))
                if got:
                    hit.update(range(s, s + size))
                    found |= got
        out[key] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def quality(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    tri = Counter(zip(w, w[1:], w[2:]))
    rep = {p for s in range(len(w) - 2) if tri[tuple(w[s:s + 3])] > 1 for p in (s, s + 1, s + 2)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep),
            len(w) < 50 or 100 * len(rep) > 50 * len(w))


def secrets(text):
    t = text or ""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 32]
    spans.sort()
    n = [sum(s[1] == k for s in spans) for k in range(3)]
    return (*n, sha(",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans)))
