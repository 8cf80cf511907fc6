"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def word_list(text):
    return WORD.findall((text or "").encode())


def repeated_words(docs, window):
    """{doc_id: (n_words, n_removed, sha of kept)} for rows (doc_id, text) with different ids."""
    lists = {i: word_list(t) for i, t in docs}
    first = {}
    for i in sorted(lists):
        for at in range(len(lists[i]) - window + 1):
            first.setdefault(tuple(lists[i][at:at + window]), i)
    out = {}
    for i, w in lists.items():
        gone = [False] * len(w)
        for at in range(len(w) - window + 1):
            if first[tuple(w[at:at + window])] < i:
                gone[at:at + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), sum(gone), sha(b" ".join(kept)))
    return out


def repeated_bytes(docs, length, keep="none"):
    """[(doc_id, n_bytes, n_removed, n_spans, sha of kept)] in the order of the rows."""
    texts = [(t or "").encode() for _, t in docs]
    places = defaultdict(list)
    for r in sorted(range(len(docs)), key=lambda r: docs[r][0]):
        for at in range(len(texts[r]) - length + 1):
            places[texts[r][at:at + length]].append((r, at))
    gone = [bytearray(len(t)) for t in texts]
    for found in places.values():
        for r, at in (found[1:] if keep == "first" else found if len(found) > 1 else []):
            gone[r][at:at + length] = b"\1" * length
    out = []
    for (i, _), t, g in zip(docs, texts, gone):
        kept = bytes(c for c, x in zip(t, g) if not x)
        out.append((i, len(t), sum(g), len(re.findall(b"\1+", bytes(g))), sha(kept)))
    return out


def shingles(text, size=5):
    w = word_list((text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).decode())
    if not w:
        return set()
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))}


def jaccard_components(docs, size=5, share=80):
    """{doc_id: (n_shingles, component)} for rows with different ids."""
    sets = {i: shingles(t, size) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= share * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def counts(items):
    return Counter(items)
