"""Plain versions that the operators are held against."""

import hashlib

import numpy as np
import xxhash


def components(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def simhash(text, width=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lower + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def simhash_groups(rows, radius=3):
    ids = [r[0] for r in rows]
    fp = np.array([simhash(r[1]) for r in rows], np.uint64)
    links = []
    for i in range(len(ids)):
        near = np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= radius) + i + 1
        links += [(ids[i], ids[j]) for j in near.tolist()]
    comp = components(ids, links)
    return [(i, f"{int(f):016x}", comp[i]) for i, f in zip(ids, fp, strict=True)]


def remove_repeats(rows, length=50):
    """rows (doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, sha256 of the rest)."""
    least = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            least[s] = min(least.get(s, i), i)
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if least[t[p : p + length]] < i:
                gone[p : p + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(gone) else 0))
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def vector_links(rows, threshold=0.93):
    """rows (vec_id, vector, label) -> {vec_id: (n_links, component_id)}."""
    good = {}
    for i, v, lab in rows:
        if v is not None and lab is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault((lab, len(v)), []).append((i, np.array(v, np.float64)))
    links, n = [], {r[0]: 0 for r in rows}
    for group in good.values():
        x = np.stack([v / np.linalg.norm(v) for _, v in group])
        for a in range(len(x)):
            for b in (np.flatnonzero(x[a + 1 :] @ x[a] >= threshold) + a + 1).tolist():
                links.append((group[a][0], group[b][0]))
                n[group[a][0]] += 1
                n[group[b][0]] += 1
    comp = components([r[0] for r in rows], links)
    return {i: (n[i], comp[i]) for i in n}
