"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import zlib

import public_tokenizers
from tokenizers import Tokenizer


def words(text):
    return (text or "").encode().split()


def word_texts(text):
    return [w.decode() for w in words(text)]


def measures(text):
    t = text or ""
    w = word_texts(t)
    lines = [x for x in t.split("\n") if words(x)]
    grams: dict = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {p for at in grams.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed


def normal(line):
    return " ".join(word_texts(line.lower()))


def kept_texts(rows, min_documents=10, per_mille=10, min_texts=10):
    """rows (doc_id, text, source) -> per row (kept, text without frequent lines)."""
    total: dict = {}
    often: dict = {}
    texts: dict = {}
    for _, t, s in rows:
        total[s] = total.get(s, 0) + 1
        for x in {normal(x) for x in (t or "").split("\n") if words(x)}:
            often[s, x] = often.get((s, x), 0) + 1
            texts.setdefault((s, x), set()).add(t)
    out = []
    for _, t, s in rows:
        most = max(1000 * min_documents, per_mille * total[s])
        gone = [i for i, x in enumerate((t or "").split("\n")) if words(x) and 1000 * often[s, normal(x)] > most and len(texts[s, normal(x)]) > min_texts]
        n, *_, failed = measures(t)
        removed = sum(len(words(x)) for i, x in enumerate((t or "").split("\n")) if i in set(gone))
        bad = removed > 0 and (100 * removed > 50 * n or n - removed < 50)
        left = "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in set(gone)) if gone else t
        out.append((not failed and not bad, left, len(gone), n - removed))
    return out


def deduped(rows, size=3):
    """rows (doc_id, text), ids distinct -> doc_id: (n_lines, n_removed, text)."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines = (text or "").split("\n")
        at = [i for i, x in enumerate(lines) if words(x)]
        gone = set()
        for k in range(len(at) - size + 1):
            w = tuple(normal(lines[i]) for i in at[k : k + size])
            if w in seen:
                gone |= set(at[k : k + size])
            seen.add(w)
        left = text if not gone else "" if len(gone) == len(at) else "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out[doc] = (len(at), len(gone), left)
    return out


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def components(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard(rows):
    sets = {d: shingle_set(t) for d, t in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = components(sets, linked)
    return {d: (len(sets[d]), comp[d], sum(d in p for p in linked)) for d in sets}


def cosine_links(rows, least=0.95):
    good = {i: [x / max(map(abs, v)) for x in v] for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    cos = lambda a, b: math.fsum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(math.fsum(x * x for x in a)) / math.sqrt(math.fsum(y * y for y in b))
    linked = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and cos(good[a], good[b]) >= least]
    comp = components([i for i, _ in rows], linked)
    return {i: (sum(i in p for p in linked), comp[i], comp[i] == i) for i, _ in rows}


def targets(sizes, weights=(3, 1, 2), share=1.5):
    """source: size -> source: target, by sharing the excess again until none is above twice its size."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] <= level * w[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        out |= {s: float(2 * sizes[s]) for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return out


def mixed(rows, seed="mix"):
    """rows (doc_id, text, source), ids distinct -> (target by source, words taken by doc_id)."""
    size = {d: len(words(t)) for d, t, _ in rows}
    total: dict = {}
    for d, _, s in rows:
        total[s] = total.get(s, 0) + size[d]
    want = targets(total)
    names = sorted((s for s in total if s is not None)) + ([None] if None in total else [])
    turn = {d: int(hashlib.md5(f"{seed}|{d}".encode()).hexdigest()[:12], 16) for d, _, _ in rows}
    queue, run = [], dict.fromkeys(total, 0)
    for d, _, s in sorted(rows, key=lambda r: (turn[r[0]], r[0])):
        run[s] += size[d]
        if size[d] and want[s] > 0:
            queue += [((run[s] + e * total[s]) / want[s], names.index(s), e, turn[d], d) for e in (0, 1)]
    taken, used, budget = dict.fromkeys(size, 0), 0, 1.5 * sum(total.values())
    for *_, d in sorted(queue):
        if used + size[d] > budget:
            break
        used += size[d]
        taken[d] += size[d]
    return want, taken


def tokens(text, _of=[]):
    if not _of:
        _of.append(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    return _of[0].encode(text or "", add_special_tokens=False).ids + [1]


def pieces(text, longest=2048):
    ids = tokens(text)
    at, out = 0, []
    while at < len(ids):
        n = min(longest, 1 << (len(ids) - at).bit_length() - 1)
        part = ids[at : at + n]
        out.append((at, n, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)), len(ids)))
        at += n
    return out
