"""Plain Python versions of the corpus operators, for small inputs."""

import re
from collections import Counter

import numpy as np

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def kept_lines(texts, min_docs):
    """(number of lines, dropped, text left) of each text."""
    lines = [(t or "").split("\n") for t in texts]
    key = lambda line: line.strip("\t\n\x0b\x0c\r ").translate(FOLD)
    seen = Counter(k for own in lines for k in {key(line) for line in own} if k)
    out = []
    for own in lines:
        left = [line for line in own if seen[key(line)] < min_docs]
        out.append((len(own), len(own) - len(left), "\n".join(left)))
    return out


def shingles(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))) if found else frozenset()


def near_groups(texts, words, percent):
    """(set size, smallest linked number) of each text, by comparing all pairs."""
    sets = [shingles(t, words) for t in texts]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def without_repeats(texts, length):
    """(bytes, removed, spans, bytes left, flags of removed bytes) of each text, by counting every window."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.diff(np.concatenate([[False], gone]).astype(int))
        out.append((len(d), int(gone.sum()), int((edges == 1).sum()), bytes(b for b, g in zip(d, gone) if not g), gone[:-1]))
    return out


def whole_letters(text, gone):
    """The text without the letters all of whose bytes are gone."""
    out, at = [], 0
    for letter in text:
        size = len(letter.encode())
        if not gone[at : at + size].all():
            out.append(letter)
        at += size
    return "".join(out)


def sha(text):
    import hashlib

    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def merkle_field(value):
    return "-" if value is None else f"{len(str(value).encode('utf-8'))}:{value}"


def merkle_tree(nodes):
    """Levels of a tree, bottom first: pairs become their hash, an odd last node its own hash, until one is left."""
    levels = [list(nodes)]
    while len(levels[-1]) > 1:
        cur = levels[-1]
        levels.append([sha("".join(cur[i : i + 2])) for i in range(0, len(cur), 2)])
    return levels


def merkle_path(levels, place):
    """Per level (sibling or None, sibling stands left)."""
    out = []
    for level in levels[:-1]:
        other = place ^ 1
        out.append((level[other] if other < len(level) else None, other < place))
        place >>= 1
    return out


def merkle_manifest(rows, tampered):
    """rows: dicts of doc_id, source, lang, n_chars, text. Per row (leaf, subroot, root, proof, folded, verified)."""
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    leaf = lambda r: sha("".join(merkle_field(r[f]) for f in fields))
    by_lang = {}
    for i, r in enumerate(rows):
        by_lang.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), i))
    langs = sorted(by_lang, key=lambda g: (g is not None, (g or "").encode("utf-8")))
    trees = {g: merkle_tree([x[2] for x in sorted(by_lang[g])]) for g in langs}
    top = merkle_tree([trees[g][-1][0] for g in langs])
    out = [None] * len(rows)
    for gi, g in enumerate(langs):
        for place, (_, _, lf, i) in enumerate(sorted(by_lang[g])):
            path = merkle_path(trees[g], place) + merkle_path(top, gi)
            r = rows[i]
            node = sha("".join(merkle_field(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"] + 1, r["text"]))) if tampered(r) else lf
            for sib, left in path:
                node = sha(node if sib is None else (sib + node if left else node + sib))
            proof = sha("".join(s for s, _ in path if s is not None))
            out[i] = (lf, trees[g][-1][0], top[-1][0], proof, node, node == top[-1][0])
    return out


def brute_runs(w):
    """Runs (start, length, period) by trying every period and start."""
    n, out = len(w), set()
    for q in range(1, n + 1):
        for s in range(n):
            if s > 0 and s - 1 + q < n and w[s - 1] == w[s - 1 + q]:
                continue
            e = s + q
            while e < n and w[e] == w[e - q]:
                e += 1
            length = e - s
            if e > n or length < max(6, 4 * q):
                continue
            smallest = next(p for p in range(1, length + 1) if all(w[s + i] == w[s + i + p] for i in range(length - p)))
            if smallest == q:
                out.add((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def quality_rows(rows, min_docs=10):
    """Per row (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_lines, removed_chars)."""
    blank = "\x20\x09\x0a\x0b\x0c\x0d"
    out, keys = [], []
    for r in rows:
        t = r["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [ln for ln in t.split("\n") if any(c not in blank for c in ln)]
        dup = sum(1 for i, ln in enumerate(lines) if ln in lines[:i])
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        cover = set()
        for i, g in enumerate(grams):
            if grams.count(g) > 1:
                cover.update(range(i, i + 3))
        norm = [re.sub(r"[\x20\x09-\x0D]+", " ", ln.lower()).strip(" ") for ln in lines]
        keys.append((r["source"], norm, [sum(len(w) for w in re.findall(r"[^\x20\x09-\x0D]+", ln)) for ln in lines]))
        out.append([len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(cover)])
    held = Counter((host, k) for host, norm, _ in keys for k in set(norm))
    for row, (host, norm, chars) in zip(out, keys):
        gone = [c for k, c in zip(norm, chars) if held[(host, k)] >= min_docs]
        row += [len(gone), sum(gone)]
    return [tuple(r) for r in out]
