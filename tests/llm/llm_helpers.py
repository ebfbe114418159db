"""Plain-Python versions of the operators' contracts, and awkward documents."""
import random
import re

AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, score string, kept int, items string, " \
          "lang_pred int, ids string, found string, n_lines string, n int, cid string, token string, h string"
ALPHA = {c: c + 32 for c in range(65, 91)}


def docs(spark, rows):
    """(doc_id, text) rows in a table whose other columns clash with the operators' own names."""
    data = [(i, t, "en", "s", len(t) if t is not None else None, "x", 1, "x", 2, "x", "x", "x", 3, "x", "x", "x") for i, t in rows]
    return spark.createDataFrame(data, AWKWARD)


def prose(rnd, words, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(words))


def words_ws(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ALPHA))


def words_alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ALPHA))


def shingles(words, k=5):
    if not words:
        return set()
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def components(nodes, links):
    """node -> smallest node it reaches."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_components(rows):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = {i: shingles(words_ws(t)) for i, t in rows}
    ids = sorted(sets)
    links = [
        (a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    found = components(ids, links)
    return {i: (len(sets[i]), found[i]) for i in ids}


def dropped_lines(rows, min_docs=10):
    """Per row (doc_id, lines, dropped, kept text)."""
    def key(line):
        return line.strip(" \t\n\x0b\f\r").translate(ALPHA)

    where = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            where.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or len(where[key(x)]) < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def contained_items(rows, items, containment=0.8):
    out = []
    for d, t in rows:
        w = words_alnum(t)
        for i, x in items:
            v = words_alnum(x)
            if v:
                k = min(5, len(v))
                want, have = shingles(v, k), shingles(w, k) if len(w) >= k else set()
                if 10 * len(want & have) >= 8 * len(want):
                    out.append((d, i, len(want), len(want & have)))
    return sorted(out, key=repr)


def near_copy(rnd, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
    return " ".join(w)
