"""Plain versions of what the operators compute, for small tables."""


def sets_of(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else (frozenset([tuple(w)]) if w else frozenset())


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def cut_words(rows, window):
    """(id, kept words, number removed) of each row (id, text)."""
    rows = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in rows:
        for p in range(len(w) - window + 1):
            if i is not None:
                x = tuple(w[p : p + window])
                first[x] = min(i, first.get(x, i))
    out = []
    for i, w in rows:
        gone = {p + j for p in range(len(w) - window + 1) if i is not None and first[tuple(w[p : p + window])] < i for j in range(window)}
        out.append((i, [x for n, x in enumerate(w) if n not in gone], len(gone)))
    return out
