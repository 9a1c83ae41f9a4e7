"""A plain model of the engine's answers, over lists of (key, size, class)."""

from collections import Counter, defaultdict


def listing(objects, prefix):
    out = defaultdict(lambda: [0, Counter()])
    for key, size, cls in objects:
        if key.startswith(prefix):
            rest = key[len(prefix) :]
            cut = rest.find("/")
            name, is_dir = (rest[: cut + 1], True) if cut >= 0 else (rest, False)
            out[name, is_dir][0] += 1
            out[name, is_dir][1][cls] += size
    return {k: (n, {c: b for c, b in by.items() if b}) for k, (n, by) in out.items()}


def directories(objects):
    return {""} | {key[: i + 1] for key, _, _ in objects for i, c in enumerate(key) if c == "/"}


def pages(objects, prefix, delimiter, k):
    """Requests, contents and prefixes of a listing, page by page."""
    if not delimiter:
        names = sorted(key for key, _, _ in objects if key.startswith(prefix))
        return max(1, -(-len(names) // k)), len(names), []
    entries = sorted(listing(objects, prefix))
    return max(1, -(-len(entries) // k)), sum(not d for _, d in entries), [prefix + n for n, d in entries if d]


def simulate(objects, strategy, depth, k):
    requests = contents = prefixes = 0
    todo = [("", 0)]
    limit = {"s1-recursive": 0, "s2-probe-root": 1, "s3-current": depth, "s4-worksteal": 10**9}[strategy]
    while todo:
        p, d = todo.pop()
        r, c, below = pages(objects, p, "/" if d < limit else "", k)
        requests += r
        contents += c
        prefixes += len(below)
        todo += [(b, d + 1) for b in below]
    return requests, contents, prefixes


def trie(keys):
    """Nodes of a compressed trie built by inserting keys: path -> (parent, has key, children)."""
    keys = sorted({k.encode() for k in keys})
    inner = {b""}
    for a, b in zip(keys, keys[1:], strict=False):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        inner.add(a[:n])
    nodes = inner | set(keys)
    parent = {p: max((q for q in inner if p != q and p.startswith(q)), key=len, default=None) for p in nodes}
    children = Counter(parent.values())
    return {p: (parent[p], p in set(keys), children[p], p in inner) for p in nodes}
