"""Plain Python versions of what the operators must return, for small inputs."""

import hashlib
import math
import re
from collections import defaultdict

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def contamination(docs, items, window=10):
    where = defaultdict(set)
    for item_id, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if w else ():
            where[tuple(w[i : i + n])].add(str(item_id))
    widths = {len(k) for k in where}
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in widths:
            for i in range(len(w) - n + 1):
                if ids := where.get(tuple(w[i : i + n])):
                    found |= ids
                    hit.update(range(i, i + n))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def licences(docs):
    out = []
    for doc_id, text in docs:
        w, at, labels = words(text), [], set()
        for label, phrase in PHRASES.items():
            p = phrase.split()
            here = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        out.append((doc_id, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    return out


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_duplicates(docs, bits=4):
    fps = defaultdict(list)
    for doc_id, text in docs:
        fps[fingerprint(text)].append(doc_id)
    keys, parent = list(fps), {f: f for f in fps}

    def find(f):
        while parent[f] != f:
            parent[f] = parent[parent[f]]
            f = parent[f]
        return f

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                parent[find(a)] = find(b)
    least = defaultdict(lambda: None)
    for f, ids in fps.items():
        known = [i for i in ids if i is not None]
        if known:
            least[find(f)] = min([*known, *([least[find(f)]] if least[find(f)] is not None else [])])
    return [(i, f"{f:016x}", least[find(f)]) for f, ids in fps.items() for i in ids]


def exact(docs):
    groups = defaultdict(list)
    for doc_id, text in docs:
        groups[(text or "").translate(LOWER)].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        stays = ids.index(keep)
        out += [(i, keep, len(ids), at == stays, hashlib.sha256(text.encode()).hexdigest()) for at, i in enumerate(ids)]
    return out


def ftrl(examples, epochs, alpha, beta, l1, l2):
    """FTRL-proximal over (set of features, label), coordinate by coordinate; {feature: weight}, the bias under None."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        least = 0 if i is None else l1
        if abs(z[i]) <= least:
            return 0.0
        return (math.copysign(least, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for found, label in examples:
            w = {i: weight(i) for i in [*found, None]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in w:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in list(z)}


def toxic_features(text):
    """Words, neighbours and pairs around one word, as they read, repeats included."""
    w = words(text)
    return [*w, *(("next", *p) for p in zip(w, w[1:])), *(("skip", *p) for p in zip(w, w[2:]))]


def subword_sgd(examples, vectors, orders, rate):
    """Softmax over the mean of learned vectors, one text and one number at a time: out, bias after training.

    ``examples``: ({slot: share}, label); ``vectors``: {slot: list}, trained in place; ``orders``: the texts' order in each epoch.
    """
    dim = len(next(iter(vectors.values())))
    out, bias, done, steps = [[0.0] * dim, [0.0] * dim], [0.0, 0.0], 0, len(examples) * len(orders)
    for i in (i for order in orders for i in order):
        (share, label), now = examples[i], rate * (1 - done / steps)
        done += 1
        mean = [sum(s * vectors[k][d] for k, s in share.items()) for d in range(dim)]
        x = [sum(o * m for o, m in zip(out[c], mean)) + bias[c] for c in (0, 1)]
        p = [math.exp(v) / (math.exp(x[0]) + math.exp(x[1])) for v in x]
        miss = [p[c] - (c == label) for c in (0, 1)]
        back = [miss[0] * out[0][d] + miss[1] * out[1][d] for d in range(dim)]
        for c in (0, 1):
            out[c] = [o - now * miss[c] * m for o, m in zip(out[c], mean)]
            bias[c] -= now * 0.1 * miss[c]
        square = sum(s * s for s in share.values())
        for k, s in share.items():
            vectors[k] = [v - now / square * s * g for v, g in zip(vectors[k], back)]
    return out, bias


def quality_tokens(text):
    """Words, neighbours (any word twice in a row is one token) and runs of 3 and 4 bytes of a text, repeats included."""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    b = (text or "").encode()
    pairs = [("again",) if p == q else (p, q) for p, q in zip(w, w[1:])]
    return [*w, *pairs, *(b[i : i + n] for n in (3, 4) for i in range(len(b) - n + 1))]


def kept_paths(blocks):
    """Indices of the blocks that the ratios of tag paths keep; blocks: (path of (element, tag), text, links, marked, linkable, named).

    Every sum runs over all blocks anew; an element is a number, a path the tags around it.
    """
    import math
    import re
    from collections import Counter

    from quern.llm import html_text as H

    path = [tuple(t for _, t in p) for p, *_ in blocks]
    size = [len(t) for _, t, *_ in blocks]
    links = [min(b[2], size[i]) for i, b in enumerate(blocks)]
    marks = [len(re.findall(r"[.,;:!?…。、，！？¿¡]", t)) for _, t, *_ in blocks]
    named = [b[5] for b in blocks]

    def ratio(own, linked=None):
        own = list(own)
        total, n = sum(size[i] for i in own), len(own)
        linked = sum(links[i] for i in own) / total if linked is None else linked
        return math.log1p(total / n) * math.log1p(1 + sum(marks[i] for i in own) / n) * (1 - linked)

    every = range(len(blocks))
    below = lambda p: [i for i in every if path[i][: len(p)] == p]
    mass = lambda p: sum((size[i] - links[i]) * (H.PRIOR if named[i] else 1) for i in below(p))
    around = {p[:n] for p in path for n in range(len(p) + 1)}
    outer = {}
    for i in every:
        if blocks[i][3] and not named[i]:
            at = next(n for n in range(1, len(path[i]) + 1) if path[i][n - 1] in ("article", "main"))
            outer[path[i][:at]] = outer.get(path[i][:at], 0) + size[i] - links[i]
    order = {}
    for p, *_ in blocks:
        for n in range(len(p) + 1):
            order.setdefault(tuple(t for _, t in p[:n]), len(order))
    if outer:
        parts = {p for p, m in outer.items() if m >= H.FAIR * max(outer.values())}
    else:
        at = ()
        kids = lambda p: [q for q in sorted(around, key=order.get) if len(q) == len(p) + 1 and q[: len(p)] == p]

        def one(q):
            sizes = Counter()
            for i in below(q):
                sizes[blocks[i][0][: len(q)]] += size[i] - links[i]
            return mass(q) * max(sizes.values()) / max(1, sum(sizes.values()))

        while inner := [q for q in kids(at) if q[-1] in H._LAYOUT and kids(q) and one(q) > H.CORE * mass(at)]:
            at = inner[0]
        parts = {at}
        if at and len(at) > 1 and at[-2] in H._CONTAINERS:
            parts |= {q for q in kids(at[:-1]) if q[-1] in ("h1", "h2")}
    part = lambda p: next((p[:n] for n in range(len(p) + 1) if p[:n] in parts), None)
    held = Counter()
    for element in {p[:n] for p, *_ in blocks for n in range(1, len(p) + 1)}:
        held[tuple(t for _, t in element)] += 1
    inside = [i for i in every if part(path[i]) is not None]
    fused = {}
    for key in {(path[i], named[i]) for i in every}:
        own = [i for i in every if (path[i], named[i]) == key]
        beside = [i for i in every if (path[i][:-1], named[i]) == (key[0][:-1], key[1]) and bool(path[i]) == bool(key[0])] if key[0] else [i for i in every if len(path[i]) < 2 and named[i] == key[1]]
        linked = sum(links[i] for i in own) / sum(size[i] for i in own)
        if part(key[0]) is not None and blocks[own[-1]][3] and blocks[own[-1]][4]:
            linked = (linked + sum(links[i] for i in inside) / sum(size[i] for i in inside)) / 2
        fused[key] = (ratio(own, linked) + ratio(beside, linked)) / 2 * (H.PRIOR if key[1] else 1)
    weight = lambda key: sum((size[i] - links[i]) * (H.PRIOR if key[1] else 1) for i in every if (path[i], named[i]) == key) if part(key[0]) is not None else -1
    level = fused[max(fused, key=lambda key: (weight(key), order[key[0]], key[1]))] if fused else 0

    def is_poor(p):
        own = [i for i in below(p) if part(path[i]) is not None]
        running = [i for i in own if path[i][-1] == "p" or path[i][-1] in H._CONTAINERS]
        if p[-1] not in H._CONTAINERS or not running or ratio(running) >= H.MID * level:
            return False
        total = sum(size[i] for i in own)
        boxes = [q for q in around if q[:-1] == p and len(q) == len(p) + 1 and q[-1] in H._CONTAINERS and held[q] >= 2 * held[p] and any(i in running for i in below(q))]
        titles = sum(size[i] for i in own if len(path[i]) == len(p) + 1 and path[i][-1] in H._HEADINGS)
        return sum(links[i] for i in own) >= H.LINKED * total or any(sum(size[i] for i in below(q)) >= H.LISTED * (total - titles) for q in boxes)

    def is_kept(key):
        p, own = key[0], part(key[0])
        if fused[key] <= 0:
            return False
        if own is None:
            holder = p if p[-1] in H._CONTAINERS or any(q[: len(p) - 1] == p[:-1] for q in parts) else p[:-1]
            return fused[key] >= H.HIGH * level and mass(holder) >= H.FAIR * sum(mass(q) for q in parts)
        return fused[key] >= H.LOW * level and not any(is_poor(p[:n]) for n in range(len(own) + 1, len(p) + 1))

    return [i for i in every if is_kept((path[i], named[i]))]
