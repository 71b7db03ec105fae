"""Runs against all stretches of all periods, one by one."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from quern.llm import periodic

from .conftest import ODD, SF


def plain_runs(words):
    """Every maximal stretch of each period, kept if long enough and if no smaller period holds all of it."""
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids, found = np.array([numbers[w] for w in words], np.int64), []
    for q in range(1, len(ids) // 4 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], ids[q:] == ids[:-q], [0]))))
        for s, e in zip(edges[::2].tolist(), (edges[1::2] + q).tolist()):
            if e - s >= max(6, 4 * q) and not any((ids[s : e - p] == ids[s + p : e]).all() for p in range(1, q)):
                found.append((s, e, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    dropped = {i for s, e, q in found for i in range(s + q, e)}
    best = max(found, key=lambda r: ((r[1] - r[0]) / r[2], -r[0], -r[2]), default=None)
    told = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    return doc_id, len(found), *told, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest()


def words_of(rng):
    """Random words with loops in loops put in."""
    out = [rng.randrange(rng.choice((1, 2, 3, 30))) for _ in range(rng.randrange(1, 60))]
    for _ in range(rng.randrange(4)):
        p = rng.randrange(1, 14)
        loop = [rng.randrange(rng.choice((1, 2, 3))) for _ in range(p)]
        if rng.random() < 0.4:
            loop = loop[:1] * rng.randrange(6, 9) + loop
        at = rng.randrange(len(out) + 1)
        out[at:at] = (loop * 9)[: rng.randrange(3 * len(loop), 9 * len(loop))]
    return out


@pytest.mark.parametrize("search, key", [(1 << 16, 8), (8, 8), (16, 2)])
def test_runs_of_random_words(monkeypatch, search, key):
    monkeypatch.setattr(periodic, "SEARCH", search)
    monkeypatch.setattr(periodic, "KEY", key)
    rng = random.Random(5)
    several = 0
    for _ in range(700):
        words = words_of(rng)
        want = plain_runs(words)
        several += len(want) > 2
        assert periodic.runs(np.array(words)) == want
    assert several > 50


def test_all_short_sequences():
    """Every sequence of two words up to 12 long, as the tail of none."""
    for n in range(13):
        for bits in range(1 << n):
            words = [bits >> i & 1 for i in range(n)]
            assert periodic.runs(np.array(words, np.int64)) == plain_runs(words)


def test_query(spark, documents):
    want = sorted(plain_row(i, t) for i, t in documents)
    got = sorted(tuple(r) for r in periodic.op11_periodic_runs(spark, SF).collect())
    assert got == want
    assert sum(r[1] > 0 for r in got) > 5


def test_odd_rows(spark, odd, empty):
    rows = periodic.detected(odd).collect()
    assert len(rows) == len(ODD)
    nothing = hashlib.sha256(b"").hexdigest()
    by = {r.doc_id: r for r in rows}
    assert all((by[i].n_runs, by[i].start, by[i].runs_sha256, by[i].collapsed_sha256) == (0, None, nothing, nothing) for i in (900001, 900002, 900003))
    assert (by[900009].n_runs, by[900009].length, by[900009].period, by[900009].exponent_milli) == (1, 60000, 1, 60_000_000)
    assert periodic.detected(empty).count() == 0 and periodic.without_runs(empty).count() == 0
    texts = {r.doc_id: (r.text, r.n_dropped) for r in periodic.without_runs(odd).collect()}
    assert texts[900009] == ("word MIT License 192.168.0.1 mail a.b@c.de", 59999) and texts[900001] == ("", 0)


def test_long_loops_end_soon():
    """Loops of many periods in a long text, where all distances of a scale repeat."""
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 5000, 30_000), np.tile(rng.integers(0, 2000, 700), 60), np.tile([1, 2, 2, 3, 2], 20_000), rng.integers(0, 20, 60_000)])
    found = periodic.runs(ids)
    assert any(q == 700 and e - s >= 42_000 for s, e, q in found) and any(q == 5 and e - s >= 100_000 for s, e, q in found)
    assert all(np.array_equal(ids[s : e - q], ids[s + q : e]) for s, e, q in found)
