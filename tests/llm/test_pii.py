"""The base rules against their plain regular expressions, and what the trees add."""

import hashlib
import math
import random
import re

import numpy as np

from quern.llm import pii

from .conftest import ODD, SF

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, rule in KINDS.items():
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0,
                "card": 16 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(digits[::-1])) % 10 == 0,
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_rules(documents):
    rng = random.Random(4)
    odd = ["".join(rng.choice("@@..aZ09-+%_ ()1234ß") for _ in range(rng.randrange(60))) for _ in range(20000)]
    odd += ["4111 1111 1111 1111", "4111-1111-1111-1111x", "+1 (555) 555-0100.", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.0004", "a@b@c.de@f.gh", "x" * 3000 + "@y.zz"]
    for text in [*odd, *(t for _, t in documents)]:
        assert pii.base_spans(text) == plain(text), text[:200]


def test_query(spark, documents, odd, empty):
    for df, rows in ((spark.read.parquet(f"{SF}/documents.parquet"), documents), (odd, ODD)):
        got = sorted((r.doc_id or -1, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.find(df).collect())
        want = []
        for i, text in rows:
            spans = plain(text or "")
            n = [sum(k == kind for k, _, _ in spans) for kind in KINDS]
            want.append((i or -1, *n, hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()))
        assert got == sorted(want)
    assert pii.find(empty).count() == 0


def test_trees():
    finder = pii.Finder(pii.train())
    rng = np.random.default_rng(99)
    made = pii._examples(rng)
    hits = [(finder.probabilities(t, [(k, s, e)])[0] >= finder.thresholds[k], y) for t, k, s, e, y in (next(made) for _ in range(1500))]
    found = [y for hit, y in hits if hit]
    assert sum(found) / len(found) >= 0.95 and sum(found) >= 0.8 * sum(y for _, y in hits)
    kinds = lambda text: [k for k, _, _ in sum(finder.spans(text), [])]
    assert kinds('he token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" and') == ["secret"]
    assert kinds("stth 5927243074273351 with") == ["account"]
    assert kinds("In 2024 there were 1,000 of them, 3.14159 each; version 1.2.3; 12:30.") == []
    assert kinds("The Apache License, Version 2.0. internationalization-of-everything") == []
    assert pii.redact("mail a@b.de now", finder) == "mail [email] now"
    for n in (20, 129, 500, 5000):  # of any length, and wherever the first digit stands
        key = "".join(random.Random(n).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", k=n)) + "7Q"
        assert finder.spans(f'the token = "{key}" here')[1] == [("secret", 13, 15 + n)]
    assert [k for k, *_ in pii.candidates("1" * 3000)] == ["account"] and len(pii.candidates("-" * 100_000 + " " + "a" * 100_000)) == 0


def slow_spans(model, text):
    """Candidates one by one, trees walked one by one."""
    row, out = model.iloc[0], []
    trees = np.frombuffer(row["trees"], "<f8").reshape(pii.TREES, -1, 2)
    base = plain(text)
    for kind, s, e in pii.candidates(text):
        if any(s < y and x < e for _, x, y in base):
            continue
        x, total = pii.features(text, kind, s, e), 0.0
        for tree in trees:
            at = 0
            while at < len(tree) // 2:
                at = 2 * at + 1 + (x[int(tree[at][0])] > tree[at][1])
            total += tree[at][1]
        p = 1 / (1 + math.exp(-(row["scale"] * total + row["shift"])))
        if p >= row["thresholds"][pii.MORE_KINDS.index(kind)]:
            out.append((-p, kind, s, e))
    taken = []
    for _, kind, s, e in sorted(out):
        if all(e <= x or y <= s for _, x, y in taken):
            taken.append((kind, s, e))
    return base, sorted(taken, key=lambda c: (pii.MORE_KINDS.index(c[0]), c[1]))


#: Formats that stand in the tables' documents and are no base kind.
PLANTED = re.compile(r'(?<=token = ")[0-9a-f]{40}(?=")|(?<=password=)[0-9a-f]{18}\b|\bAKIA[A-Z0-9]{16}\b')


def test_added_spans(spark):
    """As by walking the trees one by one; the tables' tokens and keys are found, and little else."""
    model = pii.train()
    finder = pii.Finder(model)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    found = {r.doc_id: r for r in pii.op9_boosted_pii(spark, "/root/testdata/sf0.01").collect()}
    planted = hit = other = 0
    for i, text in docs:
        base, more = finder.spans(text or "")
        assert (base, more) == slow_spans(model, text or "")
        assert found[i].spans == ",".join(f"{k}:{s}:{e}" for k, s, e in base + more) and found[i].n_spans == len(base + more)
        spans = [m.span() for m in PLANTED.finditer(text or "")]
        planted += len(spans)
        hit += sum(any(s <= a and b <= e for _, s, e in more) for a, b in spans)
        other += sum(k == "secret" and not any(a < e and s < b for a, b in spans) for k, s, e in more)
    assert planted > 0 and hit >= 0.95 * planted and other <= 0.05 * planted


def test_many_spans_in_a_text():
    """Time in proportion to the text: 100,000 spans of all kinds, numbers in one run that ends in a letter."""
    import time

    finder = pii.Finder(pii.train())
    one = "mail a1@b.co from 10.0.0.1, card 4111 1111 1111 1111 or 5927243074273351; token = 2abc3ff2ca8fb1e4c565a0eb63815530a948bdde. "
    text = one * 20_000 + "1 " * 200_000 + "x"
    began = time.process_time()
    base, more = finder.spans(text)
    assert len(base) == 60_000 and len(more) >= 40_000 and time.process_time() - began < 120
    few = finder.spans(one * 3)
    assert [len(base) * 3, len(more) * 3] == [len(few[0]) * 20_000, len(few[1]) * 20_000]


def test_account_candidates_are_those_of_the_rule():
    """The walk over runs of digits against one regular expression tried at every place."""
    rule = re.compile(r"(?<![0-9A-Za-z.])[0-9](?:[ -]?[0-9]){8,}+(?![0-9A-Za-z])")
    rng = random.Random(8)
    for _ in range(20_000):
        text = "".join(rng.choice("00123 -.xÄ") if rng.random() < 0.4 else rng.choice("0123456789 ") for _ in range(rng.randrange(40)))
        assert list(pii._accounts(text)) == [m.span() for m in rule.finditer(text)], text


def test_apart():
    rng = random.Random(9)
    for _ in range(500):
        spans, others = ([("k", s, s + rng.randrange(1, 9)) for s in (rng.randrange(60) for _ in range(rng.randrange(9)))] for _ in range(2))
        assert pii.apart(spans, others) == [c for c in spans if not any(c[1] < e and s < c[2] for _, s, e in others)]
