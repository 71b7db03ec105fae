"""Token ids against the tokenizer itself, pieces against the documents they must rebuild."""

import random
import zlib
from collections import defaultdict

import numpy as np

from quern.llm import packing
from quern.llm.wordbpe import WordBpe

from .conftest import ODD, SF


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.public_tokenizer())


def test_ids_are_the_tokenizers(documents):
    rng = random.Random(3)
    odd = ["", "It's I'LL don't 'S 'reX x'''s", "ÄÖÜ × ÷ \xadsoft", "ǅ ﬁ ½ ²", "<|endoftext|> a <|startoftext|>", "\x1c a\x1fb\x85c\xa0d", "İ ΑΣ", "日本語", "é", "a" * 500]
    odd += ["".join(chr(rng.choice([rng.randrange(9, 127), rng.randrange(160, 384), 32, 39, rng.randrange(1, 0x2FFF)])) for _ in range(30)) for _ in range(500)]
    texts = odd + [t for _, t in documents]
    plain = tokenizer()
    for text, ids in zip(texts, WordBpe(packing.public_tokenizer()).encode(texts)):
        assert np.frombuffer(ids, "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids


def check(pieces, docs, window=4096):
    """Every id in exactly one piece, sequences gapless, padding by the rule; returns the padded share."""
    plain = tokenizer()
    ids = [(i, plain.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in docs]
    left = defaultdict(int)
    for i, x in ids:
        left[i, len(x)] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    total = sum(len(x) for _, x in ids)
    assert sum(p.length for p in pieces) == total
    for i, x in ids:
        own = [p for p in by_doc[i] if p.doc_tokens == len(x)]
        covered = defaultdict(int)
        for p in own:
            assert p.length > 0
            same = [y for j, y in ids if j == i and len(y) == len(x)]
            assert p.ids_crc32 in {zlib.crc32(np.array(y[p.start : p.start + p.length], "<u4").tobytes()) for y in same}
            for at in range(p.start, p.start + p.length):
                covered[at] += 1
        assert dict(covered) == {at: left[i, len(x)] for at in range(len(x))}
    padded = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        at = 0
        for p in own:
            assert p.offset == at
            at += p.length
        assert at <= window
        padded += 0 if at & (at - 1) == 0 else window - at
    return padded / total


def test_pieces(spark, documents, odd, empty):
    assert check(packing.op3_mixture_packing(spark, SF).collect(), documents) == 0
    assert check(packing.pack(odd.withColumn("block", odd["key"])).collect(), ODD) == 0
    assert packing.pack(empty).count() == 0


def test_mixture_and_deficits(spark):
    """With plenty of both sources, every window holds the target shares; deficits go on across blocks."""
    rows = [(i, f"word{i % 7} " * 300, "a" if i % 2 else "b") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    tokens = packing.tokenized(docs, packing.public_tokenizer())
    book = packing.ledger(tokens, {"a": 3, "b": 1}).collect()
    own, everything = defaultdict(int), 0
    sums = defaultdict(int)
    for r in tokens.select("block", "source", "tokens").collect():
        sums[r.block, r.source] += r.tokens
    for block in sorted({b for b, _ in sums}):
        for r in (r for r in book if r.block == block):
            assert abs(r.owed - ((0.75 if r.source == "a" else 0.25) * everything - own[r.source])) < 1e-6
        for s in "ab":
            own[s] += sums[block, s]
            everything += sums[block, s]
    mixer = packing.Mixer(0, 100)
    for i in range(20):
        mixer.add("a", 0.75, 0, i, np.arange(150, dtype="<u2"))
        mixer.add("b", 0.25, 0, 100 + i, np.arange(50, dtype="<u2"))
    mixer.finish()
    share = defaultdict(int)
    for _, _, n, _, _, sequence, _, source in mixer.out:
        share[sequence, source] += n
    assert all(abs(share[s, "a"] - 75) <= 1 for s in range(40))


def test_windows_hold_the_shares_of_a_table_stored_by_source(spark, monkeypatch):
    """A file for each source: every window mixes all of them all the same, in all parts, and no id is lost."""
    monkeypatch.setattr(packing, "BUFFER", 6 * 4096)
    rows = [(i, f"word{i % 7} " * (40 + i % 50 * 9), "abc"[0 if i < 240 else 1 if i < 360 else 2]) for i in range(400)]
    rows.append((400, "long " * 30_000, "c"))
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 5), "doc_id long, text string, source string")
    tokens = defaultdict(int)
    for r in packing.tokenized(docs, packing.public_tokenizer()).collect():
        tokens[r.source] += r.tokens
    total = sum(tokens.values())

    def mixed(shares):
        pieces = packing.pack(docs, shares=shares).collect()
        assert check(pieces, [(i, t) for i, t, _ in rows]) == 0
        by = defaultdict(lambda: defaultdict(int))
        for p in pieces:
            by[p.sequence_id][p.source] += p.length
        return {s: w for s, w in by.items() if sum(w.values()) == 4096}

    windows = mixed(None)
    assert all(abs(w[s] / 4096 - n / total) < 0.01 for w in windows.values() for s, n in tokens.items())
    assert len({s >> 33 for s in windows}) == -(-total // (6 * 4096)) > 5
    # until "a" is dry, a and b stand 3 to 1; then b is alone, then c, which has no share
    windows = mixed({"a": 3, "b": 1})
    both = [w for w in windows.values() if w["a"] > 100 and w["b"] > 100 and not w["c"]]
    assert sum(abs(w["a"] - 3072) <= 8 for w in both) >= len(both) - 1 and len(both) > 3
    assert sum(1 for w in windows.values() if (w["a"] or w["b"]) and w["c"]) <= 1
