"""Personal data: candidate spans scored by gradient-boosted trees.

Generators with high recall propose spans, overlapping or not. A base candidate
(e-mail, ip, card, phone) that meets its rule stays as it is. The others become
features of format (length, digits, separators, checksums, character mix) and
context (neighbouring characters, telling words before) for boosted trees
trained here; Platt scaling makes their sum a probability, and a threshold for
each kind, set for precision on rows held out of training, selects redactions.
Of overlapping selected spans the likeliest stays, and none overlaps a base span.

No labels of personal data exist, so the trees are trained on a fixed number of
formats written out from a seed (TRAIN_ROWS) between words of random letters, not
on the corpus. Accounts, tokens and keys may have any length.

Defined results: null and empty texts have no spans (base_sha256 is that of the
empty string); positions count code points of the whole text; repeated rows give
equal results, a null doc_id is carried through, an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches

if TYPE_CHECKING:
    import pandas as pd

#: The kinds of the base scan, in their order.
BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that the trees decide on.
MORE_KINDS = ("account", "iban", "secret", "ssn", "telephone")
TRAIN_ROWS = 6_000
TREES, DEPTH, RATE, BINS = 40, 3, 0.25, 16
PRECISION = 0.98
CONTEXT = 28
#: Candidates of a text that are scored at once.
PART = 20_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits begins: what is left of the run is taken whole by an earlier match.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SPACED = re.compile(r"[0-9](?:[ -]?[0-9])*+")
_GENERATORS = (
    ("account", re.compile(r"(?<![0-9A-Za-z.])[0-9]{9,}+(?![0-9A-Za-z])")),  # each number of several in a row
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4}){3,8}(?![0-9A-Za-z])")),
    ("secret", re.compile(r"(?<![0-9A-Za-z_/+-])(?=[A-Za-z_/+-]*+[0-9]|[A-Z]{20})(?=[0-9_/+-]*+[A-Za-z])[A-Za-z0-9_/+-]{16,}+")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("telephone", re.compile(r"(?<![0-9+(])\(?[0-9]{2,5}\)?[ .-]?[0-9]{3,4}[ .-][0-9]{3,5}(?![0-9])")),
)
#: Words that tell what stands after them.
_TELLING = {
    "secret": ("token", "secret", "passw", "key", "auth", "bearer"),
    "account": ("card", "account", "konto", "cuenta", "compte", "visa", "credit"),
    "telephone": ("phone", "call", "tel", "fax", "mobile"),
    "ssn": ("ssn", "social", "security"),
    "iban": ("iban", "bank", "konto"),
}


def luhn(digits: str) -> bool:
    twice = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the e-mail rule, leftmost first, found from each @ outwards."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            free = domain.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base rules, by kind as listed and start."""
    found = [("email", s, e) for s, e in emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def _accounts(text: str) -> Iterator[tuple[int, int]]:
    """Digits with single spaces or hyphens between, nine at least, beside no letter or point: a run, or what of it follows its first number."""
    for m in _SPACED.finditer(text):
        start, end = m.span()
        after = text[end : end + 1]
        if end - start < 9 or (after.isascii() and after.isalpha()):
            continue
        before = text[start - 1 : start]
        if before == "." or (before.isascii() and before.isalpha()):
            while start < end and text[start] not in " -":
                start += 1
            start += 1
        if sum("0" <= c <= "9" for c in text[start:end]) >= 9:
            yield start, end


def candidates(text: str) -> list[tuple[str, int, int]]:
    """What the generators propose for the trees; spans may overlap."""
    found = [("account", *span) for span in _accounts(text)]
    found += ((kind, *m.span()) for kind, rule in _GENERATORS for m in rule.finditer(text))
    return list(dict.fromkeys(found))


def apart(spans: list[tuple[str, int, int]], others: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Those of ``spans`` that overlap none of ``others``: the others that begin before a span's end must all end before its start."""
    ordered = sorted((s, e) for _, s, e in others)
    starts, ends = [s for s, _ in ordered], list(accumulate((e for _, e in ordered), max))
    return [c for c in spans if not (n := bisect_left(starts, c[2])) or ends[n - 1] <= c[1]]


def _mod97(s: str) -> bool:
    s = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def _can_be_ssn(span: str) -> bool:
    area, group, serial = span.split("-")
    return area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    span, before, after = text[start:end], text[max(0, start - CONTEXT) : start].lower(), text[end : end + 1]
    digits = "".join(c for c in span if "0" <= c <= "9")
    letters = sum(c.isalpha() for c in span)
    marks = len(span) - len(digits) - letters
    near = before[-1:]
    return [
        *(float(kind == k) for k in MORE_KINDS),
        len(span),
        len(digits),
        letters,
        marks,
        sum(c.isupper() for c in span),
        sum(c in "0123456789abcdef" for c in span.lower()) / len(span),
        len(set(span)) / len(span),
        max((span.count(c) for c in set(span)), default=0) / len(span),
        sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:])),
        float(len(digits) >= 12 and luhn(digits)),
        float(kind == "iban" and _mod97(span.replace(" ", ""))),
        float(near.isspace() or near == ""),
        float(near in "\"'=:"),
        float(after.isspace() or after == ""),
        float(after in "\"'.,;"),
        float("=" in before or ":" in before),
        float(any(w in before for w in _TELLING[kind])),
        float(any(w in before for words in _TELLING.values() for w in words)),
        float("(" in span),
        float(digits[:1] in "3456"),
        float(kind == "ssn" and _can_be_ssn(span)),
        sum(not c.isupper() and not c.isdigit() for c in span) / len(span),
        float(before.rstrip()[-1:].isdigit()),
    ]


def _examples(rng: np.random.Generator) -> Iterator[tuple[str, str, int, int, int]]:
    """text, kind, start, end, label: formats that are personal data or look like it."""

    def number(n):
        return "".join(map(str, rng.integers(0, 10, n)))

    def pick(*x):
        return x[int(rng.integers(len(x)))]

    def word():
        return "".join(pick(*"abcdefghijklmnopqrstuvwxyz") for _ in range(int(rng.integers(1, 10))))

    def characters(alphabet, n):
        return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))

    def checked(head, n):
        """``n`` digits that begin with ``head`` and pass the card checksum."""
        value = head + number(n - 1 - len(head))
        return next(v for d in "0123456789" if luhn(v := value + d))

    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    while True:
        words = [word() for _ in range(6)]
        lead = " ".join(pick(*words) for _ in range(int(rng.integers(1, 6)))) + pick(" ", ". ", ", ", "\n")
        kind, good = pick(*MORE_KINDS), bool(rng.integers(2))
        tell = f"{pick(*_TELLING[kind])}{pick(' ', ': ', ' = ')}" if rng.random() < (0.5 if good else 0.08) else ""
        if kind == "account":  # numbers of cards, whole or mistyped, and of accounts that are named as such
            n, head = int(rng.integers(13, 20)), pick("3", "4", "5", "6")
            value = pick(checked(head, n), head + number(15), " ".join(head * (i == 0) + number(4 - (i == 0)) for i in range(4)))
            if good and tell and rng.random() < 0.4:
                value = number(int(rng.integers(12, 20)))
            if not good:
                value = pick(number(int(rng.integers(9, 12))), number(int(rng.integers(21, 60))), pick("0", "1") * n, pick("0", "1", "7", "8", "9") + number(n), f"20{number(2)} {number(2)} {number(2)} {number(3)}", "19" + number(2) + "-20" + number(2) + "-" + number(2))
        elif kind == "iban":
            value = pick("DE", "FR", "ES", "GB") + "00" + number(18)
            rest = int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97
            value = value[:2] + f"{98 - rest:02d}" + value[4:] if good else pick("AB", "XK", "ISO", "PART")[:2] + number(16)
        elif kind == "secret":
            n = int(rng.integers(24, 48)) if rng.random() < 0.8 else int(rng.integers(48, 400))
            form = int(rng.integers(6))
            key = characters(upper, 4) + characters(upper + "0123456789", 16)
            value = (characters("0123456789abcdef", n), characters(upper + upper.lower() + "0123456789", n), key, key, characters(upper + upper.lower() + "0123456789/+-_", n), characters("0123456789abcdef", int(rng.integers(16, 25))))[form]
            if good and (form == 5 or rng.random() < 0.6):
                tell = pick("token", "secret", "api_key", "password", "key") + pick(' = "', "=", ": ", " ")
            if not good:
                value = pick("-".join(words[:5]) + "-" + number(2), "_".join(words[:5]) + number(1), "/".join(words) + "/" + number(4), pick("a", "x", "-", "_", "=") * int(rng.integers(15, 60)) + number(2), f"{words[0]}-{number(1)}-{words[1]}-{number(2)}-{words[2]}", number(int(rng.integers(17, 40))), words[0] + words[1] + words[2] + words[3] + number(2))
        elif kind == "ssn":
            value = f"{rng.integers(1, 666):03d}-{rng.integers(1, 100):02d}-{rng.integers(1, 10000):04d}"
            if not good:
                value = f"{pick('000', '666', '978')}-{pick('00', number(2))}-{pick('0000', number(4))}"
        else:
            value = pick(f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"{number(3)}.{number(3)}.{number(4)}")
            if not good:
                value = pick(f"{number(2)} {number(3)} {number(3)}", f"{number(4)} {number(4)} {number(4)}", f"{number(2)}.{number(3)}.{number(3)}", f"20{number(2)} 1{number(2)} 20{number(2)}")
        text = lead + tell + value + pick(" ", ".", ",", '"') + pick(*words)
        start = len(lead) + len(tell)
        if any(c == (kind, start, start + len(value)) for c in candidates(text)):
            yield text, kind, start, start + len(value), int(good)


def _bins(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for column in x.T]


def train_trees(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Trees of log-loss boosting, each 2^DEPTH - 1 splits (feature, threshold) then 2^DEPTH leaves (0, value)."""
    edges = _bins(x)
    binned = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T)], 1)
    inner, out, total = (1 << DEPTH) - 1, [], np.zeros(len(y))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h, place = p - y, p * (1 - p), np.zeros(len(y), int)
        tree = np.zeros((2 * inner + 1, 2))
        for node in range(inner):
            own = np.flatnonzero(place == node)
            tree[node], best, gs, hs = (0, np.inf), 1e-6, g[own].sum(), h[own].sum()
            for f in range(x.shape[1]) if len(own) > 20 else ():
                gl = np.cumsum(np.bincount(binned[own, f], g[own], len(edges[f]) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[own, f], h[own], len(edges[f]) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                if len(gain) and gain.max() > best:
                    best, tree[node] = gain.max(), (f, edges[f][int(gain.argmax())])
            right = x[own, int(tree[node, 0])] > tree[node, 1]
            place[own] = 2 * node + 1 + right
        for leaf in range(inner, 2 * inner + 1):
            own = place == leaf
            tree[leaf, 1] = -RATE * g[own].sum() / (h[own].sum() + 1)
        total += tree[place, 1]
        out.append(tree)
    return np.stack(out)


def margins(trees: np.ndarray, x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for tree in trees:
        at = np.zeros(len(x), int)
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[np.arange(len(x)), tree[at, 0].astype(int)] > tree[at, 1])
        total += tree[at, 1]
    return total


def train(rows: int = TRAIN_ROWS, seed: int = 17) -> pd.DataFrame:
    """One row: trees, Platt scale and shift, thresholds in the order of MORE_KINDS."""
    import pandas as pd

    made = _examples(np.random.default_rng(seed))
    sample = [next(made) for _ in range(rows)]
    x = np.array([features(*s[:4]) for s in sample])
    y = np.array([s[4] for s in sample])
    half = rows // 2
    trees = train_trees(x[:half], y[:half])
    m, held = margins(trees, x[half:]), y[half:]
    scale, shift = 1.0, 0.0
    for _ in range(200):  # Platt scaling by Newton steps
        p = 1 / (1 + np.exp(-(scale * m + shift)))
        w = p * (1 - p) + 1e-9
        gradient = np.array([((p - held) * m).sum(), (p - held).sum()])
        curve = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-3]])
        scale, shift = np.array([scale, shift]) - 0.5 * np.linalg.solve(curve, gradient)
    p = 1 / (1 + np.exp(-(scale * m + shift)))
    thresholds = []
    for k in range(len(MORE_KINDS)):
        own = x[half:, k] == 1
        ranked = sorted(zip(p[own], held[own]), reverse=True)
        good = np.cumsum([t for _, t in ranked]) / np.arange(1, len(ranked) + 1)
        last = max((i for i in range(len(ranked)) if good[i] >= PRECISION), default=0)
        thresholds.append(max(0.5, ranked[last][0]))
    return pd.DataFrame({"trees": [trees.astype("<f8").tobytes()], "scale": [scale], "shift": [shift], "thresholds": [thresholds]})


class Finder:
    def __init__(self, model: pd.DataFrame):
        row = model.iloc[0]
        self.trees = np.frombuffer(row["trees"], "<f8").reshape(TREES, -1, 2)
        self.scale, self.shift, self.thresholds = row["scale"], row["shift"], dict(zip(MORE_KINDS, row["thresholds"]))

    def probabilities(self, text: str, spans: list[tuple[str, int, int]]) -> np.ndarray:
        out = []
        for at in range(0, len(spans), PART):
            x = np.array([features(text, *s) for s in spans[at : at + PART]])
            out.append(1 / (1 + np.exp(-np.clip(self.scale * margins(self.trees, x) + self.shift, -35, 35))))
        return np.concatenate(out)

    def spans(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Base spans, and the spans that the trees add, by kind and start."""
        base = base_spans(text)
        free = apart(candidates(text), base)
        if not free:
            return base, []
        likely = sorted((-p, c) for p, c in zip(self.probabilities(text, free), free) if p >= self.thresholds[c[0]])
        taken: list[tuple[str, int, int]] = []
        covered = bytearray(len(text))
        for _, c in likely:
            if covered.find(1, c[1], c[2]) < 0:
                covered[c[1] : c[2]] = b"\1" * (c[2] - c[1])
                taken.append(c)
        return base, sorted(taken, key=lambda c: (MORE_KINDS.index(c[0]), c[1]))


_LOOK = re.compile("[0-9@]|[A-Z]{20}")


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans for every row of ``docs``."""
    model = docs.sparkSession.range(1, numPartitions=1).mapInPandas(lambda it: (train() for _ in it), "trees binary, scale double, shift double, thresholds array<double>").toPandas()
    counts = [f"n_{k}" for k in BASE_KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(model)
        for b in batches:
            rows = []
            for cell in b.column(1):
                text = cell.as_py()
                base, more = finder.spans(text) if text and _LOOK.search(text) else ([], [])
                rows.append((*(sum(k == kind for k, _, _ in base) for kind in BASE_KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more), len(base) + len(more)))
            columns = list(zip(*rows)) if rows else [()] * (len(counts) + 3)
            kinds = [pa.int64()] * len(counts) + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", *counts, "base_sha256", "spans", "n_spans"])

    short_batches(docs.sparkSession)
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base_sha256 string, spans string, n_spans long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def redact(text: str, finder: Finder) -> str:
    """``text`` with each span replaced by its kind in brackets."""
    base, more = finder.spans(text)
    for kind, s, e in sorted(base + more, key=lambda c: -c[1]):
        text = f"{text[:s]}[{kind}]{text[e:]}"
    return text


def op9_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_boosted_pii": op9_boosted_pii}
ORACLE_SQL: dict[str, str] = {}
