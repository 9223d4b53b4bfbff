"""Personal data: fixed patterns, and a linear-chain conditional random field.

The patterns give the base spans. The field adds spans that they don't cover
(telephone numbers without a plus, identity numbers, cards and addresses in odd
forms); what fails its kind's check digits or range is dropped. Its tokens are the parts
between white space; its features are word shapes of a token and of its
neighbours and the words about it. Only tokens with a digit or an @ may carry
a label, so chains end at other tokens and each chain is decoded by itself,
which is exact. It is trained on the small labelled table below, spread out by
fixed random fillers, by gradient steps on the exact likelihood; chains of one
length are decoded together by Viterbi in numpy.

Null text counts as empty. Places count characters, ends are exclusive.
Repeated rows have equal results; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts

# The base kinds in their order, then what only the field finds.
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "id"]

# The patterns, written so that each character is looked at a bounded number of
# times: numbers start where no digit precedes, runs are never given back.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # start, kind, end


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Each @ with what stands before it since the last match, and a domain."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, 0, domain.end()))
            done = domain.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    out = _emails(text) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = re.sub("[^0-9]", "", m[0])
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- the field -------------------------------------------------------------

#: Small labelled table: {kind} is filled with a form below, {n} with a number
#: that is no personal data; each row is used EACH times.
TABLE = """
call me at {phone} tonight
Phone: {phone}
tel {phone} or {phone}
my number is {phone}, thanks
fax {phone}
reach us on {phone} any time
the word {phone} and
Contact {phone} {email}
write to {email} soon
e-mail {email}
und {email} oder {phone}
mail {email} , {ip}
the word {email} and
server {ip} is down
from {ip} to {ip}
host {ip}
the word {ip} and
card {card} expires {n}
paid with {card}
Visa {card}
the word {card} and
SSN {id}
social security number {id}
ssn: {id} born {n}
the word {id} and
on {n} we sold {n} of them
in {n} there were {n} people
page {n} of {n}
version {n} came out
it costs {n} today
at {n} the bus leaves
chapter {n} , line {n}
about {n} percent
since {n}
the word {n} and
{n} and {n}
item {n} {n} {n}
room {n} floor {n}
see {n}
@home and @work
follow @user now
order {n} shipped
"""
#: Forms of the fillers; d is a random digit, x a random letter.
FORMS = {
    "phone": ["ddd-ddd-dddd", "(ddd) ddd-dddd", "ddd.ddd.dddd", "ddd ddd dddd", "(ddd)ddd-dddd", "0dd dddd dddd", "1-ddd-ddd-dddd", "+d (ddd) ddd-dddd", "+dd ddd dddddd"],
    "email": ["xxxx@xxxx.xxx", "xxx.xxxx@xxx.xx", "xxxxd@xxxxx.xxx", "xxx.dd@xxxxd.xxxx.xxx", "xxx+xx@xxx.xx"],
    "ip": ["dd.dd.dd.dd", "ddd.dd.d.ddd", "ddd.ddd.d.d", "dd.ddd.ddd.dd"],
    "card": ["dddd dddd dddd dddd", "dddd-dddd-dddd-dddd", "dddddddddddddddd", "dddd dddddd ddddd"],
    "id": ["ddd-dd-dddd", "ddd-dd-dddd."],
    "n": ["d", "dd", "ddd", "dddd", "ddddd", "dd.d", "d.dd", "d,ddd", "dd,ddd,ddd", "dddd-dd-dd", "dd/dd/dddd", "dd.dd.dddd", "dd:dd", "$dd", "dd%", "v d.d.d", "d.d.d", "#dddd", "ddx", "xd", "dddd.", "dd,", "(dddd)", "dddd-dddd", "xxdxxdxd", "ddst", "d-dd", "ddddddd", "dddddddd"],
}
EACH = 12
LABELS = ["O", *(f"{b}-{k}" for k in KINDS for b in "BI")]
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_WORD_BEFORE, _WORD_AFTER = re.compile(r"(\S{1,30})\s+$"), re.compile(r"\s+(\S{1,30})")
_EDGE = " \t\n\r\"'<>[]{},;:!?"


def shape(token: str) -> str:
    """Letters as x, digits as d; runs of letters shortened, of digits up to 6 kept."""
    s = re.sub(r"[0-9]", "d", re.sub(r"[^\W\d_]+", "x", token[:80]))
    return re.sub(r"d{7,}", "D", s)


def features(tokens: list[str], i: int, before: str, after: str) -> list[str]:
    s = shape(tokens[i].strip(_EDGE).rstrip("."))
    digits = sum(c.isdigit() for c in tokens[i])
    last = shape(tokens[i - 1].strip(_EDGE)) if i else "<"
    following = shape(tokens[i + 1].strip(_EDGE)) if i + 1 < len(tokens) else ">"
    near = before if not i else "-"
    return [
        "bias", f"s={s}", f"n={min(digits, 20)}", f"l={last}", f"f={following}", f"ls={last}|{s}", f"sf={s}|{following}",
        f"w={near.lower().strip(_EDGE)[:12]}", f"a={after.lower().strip(_EDGE)[:12] if i + 1 == len(tokens) else '-'}",
        f"dots={tokens[i].count('.')}", f"at={tokens[i].count('@')}", f"len={len(tokens)}",
    ]


def training_rows(seed: int = 5) -> list[tuple[list[list[str]], list[int]]]:
    """Chains of feature lists and their labels, from the labelled table."""
    rng = np.random.default_rng(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def filled(form: str) -> str:
        return re.sub("[dx]", lambda m: str(rng.integers(10)) if m[0] == "d" else letters[rng.integers(26)], form)

    rows = []
    for line in TABLE.strip().split("\n"):
        for _ in range(EACH):
            text, spans, at = "", [], 0
            for m in re.finditer(r"\{(\w+)\}", line):
                text += line[at : m.start()]
                value = filled(str(rng.choice(FORMS[m[1]])))
                if m[1] in KINDS:
                    spans.append((len(text), len(text) + len(value), KINDS.index(m[1])))
                text, at = text + value, m.end()
            text += line[at:]
            for chain in chains(text):
                labels = []
                for start, end in chain:
                    own = [(a, k) for a, b, k in spans if a < end and start < b]
                    labels.append(1 + 2 * own[0][1] + (start > own[0][0]) if own else 0)
                rows.append((chain_features(text, chain), labels))
    return rows


def chains(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring tokens (of one line) that may carry a label."""
    out: list[list[tuple[int, int]]] = []
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        if out and start - out[-1][-1][1] <= 4 and text[out[-1][-1][1] : start].strip(" \t") == "":
            out[-1].append((start, end))
        else:
            out.append([(start, end)])
    return out


def chain_features(text: str, chain: list[tuple[int, int]]) -> list[list[str]]:
    first, last = chain[0][0], chain[-1][1]
    b = _WORD_BEFORE.search(text[max(0, first - 40) : first])
    a = _WORD_AFTER.match(text, last)
    tokens = [text[s:e] for s, e in chain]
    return [features(tokens, i, b[1] if b else "", a[1] if a else "") for i in range(len(tokens))]


class Field:
    def __init__(self):
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, len(LABELS)))
        self.steps = np.zeros((len(LABELS), len(LABELS)))
        # An inside label follows its kind's begin or inside label only.
        allowed = np.ones((len(LABELS), len(LABELS)), bool)
        for k in range(len(KINDS)):
            allowed[:, 2 + 2 * k] = False
            allowed[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
        self.bar = np.where(allowed, 0.0, -1e4)
        self.first = np.array([-1e4 if n.startswith("I") else 0.0 for n in LABELS])

    def scores(self, chain: list[list[str]]) -> np.ndarray:
        return np.array([self.weights[[self.index[f] for f in fs if f in self.index]].sum(0) for fs in chain])

    def train(self, rows, rounds: int = 120, rate: float = 0.15, decay: float = 2e-3) -> "Field":
        for chain, _ in rows:
            for f in (f for fs in chain for f in fs):
                self.index.setdefault(f, len(self.index))
        by: dict[int, list] = defaultdict(list)
        for chain, labels in rows:
            by[len(chain)].append(([[self.index[f] for f in fs] for fs in chain], labels))
        groups = [(np.array([c for c, _ in g]), np.array([y for _, y in g])) for g in by.values()]
        self.weights = np.zeros((len(self.index), len(LABELS)))
        n = len(rows)
        params, mean, square = [self.weights, self.steps], [0.0, 0.0], [0.0, 0.0]
        for t in range(1, rounds + 1):
            grads = [np.zeros_like(p) for p in params]
            for feats, labels in groups:
                self._gradient(feats, labels, grads)
            for i, p in enumerate(params):
                g = grads[i] / n + decay * p
                mean[i] = 0.9 * mean[i] + 0.1 * g
                square[i] = 0.999 * square[i] + 0.001 * g * g
                p -= rate * (mean[i] / (1 - 0.9**t)) / (np.sqrt(square[i] / (1 - 0.999**t)) + 1e-8)
        return self

    def _gradient(self, feats: np.ndarray, labels: np.ndarray, grads: list[np.ndarray]) -> None:
        """Adds expected minus observed counts, by forward and backward passes."""
        n, size, _ = feats.shape
        emit = self.weights[feats].sum(2)
        step = self.steps + self.bar
        ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0] + self.first
        for t in range(1, size):
            ahead[:, t] = emit[:, t] + _lse(ahead[:, t - 1, :, None] + step, 1)
        for t in range(size - 2, -1, -1):
            behind[:, t] = _lse(step + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        total = _lse(ahead[:, -1], 1)[:, None, None]
        node = np.exp(ahead + behind - total)
        np.subtract.at(node, (np.arange(n)[:, None], np.arange(size), labels), 1)
        for f in range(feats.shape[2]):
            np.add.at(grads[0], feats[:, :, f], node)
        for t in range(1, size):
            edge = ahead[:, t - 1, :, None] + step + (emit[:, t] + behind[:, t])[:, None, :]
            grads[1] += np.exp(edge - total).sum(0)
            np.subtract.at(grads[1], (labels[:, t - 1], labels[:, t]), 1)

    def decode(self, batch: list[list[list[str]]]) -> list[np.ndarray]:
        """Best labels of each chain; chains of a length go through Viterbi together."""
        out: list = [None] * len(batch)
        by: dict[int, list[int]] = defaultdict(list)
        for i, chain in enumerate(batch):
            by[len(chain)].append(i)
        step = self.steps + self.bar
        for size, rows in by.items():
            emit = np.array([self.scores(batch[i]) for i in rows])
            best, back = emit[:, 0] + self.first, []
            for t in range(1, size):
                path = best[:, :, None] + step
                back.append(path.argmax(1))
                best = path.max(1) + emit[:, t]
            labels = np.zeros((len(rows), size), np.int64)
            labels[:, -1] = best.argmax(1)
            for t in range(size - 2, -1, -1):
                labels[:, t] = back[t][np.arange(len(rows)), labels[:, t + 1]]
            for i, x in zip(rows, labels, strict=True):
                out[i] = x
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


@functools.lru_cache(maxsize=1)
def field() -> Field:
    return Field().train(training_rows())


def find(texts: list[str], model: Field) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and the spans that the field adds, of each text."""
    base = [base_spans(t) for t in texts]
    where, batch = [], []
    for i, t in enumerate(texts):
        taken = base[i]
        for chain in chains(t):
            # A chain that the patterns cover whole has nothing to add.
            if any(not any(s <= a and b <= e for s, _, e in near(taken, chain)) for a, b in chain):
                where.append((i, chain))
                batch.append(chain_features(t, chain))
    added: list[list[Span]] = [[] for _ in texts]
    for (i, chain), labels in zip(where, model.decode(batch), strict=True):
        t, spans = texts[i], []
        for (a, b), y in zip(chain, labels.tolist(), strict=True):
            if y and y % 2:
                spans.append([a, (y - 1) // 2, b])
            elif y and spans:
                spans[-1][2] = b
        for a, k, b in spans:
            while a < b and t[a] in _EDGE:
                a += 1
            while b > a and t[b - 1] in _EDGE + ".":
                b -= 1
            if a < b and valid(k, t[a:b]) and not any(s < b and a < e for s, _, e in near(base[i], [(a, b)])):
                added[i].append((a, k, b))
    return list(zip(base, added, strict=True))


def valid(kind: int, value: str) -> bool:
    """What a labelled span must hold besides its shape: numbers that fail their
    kind's check (a card's check digit, an address's range) are no personal data."""
    digits = re.sub("[^0-9]", "", value)
    if KINDS[kind] == "email":
        return "@" in value.strip("@")
    if KINDS[kind] == "ip":
        parts = value.split(".")
        return len(parts) == 4 and all(len(p) <= 3 and p.isdecimal() and int(p) <= 255 for p in parts)
    if KINDS[kind] == "card":
        return 14 <= len(digits) <= 19 and _luhn(digits)
    return 9 <= len(digits) <= 15


def near(spans: list[Span], chain: list[tuple[int, int]]) -> list[Span]:
    """Those of the spans that reach into a chain."""
    if len(spans) < 8:
        return spans
    import bisect

    a = max(0, bisect.bisect_left(spans, (chain[0][0], 0, 0)) - len(KINDS))
    b = bisect.bisect_right(spans, (chain[-1][1], 9, 0))
    return spans[a:b]


def spans_string(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep's columns; base and added: arrays of (start, kind, end)."""
    model = df.sparkSession.sparkContext.broadcast(field())  # a few thousand features

    def kernel():
        def run(texts):
            found = find(texts, model.value)
            as_rows = lambda spans: [{"start": a, "kind": KINDS[k], "end": b} for a, k, b in sorted(spans)]
            return {"base": [as_rows(b) for b, _ in found], "added": [as_rows(x) for _, x in found]}

        return run

    span = T.StructType(
        [T.StructField("start", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("end", T.LongType())]
    )
    fields = [T.StructField(n, T.ArrayType(span)) for n in ("base", "added")]
    return map_texts(df, kernel, fields, keep, text)


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans."""
    found = scan(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"])
    kinds = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda s: F.array_join(
        F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ","
    )
    placed = F.transform(
        F.concat("base", "added"), lambda x: F.struct(x["start"], F.array_position(kinds, x["kind"]).alias("k"), x["kind"], x["end"])
    )
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.sort_array(placed)).alias("spans"),
    )
