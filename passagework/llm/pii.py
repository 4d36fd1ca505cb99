"""Personal data: base patterns and a skip-chain conditional random field.

Tokens with a digit or an @ are the field's nodes; all other tokens are certainly
no personal data, so leaving them out changes nothing. Adjacent nodes share chain
potentials, nodes with equal digits (or equal text) share skip potentials with one
anchor of theirs, however far apart, and damped loopy sum-product, run until its
messages stay, makes the labels of a document agree: a phone number written without
its prefix is found because the full one is there.
Weights are trained here by pseudo-likelihood on generated sentences with a fixed
seed. Spans of the base patterns always stay; the field adds spans.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("none", *KINDS)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can't begin inside a digit run: what follows the run is the same from each of its digits
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NODE = re.compile(r"[0-9@]")
_BLANK = re.compile(r"[\x20\x09-\x0D]")
_ASSIGNED = re.compile(r"(?i)(?:token|secret|key|passw|pwd|auth)[a-z_]{0,20}[\"']?[\x20]?[:=][\x20]?[\"']?$")
_LONG = re.compile(r"[A-Za-z0-9_+/=-]{20,}")
#: Rounds end when no message changes by more than TOLERANCE; after each PATIENCE rounds the part of a new message halves, so that cycles settle.
TOLERANCE, DAMPING, PATIENCE = 1e-6, 0.5, 200
#: Edges whose messages are computed at a time, and bytes of text whose fields are; a longer text is alone.
EDGES, BYTES = 1 << 16, 1 << 20
#: Log weight of an observed label.
OBSERVED = 1e4


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, in time linear in the text: each has one @, with a run of local characters before it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; leftmost non-overlapping for each kind."""
    out = [("email", a, b) for a, b in _emails(text)]
    if _NODE.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def nodes(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, int, str]]:
    """Tokens with a digit or @: (start, end, base label, key for skip edges)."""
    out, at = [], 0
    spans = sorted((a, b, LABELS.index(k)) for k, a, b in base)
    i, reach = 0, []
    while m := _NODE.search(text, at):
        begin = m.start()
        while begin > at and not _BLANK.match(text, begin - 1):
            begin -= 1
        stop = _BLANK.search(text, m.end())
        end = stop.start() if stop else len(text)
        while i < len(spans) and spans[i][0] < end:
            reach.append(spans[i])
            i += 1
        reach = [s for s in reach if s[1] > begin]
        label = min((s[2] for s in reach), default=0)
        word = text[begin:end]
        digits = re.sub(r"[^0-9]", "", word)
        out.append((begin, end, label, digits if len(digits) >= 3 and "@" not in word else word.strip("\"'.,;:()[]<>").lower()))
        at = end
    return out


def features(text: str, node: tuple[int, int, int, str]) -> list[float]:
    begin, end, base, _ = node
    word = text[begin:end]
    digits = sum(c in "0123456789" for c in word)
    letters = sum(c.isalpha() for c in word)
    assigned = bool(_ASSIGNED.search(text[max(0, begin - 40) : begin] + word[: len(word) - len(word.lstrip("\"'"))]))
    f = [1.0] + [float(base == k) for k in range(1, 5)]
    f += [float(digits <= 2), float(3 <= digits <= 6), float(7 <= digits <= 12), float(digits >= 13), float(letters > digits), float("@" in word), float(word.count(".") >= 3), float(bool(_LONG.search(word)) and letters > 0 and digits > 0), float(assigned), float(word[:1] in "+(" or "-" in word)]
    return f


def _edges(found: list[tuple[int, int, int, str]], text: str, offset: int) -> tuple[list, list]:
    """Chain edges between nodes with at most two blanks or signs between; skip edges to the key's anchor.

    The anchor is the first node of the key in a base pattern, else its first node, so
    no mention is more than two edges from another one however often they repeat.
    """
    chain, skip, anchor = [], [], {}
    for k, (_, _, base, key) in enumerate(found):
        if len(key) >= 3 and (key not in anchor or base and not found[anchor[key]][2]):
            anchor[key] = k
    for k, (begin, _, _, key) in enumerate(found):
        if k and begin - found[k - 1][1] <= 2:
            chain.append((offset + k - 1, offset + k))
        if len(key) >= 3 and anchor[key] != k:
            skip.append((offset + min(k, anchor[key]), offset + max(k, anchor[key])))
    return chain, skip


def examples(n: int = 400, seed: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Generated texts with all their entities, some in forms that the base patterns miss."""
    r, out = random.Random(seed), []
    word = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(2, 8)))
    for _ in range(n):
        text, gold = "", []

        def say(s: str, kind: str | None = None) -> None:
            nonlocal text
            text += " " * bool(text)
            if kind:
                gold.append((kind, len(text), len(text) + len(s)))
            text += s

        area, line = r.randint(200, 999), f"555-{r.randint(0, 9999):04d}"
        card = [str(r.randint(0, 9)) for _ in range(15)]
        card = next(c for c in ("".join(card) + str(d) for d in range(10)) if luhn(c))
        token = "".join(r.choice("0123456789abcdef") for _ in range(40))
        mail = f"{word()}.{r.randint(1, 99)}@{word()}.example.com"
        address = ".".join(str(r.randint(1, 255)) for _ in range(4))
        forms = [[(mail, "email")], [(address, "ip")], [(card, "card")], [(f"+1 ({area}) {line}", "phone")], [(f"+1 ({area}) {line}", "phone"), (f"({area}) {line}", "phone")], [("token =", None), (f'"{token}"', "secret")]]
        chosen = r.sample(forms, r.randint(1, 3))
        if r.random() < 0.4:
            chosen += r.sample(chosen, 1)
        noise = [f"{r.randint(1, 40)}", f"{r.randint(1900, 2030)}", f"{r.randint(1, 9)}.{r.randint(0, 9)}", f"({area + 1})", f"{r.randint(10**9, 10**12)}", f"{r.randint(10**15, 9 * 10**15)}", f"{r.randint(100, 999)}-{r.randint(1000, 9999)}", "".join(r.choice("0123456789abcdef") for _ in range(32)), f"@{word()}"]
        chosen += [[(x, None)] for x in r.sample(noise, r.randint(1, 5))]
        r.shuffle(chosen)
        for form in chosen:
            for s, kind in form:
                if kind != "secret":
                    for _ in range(r.randint(1, 5)):
                        say(word())
                say(s, kind)
        out.append((text, gold))
    return out


class Field:
    """Weights of node features, chain and skip edges."""

    def __init__(self, w: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.w, self.chain, self.skip = w, chain, skip

    @classmethod
    def train(cls, data=None, steps: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> Field:
        """Pseudo-likelihood: each label given its neighbours' labels is a logistic model of features and neighbour counts."""
        x, y, chain, skip = [], [], [], []
        for text, gold in data or examples():
            found = nodes(text, base_spans(text))
            c, s = _edges(found, text, len(x))
            chain += c
            skip += s
            for node in found:
                x.append(features(text, node))
                y.append(next((LABELS.index(k) for k, a, b in gold if a < node[1] and node[0] < b), 0))
        x, y, m = np.array(x), np.array(y), len(LABELS)
        near = np.zeros((3, len(y), m))  # labels of the node before, after, and of skip neighbours
        for a, b in chain:
            near[0, b, y[a]] += 1
            near[1, a, y[b]] += 1
        for a, b in skip:
            near[2, a, y[b]] += 1
            near[2, b, y[a]] += 1
        w, t, k = np.zeros((x.shape[1], m)), np.zeros((m, m)), np.zeros((m, m))
        target = np.eye(m)[y]
        for _ in range(steps):
            z = x @ w + near[0] @ t + near[1] @ t.T + near[2] @ k
            z = np.exp(z - z.max(1, keepdims=True))
            g = (target - z / z.sum(1, keepdims=True)) / len(y)
            w += 8 * rate * (x.T @ g - ridge * w)
            t += 8 * rate * (near[0].T @ g + (near[1].T @ g).T - ridge * t)
            d = near[2].T @ g
            k += 8 * rate * (d + d.T - ridge * k)
        return cls(w, t, k)

    def marginals(self, x: np.ndarray, chain: list, skip: list) -> np.ndarray:
        """Label probabilities of all nodes of any number of documents at once, by damped loopy sum-product.

        Labels from base patterns are observed, since their spans always stay: any number of uncertain mentions can't outvote a full form.
        """
        unary = x @ self.w
        unary[:, 1:5] += OBSERVED * x[:, 1:5]
        edges = np.array([*chain, *skip], np.int64).reshape(-1, 2)
        belief = unary
        if len(edges):
            pair = np.stack([self.chain, self.skip, self.chain.T, self.skip.T])
            source, to = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
            kind = np.r_[np.zeros(len(chain), np.int8), np.ones(len(skip), np.int8)]
            kind = np.r_[kind, kind + 2]
            n, back = len(edges), np.r_[np.arange(len(edges), 2 * len(edges)), np.arange(len(edges))]
            sent, rounds, old = np.zeros((2 * n, len(LABELS))), 0, DAMPING
            while True:
                belief = unary.copy()
                np.add.at(belief, to, sent)
                new = np.empty_like(sent)
                for a in range(0, 2 * n, EDGES):  # a matrix for each edge, so not all at once
                    part = slice(a, a + EDGES)
                    out = (belief[source[part]] - sent[back[part]])[:, :, None] + pair[kind[part]]
                    top = out.max(1, keepdims=True)
                    new[part] = np.log(np.exp(out - top).sum(1)) + top[:, 0]
                new -= new.max(1, keepdims=True)
                far = np.abs(new - sent).max()
                sent = old * sent + (1 - old) * new
                rounds += 1
                if far <= TOLERANCE:
                    break
                if rounds % PATIENCE == 0:
                    old = 1 - (1 - old) / 2
                    if 1 - old < TOLERANCE:
                        break
            belief = unary.copy()
            np.add.at(belief, to, sent)
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _trim(text: str, a: int, b: int, kind: str) -> tuple[int, int]:
    edge = "\"'.,;:<>[]{}|#*$%&" + "()=" * (kind == "secret")
    while a < b and text[a] in edge:
        a += 1
    while b > a and text[b - 1] in edge:
        b -= 1
    return a, b


def spans(texts: list[str], field: Field, least: float = 0.5) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; an added span is a run of nodes of one label, clear of base spans."""
    bases = [base_spans(t) for t in texts]
    found = [nodes(t, b) for t, b in zip(texts, bases)]
    x, chain, skip = [], [], []
    for t, f in zip(texts, found):
        c, s = _edges(f, t, len(x))
        chain += c
        skip += s
        x += [features(t, n) for n in f]
    p = field.marginals(np.array(x), chain, skip) if x else np.zeros((0, len(LABELS)))
    label = np.where(p.max(1) > least, p.argmax(1), 0) if len(p) else np.zeros(0, np.int64)
    out, at = [], 0
    for t, base, f in zip(texts, bases, found):
        more, open_ = [], None
        for (a, b, known, _), y in zip(f, label[at : at + len(f)].tolist()):
            if known or not y:
                open_ = None
            elif open_ is not None and more[open_][0] == y and a - more[open_][2] <= 1:
                more[open_] = (y, more[open_][1], b)
            else:
                more.append((y, a, b))
                open_ = len(more) - 1
        at += len(f)
        added = [(LABELS[y], *_trim(t, a, b, LABELS[y])) for y, a, b in more]
        everything = base + [s for s in added if s[1] < s[2]]
        out.append((base, sorted(everything, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
    return out


def _joined(found: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


SCHEMA = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:4]), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_secret", pa.int64()), ("n_added", pa.int64())])


def _find(field):
    def run(batches):
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            first = 0
            while first < len(batch):
                # rows of about BYTES of text, one at least
                stop = max(first + 1, min(first + 256, int(np.searchsorted(size, (size[first - 1] if first else 0) + BYTES, "right"))))
                texts = [t or "" for t in batch.column(1).slice(first, stop - first).to_pylist()]
                results = spans(texts, field.value)
                cols = [[sum(s[0] == k for s in base) for base, _ in results] for k in KINDS[:4]]
                told = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in results]
                secret = [sum(s[0] == "secret" for s in all_) for _, all_ in results]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *(pa.array(c, pa.int64()) for c in cols), pa.array(told, pa.string()), pa.array([_joined(a) for _, a in results], pa.string()), pa.array(secret, pa.int64()), pa.array([len(a) - len(b) for b, a in results], pa.int64())], schema=SCHEMA)
                first = stop

    return run


def find_personal(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_email, n_ip, n_card, n_phone (base patterns), base_sha256, spans, n_secret, n_added.

    spans are kind:start:end in code points, by kind and start. Null counts as an
    empty text, without spans; repeated rows each have a row; ids may be null. No
    other column is read.
    """
    held = docs.sparkSession.sparkContext.broadcast(field or Field.train())
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return named.mapInArrow(_find(held), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_added long")
