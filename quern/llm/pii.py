"""Personal data: pattern spans, and a skip-chain conditional random field that makes labels consistent in a document.

Patterns give base spans of four kinds: email, ip, card, phone.  The field then looks at every other number-like or
address-like candidate of a document that has base spans.  Its nodes are base spans and candidates in text order, its
labels O and the four kinds.  Node potentials are log-linear in a candidate's shape; base spans are observed.  Chain
edges join neighbours; skip edges join equal or similar nodes (the same case-folded text, the same nine last digits, or
an address and its own local part) however far apart: one edge to the previous node of the same likeness and, where
neither neighbour in that likeness is a base span, one to the nearest base span of it (the last before, else the first
after).  So edges grow with nodes, and a base span reaches each repeat by itself, however many there are: a run of
repeats hanging on one edge would rather break it than bear the sum of their bias to O.  As base spans are observed,
these edges are terms of the repeats' own potentials.  Loopy sum-product messages run until they change by less than
1e-4, or for ``ROUNDS`` rounds; a candidate whose most likely label is a kind is added.

Node, chain and skip weights are fitted together, by gradient ascent on the pseudo-likelihood of candidates' labels given
their neighbours', in a bounded sample of documents (``train_docs`` of at most ``max_chars`` code points; every document is
scanned and labelled whole).  Patterns label base spans only, so for each base span of the sample its document gets, at some place, a mention in
a form that the patterns refuse (a phone without its country, a card in dotted groups, an address's local part), labelled
with its kind, and a look-alike of the same shape with other digits, labelled O as all other candidates are.

Without a base span all skip potentials meet only unlabelled nodes, and every label stays O; such documents are done
after the patterns.  Base spans always stay.  Offsets are code points, ends exclusive.

Defined results: null text is empty and has no spans; repeated rows each get the same answer; null ids stay null; other
columns are not read.  A sample without candidates leaves the stated weights of ``Field``.  Patterns and candidates are
found in time linear in the text, also in texts that are one long run of digits or marks.

At scale: one map over the table, no shuffle; the model is a few dozen numbers.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.storage import modest_batches
from quern.llm.textcore import trim, trimmed

KINDS = ("email", "ip", "card", "phone")
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"[+(]?[0-9](?:[ ().-]{0,2}[0-9])++")
_WORD = re.compile(r"[A-Za-z0-9._%+-]++(?:@[A-Za-z0-9.-]*+)?")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start."""
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        done = 0
        for m in _AT.finditer(text):
            a = m.start()
            while a > done and text[a - 1] in _LOCAL:
                a -= 1
            if a < m.start():
                out.append((0, a, m.end()))
                done = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) < 256 for x in m[0].split(".")):
                out.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and m.end() - m.start() <= 37:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


def candidates(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Number-like and address-like stretches that touch no base span."""
    out = [(m.start(), m.end()) for m in _NUMBER.finditer(text) if m.end() - m.start() >= 7]
    for m in _WORD.finditer(text):
        if m.end() - m.start() >= 5:
            word = m[0].rstrip("._%+@-")
            a = m.end() - len(m[0].lstrip(".-"))
            if m.start() + len(word) - a >= 5 and _mixed(word):
                out.append((a, m.start() + len(word)))
    out.sort()
    taken, kept, last = sorted(taken), [], 0
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    for a, b in out:
        k = bisect_left(starts, b)  # spans that start before the candidate ends, and how far they reach
        if a >= last and (k == 0 or reach[k - 1] <= a):
            kept.append((a, b))
            last = b
    return kept


def _mixed(word: str) -> bool:
    return any("0" <= c <= "9" or c in "@_%+" for c in word) and any(c.isalpha() for c in word)


def likenesses(piece: str, kind: int | None) -> list[str]:
    """Keys under which nodes count as equal or similar."""
    digits = "".join(c for c in piece if "0" <= c <= "9")
    keys = ["=" + piece.casefold()]
    if len(digits) >= 8 and "@" not in piece and (kind != 1) and not any(c.isalpha() for c in piece):
        keys.append("#" + digits[-9:])
    if kind == 0:
        keys.append("=" + piece.rpartition("@")[0].casefold())
    return keys


def shape(piece: str) -> np.ndarray:
    """Features of a candidate: a constant, digit counts, separators, letters."""
    d = sum("0" <= c <= "9" for c in piece)
    return np.array([1, d <= 6, 7 <= d <= 9, 10 <= d <= 12, 13 <= d <= 15, 16 <= d <= 19, d > 19, piece[:1] == "+", "(" in piece, piece.count(".") == 3, "@" in piece, any(c.isalpha() for c in piece), "-" in piece, " " in piece], float)


ROUNDS = 400
N_LABELS, N_FEATURES = 1 + len(KINDS), len(shape(""))


class Field:
    """The skip-chain field: node weights (features by labels), chain weight, skip weight."""

    def __init__(self, node: np.ndarray | None = None, chain: float = 0.2, skip: float = 4.0):
        if node is None:
            node = np.zeros((N_FEATURES, N_LABELS))
            node[0, 0] = 2.0
        self.node, self.chain, self.skip = node, chain, skip

    def edges(self, keys: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        pairs, weights, last = [], [], {}
        for k, own in enumerate(keys):
            if k:
                pairs.append((k - 1, k))
                weights.append(self.chain)
            for key in own:
                if key in last and last[key] != k:
                    pairs.append((last[key], k))
                    weights.append(self.skip)
                last[key] = k
        return np.array(pairs, np.int64).reshape(-1, 2), np.array(weights, float)

    def reach(self, unary: np.ndarray, keys: list[list[str]], kinds: list[int]) -> None:
        """Adds to ``unary`` the skip edges from nodes to base spans that are no neighbours of theirs in a likeness."""
        alike: dict[str, list[int]] = {}
        for i, own in enumerate(keys):
            for key in dict.fromkeys(own):
                alike.setdefault(key, []).append(i)
        for nodes in alike.values():
            based = [at for at, i in enumerate(nodes) if kinds[i] >= 0]
            for at, i in enumerate(nodes):
                k = bisect_left(based, at)
                if based and kinds[i] < 0 and not any(abs(b - at) == 1 for b in based[max(0, k - 1) : k + 1]):
                    unary[i, kinds[nodes[based[max(0, k - 1)]]] + 1] += self.skip

    def beliefs(self, unary: np.ndarray, pairs: np.ndarray, weights: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
        """Loopy sum-product over Potts edges; rows are log beliefs of nodes."""
        m = len(pairs)
        if not m:
            return unary - np.logaddexp.reduce(unary, axis=1, keepdims=True)
        source, target = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        same = np.exp(np.concatenate([weights, weights]))[:, None] - 1
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        message = np.zeros((2 * m, N_LABELS))
        for _ in range(rounds):
            total = unary.copy()
            np.add.at(total, target, message)
            out = total[source] - message[back]
            out = np.exp(out - out.max(1, keepdims=True))
            new = np.log(out * same + out.sum(1, keepdims=True))
            new -= new.max(1, keepdims=True)
            if np.abs(new - message).max() < 1e-4:
                break
            message = 0.5 * message + 0.5 * new
        total = unary.copy()
        np.add.at(total, target, message)
        return total - np.logaddexp.reduce(total, axis=1, keepdims=True)

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans that consistency with the base spans adds."""
        if not base:
            return []
        spare = candidates(text, [(a, b) for _, a, b in base])
        if not spare:
            return []
        nodes = sorted([(a, b, k) for k, a, b in base] + [(a, b, -1) for a, b in spare])
        keys = [likenesses(text[a:b], k if k >= 0 else None) for a, b, k in nodes]
        known = {key for (_, _, k), own in zip(nodes, keys, strict=True) if k >= 0 for key in own}
        if not any(k < 0 and known.intersection(own) for (_, _, k), own in zip(nodes, keys, strict=True)):
            return []  # no likeness reaches a base span: every candidate keeps the label O that its shape prefers
        unary = np.zeros((len(nodes), N_LABELS))
        for row, (a, b, k) in zip(unary, nodes, strict=True):
            if k >= 0:
                row[:] = -50
                row[k + 1] = 0
            else:
                row[:] = shape(text[a:b]) @ self.node
        self.reach(unary, keys, [k for _, _, k in nodes])
        best = self.beliefs(unary, *self.edges(keys)).argmax(1)
        return [(int(y) - 1, a, b) for y, (a, b, k) in zip(best, nodes, strict=True) if k < 0 and y > 0]


def refused_form(piece: str, kind: int) -> str | None:
    """A mention of a base span that the patterns don't take; None where there is none that makes a candidate."""
    digits = "".join(c for c in piece if "0" <= c <= "9")
    if kind == 0:
        word = piece.rpartition("@")[0]
        return word if len(word) >= 5 and _mixed(word) else None
    if kind == 2:
        return ".".join(digits[k : k + 4] for k in range(0, len(digits), 4))
    if kind == 3 and len(digits) >= 10:
        national = re.sub("^[+][0-9]*[^0-9(]*", "", piece)
        return national if sum("0" <= c <= "9" for c in national) >= 9 else digits[-10:]
    return None


def look_alike(piece: str) -> str:
    """The same shape with other digits and, in addresses, other letters."""
    turn = str.maketrans("0123456789abcdefghijklmnopqrstuvwxyz", "3456789012nopqrstuvwxyzabcdefghijklm")
    return piece.translate(turn)


def training_document(text: str) -> list[tuple[str, int, int]]:
    """Nodes (text, kind of a base span or -1, label or -1 where unknown) of a text with mentions and look-alikes added."""
    base = base_spans(text)
    nodes = [(a, b, k) for k, a, b in base] + [(a, b, -1) for a, b in candidates(text, [(a, b) for _, a, b in base])]
    nodes = [(text[a:b], k, k + 1) for a, b, k in sorted(nodes)]
    held = {key for piece, k, _ in nodes if k >= 0 for key in likenesses(piece, k)}
    nodes = [(piece, k, y if k >= 0 or not held.intersection(likenesses(piece, None)) else -1) for piece, k, y in nodes]
    for k, a, b in base:
        form = refused_form(text[a:b], k)
        for node in [] if form is None else [(form, -1, k + 1), (look_alike(form), -1, 0)]:
            nodes.insert(crc32(f"{node[0]}/{len(nodes)}".encode()) % (len(nodes) + 1), node)  # anywhere: no order to learn
    return nodes


def train(texts: list[str], rounds: int = 600, rate: float = 0.3, prior: float = 1e-3, chain_prior: float = 0.05) -> Field:
    """Pseudo-likelihood fit of node, chain and skip weights on base labels, refused mentions and look-alikes."""
    x, y, chain, skip = [], [], [], []
    plain = Field(chain=0.0, skip=1.0)
    for text in texts:
        nodes = training_document(text)
        keys = [likenesses(piece, k if k >= 0 else None) for piece, k, _ in nodes]
        one = np.zeros((len(nodes) + 1, N_LABELS))  # the last row is no node's
        for i, (_, _, label) in enumerate(nodes):
            if label >= 0:
                one[i, label] = 1
        alike = np.zeros((len(nodes), N_LABELS))
        for (i, j), w in zip(*plain.edges(keys), strict=True):
            alike[i] += w * one[j]
            alike[j] += w * one[i]
        plain.reach(alike, keys, [k for _, k, _ in nodes])
        for i, (piece, k, label) in enumerate(nodes):
            if k < 0 <= label:
                x.append(shape(piece))
                y.append(label)
                chain.append(one[i - 1] * (i > 0) + one[i + 1])
                skip.append(alike[i])
    if not x:
        return Field()
    x, y, chain, skip = np.array(x), np.eye(N_LABELS)[y], np.array(chain), np.array(skip)
    start = Field()
    theta = np.concatenate([start.node.ravel(), [start.chain, start.skip]])
    moment, square, shrink = np.zeros_like(theta), np.zeros_like(theta), np.full(len(theta), prior)
    shrink[-2] = chain_prior  # neighbours in the text say little, so few documents shall not make much of them
    for t in range(1, rounds + 1):
        logits = x @ theta[:-2].reshape(N_FEATURES, N_LABELS) + theta[-2] * chain + theta[-1] * skip
        p = np.exp(logits - logits.max(1, keepdims=True))
        left = y - p / p.sum(1, keepdims=True)
        slope = np.concatenate([(x.T @ left).ravel(), [(left * chain).sum(), (left * skip).sum()]]) / len(x) - shrink * theta
        moment, square = 0.9 * moment + 0.1 * slope, 0.99 * square + 0.01 * slope * slope  # steps by Adam's rule
        theta = theta + rate / np.sqrt(t) * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return Field(theta[:-2].reshape(N_FEATURES, N_LABELS), float(theta[-2]), float(theta[-1]))


def fit(docs: DataFrame, train_docs: int = 2000, id_col: str = "doc_id", text_col: str = "text", max_chars: int = 8000) -> Field:
    """Fits on at most ``train_docs`` distinct rows, the first by a hash, of at most ``max_chars`` code points with a digit or an at sign."""
    text = F.col(text_col)
    some = docs.select(F.xxhash64(F.col(id_col), text).alias("h"), text.alias("text")).where((F.length(text) <= max_chars) & text.rlike("[0-9@]"))
    chosen = [r.h for r in some.select("h").distinct().orderBy("h").limit(train_docs).collect()]
    if not chosen:
        return train([])
    rows = some.where(F.col("h") <= chosen[-1]).groupBy("h").agg(F.min("text").alias("text")).collect()
    field = train([r.text for r in sorted(rows)])
    del rows
    trim()
    return field


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (of all spans), base_sha256, spans, n_added."""
    modest_batches(docs.sparkSession)
    field = field or fit(docs, id_col=id_col, text_col=text_col)

    def work(batches):
        for batch in batches:
            counts, digests, listed, more = [], [], [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text) if text else []
                added = field.added(text, base) if base else []
                spans = base + added
                counts.append([sum(k == i for k, _, _ in spans) for i in range(len(KINDS))])
                digests.append(hashlib.sha256(spelled(base).encode()).hexdigest())
                listed.append(spelled(spans))
                more.append(len(added))
            kinds = np.array(counts, np.int64).reshape(-1, len(KINDS)).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, kinds), pa.array(digests, pa.string()), pa.array(listed, pa.string()), pa.array(more, pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(trimmed(work), f"doc_id long, {counts}, base_sha256 string, spans string, n_added long")


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each stretch covered by spans becomes its kind's placeholder (of overlapping spans, the first one's)."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the found spans replaced in the text (and the count of code points renewed); null text stays null."""
    modest_batches(docs.sparkSession)
    field = field or fit(docs, id_col=id_col, text_col=text_col)

    def work(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            column = batch.column(at)
            texts = column.to_pylist()
            for i, text in enumerate(texts):
                base = base_spans(text) if text else []
                if base:
                    texts[i] = redact_text(text, base + field.added(text, base))
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, column.type))
            if chars_col in batch.schema.names:
                k = batch.schema.get_field_index(chars_col)
                batch = batch.set_column(k, batch.schema.field(k), pa.array([None if t is None else len(t) for t in texts]).cast(batch.column(k).type))
            yield batch

    return docs.mapInArrow(trimmed(work), docs.schema)
