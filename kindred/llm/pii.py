"""Operator 5, personal data: exact patterns, and a skip-chain conditional random field that spreads their labels.

Base matches (email, ip, card, phone) are regular expressions with a validity check. Tokens that merely look like
such data (numbers of seven digits or more with separators, words with an @) become variables of a field over the
document: neighbours in order are linked, and so are distant tokens that repeat or resemble each other (equal
digits, equal last seven digits, equal network part, equal mailbox). Loopy message passing makes labels agree along these
links: a number that is written as a valid phone number once and without its prefix later is found both times. A
token is added when its posterior is high and it has a skip link, or would be a base match if it stood alone; base matches
always stay. Numbers that stand side by side, which a base pattern takes for one too long, are tokens of their own.

Texts without a base match are judged in the same way: linked look-alikes are found where their cues and form alone
make the posterior high.

Feature weights, transition weights and the weight of agreement are learned from counts on a bounded sample of
documents, labelled by the base patterns (`train_docs` documents of least hash). A look-alike that skip links join to a base match
has no label there, since the patterns can't tell, and is left out of the counts; agreement counts linked base matches, beside
a prior (`agreement`). What only a pattern's notation asks for, such as a number's plus, is no feature: look-alikes lack it by definition.

Cases: null text is empty and has no spans; spans are code points, end exclusive; without spans the results are empty
strings. Without training rows weights are flat. Links join consecutive occurrences, so a token repeated n times has n - 1
links. Ties: of equal posteriors the kind listed first wins, and tokens of equal keys link in order of position. Very long
texts are judged whole, at a cost in proportion to their length. Repeated rows give repeated results; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import map_arrow

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
# The base patterns, written so that a failing text costs linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
MAILBOX = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
WORD = re.compile(r"[^ ]+")
AREA = re.compile(r"\([+0-9]")
# What looks like data.
NUMBER = re.compile(r"\+?\(?[0-9][ ().0-9-]{5,}[0-9]")
AT = re.compile(r"@|\(at\)|\[at\]")
AT_STOP = re.compile(r"[\s@<>\"'(),;\]]")
AT_REST = re.compile(r"[^\s@<>\"'(),;]+")
LONGEST = 19  # digits of a number that can be one of the kinds
CUES = (
    ("phone", re.compile(r"(?i)(?:tel|phone|fon|call|mobil|handy|móvil|tél)[^\n]{0,12}$")),
    ("card", re.compile(r"(?i)(?:card|visa|karte|carte|tarjeta)[^\n]{0,12}$")),
    ("ip", re.compile(r"(?i)(?:\bip\b|host|server|addr)[^\n]{0,12}$")),
    ("email", re.compile(r"(?i)(?:mail|correo|courriel)[^\n]{0,12}$")),
)
Span = tuple[int, int, int]


@dataclass(frozen=True)
class PiiParams:
    train_docs: int = 2000
    rounds: int = 20
    damping: float = 0.3
    least: float = 0.9  # posterior of an added token
    agreement: tuple[float, float] = (20.0, 1.0)  # prior counts of linked pairs that agree and don't


@dataclass(frozen=True)
class PiiModel:
    prior: tuple[float, ...]
    features: dict[str, tuple[float, ...]]
    chain: tuple[tuple[float, ...], ...]
    agree: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Each @ can end one mailbox, which reaches left to the last match's end at most."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in MAILBOX:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        done = max(done, at + 1) if not m else done  # a run can't cross an @, so nothing before it matters again
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) by start, then kind."""
    out = _emails(text) if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or "0") <= 255 for g in m.groups())]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = NOT_DIGIT.sub("", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _digits(s: str) -> int:
    return len(NOT_DIGIT.sub("", s))


def _at_words(text: str) -> list[tuple[int, int]]:
    """Words around an @ or its spelt forms; each grows left to the end of the last one at most, so the cost is linear."""
    out, done = [], 0
    for m in AT.finditer(text):
        a = m.start()
        while a > done and not AT_STOP.match(text, a - 1):
            a -= 1
        rest = AT_REST.match(text, m.end())
        if a < m.start() and rest:
            out.append((a, rest.end()))
        done = m.end()
    return out


def candidates(text: str, base: list[Span]) -> list[tuple[int, int, int]]:
    """(start, end, label) of what looks like data, with the label of an overlapping base match, by start.

    Base matches are candidates with their own bounds; look-alikes that touch one are not added again.
    """
    found = [(s, e, k) for s, k, e in base]
    looks = []
    if DIGIT.search(text):
        for m in NUMBER.finditer(text):
            # what is too long for one number is several that stand side by side
            parts = [(m.start(), m.end())] if _digits(m[0]) <= LONGEST else [(m.start() + p.start(), m.start() + p.end()) for p in WORD.finditer(m[0])]
            looks += [(a, b) for a, b in parts if _digits(text[a:b]) >= 7]
    looks += _at_words(text)
    ends, i, taken = sorted(found), 0, -1
    for s, e in sorted(looks):
        while i < len(ends) and ends[i][1] <= s:
            taken, i = max(taken, ends[i][1]), i + 1
        if s >= taken and not (i < len(ends) and ends[i][0] < e):
            found.append((s, e, OTHER))
            taken = max(taken, e)
    return sorted(found)


def features(text: str, start: int, end: int) -> list[str]:
    s = text[start:end]
    digits = NOT_DIGIT.sub("", s)
    cue = next((name for name, p in CUES if p.search(text, max(0, start - 24), start)), "none")
    inside = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    size = next(n for n in (0, 6, 8, 15, LONGEST, math.inf) if len(digits) <= n)  # a number loses some digits with its prefix
    return [f"luhn{12 <= len(digits) <= LONGEST and luhn(digits)}", f"inside{inside}", f"n{size}", f"par{bool(AREA.search(s))}", f"dot{min(s.count('.'), 4)}", f"at{'@' in s or 'at' in s}", f"sep{' ' in s}{'-' in s}", f"cue_{cue}"]


def keys(text: str, start: int, end: int) -> list[str]:
    """What a token shares with the tokens that it is linked to."""
    s = text[start:end].lower()
    if "@" in s or "at)" in s or "at]" in s:
        box = re.split(r"@|\(at\)|\[at\]", s, maxsplit=1)
        return [f"w{s}", f"b{box[0]}"] if len(box[0]) > 3 else [f"w{s}"]
    digits = NOT_DIGIT.sub("", s)
    out = [f"d{digits}"]
    if s.count(".") == 3:
        return [*out, f"i{s.rsplit('.', 1)[0]}"]
    return [*out, f"e{digits[-7:]}"] + ([f"c{digits[:6]}{len(digits)}"] if len(digits) >= 12 else [])


def links(text: str, tokens: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Skip links between consecutive tokens of a shared key; each pair once."""
    last: dict[str, int] = {}
    out: dict[tuple[int, int], None] = {}
    for i, (s, e, _) in enumerate(tokens):
        for k in keys(text, s, e):
            if k in last and last[k] != i:
                out[(last[k], i)] = None
            last[k] = i
    return list(out)


def _alone(text: str, start: int, end: int) -> int:
    """The kind of the base match that a token would be if it stood alone."""
    return next((k for s, k, e in base_spans(text[start:end]) if (s, e) == (0, end - start)), OTHER)


def _unlabelled(tokens: list[tuple[int, int, int]], skips: list[tuple[int, int]]) -> set[int]:
    """Look-alikes that skip links join to a labelled token, over other look-alikes or at once."""
    near: dict[int, list[int]] = defaultdict(list)
    for i, j in skips:
        near[i].append(j)
        near[j].append(i)
    reached = {i for i in near if tokens[i][2] != OTHER}
    open_ = list(reached)
    while open_:
        more = [j for j in near[open_.pop()] if j not in reached]
        reached.update(more)
        open_ += more
    return {i for i in reached if tokens[i][2] == OTHER}


def counts(texts: list[str]) -> dict[str, int]:
    """What training needs of some documents."""
    out: dict[str, int] = defaultdict(int)
    for t in texts:
        tokens = [(s, e, _alone(t, s, e) if k == OTHER else k) for s, e, k in candidates(t, base_spans(t))]
        skips = links(t, tokens)
        unknown, skipped = _unlabelled(tokens, skips), set(skips)
        for i, (s, e, k) in enumerate(tokens):
            if i in unknown:
                continue
            out[f"L:{k}"] += 1
            for f in features(t, s, e):
                out[f"F:{f}:{k}"] += 1
            if i and i - 1 not in unknown and (i - 1, i) not in skipped:
                out[f"T:{tokens[i - 1][2]}:{k}"] += 1
        for i, j in skips:
            if OTHER not in (tokens[i][2], tokens[j][2]) and tokens[i][1] <= tokens[j][0]:  # one place may match two patterns
                out[f"S:{int(tokens[i][2] == tokens[j][2])}"] += 1
    return out


def train(docs: DataFrame, params: PiiParams = PiiParams()) -> PiiModel:
    """Weights from counts over the `train_docs` documents of least hash; their texts are whole."""
    ids = docs.select(F.col("doc_id").alias("d")).where(F.col("d").isNotNull()).distinct().orderBy(F.xxhash64("d"), "d").limit(params.train_docs)
    chosen = docs.select(F.col("doc_id").alias("d"), F.col("text").alias("t")).where(F.col("t").isNotNull()).join(F.broadcast(ids), "d", "left_semi")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = counts(batch.column(0).to_pylist())
        return pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.int64())], ["k", "n"])

    sums = {r.k: r.n for r in map_arrow(chosen.select("t"), run, "k string, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}  # one row a feature and label
    labels = range(OTHER + 1)
    seen = [sums.get(f"L:{k}", 0) for k in labels]
    total = sum(seen) + len(seen)
    prior = tuple(math.log((n + 1) / total) for n in seen)
    names = {k.split(":")[1] for k in sums if k[0] == "F"}
    feats = {f: tuple(math.log((sums.get(f"F:{f}:{k}", 0) + 0.5) / (seen[k] + 1)) for k in labels) for f in names}
    after = [[sums.get(f"T:{a}:{b}", 0) + 1 for b in labels] for a in labels]
    chain = tuple(tuple(math.log(n / sum(row)) - prior[b] for b, n in enumerate(row)) for row in after)
    agree = math.log((sums.get("S:1", 0) + params.agreement[0]) / (sums.get("S:0", 0) + params.agreement[1]))
    return PiiModel(prior, feats, chain, agree)


def infer(model: PiiModel, text: str, tokens: list[tuple[int, int, int]], skips: list[tuple[int, int]], params: PiiParams = PiiParams()) -> np.ndarray:
    """Posteriors (tokens, labels) by damped loopy sum-product over chain and skip edges."""
    n, size = len(tokens), OTHER + 1
    unary = np.zeros((n, size))
    for i, (s, e, k) in enumerate(tokens):
        unary[i] = model.prior
        for f in features(text, s, e):
            unary[i] += model.features.get(f, 0.0)
        if k != OTHER:
            unary[i] = np.where(np.arange(size) == k, 0.0, -40.0)  # observed
    skipped = set(skips)
    chain = [(i, i + 1) for i in range(n - 1) if (i, i + 1) not in skipped]
    edges = np.array(chain + skips).reshape(-1, 2)
    if not len(edges):
        p = np.exp(unary - unary.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
    table = np.concatenate([np.repeat(np.array(model.chain)[None], len(chain), 0), np.repeat((np.eye(size) * model.agree)[None], len(skips), 0)])
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    potential = np.concatenate([table, table.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    messages = np.zeros((len(source), size))
    for _ in range(params.rounds):
        belief = unary.copy()
        np.add.at(belief, target, messages)
        cavity = belief[source] - messages[back]
        joint = cavity[:, :, None] + potential
        top = joint.max(1)
        new = top + np.log(np.exp(joint - top[:, None, :]).sum(1))
        new -= new.max(1, keepdims=True)
        change = float(np.abs(new - messages).max())
        messages = params.damping * messages + (1 - params.damping) * new
        if change < 1e-4:
            break
    belief = unary.copy()
    np.add.at(belief, target, messages)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def find(text: str, model: PiiModel, params: PiiParams = PiiParams()) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans of one text."""
    base = base_spans(text)
    tokens = candidates(text, base)
    if len(tokens) == len(base):
        return base, []
    skips = links(text, tokens)
    linked = {i for pair in skips for i in pair}
    p = infer(model, text, tokens, skips, params)
    label = p.argmax(1)
    added = [(s, int(label[i]), e) for i, (s, e, k) in enumerate(tokens) if k == OTHER and label[i] != OTHER and p[i, label[i]] >= params.least and (i in linked or _alone(text, s, e) == label[i])]
    return base, added


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, overlapping ones together, replaced by its first kind in brackets."""
    out, at = [], 0
    for s, k, e in sorted(spans):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], f"[{KINDS[k]}]"]
        at = e
    return "".join([*out, text[at:]])


def digest(docs: DataFrame, model: PiiModel, params: PiiParams = PiiParams()) -> DataFrame:
    """Per row: base matches by kind and their digest, all spans and their number."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, 1000):
            rows: list[list] = [[] for _ in range(7)]
            for t in batch.column(1).slice(at, 1000).to_pylist():
                base, added = find(t or "", model, params)
                for k in range(4):
                    rows[k].append(sum(s[1] == k for s in base))
                rows[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
                rows[5].append(joined(base + added))
                rows[6].append(len(base) + len(added))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1000), *(pa.array(r, t) for r, t in zip(rows, types))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redacted(docs: DataFrame, model: PiiModel, params: PiiParams = PiiParams()) -> DataFrame:
    """docs with every span of `text` replaced; n_chars, where there is one, follows. Null texts stay null."""
    names = docs.columns
    at = names.index("text")
    sized = "n_chars" in names

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(batch.columns)
        texts = columns[at].to_pylist()
        for i, t in enumerate(texts):
            if t:
                base, added = find(t, model, params)
                if base or added:
                    texts[i] = redact(t, base + added)
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        if sized:
            k = names.index("n_chars")
            old = columns[k].to_pylist()
            columns[k] = pa.array([n if t is None else len(t) for t, n in zip(texts, old)], batch.schema.field(k).type)
        return pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return map_arrow(docs, run, docs.schema)
