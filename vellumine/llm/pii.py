"""Personal data: stated patterns, and a semi-Markov conditional random field that adds spans.

The base patterns are scanned in linear time. The field works on windows around marks that could belong to
personal data and that no base span covers. Its candidates are whole segments of at most ``LONGEST`` tokens;
features of the entire segment (digit count and grouping, checksum, octets, spelled-out signs, neighbours)
score each candidate and kind, and dynamic programming over the window chooses boundaries and kinds
together. Weights are fitted by maximum likelihood on at most ``FIT_DOCS`` documents, where base spans are
the truth, also rewritten in the disguises that the patterns miss.
"""
from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

KINDS = ("email", "ip", "card", "phone")
FIT_DOCS = 1500
FIT_WINDOWS = 900
LONGEST = 24
AROUND = 8
EPOCHS = 12

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """What the pattern finds from left to right: around each @, the run before it and the domain after it."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            end = m.end()
        else:
            end = max(end, at)  # no match crosses this sign
        at = text.find("@", max(at + 1, end))
    return out


def addresses(text: str) -> list[Span]:
    """Runs of dotted numbers, four by four."""
    out = []
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in four):
                out.append((at, end, "ip"))
            at = end + 1
    return out


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 37:
            digits = re.sub(r"[ -]", "", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    return out


def phones(text: str) -> list[Span]:
    return [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.findall(m[0])) <= 15] if "+" in text else []


def base_spans(text: str) -> list[Span]:
    """By start, then kind as listed."""
    if "@" not in text and not _DIGITS.search(text):
        return []
    return sorted(emails(text) + addresses(text) + cards(text) + phones(text), key=lambda s: (s[0], KINDS.index(s[2])))


# Windows, candidates and features

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)
_MARK = re.compile(r"@|\[at\]|\(at\)|(?:[0-9][ ().:/-]{0,3}){7,}|[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}|\bat\b(?=.{1,40}\bdot\b)", re.I)
#: Each match of _MARK holds a digit or one of these, case ignored.
_NEEDED = ("@", "[at]", "(at)", "dot")
_SIGN = re.compile(r"@|[\[(]\s*at\s*[\])]", re.I)
_SPELLED_AT = re.compile(r"\s*(?:@|[\[(]\s*at\s*[\])]|\bat\b)\s*", re.I)
_SPELLED_DOT = re.compile(r"\s*(?:\.|[\[(]\s*dot\s*[\])]|\bdot\b)\s*", re.I)
_PLAIN_EMAIL = re.compile(r"[a-z0-9._%+-]{1,64}@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,12}", re.I)
FEATURES = (
    "bias", "tokens", "spaces", "glued before", "glued after", "word inside", "digits 7 to 9", "digits 10 to 11", "digits 12 to 15", "digits 16", "digits 17 to 19",
    "luhn", "fours", "groups 3 3 4", "brackets", "plus", "one group", "even separators", "octets", "four groups", "plain email", "spelled at", "spelled dot", "real at", "zero first", "letter near",
)


def marks(text: str) -> list[tuple[int, int]]:
    if not _DIGITS.search(text) and not any(x in text.lower() for x in _NEEDED):
        return []
    return [(m.start(), m.end()) for m in _MARK.finditer(text)]


def windows(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches of text around the marks, merged where they overlap."""
    out: list[list[int]] = []
    for a, b in spans:
        a, b = max(0, a - 40), min(len(text), b + 40)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int, list[float]]]:
    """(first token, token after the last, kind, features) for every segment that may be an entity."""
    out = []
    kinds = ["s" if text[a].isspace() else "d" if text[a].isdigit() and text[a].isascii() else "w" if text[a].isalpha() else text[a] for a, _ in tokens]
    n = len(tokens)
    for i in range(n):
        if kinds[i] not in "dw+(":
            continue
        digits = words = ats = dots = 0
        for j in range(i, min(n, i + LONGEST)):
            a, b = tokens[j]
            if kinds[j] == "d":
                digits += b - a
            elif kinds[j] == "w":
                words += 1
                ats += text[a:b].lower() == "at"
                dots += text[a:b].lower() == "dot"
            elif kinds[j] == "@":
                ats += 1
            if digits > 24 or text[a:b].count("\n"):
                break
            if kinds[j] == "d" and not words and kinds[i] in "d+(":
                span = text[tokens[i][0] : b]
                if 7 <= digits <= 15:
                    out.append((i, j + 1, 3, features(text, tokens[i][0], b, j + 1 - i, span, digits)))
                if 12 <= digits <= 19 and kinds[i] == "d":
                    out.append((i, j + 1, 2, features(text, tokens[i][0], b, j + 1 - i, span, digits)))
                if kinds[i] == "d" and span.count(".") == 3 and digits <= 12:
                    out.append((i, j + 1, 1, features(text, tokens[i][0], b, j + 1 - i, span, digits)))
            elif kinds[j] == "w" and ats == 1 and kinds[i] in "dw" and i < j:
                span = text[tokens[i][0] : b]
                if dots or "." in span and _SIGN.search(span):
                    out.append((i, j + 1, 0, features(text, tokens[i][0], b, j + 1 - i, span, digits)))
    return out


def features(text: str, a: int, b: int, size: int, span: str, digits: int) -> list[float]:
    number = "".join(_DIGITS.findall(span))
    groups = re.findall(r"[0-9]+", span)
    lengths = [len(g) for g in groups]
    joined = _SPELLED_DOT.sub(".", _SPELLED_AT.sub("@", span, count=1))
    between = re.findall(r"(?<=[0-9])[^0-9]+(?=[0-9])", span)
    before, after = text[a - 1 : a], text[b : b + 1]
    return [float(x) for x in (
        1, size / 10, span.count(" ") / 5, before.isalnum() or before in ("_", "=", '"', "."), after.isalnum() or after in ("_", "@", '"'), bool(re.search(r"[^\W\d_]", span)),
        7 <= digits <= 9, 10 <= digits <= 11, 12 <= digits <= 15, digits == 16, 17 <= digits <= 19,
        13 <= digits <= 19 and luhn(number), lengths[:-1] == [4] * (len(lengths) - 1) and len(lengths) >= 3, lengths[-3:] == [3, 3, 4], "(" in span and ")" in span, span[:1] == "+",
        len(groups) == 1, len(set(between)) == 1, len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups), len(groups) == 4, bool(_PLAIN_EMAIL.fullmatch(joined)),
        bool(re.search(r"[\[(]\s*at\s*[\])]|\sat\s", span, re.I)), bool(re.search(r"[\[(]\s*dot\s*[\])]|\sdot\s", span, re.I)), "@" in span, number[:1] == "0", before.isalpha() or after.isalpha(),
    )]


def viterbi(n: int, found: list[tuple[int, int, int, list[float]]], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """The best segmentation of n tokens: (first, after last, kind); all other tokens score 0."""
    ending: dict[int, list[tuple[int, int, float]]] = {}
    for i, j, kind, f in found:
        s = float(weights[kind] @ np.array(f))
        if s > 0:
            ending.setdefault(j, []).append((i, kind, s))
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, kind, s in ending.get(j, ()):
            if best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, (i, kind)
    out, j = [], n
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            out.append((back[j][0], j, back[j][1]))
            j = back[j][0]
    return out[::-1]


def fit_weights(samples: list[tuple[str, list[Span]]], epochs: int = EPOCHS) -> np.ndarray:
    """Maximum likelihood by AdaGrad; samples: a window's text and its true spans."""
    weights = np.zeros((len(KINDS), len(FEATURES)))
    squares = np.full_like(weights, 1e-2)
    ready = []
    for text, spans in samples:
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        found = candidates(text, tokens)
        if found:
            true = {(a, b, KINDS.index(k)) for a, b, k in spans}
            x = np.array([f for *_, f in found])
            gold = np.array([(tokens[i][0], tokens[j - 1][1], k) in true for i, j, k, _ in found], float)
            ready.append((len(tokens), [(i, j) for i, j, _, _ in found], np.array([k for _, _, k, _ in found]), x, gold))
    for _ in range(epochs):
        for n, edges, kinds, x, gold in ready:
            scores = (weights[kinds] * x).sum(axis=1)
            ending: dict[int, list[int]] = {}
            starting: dict[int, list[int]] = {}
            for e, (i, j) in enumerate(edges):
                ending.setdefault(j, []).append(e)
                starting.setdefault(i, []).append(e)
            forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
            for j in range(1, n + 1):
                forward[j] = total([forward[j - 1], *[forward[edges[e][0]] + scores[e] for e in ending.get(j, ())]])
            for i in range(n - 1, -1, -1):
                backward[i] = total([backward[i + 1], *[scores[e] + backward[edges[e][1]] for e in starting.get(i, ())]])
            p = np.array([math.exp(min(0.0, forward[i] + scores[e] + backward[j] - forward[n])) for e, (i, j) in enumerate(edges)])
            step = np.zeros_like(weights)
            np.add.at(step, kinds, (gold - p)[:, None] * x)
            step -= 1e-3 * weights
            squares += step * step
            weights += 0.5 * step / np.sqrt(squares)
    return weights


def total(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values)) if len(values) > 1 else top


def disguised(span: str, kind: str, rng: random.Random) -> str:
    if kind == "email":
        at, dot = rng.choice(((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), (" @ ", " . ")))
        name, _, domain = span.partition("@")
        return name.strip("._%+-") + at + domain.replace(".", dot)
    if kind == "ip":
        return rng.choice((" . ", ". ", " .")).join(span.split("."))
    if kind == "card":
        number = "".join(_DIGITS.findall(span))
        return rng.choice((".", "/", "  ")).join(number[i : i + 4] for i in range(0, len(number), 4))
    number = "".join(_DIGITS.findall(span))
    tail = number[-10:]
    return rng.choice((f"({tail[:3]}) {tail[3:6]}-{tail[6:]}", f"{tail[:3]}-{tail[3:6]}-{tail[6:]}", f"{tail[:3]}.{tail[3:6]}.{tail[6:]}", f"00{number[:-10] or 1} {tail[:3]} {tail[3:6]} {tail[6:]}"))


def training_windows(text: str, seed: int) -> list[tuple[str, list[Span]]]:
    """A document's windows with base spans as they stand, and once more in disguise; true spans don't overlap."""
    rng, out = random.Random(seed), []
    base = base_spans(text)
    for a, b in windows(text, [(s, e) for s, e, _ in base] + marks(text)) if base or marks(text) else ():
        inside, end = [], a
        for s, e, k in base:
            if s >= end and e <= b:
                inside.append((s, e, k))
                end = e
        piece = text[a:b]
        out.append((piece, [(s - a, e - a, k) for s, e, k in inside]))
        if inside:
            made, true, at = "", [], a
            for s, e, k in inside:
                made += text[at:s]
                new = disguised(text[s:e], k, rng)
                true.append((len(made), len(made) + len(new), k))
                made, at = made + new, e
            out.append((made + text[at:b], true))
    return out[:8]


def added_spans(text: str, base: list[Span], weights: np.ndarray) -> list[Span]:
    """What the field finds outside the base spans."""
    left = [(a, b) for a, b in marks(text) if not any(s < b and a < e for s, e, _ in base)] if len(base) < 50 else _uncovered(marks(text), base)
    out: list[Span] = []
    for a, b in windows(text, left):
        # A base span cuts the window: no segment crosses it.
        cuts = sorted((max(a, s), min(b, e)) for s, e, _ in base if s < b and a < e)
        at = a
        for s, e in [*cuts, (b, b)]:
            if s > at:
                piece = text[max(0, at - 1) : s + 1]
                shift = max(0, at - 1)
                tokens = [m.span() for m in _TOKEN.finditer(text, at, s)]
                tokens = [(x - shift, y - shift) for x, y in tokens]
                found = candidates(piece, tokens)
                out += [(tokens[i][0] + shift, tokens[j - 1][1] + shift, KINDS[k]) for i, j, k in (viterbi(len(tokens), found, weights) if found else ())]
            at = max(at, e)
    return out


def _uncovered(found: list[tuple[int, int]], base: list[Span]) -> list[tuple[int, int]]:
    starts = np.array([s for s, _, _ in base])
    reach = np.maximum.accumulate(np.array([e for _, e, _ in base]))
    out = []
    for a, b in found:
        i = int(np.searchsorted(starts, b)) - 1
        if i < 0 or reach[i] <= a:
            out.append((a, b))
    return out


def line(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> np.ndarray:
    """Weights from at most fit_docs documents that hold marks, the first by a hash of the text over all of them."""
    texts = docs.select(text_of().alias("text")).where("text rlike '[0-9]{4}|[0-9][.][0-9]|@'").select(F.xxhash64("text").alias("h"), "text")
    chosen = written(texts.select("h").distinct().orderBy("h").limit(fit_docs), "pii-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = training_windows(text, h)
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(got), pa.int64()), pa.array(range(len(got)), pa.int32()), pa.array([t for t, _ in got], pa.string()), pa.array([line(s) for _, s in got], pa.string())], ["h", "i", "text", "spans"])

    rows = texts.join(F.broadcast(chosen), "h").mapInArrow(run, "h long, i int, text string, spans string")
    taken = rows.distinct().orderBy(F.xxhash64("h", "i"), "h", "i").limit(FIT_WINDOWS).collect()
    parse = lambda s: [(int(a), int(b), k) for k, a, b in (x.split(":") for x in s.split(","))] if s else []
    return fit_weights([(r["text"], parse(r["spans"])) for r in taken])


def find_pii(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans: one row per row of docs.

    n_spans counts all spans. The other counts and base_sha256 are of the base spans; spans has the added ones too, and none of these overlaps
    a base span. Null texts count as empty. Offsets are code points, ends exclusive. An empty table gives no rows.
    """
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs, fit_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                counts: list[list[int]] = [[] for _ in KINDS]
                shas, lines, added, every = [], [], [], []
                for text in batch.column(1).to_pylist():
                    base = base_spans(text)
                    more = added_spans(text, base, weights.value)
                    for k, c in zip(KINDS, counts):
                        c.append(sum(s[2] == k for s in base))
                    shas.append(hashlib.sha256(line(base).encode()).hexdigest())
                    lines.append(line(base + more))
                    added.append(len(more))
                    every.append(len(base) + len(more))
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(shas, pa.string()), pa.array(lines, pa.string()), pa.array(added, pa.int64()), pa.array(every, pa.int64())], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added", "n_spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first wins."""
    out, at = [], 0
    for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))):
        if s >= at:
            out += [text[at:s], f"<{k}>"]
            at = e
    return "".join(out) + text[at:]
