"""Personal data by weak supervision.

Exact base patterns (email, ip, card, phone) always count.  Beside them, wider candidate
patterns are judged by four labelers that vote yes, no or abstain: a strict regex, a
gazetteer of known prefixes and endings, the words before the span, and the span's shape.
Expectation-maximisation over the counts of vote patterns of the whole corpus (a table of at
most kinds x 3^4 rows) estimates how far each labeler can be trusted; the resulting
probabilities train a logistic span classifier on at most about ``TRAIN_SPANS`` spans (a
documented bound), and candidates it accepts join the base spans where they don't overlap.

Every text is read twice at most, whole, and all scans are linear in its length.

Defined results: a null text is empty; an empty text has no spans (``base_sha256`` is that of
the empty string); rows with equal or null doc_ids are separate rows; an empty table gives no
rows; without any candidate no span is added; other columns than doc_id and text are ignored
by ``find`` and kept by ``mask``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewline.llm.common import Scratch, draw

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
YES, NO, ABSTAIN = 0, 1, 2
LABELERS = 4
TRAIN_SPANS = 20_000
EM_ROUNDS = 40
# How many characters before a span the context labeler reads.
CONTEXT = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
# Wider candidates.
_LOOSE_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64}(?: ?(?:@|\(at\)|\[at\]) ?)[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{2,24}){1,4}")
_LOOSE_PHONE = re.compile(r"(?<![0-9A-Za-z.])[(]?[0-9]{2,4}[)]?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])")
_LOOSE_SECRET = re.compile(r"[A-Za-z0-9+/_-]{20,}+=*")

# Gazetteers: lists of well-known values.
_ENDINGS = frozenset("com org net edu gov io de fr es uk eu info biz".split())
_ISSUERS = ("34", "35", "36", "37", "4", "51", "52", "53", "54", "55", "6011", "62", "65")
_SECRET_HEADS = ("AKIA", "ghp_", "sk-", "xox", "AIza", "eyJ")
_PLACEHOLDERS = ("0.", "127.", "255.")
_WORDS = {
    "email": ("email", "e-mail", "mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "login", "addr"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "telefon", "cell"),
    "secret": ("token", "key", "secret", "password", "passwd", "api", "auth", "bearer"),
}
_AGAINST = ("version", "isbn", "order", "invoice", "sha", "commit", "license", "v")
_WORD = re.compile(r"[a-z-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, by start, then kind."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _DOTTED.finditer(text):
            parts, start = m.group().split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                own = parts[i:i + 4]
                end = start + sum(map(len, own)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in own):
                    out.append((start, 1, end))
                start = end + 1
        for m in _NUMBER.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(map(str.isdecimal, m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and wider ones that overlap none of them nor each other."""
    found = []
    if "@" in text or "(at)" in text or "[at]" in text:
        found += [(m.start(), 0, m.end()) for m in _LOOSE_AT.finditer(text)]
    if _DIGIT.search(text):
        for m in _DOTTED.finditer(text):
            if m.group().count(".") == 3:
                found.append((m.start(), 1, m.end()))
        for m in _NUMBER.finditer(text):
            if 12 <= sum(map(str.isdigit, m.group())) <= 19:
                found.append((m.start(), 2, m.end()))
        found += [(m.start(), 3, m.end()) for m in _LOOSE_PHONE.finditer(text)]
        found += [(m.start(), 4, m.end()) for m in _LOOSE_SECRET.finditer(text) if _DIGIT.search(m.group())]
    out, end, k = list(base), 0, 0
    furthest = sorted((s, e) for s, _, e in base)
    for start, kind, stop in sorted(found, key=lambda c: (c[0], -c[2], c[1])):
        while k < len(furthest) and furthest[k][0] < stop:
            end = max(end, furthest[k][1])
            k += 1
        if start >= end:
            out.append((start, kind, stop))
            end = stop
    out.sort()
    return out


def votes(text: str, span: tuple[int, int, int]) -> tuple[int, ...]:
    """What the regex, gazetteer, context and shape labelers say of a candidate."""
    start, number, end = span
    kind, own = KINDS[number], text[start:end]
    digits = "".join(c for c in own if "0" <= c <= "9")
    if kind == "email":
        strict = "@" in own and " " not in own
        known = YES if own.rpartition(".")[2].strip().lower() in _ENDINGS else ABSTAIN
        shape = YES if own.count("@") <= 1 and len(own) <= 80 else NO
    elif kind == "ip":
        parts = own.split(".")
        strict = all(len(p) <= 3 and int(p) <= 255 for p in parts)
        known = NO if own.startswith(_PLACEHOLDERS) else ABSTAIN
        shape = YES if len(own) >= 9 else NO if len(own) == 7 else ABSTAIN
    elif kind == "card":
        strict = 14 <= len(digits) <= 19 and luhn(digits)
        known = YES if digits.startswith(_ISSUERS) else NO
        shape = YES if len(digits) in (15, 16) else NO
    elif kind == "phone":
        strict = own.startswith("+") and 10 <= len(digits) <= 15
        known = YES if own.startswith(("+1", "+33", "+34", "+44", "+49", "00")) else ABSTAIN
        shape = YES if 9 <= len(digits) <= 13 else NO
    else:
        strict = re.fullmatch(r"[0-9a-f]{32,128}|[0-9A-F]{32,128}|[A-Za-z0-9_+/-]{36,}=*", own) is not None
        known = YES if own.startswith(_SECRET_HEADS) else ABSTAIN
        share = len(digits) / len(own)
        shape = YES if 0.15 <= share <= 0.9 and len(set(own)) >= 10 else NO
    before = _WORD.findall(text[max(0, start - CONTEXT):start].lower())[-4:]
    near = YES if any(w in _WORDS[kind] for w in before) else NO if any(w in _AGAINST for w in before) else ABSTAIN
    return YES if strict else NO, known, near, shape


def features(text: str, span: tuple[int, int, int], voted: tuple[int, ...]) -> list[float]:
    own = text[span[0]:span[2]]
    n = len(own)
    entropy = -sum(own.count(c) / n * math.log(own.count(c) / n) for c in set(own)) if n <= 256 else 4.0
    out = [1.0, math.log(n), sum(c.isdigit() for c in own) / n, sum(not c.isalnum() for c in own) / n, entropy]
    out += [float(span[1] == k) for k in range(len(KINDS))]
    for v in voted:
        out += [float(v == YES), float(v == NO)]
    return out


WIDTH = 5 + len(KINDS) + 2 * LABELERS


def pattern(voted: tuple[int, ...]) -> int:
    return sum(v * 3 ** i for i, v in enumerate(voted))


def reliabilities(kinds: np.ndarray, patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Probability that spans of each (kind, vote pattern) are personal data.

    Expectation-maximisation with a prior for each kind and, for each labeler, the chances
    of its three votes given either truth; it starts from the majority of the votes.
    """
    said = np.stack([patterns // 3 ** i % 3 for i in range(LABELERS)], 1)
    yes, no = (said == YES).sum(1), (said == NO).sum(1)
    p = (yes + 0.5) / (yes + no + 1.0)
    for _ in range(EM_ROUNDS):
        prior = np.array([(1 + (p * counts)[kinds == k].sum()) / (2 + counts[kinds == k].sum()) for k in range(len(KINDS))])
        log_yes, log_no = np.log(prior[kinds]), np.log(1 - prior[kinds])
        for i in range(LABELERS):
            for truth, weight, log in ((1, p * counts, log_yes), (0, (1 - p) * counts, log_no)):
                chance = np.bincount(said[:, i], weight, 3) + 1
                # A labeler is taken to be right more often than not.
                better, worse = (YES, NO) if truth else (NO, YES)
                if chance[better] < chance[worse]:
                    chance[[better, worse]] = chance[[better, worse]].mean()
                log += np.log(chance / chance.sum())[said[:, i]]
        p = 1 / (1 + np.exp(np.clip(log_no - log_yes, -500, 500)))
    return p


def train(x: np.ndarray, y: np.ndarray, count: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights for soft labels ``y`` of rows that count ``count`` times, by damped Newton steps."""
    w = np.zeros(WIDTH)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (count * p * (1 - p))[:, None]).T @ x + ridge * np.eye(WIDTH), x.T @ (count * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _describe(text: str) -> tuple[list, list, list]:
    """Base spans, candidates and the candidates' votes of a text."""
    base = base_spans(text)
    found = candidates(text, base)
    return base, found, [votes(text, c) for c in found]


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_FOUND = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, "
          "found array<struct<start: long, kind: int, end: long, base: boolean, pattern: int, features: array<float>>>")
_FOUND_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("base", pa.bool_()),
                                  ("pattern", pa.int32()), ("features", pa.list_(pa.float32()))]))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, bases, rows = [[] for _ in BASE_KINDS], [], []
        for value in batch.column(1):
            text = value.as_py() or ""
            base, found, said = _describe(text)
            known = set(base)
            for k, c in enumerate(counts):
                c.append(sum(s[1] == k for s in base))
            bases.append(written(base))
            rows.append([{"start": s[0], "kind": s[1], "end": s[2], "base": s in known, "pattern": pattern(v),
                          "features": features(text, s, v)} for s, v in zip(found, said)])
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(bases, pa.string()),
                                          pa.array(rows, _FOUND_TYPE)],
                                         names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "found"])


def extract(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(_extract, _FOUND)


def fit(extracted: DataFrame, train_spans: int = TRAIN_SPANS) -> np.ndarray:
    """The span classifier's weights from a stored ``extract`` table."""
    spans = extracted.select(F.explode("found").alias("s")).select("s.*")
    seen = spans.groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "pattern").collect()
    if not seen:
        return np.zeros(WIDTH)
    p = reliabilities(*(np.array([r[c] for r in seen]) for c in ("kind", "pattern", "n")))
    soft = {(r.kind, r.pattern): v for r, v in zip(seen, p)}
    got = draw(spans.select("kind", "pattern", "features"), train_spans).toArrow().sort_by("place")
    x = np.array(got["features"].to_pylist(), float).reshape(-1, WIDTH)
    y = np.array([soft[k] for k in zip(got["kind"].to_pylist(), got["pattern"].to_pylist())])
    return train(x, y, got["weight"].to_numpy())


def find(docs: DataFrame, train_spans: int = TRAIN_SPANS) -> DataFrame:
    """doc_id, the counts of base spans, the hash of the base spans, and all spans."""
    extracted = Scratch(docs.sparkSession, "pii").store(extract(docs))
    weights = fit(extracted, train_spans)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, spans = [], []
            for base, found in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist()):
                hashes.append(hashlib.sha256(base.encode()).hexdigest())
                spans.append(written((s["start"], s["kind"], s["end"]) for s in found
                                     if s["base"] or np.dot(s["features"], weights) > 0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(hashes, pa.string()), pa.array(spans, pa.string())],
                                             names=[*batch.schema.names[:5], "base_sha256", "spans"])

    return extracted.mapInArrow(tasks, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, weights: np.ndarray) -> str:
    """The text with every span replaced by its kind; of overlapping spans the first stands
    for their union."""
    base, found, said = _describe(text)
    known, out, at = set(base), [], 0
    for s, v in zip(found, said):
        if s in known or np.dot(np.float32(features(text, s, v)), weights) > 0:
            if s[0] >= at:
                out += [text[at:s[0]], f"<{KINDS[s[1]].upper()}>"]
            at = max(at, s[2])
    return "".join(out) + text[at:]


def mask(docs: DataFrame, train_spans: int = TRAIN_SPANS) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; a column n_chars follows the new text."""
    scratch = Scratch(docs.sparkSession, "pii")
    extracted = scratch.store(extract(docs))
    weights = fit(extracted, train_spans)
    scratch.drop(extracted)
    at = docs.columns.index("text")

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([t if t is None else masked(t, weights) for t in batch.column(at).to_pylist()], pa.string())
            yield batch.set_column(at, batch.schema.names[at], text)

    out = docs.mapInArrow(tasks, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out
