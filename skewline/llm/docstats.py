"""Statistics of whole documents as a float matrix, computed on the column's bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from skewline.llm.arrowtext import SPACE, text_bytes, word_hashes, words

_LOWER, _UPPER, _DIGIT, _BLANK, _NEWLINE, _CONTROL, _STOP, _MARK, _BAR, _SYMBOL, _HIGH = range(11)
_CLASS = np.full(256, _SYMBOL, np.int64)
_CLASS[:32] = _CONTROL
_CLASS[128:] = _HIGH
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = _LOWER, _UPPER, _DIGIT
_CLASS[32], _CLASS[10], _CLASS[124] = _BLANK, _NEWLINE, _BAR
for _c in b".,;:'\"-()":
    _CLASS[_c] = _STOP
for _c in b"!?":
    _CLASS[_c] = _MARK
_LETTER = np.isin(_CLASS, (_LOWER, _UPPER, _HIGH))
_ODD_END = np.isin(_CLASS, (_MARK, _BAR, _SYMBOL))
_LINE = np.zeros(256, bool)
_LINE[10] = True

NAMES = (["log_bytes", "log_words", "word_length", "word_length_sd", "longest_word"]
         + [f"share_{c}" for c in ("lower", "upper", "digit", "blank", "newline", "control", "stop", "mark", "bar",
                                   "symbol", "high")]
         + ["no_letter_words", "upper_words", "odd_end_words", "repeated_next", "distinct_words", "top_word",
            "distinct_pairs", "log_lines", "distinct_lines", "line_length", "digit_words", "short_words"])


def _distinct(doc: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct hashes in each document, and the count of its most frequent one."""
    out, top = np.zeros(n), np.zeros(n)
    if len(doc):
        key = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        run = np.diff(np.concatenate([at, [len(key)]]))
        d = (key[at] >> np.uint64(40)).astype(np.int64)
        out = np.bincount(d, minlength=n).astype(float)
        np.maximum.at(top, d, run)
    return out, top


def statistics(col: pa.Array) -> np.ndarray:
    """Rows of ``NAMES`` for a string column; an empty or null text has zeros."""
    data, offs = text_bytes(col)
    n, size = len(col), np.diff(offs).astype(float)
    per = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    doc_of_byte = np.repeat(np.arange(n), np.diff(offs))
    cls = _CLASS[data]
    counts = np.bincount(doc_of_byte * 11 + cls, minlength=11 * n).reshape(n, 11)
    starts, ends, first = words(data, offs, SPACE)
    nw = np.diff(first).astype(float)
    doc = np.repeat(np.arange(n), np.diff(first))
    total = lambda values: np.bincount(doc, values, n) if len(doc) else np.zeros(n)
    length = (ends - starts).astype(float)
    h = word_hashes(data, starts, ends)
    within = lambda mask: np.concatenate([[0], np.cumsum(mask[cls], dtype=np.int64)])
    letters, uppers, digits = (within(np.isin(np.arange(11), c)) for c in ((_LOWER, _UPPER, _HIGH), _UPPER, _DIGIT))
    of = lambda c: c[ends] - c[starts]
    mean = per(total(length), nw)
    spread = np.sqrt(np.maximum(per(total(length ** 2), nw) - mean ** 2, 0))
    longest = np.zeros(n)
    if len(doc):
        np.maximum.at(longest, doc, length)
    same = np.zeros(len(doc), bool)
    pair = np.zeros(0, np.uint64)
    if len(doc) > 1:
        inner = doc[1:] == doc[:-1]
        same[1:] = inner & (h[1:] == h[:-1])
        pair = (h[1:] * np.uint64(0x9E3779B97F4A7C15) + h[:-1])[inner]
        pair_doc = doc[1:][inner]
    distinct, top = _distinct(doc, h, n)
    pairs, _ = _distinct(pair_doc, pair, n) if len(pair) else (np.zeros(n), None)
    ls, le, lf = words(data, offs, _LINE)
    nl = np.diff(lf).astype(float)
    lines, _ = _distinct(np.repeat(np.arange(n), np.diff(lf)), word_hashes(data, ls, le), n)
    upper_word = (of(uppers) == of(letters)) & (of(letters) > 1)
    odd = _ODD_END[data[ends - 1]] if len(ends) else np.zeros(0)
    columns = [np.log1p(size), np.log1p(nw), mean, spread, np.log1p(longest)]
    columns += [per(counts[:, c], size) for c in range(11)]
    columns += [per(total(of(letters) == 0), nw), per(total(upper_word), nw), per(total(odd), nw), per(total(same), nw),
                per(distinct, nw), per(top, nw), per(pairs, np.maximum(nw - 1, 0)), np.log1p(nl), per(lines, nl),
                per(size, nl), per(total(of(digits) > 0), nw), per(total(length <= 2), nw)]
    return np.stack(columns, 1)
