"""Counts and statistics of whole texts, from one pass over their bytes."""

from __future__ import annotations

import numpy as np

from spanframe.llm import arrays as A

#: Characters counted as symbols by the quality rules.
RULE_SYMBOLS = b"#*$%&|<>"


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_RULE = _table(RULE_SYMBOLS)
_SYMBOL = _table(b"#*$%&|<>~^=+@\\/{}[]_`")
_PUNCT = _table(b".,;:!?'\"()-")
_END = _table(b".!?:;\"')")
_UPPER = _table(bytes(range(0x41, 0x5B)))
_DIGIT = _table(b"0123456789")


def counts(data: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Whole-number counts of each text of a block, among them those of the quality rules (n_words ... n_repeat_words)."""
    n = len(ends) - 1
    lead = (data & 0xC0) != 0x80
    starts, stops, docs = A.runs(~A.SPACE[data], ends)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=points[1:])
    length = points[stops] - points[starts]
    prefix = A.prefix_hash(data)
    words = A.span_hash(prefix, starts, stops)
    windows, at = A.shingles(words, docs, 5)
    often = at[A.again(windows, docs[at])[0]]
    cover = np.zeros(len(words) + 1, np.int64)
    cover[: len(words)] += np.bincount(often, minlength=len(words))[: len(words)]
    cover -= np.bincount(often + 5, minlength=len(words) + 1)
    line_starts, line_stops, line_docs = A.runs(data != 0x0A, ends)
    word_count = np.zeros(len(data) + 1, np.int64)
    word_count[1:] = np.cumsum(np.bincount(starts, minlength=len(data)))
    full = word_count[line_stops] > word_count[line_starts]
    line_starts, line_stops, line_docs = line_starts[full], line_stops[full], line_docs[full]
    repeated = A.again(A.span_hash(prefix, line_starts, line_stops), line_docs)[1]
    per = lambda mask, d: np.bincount(d[mask], minlength=n)
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=symbols[1:])
    capital = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_UPPER[data], out=capital[1:])
    return {
        "n_words": np.bincount(docs, minlength=n), "word_chars": A.per_doc(length, docs, n).astype(np.int64),
        "n_symbols": A.counts_in(_RULE[data], ends), "n_dup_lines": per(repeated, line_docs), "n_repeat_words": per(np.cumsum(cover[: len(words)]) > 0, docs),
        "chars": A.counts_in(lead, ends), "odd": A.counts_in(_SYMBOL[data], ends), "punctuation": A.counts_in(_PUNCT[data], ends),
        "upper": A.counts_in(_UPPER[data], ends), "digits": A.counts_in(_DIGIT[data], ends), "wide": A.counts_in(data >= 0xC0, ends),
        "lines": np.bincount(line_docs, minlength=n), "ended": per(_END[data[line_stops - 1]] if len(line_stops) else np.zeros(0, bool), line_docs),
        "word_squares": A.per_doc(length * length, docs, n).astype(np.int64), "short_words": per(length <= 3, docs), "long_words": per(length >= 20, docs),
        "odd_words": per(symbols[stops] > symbols[starts], docs), "capital_words": per(2 * (capital[stops] - capital[starts]) > stops - starts, docs),
        "words_again": per(A.again(words, docs)[1], docs), "twins": per(np.concatenate([np.zeros(1, bool), (words[1:] == words[:-1]) & (docs[1:] == docs[:-1])])[: len(words)], docs),
    }


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """Transformed statistics, one row per text: logs of sizes and log odds of shares, all finite for empty texts."""
    odds = lambda part, whole: np.log((c[part] + 0.5) / (np.maximum(c[whole] - c[part], 0) + 0.5 + 0.01 * c[whole]))
    words = np.maximum(c["n_words"], 1)
    mean = c["word_chars"] / words
    return np.column_stack(
        [
            np.log1p(c["n_words"]), np.log1p(c["lines"]), np.log1p(mean), np.log1p(np.sqrt(np.maximum(c["word_squares"] / words - mean**2, 0))),
            np.log1p(c["n_words"] / np.maximum(c["lines"], 1)), odds("n_repeat_words", "n_words"), odds("n_dup_lines", "lines"), odds("odd", "chars"),
            odds("punctuation", "chars"), odds("upper", "chars"), odds("digits", "chars"), odds("wide", "chars"), odds("ended", "lines"),
            odds("short_words", "n_words"), odds("long_words", "n_words"), odds("odd_words", "n_words"), odds("capital_words", "n_words"),
            odds("words_again", "n_words"), odds("twins", "n_words"),
        ]
    ).astype(np.float64)
