"""Quality rules, line first: lines that fail a rule go, then documents that lose too much text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nichegrid.llm.common import LOWER, UPPER, WORD, arrow
from nichegrid.llm.textkit import Words, mix, pieces, sequences

#: Patterns that Python, Spark and DuckDB read alike. Letters are tested with A-Z folded to a-z.
SYMBOLS = r"[#*$%&|<>]"
SHOUTS = r"[!?#*$%&]{2,}"
END = r"[.!?:;…。！？]['\")\]»”’]*[\x20\x09-\x0D]*$"
PAUSE = r"[.,;:!?…。，！？]"
BORDER = r"[|>»›·•→]"
NAVIGATION = (
    r"^[\x20\x09-\x0D|/>»›·•→-]*((home|menu|log ?in|log ?out|sign (in|up)|register|search|next|prev|previous|back|share|print|contact|contact us|about|about us|faq|help|sitemap|skip to content|read more|click here|more)"
    r"([\x20\x09-\x0D|/>»›·•→-]+|$))+$"
)
BOILERPLATE = (
    r"(all rights reserved|copyright \(c\)|©|terms of (use|service)|privacy policy|cookie (policy|settings)|uses? cookies|(licensed|released) under the|"
    r"enable javascript|lorem ipsum|subscribe to our|powered by|advertisement)"
)

_FOLD = str.maketrans(UPPER, LOWER)
_word, _symbols, _shouts, _end, _pause, _border, _navigation, _boilerplate = (re.compile(p) for p in (WORD, SYMBOLS, SHOUTS, END, PAUSE, BORDER, NAVIGATION, BOILERPLATE))
_space = re.compile(r"[\x20\x09-\x0D]+")

COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "n_lines long, n_punctuation long, n_navigation long, n_boilerplate long, removed_chars long, kept boolean"
)


@dataclass(frozen=True)
class Limits:
    """When a document fails: too few words, too many of them in repeated windows (percent), or too much text in failed lines (percent of its word characters)."""

    min_words: int = 10
    max_repeat: int = 20
    max_loss: int = 50


def fault(line: str, words: int) -> str | None:
    """The rule that a line of `words` words fails first: navigation, boilerplate or punctuation; None for none.

    Navigation: two borders such as | or » or more, one for every four words; or nothing but words of menus.
    Boilerplate: a phrase of notices in a line of up to 40 words. Punctuation: two doubled marks or more, one for every
    four words; a line of up to nine words that doesn't end as a sentence; a longer one without any mark.
    """
    borders = len(_border.findall(line))
    low = line.translate(_FOLD)
    if borders >= 2 and 4 * borders >= words or words <= 40 and _navigation.match(low):
        return "navigation"
    if words <= 40 and _boilerplate.search(low):
        return "boilerplate"
    shouts = len(_shouts.findall(line))
    if shouts >= 2 and 4 * shouts >= words or (not _end.search(line) if words < 10 else not _pause.search(line)):
        return "punctuation"
    return None


def same_spans(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Whether the `size` bytes from a and from b are equal, pair by pair."""
    out = np.ones(len(a), bool)
    sums = np.cumsum(size)
    start = 0
    while start < len(a):
        done = sums[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sums, done + most, "right")))
        if end == start + 1:
            out[start] = np.array_equal(raw[a[start] : a[start] + size[start]], raw[b[start] : b[start] + size[start]])
        else:
            n = size[start:end]
            first = np.cumsum(n) - n
            at = np.arange(int(n.sum())) - np.repeat(first, n)
            differs = raw[np.repeat(a[start:end], n) + at] != raw[np.repeat(b[start:end], n) + at]
            out[start:end] = np.diff(np.concatenate([[0], np.cumsum(differs)])[np.append(first, len(at))]) == 0
        start = end
    return out


def repeated_words(texts: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(words, words in n-word windows that the text has twice or more) of each text. Windows meet by hash and are compared word by word."""
    w = Words(texts, fold=False)
    counts = np.diff(w.firsts)
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(max(0, len(text) - n + 1))
    at = at[text[at] == text[at + n - 1]]
    key = mix(sequences(w.hashes, n)[at] + text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    new = np.ones(len(key) + 1, bool)
    new[1:-1] = key[1:] != key[:-1]
    group = np.cumsum(new[:-1]) - 1
    several = ~(new[:-1] & new[1:])
    first = at[new[:-1]][group] if len(at) else at
    at, first = at[several], first[several]
    covered = np.zeros(len(text) + 1, np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + n, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    found = inside[w.firsts[1:]] - inside[w.firsts[:-1]]
    size = w.ends - w.starts
    fine = text[at] == text[first]
    for i in range(n):
        a, b = at + i, first + i
        fine &= size[a] == size[b]
        fine[fine] = same_spans(w.raw, w.starts[a[fine]], w.starts[b[fine]], size[a[fine]])
    for i in np.unique(np.concatenate([text[at[~fine]], text[first[~fine]]])).tolist():  # equal hashes of different windows
        own = [w.raw[a:b].tobytes() for a, b in zip(w.starts[w.firsts[i] : w.firsts[i + 1]], w.ends[w.firsts[i] : w.firsts[i + 1]], strict=True)]
        places: dict[tuple[bytes, ...], list[int]] = {}
        for p in range(len(own) - n + 1):
            places.setdefault(tuple(own[p : p + n]), []).append(p)
        found[i] = len({q for ps in places.values() if len(ps) > 1 for p in ps for q in range(p, p + n)})
    return counts, found


def lines_of(text: str) -> Iterator[str]:
    start = 0
    while (end := text.find("\n", start)) >= 0:
        yield text[start:end]
        start = end + 1
    yield text[start:]


def judge(text: str, n_words: int, n_repeat: int, limits: Limits, cleaned: bool) -> tuple[list[object], str | None]:
    """The columns of COLUMNS for one text, and what is left of it."""
    seen: set[str] = set()
    left: list[str] = []
    chars = symbols = duplicates = lines = lost = 0
    failed = {"punctuation": 0, "navigation": 0, "boilerplate": 0}
    for line in lines_of(text):
        own = len(_space.sub("", line))
        if own:
            lines += 1
            chars += own
            symbols += len(_symbols.findall(line))
            if again := line in seen:
                duplicates += 1
            else:
                seen.add(line)
            if rule := "boilerplate" if again else fault(line, len(_word.findall(line))):
                failed[rule] += 1
                lost += own
                continue
        if cleaned:
            left.append(line)
    bad = n_words < limits.min_words or 100 * n_repeat > limits.max_repeat * n_words
    kept = not bad and 100 * lost <= limits.max_loss * chars
    return [n_words, chars, symbols, duplicates, n_repeat, bad, lines, *failed.values(), lost, kept], "\n".join(left) if cleaned else None


def clean(docs: DataFrame, limits: Limits = Limits(), with_text: bool = True) -> DataFrame:  # noqa: B008
    """(doc_id, COLUMNS, cleaned_text): every row of docs judged by its whole text, with the text that its passing lines leave.

    Lines are split at \\n; a line without a word is no line to judge and stays. A line that an earlier one equals is
    boilerplate. A document fails the base with fewer than `min_words` words or more than `max_repeat` percent of them in
    repeated five-word windows; it is kept unless it fails that or loses more than `max_loss` percent of its word characters.

    Null and empty texts have no words and aren't kept; a null's cleaned_text is null. Repeated rows are judged each, ids may
    be null and columns other than doc_id and text, whatever their names, are not read. Empty tables give no rows. A very
    long text is read line by line, with its distinct lines and some bytes a word in memory.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                words, repeats = repeated_words(piece["text"])
                rows, texts = [], []
                for text, n, r in zip(piece["text"], words.tolist(), repeats.tolist(), strict=True):
                    row, left = judge(text.as_py() or "", n, r, limits, with_text)
                    rows.append(row)
                    texts.append(left if text.is_valid else None)
                names = [c.split(" ")[0] for c in COLUMNS.split(", ")]
                kinds = [pa.bool_() if c.endswith("boolean") else pa.int64() for c in COLUMNS.split(", ")]
                arrays = [piece["doc_id"], *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(texts, pa.string())] if with_text else []), ["doc_id", *names] + (["cleaned_text"] if with_text else []))

    rows = docs.select("doc_id", "text")
    return arrow(rows, f, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {COLUMNS}" + (", cleaned_text string" if with_text else ""))
