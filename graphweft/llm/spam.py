"""Keyword-stuffed pages and link lists, by recurrence gaps, positional autocorrelation and learned function words.

All words of an Arrow batch are coded as integers and looked at together. A word pair's recurrence gap is the
distance to the same pair before it; keyword stuffing repeats pairs of content words at short gaps, which prose
does not. Regular repetition of any words is told by the gaps themselves, whatever their length: neighbouring
pairs share a gap, and the pairs that it leads to share a gap as well, so a block stands three times or more
(twice is a copy). The positional autocorrelation finds what repeats with words exchanged, at small lags and at the
gaps that most of a text's words recur at. Lists of distinct nouns have no function words and, as that alone would
hit any language that is not known, no sentences. Function words are no given list: of each language they are the
words that most of its documents use, up to a share of all its words. Scripts without blanks are cut into letters.
Each signal is averaged over windows of words, and a page is spam where the flagged words and links outweigh the
sentences and code.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweft.session import discard, written

#: Words of a window (about) over which the averages are taken.
WINDOW = 24
#: A pair of content words counts as crowded up to this gap (in words); regular repetition knows no such limit.
GAP = 40
LAGS = range(1, 13)
#: Averages from which a word belongs to stuffing: repeated pairs, equal words at one lag, and function words at most.
REPEATED, PERIODIC, FUNCTION = 0.3, 0.6, 0.1
#: Share of a window's words from which a gap is one of the window.
SHARED = 0.25
#: Function words at most in a text that is a list as a whole.
LISTED = 0.12
SHARE = 0.6
#: Letters that are looked at together.
CHARS = 4_000_000
#: Of texts of fewer words and links only links and tags are judged, as their words tell nothing.
LEAST_WORDS = 5

#: Function words: used by this share of a language's documents, and covering this share of its words together.
USED, COVERED = 0.2, 0.45
#: Documents of a language from which its function words are learned; of fewer none are known.
LEAST_DOCS = 50
#: Words of a run between separators at most (on average) in a list, and words to a sentence's end in texts without sentences.
RUN, NO_ENDS = 3.5, 60
#: Share of a text's words that recur at one gap, from which the autocorrelation is taken at that lag.
RECURRING = 0.1

# Letters of scripts that put no blanks between words: each is a word.
_UNSPACED = "\u0e00-\u0edf\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
_LETTER = rf"[^\W\d_{_UNSPACED}]"
_WORD = rf"[{_UNSPACED}]|{_LETTER}+(?:['’]{_LETTER}+)?"
_TOKEN = re.compile(rf"https?://[^\s)\]>\"'\x00]+|```|{_WORD}|\d[\d.,]*|[.!?…](?=\W|\Z)|[。！？؟।]|[,;|/•·、，；،：\n]+|#(?=\w)|\x00")
_ENDS, _SEPARATORS = frozenset(".!?…。！？؟।"), frozenset(",;|/•·、，；،：\n#")
_WORDS = re.compile(_WORD)
_FENCED = re.compile(r"```.*?(?:```|\Z)", re.S)
#: Marks of tags: words behind a number sign, and the list behind a label.
_TAGS = re.compile(r"(?<![\w#&/])#[^\W\d]\w*(?:-\w+)*|\b(?:tags?|keywords?|hashtags?|labels?)\s*:[^\n.]*", re.I)


class _Codes(dict):
    """Codes of words in the order of their first appearance; text end, fence, separator and sentence end come first."""

    def __init__(self):
        super().__init__({"\x00": 0, "```": 1, ",": 2, ".": 3})

    def __missing__(self, word: str) -> int:
        if word[0] in _SEPARATORS or word[0] in _ENDS:
            return 2 if word[0] in _SEPARATORS else 3
        self[word] = code = len(self)
        return code


#: The gap of a pair that did not stand before.
NONE = 1 << 30


def _gaps(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Distance in places of each key to the same key before it (NONE for none)."""
    order = np.argsort(key, kind="stable")
    k, at = key[order], place[order]
    gap = np.full(len(key), NONE, dtype=np.int64)
    same = k[1:] == k[:-1]
    gap[order[1:][same]] = (at[1:] - at[:-1])[same]
    return gap


def _regular(gap: np.ndarray, window: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which words stand in a block that comes three times or more, by the gap of the pair that each word begins.

    ``window`` is each word's window, ``words`` the number of words of each window.
    """
    at = np.flatnonzero(gap < NONE)
    _, which, count = np.unique(window[at] * NONE + gap[at], return_inverse=True, return_counts=True)
    shared = np.zeros(len(gap), dtype=bool)
    shared[at] = count[which] >= np.maximum(3, SHARED * words[window[at]])
    # a pair, the one before it and the one before that
    last = np.flatnonzero(shared)
    last = last[shared[last - gap[last]]]
    middle = last - gap[last]
    regular = np.zeros(len(gap) + 1, dtype=bool)
    for k in (last, middle, middle - gap[middle]):
        regular[k] = regular[k + 1] = True
    return regular[:-1]


def _lags(d: np.ndarray, w: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text the gap beyond LAGS at which most of its words recur, or 0 if those are few."""
    gap = _gaps(d * (int(w.max(initial=0)) + 1) + w, np.arange(len(w)))
    at = np.flatnonzero((gap < NONE) & (gap > LAGS[-1]))
    key, times = np.unique(d[at] * NONE + gap[at], return_counts=True)
    text, lag = np.divmod(key, NONE)
    out = np.zeros(len(counts), dtype=np.int64)
    order = np.argsort(times, kind="stable")
    order = order[times[order] >= RECURRING * counts[text[order]]]
    out[text[order]] = lag[order]  # the most frequent one is written last
    return out


def spam_shares(texts: list[str], functions: frozenset[str]) -> tuple[np.ndarray, ...]:
    """Of each text: the share of its letters in stuffing, in links, and its strongest autocorrelation.

    ``functions`` are the function words of the languages that are known.
    """
    n = len(texts)
    codes = _Codes()
    words = _TOKEN.findall("\x00".join(t.replace("\x00", " ").lower() for t in texts) + "\x00")
    code = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
    del words
    size = np.fromiter(map(len, codes), np.int32, len(codes))
    link = np.fromiter((w.startswith("http") and "://" in w for w in codes), bool, len(codes))[code]
    function = np.fromiter((w in functions for w in codes), bool, len(codes))
    ends = np.flatnonzero(code == 0)
    doc = np.repeat(np.arange(n), np.diff(np.concatenate(([-1], ends))))
    letters = lambda at: np.bincount(doc[at], weights=size[code[at]], minlength=n)
    # between an odd and an even fence stands code; an unclosed fence closes with its text
    fence = np.cumsum(code == 1)
    coded = (fence - np.concatenate(([0], fence[ends[:-1]]))[doc]) % 2 == 1
    total = np.maximum(letters(code > 3), 1)
    at = np.flatnonzero((code > 3) & ~link & ~coded)
    w, d = code[at], doc[at]
    enough = np.bincount(doc[(code > 3) & ~coded], minlength=n) >= LEAST_WORDS
    # whether a separator or sentence end stands before a word
    breaks, ended = np.cumsum((code == 2) | (code == 3) | (code == 0)), np.bincount(doc[(code == 3) & ~coded], minlength=n)
    links = letters(link & ~coded) / total
    tagged = np.zeros(n)
    for k in np.flatnonzero(~enough):
        plain = _FENCED.sub(" ", texts[k])
        tagged[k] = sum(len(t) for m in _TAGS.findall(plain) for t in _TOKEN.findall(m) if t[0].isalnum() and "://" not in t) / total[k]
    if not len(w):
        return tagged, links, np.zeros(n)
    function = function[w]
    pair = np.flatnonzero(d[:-1] == d[1:])
    # a pair recurs within its own text only; texts and words of a part are so few that the key fits 64 bits
    gap = np.full(len(w), NONE, dtype=np.int64)
    gap[pair] = _gaps((d[pair] * len(codes) + w[pair]) * len(codes) + w[pair + 1], pair)
    near = pair[~function[pair] & ~function[pair + 1] & (gap[pair] <= GAP)]
    again = np.zeros(len(w), dtype=np.int32)
    again[near] = again[near + 1] = 1
    # windows of about equal length, none over the end of a text
    first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
    length = np.diff(np.r_[first, len(w)])
    windows = -(-length // WINDOW)
    base = np.repeat(np.cumsum(windows) - windows, length)
    inside = np.arange(len(w)) - np.repeat(first, length)
    window = base + inside * np.repeat(windows, length) // np.repeat(length, length)
    starts = np.flatnonzero(np.r_[True, window[1:] != window[:-1]])
    share = lambda x: np.add.reduceat(x, starts, dtype=np.int32) / np.diff(np.r_[starts, len(w)])
    periodic, strongest, counts = np.zeros(len(starts)), np.zeros(n), np.maximum(np.bincount(d, minlength=n), 1)
    own = _lags(d, w, counts)[d]
    for lag in (*LAGS, None):
        equal = np.zeros(len(w), dtype=bool)
        if lag:
            equal[lag:] = (w[lag:] == w[:-lag]) & (d[lag:] == d[:-lag])
        else:
            # three times at least, as twice is a copy
            k = np.flatnonzero(own)
            k = k[inside[k] >= 2 * own[k]]
            k = k[(w[k] == w[k - own[k]]) & (w[k] == w[k - 2 * own[k]])]
            equal[k] = equal[k - own[k]] = equal[k - 2 * own[k]] = True
        # sentences of one pattern repeat their frame but not their content words
        whole = share(equal & ~function) >= PERIODIC * share(~function) if lag is None else True
        periodic = np.maximum(periodic, share(equal) * whole)
        strongest = np.maximum(strongest, np.bincount(d[equal], minlength=n) / counts)
    regular = _regular(gap, window, np.diff(np.r_[starts, len(w)]))
    blocks = (share(regular) >= PERIODIC) & (share(regular & ~function) >= PERIODIC * share(~function))
    # a list has next to no function words and short runs between separators, or no sentences at all
    broken = np.r_[True, breaks[at[1:]] != breaks[at[:-1]]]
    endless = (counts >= NO_ENDS / 2) & (counts >= NO_ENDS * ended)
    short = (share(broken) * RUN >= 1) | endless[d[starts]]
    stuffed = (share(again) >= REPEATED) | (periodic >= PERIODIC) | blocks | ((share(function) <= FUNCTION) & short)
    # a text with next to no function words is a list as a whole, though single windows may hold some
    listed = ((np.bincount(d[function], minlength=n) / counts <= LISTED) & ((np.bincount(d[broken], minlength=n) * RUN >= counts) | endless))[d]
    return np.where(enough, letters(at[stuffed[window] | listed]) / total, tagged), links, strongest


def _parts(texts: list[str]) -> Iterator[list[str]]:
    """The texts in lists of about CHARS letters, so that memory does not grow with the length of the texts."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language: of each word the documents and places that it has; of the word "" the documents and all words."""
    used: dict[tuple[str, str], list[int]] = {}

    def out() -> pa.RecordBatch:
        lang, word, docs, places = [], [], [], []
        for (x, y), (a, b) in used.items():
            lang.append(x)
            word.append(y)
            docs.append(a)
            places.append(b)
        used.clear()
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(docs, pa.int64()), pa.array(places, pa.int64())], ["lang", "word", "docs", "places"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = Counter(_WORDS.findall(text.lower()))
            for word, n in (*words.items(), ("", words.total())):
                held = used.setdefault((lang, word), [0, 0])
                held[0] += 1
                held[1] += n
            if len(used) > 500_000:
                yield out()
    yield out()


def function_words(pages: DataFrame, *, text_col: str, lang_col: str | None = None) -> frozenset[str]:
    """The function words of the pages' languages: those that most of a language's documents use.

    Words are taken in the order of their document frequency until they cover COVERED of all words, none that
    less than USED of the documents have. ``lang_col`` names languages (by its first two letters in any case);
    without it, or where it is null, pages count as one language. Languages of fewer than
    LEAST_DOCS documents have none. Gathered are the words found, a few dozen of each language.
    """
    lang = F.coalesce(F.regexp_extract(F.lower(F.trim(lang_col)), "^[a-z]{2}", 0), F.lit("")) if lang_col else F.lit("")
    rows = pages.where(F.trim(text_col) != "").select(lang.alias("lang"), F.col(text_col).alias("text"))
    counts = written(rows.mapInArrow(_counted, "lang string, word string, docs long, places long").groupBy("lang", "word").agg(F.sum("docs").alias("docs"), F.sum("places").alias("places")))
    # one row per language, of which there are 677 at most
    totals = counts.where("word = ''").select("lang", F.col("docs").alias("n"), F.col("places").alias("all"))
    often = counts.where("word <> ''").join(F.broadcast(totals), "lang").where((F.col("n") >= LEAST_DOCS) & (F.col("docs") >= USED * F.col("n")))
    so_far = F.sum("places").over(Window.partitionBy("lang").orderBy(F.desc("docs"), "word").rowsBetween(Window.unboundedPreceding, 0))
    found = often.withColumn("so_far", so_far).where(F.col("so_far") <= COVERED * F.col("all"))
    out = frozenset(r["word"] for r in found.select("word").distinct().collect())
    discard(counts)
    return out


def spam_pages(pages: DataFrame, *, id_col: str, text_col: str, lang_col: str | None = None, share: float = SHARE) -> DataFrame:
    """Pages that are mostly keywords, links or tags: ``id, stuffed_share, link_share, periodicity``.

    Whole texts are read. Null and blank texts are no spam; very short ones (fewer than five words and links)
    are where links and tags make them up, whatever their words; copies and repeated rows count each; an empty table
    gives an empty result. Function words are learned from all pages first (see ``function_words``).
    """
    functions = pages.sparkSession.sparkContext.broadcast(function_words(pages, text_col=text_col, lang_col=lang_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [spam_shares(texts, functions.value) for texts in _parts(batch.column(1).to_pylist())]
            stuffed, link, strongest = (np.concatenate([np.empty(0), *(p[k] for p in parts)]) for k in range(3))
            spam = stuffed + link > share
            kept = batch.column(0).filter(pa.array(spam))
            yield pa.RecordBatch.from_arrays([kept, *[pa.array(np.round(x[spam], 6)) for x in (stuffed, link, strongest)]], ["id", "stuffed_share", "link_share", "periodicity"])

    rows = pages.where(F.trim(text_col) != "").select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, stuffed_share double, link_share double, periodicity double")
