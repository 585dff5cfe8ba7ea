"""Evaluation texts inside a corpus: CGK embedding and covering samples of word windows as LSH keys, exact edit verification."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations
from operator import ne

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread
from .glyphs import skeleton

#: Words in a window: the shortest run that counts as a leak.
WINDOW = 10
#: Independent walks; places sampled of each. A window equal to an item's collides in every walk, one with a changed word in
#: about half of the cases; what the walks miss is met by the covering samples.
WALKS, SAMPLES = 2, 8
#: Item windows, and bytes of their keys and words, up to which these go to all executors; beyond, keys are joined by a shuffle.
BROADCAST_WINDOWS, BROADCAST_BYTES = 2_000_000, 256 << 20
#: Characters worked on at a time; longer texts come in pieces that overlap.
PIECE = 1 << 20
#: Bits (a power of 2) of the largest filter of item keys; pairs of windows measured at a time.
FILTER, PAIRS = 29, 1 << 20

_SPLIT = re.compile("(?<=\\w)[-\u2010\u2011\u00ad][ \\t]*\\r?\\n[\\s>]*(?=\\w)")
_BLANK = re.compile(r"(?<=[\w.,!?])[ \t](?=\w)")
_WORD = re.compile(r"[^\W_]+")
_STEPS = 3 * WINDOW
_SEEDS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5][:WALKS]
_PLACES = [sorted(np.random.default_rng(r + 1).permutation(2 * WINDOW)[:SAMPLES]) for r in range(WALKS)]


def words_of(text: str | None) -> list[str]:
    """The words of a text as they are compared: runs of letters and digits of its skeleton, split words joined."""
    if not text:
        return []
    if "\n" in text:
        text = _SPLIT.sub("", text)
    return _WORD.findall(skeleton(text))


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


@cache
def _covers(max_edits: int) -> list[tuple[int, tuple[int, ...], list[list[int]], list[tuple[int, ...]]]]:
    """What covering_keys samples: (words taken out, places left, parts of those, parts that a key is made of).

    Two windows of one length that differ by at most max_edits have, for some `out`, `out` words missing in each and at most
    max_edits - 2 out changed ones. Once the missing words are taken out, the changed ones lie in as many parts at most."""
    covers = []
    for out in range(min(max_edits // 2, WINDOW) + 1):
        changed, left = max_edits - 2 * out, WINDOW - out
        count = min(changed + 3 if changed else 1, left)
        parts = [p.tolist() for p in np.array_split(np.arange(left), count)] if count else []
        kept = list(combinations(range(count), max(0, count - changed)))
        covers += [(out, tuple(k for k in range(WINDOW) if k not in gone), parts, kept) for gone in combinations(range(WINDOW), out)]
    return covers


def covering_keys(symbols: np.ndarray, starts: np.ndarray, max_edits: int) -> list[np.ndarray]:
    """Keys of each window of which any two windows that differ by at most max_edits words share one, whatever the words."""
    mixed, terms, keys = _mix(symbols, 0x2545F4914F6CDD1D), {}, []

    def term(place: int, k: int) -> np.ndarray:
        if (place, k) not in terms:
            terms[place, k] = mixed[starts + place] * np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64))
        return terms[place, k]

    for out, places, parts, kept in _covers(max_edits):
        sums = [sum((term(places[k], k) for k in part[1:]), term(places[part[0]], part[0])) for part in parts]
        for number, chosen in enumerate(kept):
            total = sum((sums[c] for c in chosen), np.zeros(len(starts), np.uint64))
            keys.append(_mix(total, (out + 1) << 32 | number + 1))
    return keys


def window_keys(symbols: np.ndarray, starts: np.ndarray, max_edits: int = 2) -> list[np.ndarray]:
    """The LSH keys of each window symbols[s : s + WINDOW]: one of each walk, then the covering ones.

    The CGK embedding copies a window's symbols one by one; after each copy a bit drawn from (step, symbol) says
    whether to go on to the next symbol or to copy this one again. Edits so become a few differing places. The key
    of a walk is made of SAMPLES of its places."""
    keys = []
    for seed, places in zip(_SEEDS, _PLACES):
        bits = _mix(symbols, seed)
        at, end = starts.copy(), starts + WINDOW
        key = np.full(len(starts), seed, dtype=np.uint64)
        last = len(symbols) - 1
        for step in range(places[-1] + 1):
            inside = at < end
            here = np.minimum(at, last)
            if step in places:
                key = _mix(np.where(inside, symbols[here], np.uint64(0)), 0) ^ _mix(key, step + 1)
            at = at + (((bits[here] >> np.uint64(step)) & np.uint64(1)).astype(np.int64) & inside)
        keys.append(_mix(key, len(keys)))
    return keys + covering_keys(symbols, starts, max_edits)


def _symbols(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=True).astype(np.uint64)


def _edits(a: list[str], b: list[str]) -> int:
    """Word edit distance of two windows."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def _near(a: list[str], b: list[str], most: int) -> int:
    """Word edit distance of two windows of one length, or some number above `most` if it is that far."""
    changed = sum(map(ne, a, b))
    if changed <= 2:
        return changed
    # Each word of the one that the other has nowhere costs an edit.
    return len(set(a) - set(b)) if len(set(a) - set(b)) > most else _edits(a, b)


def _pieces(text: str | None) -> Iterator[tuple[list[str], int]]:
    """The words of a text in pieces of about PIECE characters, and how many windows of each the piece before had already.

    A piece begins so far before the end of the last one that every window lies in one piece whole."""
    start, held, size, length = 0, 0, len(text or ""), PIECE
    while start < size:
        gap = _BLANK.search(text, start + length) if start + length < size else None
        end = gap.start() if gap else size
        words = words_of(text[start:end])
        if end >= size:
            yield words, max(0, held - WINDOW + 1)
            return
        back, again = 64 * WINDOW, []
        while len(again) < WINDOW and back < 2 * (end - start):
            m = _BLANK.search(text, max(start + 1, end - back), end)
            at = m.start() if m else end
            again = words_of(text[at:end])
            back *= 4
        if len(again) < WINDOW or words[len(words) - len(again) :] != again:
            length *= 2  # no overlap to be had here: a longer piece
            continue
        yield words, max(0, held - WINDOW + 1)
        start, held, length = at, len(again), PIECE


def _flat(ids: list, lists: list[list[str]], skips: list[int]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(ids, words, their symbols, starts of windows, row of ids each belongs to) of lists of words."""
    sizes = np.array([len(ws) for ws in lists], dtype=np.int64)
    skip = np.array(skips, dtype=np.int64)
    offset = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - WINDOW + 1 - skip, 0)
    owner = np.repeat(np.arange(len(lists)), counts)
    starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + (offset + skip)[owner]
    flat = [w for ws in lists for w in ws]
    return np.array(ids), flat, _symbols(flat) if flat else np.zeros(0, np.uint64), starts.astype(np.int64), owner


def _batches(part: pd.DataFrame) -> Iterator[tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """The _flat of a batch, some PIECE characters at a time."""
    ids, lists, skips, held = [], [], [], 0
    for i, text in zip(part.id, part.text):
        for words, skip in _pieces(text):
            ids.append(i)
            lists.append(words)
            skips.append(skip)
            held += sum(map(len, words))
            if held > PIECE:
                yield _flat(ids, lists, skips)
                ids, lists, skips, held = [], [], [], 0
    if ids:
        yield _flat(ids, lists, skips)


def _word_lists(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, text) -> (id, words, skip, windows) for every piece that has windows."""
    for part in parts:
        for i, text in zip(part.id, part.text):
            for words, skip in _pieces(text):
                if len(words) - WINDOW + 1 > skip:
                    yield pd.DataFrame({"id": [i], "words": [" ".join(words)], "skip": [skip], "windows": [len(words) - WINDOW + 1 - skip]})


def _filter_bits(keys: int) -> int:
    """How many key bits a filter of so many keys tells apart: 16 to 32 places a key, while FILTER allows it."""
    return min(FILTER, max(6, (16 * keys).bit_length()))


def _passing(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where the keys (signed) may be among those that the filter was made of."""
    at = keys & (64 * len(held) - 1)
    return np.nonzero((held[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1))[0]


def _windows(max_edits: int, held=None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """(id, text) -> (id, key, words) for every key of every window; of those that pass the filter, if one is held."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for ids, flat, symbols, starts, owner in _batches(part):
                if not len(starts):
                    continue
                for key in window_keys(symbols, starts, max_edits):
                    key = key.view(np.int64)
                    some = _passing(held.value, key) if held else np.arange(len(key))
                    if len(some):
                        yield pd.DataFrame({"id": ids[owner[some]], "key": key[some], "words": [" ".join(flat[s : s + WINDOW]) for s in starts[some]]})

    return run


def leaks(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, max_edits: int = 2) -> DataFrame:
    """(doc_id, item_id, windows, edits): `windows` distinct windows of WINDOW words of the document differ from some of the
    item's by at most max_edits words, at best by `edits`; edits = 0 means WINDOW equal consecutive words.

    Every word window of every document is looked up by its keys; candidates are verified exactly on the words. Windows
    that differ by at most max_edits words share a covering key, so recall is 1 for each number of edits up to that.
    Repeated rows, null and short texts: a text of fewer than WINDOW words takes no part. Rows with a null id are left out."""
    spark = documents.sparkSession
    item_texts = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).where("id is not null and text is not null").distinct()
    lists = item_texts.mapInPandas(_word_lists, "id long, words string, skip long, windows long")
    count = lists.agg(F.sum("windows")).first()[0] or 0
    docs = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    keys = len(window_keys(np.zeros(WINDOW, np.uint64), np.zeros(1, np.int64), max_edits))
    # A window has a key and its place for each of its keys, a start, an id, and about a word of its own.
    if count <= BROADCAST_WINDOWS and count * (12 * keys + 96) <= BROADCAST_BYTES:
        held = spark.sparkContext.broadcast(_index(lists.select("id", "words", "skip").toPandas(), max_edits))
        found = spread(docs).mapInPandas(_looking_up(held, max_edits), "doc_id long, item_id long, doc_words string, edits int")
    else:
        item_windows = item_texts.mapInPandas(_windows(max_edits), "id long, key long, words string").distinct()
        bits = _filter_bits(count * keys)
        at = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
        # At most 2 ** FILTER / 64 rows come back.
        full = item_windows.groupBy(F.shiftright(at, 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(key & 63 as int)))").alias("bits")).toPandas()
        held = np.zeros(1 << bits - 6, np.uint64)
        held[full["at"].to_numpy()] = full.bits.to_numpy().view(np.uint64)
        d = cut(spread(docs).mapInPandas(_windows(max_edits, spark.sparkContext.broadcast(held)), "id long, key long, words string").toDF("doc_id", "key", "doc_words"))
        i = item_windows.toDF("item_id", "key", "item_words")
        measure = F.pandas_udf(lambda a, b: pd.Series([_near(x.split(" "), y.split(" "), max_edits) for x, y in zip(a, b)], dtype="int32"), "int")
        # Equal windows are one class: classes meet and are measured once, however many documents or items hold them.
        near = (
            d.select("key", "doc_words")
            .distinct()
            .join(i.select("key", "item_words").distinct(), "key")
            .select("doc_words", "item_words")
            .distinct()
            .withColumn("edits", F.when(F.col("doc_words") == F.col("item_words"), F.lit(0)).otherwise(measure("doc_words", "item_words")))
            .where(F.col("edits") <= max_edits)
        )
        found = d.select("doc_id", "doc_words").distinct().join(near, "doc_words").join(i.select("item_id", "item_words").distinct(), "item_words")
    return found.groupBy("doc_id", "item_id").agg(F.count_distinct("doc_words").alias("windows"), F.min("edits").alias("edits"))


def _index(lists: pd.DataFrame, max_edits: int):
    """Of the items: their words, the starts and ids of their distinct windows, sorted keys, the window of each, a filter of the keys."""
    ids, flat, symbols, starts, owner = _flat(lists.id.tolist(), [[*map(sys.intern, w.split(" "))] for w in lists.words], lists.skip.tolist())
    if not len(starts):
        return [], starts, starts, starts, starts, np.zeros(1, np.uint64)
    codes = pd.factorize(np.array(flat, dtype=object))[0].astype(np.int32)
    first = ~pd.DataFrame({"id": ids[owner]} | {f"w{k}": codes[starts + k] for k in range(WINDOW)}).duplicated().to_numpy()
    starts, ids = starts[first], ids[owner[first]]
    each = window_keys(symbols, starts, max_edits)
    keys = np.concatenate(each).view(np.int64)
    order = np.argsort(keys, kind="stable")
    held = np.zeros(1 << _filter_bits(len(keys)) - 6, np.uint64)
    at = keys & (64 * len(held) - 1)
    np.bitwise_or.at(held, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return flat, starts, ids, keys[order], (order % len(starts)).astype(np.int32), held


def _candidates(key: np.ndarray, keys: np.ndarray, windows: np.ndarray, held: np.ndarray, count: int) -> Iterator[np.ndarray]:
    """Place in key * count + item window for each pair with equal keys, about PAIRS at a time."""
    some = _passing(held, key)
    left = np.searchsorted(keys, key[some], "left")
    sizes = np.searchsorted(keys, key[some], "right") - left
    some, left, sizes = some[sizes > 0], left[sizes > 0], sizes[sizes > 0]
    group = np.cumsum(sizes) // PAIRS
    for g in np.unique(group):
        own = group == g
        n = sizes[own]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(left[own], n)
        yield np.repeat(some[own], n) * count + windows[place]


def _looking_up(held, max_edits: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, item_starts, ids, keys, windows, full = held.value
        for part in parts:
            out = []
            for own, flat, symbols, starts, owner in _batches(part) if len(keys) else ():
                if not len(starts):
                    continue
                best: dict[tuple[int, int, str], int] = {}
                for pairs in _some(c for key in window_keys(symbols, starts, max_edits) for c in _candidates(key.view(np.int64), keys, windows, full, len(ids))):
                    for h, i in zip(*(x.tolist() for x in np.divmod(pairs, len(ids)))):
                        window, other = flat[starts[h] : starts[h] + WINDOW], words[item_starts[i] : item_starts[i] + WINDOW]
                        e = _near(window, other, max_edits)
                        if e <= max_edits:
                            found = (int(own[owner[h]]), int(ids[i]), " ".join(window))
                            best[found] = min(e, best.get(found, e))
                out += [(*found, e) for found, e in best.items()]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "doc_words", "edits"])

    return run


def _some(pairs: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """The distinct pairs of all arrays, or of those that together hold about PAIRS."""
    held, size = [], 0
    for x in pairs:
        held.append(x)
        size += len(x)
        if size > PAIRS:
            yield np.unique(np.concatenate(held))
            held, size = [], 0
    if held:
        yield np.unique(np.concatenate(held))
