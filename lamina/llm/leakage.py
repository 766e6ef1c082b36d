"""Held-out items whose passages stand in training texts.

The training texts are cut into shards. The words of a shard are numbered and their suffixes sorted by prefix doubling: a suffix
array, of which those suffixes are kept whose first MIN_WORDS words stand in some item, as no other can match. Every suffix of
every item is searched in it by bisection, one word deeper at a time: the intervals of places that share its first words shrink
until none is left, which gives its longest verbatim match, all places of it, and the length of every shorter match. Intervals are
turned into places for a bounded number of them at once. Matches of one document and item are then chained in order, with gaps as
small changes of wording and markup leave them; the share of the item that the best chain spans decides. Shards are independent:
nothing is shuffled, and a text that is copied a million times costs no pairs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.texwords import words
from lamina.session import spread

#: The shortest verbatim match that counts, in words.
MIN_WORDS = 3
#: The share of an item's words that a passage must span.
MIN_SHARE = 0.4
#: Between two matches of one passage: words of the item that were altered, words of the document that were put in.
ITEM_GAP, TEXT_GAP = 8, 40
#: Of the words that a passage spans, how many must match.
MIN_DENSITY = 0.65
#: Items go to all tasks in blocks of at most so many characters; each block is a pass over the texts.
BLOCK_CHARS = 16 << 20
#: Characters of one shard.
SHARD_CHARS = 4 << 20
#: So many places of matches at most are held at once.
PLACES_AT_ONCE = 1 << 20


def plain_words(text: str | None) -> list[str]:
    """Runs of ASCII letters and digits, in lower case; nothing is known of markup."""
    return [w.lower() for w in re.findall("[A-Za-z0-9]+", text or "")]


@dataclass
class Items:
    """A block of items as one array of word numbers, with the numbers of their first words."""

    ids: list
    vocabulary: dict[str, int]
    text: np.ndarray  # word numbers of all items, each followed by a zero
    owner: np.ndarray  # of each word, the item's index
    start: np.ndarray  # of each item, its first word
    length: np.ndarray
    pairs: np.ndarray  # the distinct pairs of neighbouring words
    known: np.ndarray  # the distinct keys of three neighbouring words
    suffix: np.ndarray  # places from which at least MIN_WORDS words are left
    key: np.ndarray  # of each suffix, its first three words

    @classmethod
    def of(cls, rows: list[tuple], split: Callable[[str | None], list[str]] = words) -> Items:
        vocabulary: dict[str, int] = {}
        text, owner, start, length = [], [], [], []
        for k, (_, item) in enumerate(rows):
            w = [vocabulary.setdefault(x, len(vocabulary) + 1) for x in split(item)]
            start.append(len(text))
            length.append(len(w))
            text += [*w, 0]
            owner += [k] * (len(w) + 1)
        none = np.zeros(0, np.int64)
        items = cls([r[0] for r in rows], vocabulary, np.array(text or [0], np.int64), np.array(owner or [0], np.int64), np.array(start, np.int64), np.array(length, np.int64), none, none, none, none)
        items.pairs = np.unique(items._pair(items.text)[1])
        items.suffix, items.key = items.keyed(items.text)
        items.known = np.unique(items.key)
        return items

    def _pair(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.flatnonzero((text[:-1] > 0) & (text[1:] > 0))
        return place, text[place] * (len(self.vocabulary) + 1) + text[place + 1]

    def keyed(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose next three words may begin a match, and these words as one number: of their pair, which is one of the items', and
        of the third. Numbers are in the order of the words and can't overflow."""
        if not len(self.pairs):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place, pair = self._pair(text)
        inside = place + 2 < len(text)
        place, pair = place[inside], pair[inside]
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        hit = (self.pairs[at] == pair) & (text[place + 2] > 0)
        place = place[hit]
        return place, at[hit] * (len(self.vocabulary) + 1) + text[place + 2]


def suffix_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Numbers in the order of the suffixes by their first ``depth`` words at least; a zero ends a suffix. By prefix doubling: suffixes
    that agree in h words are sorted by what stands h words on, until they differ, end or are deep enough."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    value = text[order]
    first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, n])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, size)
    ends = np.flatnonzero(text == 0)
    left = np.r_[ends, n][np.searchsorted(ends, np.arange(n))] - np.arange(n)  # words before the next zero
    live = order[np.repeat(size > 1, size)]
    h = 1
    while h < depth and len(live):
        live = live[left[live] >= h]  # what ended before is told from the rest already
        on = live + h
        beyond = np.where(on < n, rank[np.minimum(on, n - 1)], -1)
        beyond = np.where(left[live] > h, beyond, -1)
        by = np.lexsort((beyond, rank[live]))
        live, beyond = live[by], beyond[by]
        group = rank[live]
        starts = np.r_[True, group[1:] != group[:-1]][: len(live)]
        cuts = starts | np.r_[True, beyond[1:] != beyond[:-1]][: len(live)]
        at = np.arange(len(live))
        head, cut = np.maximum.accumulate(np.where(starts, at, 0)), np.maximum.accumulate(np.where(cuts, at, 0))
        rank[live] = group + cut - head
        same = np.bincount(cut, minlength=len(live))[cut] if len(live) else at
        live = live[(same > 1) & (beyond >= 0)]
        h *= 2
    return rank


def _bisected(words_at: np.ndarray, low: np.ndarray, high: np.ndarray, word: np.ndarray, right: bool) -> np.ndarray:
    """In each interval [low, high) of a sorted array, where ``word`` would stand."""
    low, high = low.copy(), high.copy()
    todo = np.flatnonzero(low < high)
    while len(todo):
        middle = (low[todo] + high[todo]) >> 1
        found = words_at(todo, middle)
        less = found <= word[todo] if right else found < word[todo]
        low[todo] = np.where(less, middle + 1, low[todo])
        high[todo] = np.where(less, high[todo], middle)
        todo = todo[low[todo] < high[todo]]
    return low


def intervals(items: Items, text: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The suffix array of ``text``, and (place in the items, from, to, words): the intervals of it whose suffixes agree with the item's in
    exactly so many words, for every suffix of every item; those with most words hold its longest match."""
    none = np.zeros(0, np.int64)
    place, key = items.keyed(text)
    if len(place) and len(items.known):
        at = np.minimum(np.searchsorted(items.known, key), len(items.known) - 1)
        hit = items.known[at] == key
        place, key = place[hit], key[hit]
    if not len(place) or not len(items.suffix):
        return none, (none, none, none, none)
    order = np.argsort(suffix_ranks(text, int(items.length.max()))[place], kind="stable")
    array, key = place[order], key[order]
    j = items.suffix
    low, high = np.searchsorted(key, items.key, "left"), np.searchsorted(key, items.key, "right")
    there = low < high
    j, low, high = j[there], low[there], high[there]
    found: list[tuple[np.ndarray, ...]] = []
    depth = MIN_WORDS
    while len(j):
        word = items.text[np.minimum(j + depth, len(items.text) - 1)]

        def at_depth(which: np.ndarray, middle: np.ndarray) -> np.ndarray:
            on = array[middle] + depth
            return np.where(on < len(text), text[np.minimum(on, len(text) - 1)], 0)

        inner, outer = _bisected(at_depth, low, high, word, False), _bisected(at_depth, low, high, word, True)
        ended = word == 0
        inner, outer = np.where(ended, high, inner), np.where(ended, high, outer)
        for a, b in ((low, inner), (outer, high)):
            some = a < b
            found.append((j[some], a[some], b[some], np.full(int(some.sum()), depth)))
        on = inner < outer
        j, low, high = j[on], inner[on], outer[on]
        depth += 1
    return array, tuple(np.concatenate(c) for c in zip(*found))


def matches(items: Items, text: np.ndarray, min_words: int = MIN_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All longest verbatim matches of at least ``min_words``: (place in ``text``, place in the items, words), all of an item together. What
    is held is bounded: intervals are turned into places for PLACES_AT_ONCE of them, and a match that could begin a word earlier is
    dropped before the next ones follow."""
    array, (j, low, high, depth) = intervals(items, text)
    enough = depth >= min_words
    order = np.argsort(items.owner[j[enough]], kind="stable")
    j, low, high, depth = (x[enough][order] for x in (j, low, high, depth))
    total = np.cumsum(high - low)
    item = items.owner[j]
    held: list[tuple[np.ndarray, ...]] = []
    begin = 0
    while begin < len(j):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PLACES_AT_ONCE, "right")))
        if end < len(j) and item[end - 1] == item[end] and item[begin] != item[end]:
            end = int(np.searchsorted(item, item[end]))  # up to the last whole item
        count = high[begin:end] - low[begin:end]
        own = np.repeat(j[begin:end], count)
        p = array[np.repeat(low[begin:end] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        n = np.repeat(depth[begin:end], count)
        before_p, before_j = text[np.maximum(p - 1, 0)], items.text[np.maximum(own - 1, 0)]
        begins = (p == 0) | (own == 0) | (before_p != before_j) | (before_j == 0)
        held.append((p[begins], own[begins], n[begins]))
        if end == len(j) or item[end - 1] != item[end]:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held = []
        begin = end


def chains(runs: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Of matches (text place, item place, words): the chains in order, most words first. Each match goes on from the one that
    gives it most words; overlaps count once and are cut from the later match."""
    runs = sorted(runs)
    best: list[tuple[int, int, int]] = []  # words, the match before, words cut from this one
    first = 0
    longest = max(n for _, _, n in runs)
    last = set(range(len(runs)))
    for k, (p, j, n) in enumerate(runs):
        got = (n, -1, 0)
        while runs[first][0] < p - TEXT_GAP - longest:
            first += 1
        for m in range(first, k):
            q, i, l = runs[m]
            if j <= i or p <= q:
                continue
            over = max(0, i + l - j, q + l - p)
            if over >= n or j - (i + l) > ITEM_GAP or p - (q + l) > TEXT_GAP:
                continue
            if best[m][0] + n - over > got[0]:
                got = (best[m][0] + n - over, m, over)
        last.discard(got[1])
        best.append(got)
    out = []
    for k in sorted(last, key=lambda k: -best[k][0]):
        chain = []
        while k >= 0:
            (p, j, n), (_, before, over) = runs[k], best[k]
            chain.append((p + over, j + over, n - over))
            k = before
        out.append(chain[::-1])
    return out


def aligned(items: Items, text: np.ndarray, chain: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The chain as pairs (item place, text place) of single words in order, with the words that match between its matches."""
    pairs: list[tuple[int, int]] = []
    for p, j, n in chain:
        if pairs:
            (j0, p0), x = pairs[-1], items.text
            pairs += [(j0 + 1 + a, p0 + 1 + b) for a, b in _common(x[j0 + 1 : j].tolist(), text[p0 + 1 : p].tolist())]
        pairs += zip(range(j, j + n), range(p, p + n))
    return pairs


def _common(x: list[int], y: list[int]) -> list[tuple[int, int]]:
    """The places of a longest common subsequence of known words."""
    if not set(x) & set(y) - {0}:
        return []
    size = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for a in range(len(x) - 1, -1, -1):
        for b in range(len(y) - 1, -1, -1):
            size[a][b] = size[a + 1][b + 1] + 1 if x[a] == y[b] and x[a] > 0 else max(size[a + 1][b], size[a][b + 1])
    out, a, b = [], 0, 0
    while a < len(x) and b < len(y):
        if x[a] == y[b] and x[a] > 0:
            out.append((a, b))
            a, b = a + 1, b + 1
        elif size[a + 1][b] >= size[a][b + 1]:
            a += 1
        else:
            b += 1
    return out


#: Where a match may go on over altered words: distances in item and text, nearest first by the sum of both.
STEPS = [(a, gap - a) for gap in range(7) for a in range(min(gap, 3) + 1) if gap - a <= 3]


def reach(items: Items, text: np.ndarray, j: np.ndarray, p: np.ndarray, step: int, low: np.ndarray, high: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many words ``edge`` adds to matches whose outermost words are at ``j`` and ``p``, inside [low, high) of the item and
    [begin, end) of the text."""
    count, j, p = np.zeros(len(j), np.int64), j.copy(), p.copy()
    active = np.arange(len(j))
    while len(active):
        found = np.zeros(len(active), bool)
        x0, y0 = j[active] + step, p[active] + step
        for a, b in STEPS:
            x, y = x0 + step * a, y0 + step * b
            k = np.flatnonzero(~found & (x >= low[active]) & (x < high[active]) & (y >= begin[active]) & (y < end[active]))
            k = k[(items.text[x[k]] == text[y[k]]) & (items.text[x[k]] > 0)]
            found[k] = True
            j[active[k]], p[active[k]] = x[k], y[k]
        active = active[found]
        count[active] += 1
    return count


def edge(items: Items, text: np.ndarray, pair: tuple[int, int], step: int, low: int, high: int, begin: int, end: int) -> list[tuple[int, int]]:
    """What carries a chain on from its outermost pair, over altered words: words that match within three words on both sides."""
    out = []
    while True:
        for a, b in STEPS:
            x, y = pair[0] + step * (a + 1), pair[1] + step * (b + 1)
            if low <= x < high and begin <= y < end and items.text[x] == text[y] and items.text[x] > 0:
                pair = (x, y)
                out.append(pair)
                break
        else:
            return out


def densest(places: list[int], least: float) -> tuple[int, int, int] | None:
    """(words, item from, item to) of the stretch of the matching words that spans ``least`` words at MIN_DENSITY and holds most of them."""
    j = np.array(places, np.int64)
    top = None
    for a in range(len(j)):
        if top and len(j) - a <= top[0]:
            break
        span = j[a:] - j[a] + 1
        count = np.arange(1, len(span) + 1)
        good = np.flatnonzero((span >= least) & (count >= MIN_DENSITY * span))
        if len(good) and (top is None or count[good[-1]] > top[0]):
            top = (int(count[good[-1]]), int(j[a]), int(j[a + good[-1]]) + 1)
    return top


def numbered(items: Items, texts: list[str | None], split: Callable[[str | None], list[str]] = words) -> tuple[np.ndarray, np.ndarray]:
    """A shard's word numbers, zero for words that no item has and between texts; and where each text ends."""
    get = items.vocabulary.get
    parts = [np.array([*[get(x, 0) for x in split(text)], 0], np.int64) for text in texts]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.cumsum([len(p) for p in parts], dtype=np.int64)


def shard_leaks(items: Items, ids: list, texts: list[str | None], min_share: float = MIN_SHARE) -> list[tuple]:
    """(document, item, share, matching words, longest verbatim match, first and last word of the item) over one shard."""
    text, ends_of = numbered(items, texts)
    out = []
    for found in matches(items, text):
        out += _leaks(items, ids, text, ends_of, *found, min_share)
    return out


def _leaks(items: Items, ids: list, text: np.ndarray, ends_of: np.ndarray, p: np.ndarray, j: np.ndarray, n: np.ndarray, min_share: float) -> list[tuple]:
    if not len(p):
        return []
    doc, item = np.searchsorted(ends_of, p, "right"), items.owner[j]
    order = np.lexsort((p, item, doc))
    p, j, n, doc, item = p[order], j[order], n[order], doc[order], item[order]
    cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
    ends = np.r_[cut[1:], len(p)]
    wanted = min_share * items.length[item[cut]]
    # No chain holds more words than all matches, all words between them and the furthest reach at both ends.
    inside = (items.start[item], items.start[item] + items.length[item], np.r_[0, ends_of][doc], ends_of[doc])
    most = np.add.reduceat(n, cut) + ITEM_GAP * (ends - cut - 1)
    most += np.maximum.reduceat(reach(items, text, j, p, -1, *inside), cut) + np.maximum.reduceat(reach(items, text, j + n - 1, p + n - 1, 1, *inside), cut)
    out = []
    for c in np.flatnonzero(most >= np.maximum(MIN_WORDS, wanted * MIN_DENSITY)):
        s = slice(cut[c], ends[c])
        d, i = int(doc[cut[c]]), int(item[cut[c]])
        low, high, begin, end = (int(x[cut[c]]) for x in inside)
        for chain in chains(list(zip(p[s].tolist(), j[s].tolist(), n[s].tolist()))):
            pairs = aligned(items, text, chain)
            pairs = edge(items, text, pairs[0], -1, low, high, begin, end)[::-1] + pairs + edge(items, text, pairs[-1], 1, low, high, begin, end)
            if len(pairs) < MIN_DENSITY * wanted[c]:
                continue
            found = densest([x for x, _ in pairs], float(wanted[c]))
            if found:
                got, a, b = found
                out.append((ids[d], items.ids[i], (b - a) / (high - low), got, int(n[s].max()), a - low, b - low))
                break
    return out


def shard_longest(items: Items, ids: list, texts: list[str | None], min_words: int) -> list[tuple]:
    """(document, item, words of their longest verbatim match) over one shard, by plain words."""
    text, ends_of = numbered(items, texts, plain_words)
    best: dict[tuple[int, int], int] = {}
    for p, j, n in matches(items, text, min_words):
        for d, i, k in zip(np.searchsorted(ends_of, p, "right").tolist(), items.owner[j].tolist(), n.tolist()):
            best[d, i] = max(k, best.get((d, i), 0))
    return [(ids[d], items.ids[i], k) for (d, i), k in best.items()]


def _blocks(evaluation: DataFrame, item_id: str, item_text: str) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size; the driver holds one at a time."""
    block: list[tuple] = []
    chars = 0
    for row in evaluation.select(F.col(item_id).alias("i"), F.col(item_text).alias("x")).filter("x is not null").toLocalIterator():
        if chars + len(row["x"]) > BLOCK_CHARS and block:
            yield block
            block, chars = [], 0
        block.append((row["i"], row["x"]))
        chars += len(row["x"])
    yield block


def _searched(documents: DataFrame, evaluation: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, columns: list[tuple[str, T.DataType]],
              split: Callable[[str | None], list[str]], search: Callable[[Items, list, list], list[tuple]]) -> DataFrame:
    """(``doc_id``, ``item_id``, ``columns``) of what ``search`` finds in every shard of the texts, block by block of items."""
    schema = T.StructType([T.StructField(doc_id, documents.schema[doc_id].dataType), T.StructField(item_id, evaluation.schema[item_id].dataType), *[T.StructField(n, k) for n, k in columns]])
    kinds = [_arrow(f.dataType) for f in schema.fields]
    names = [f"c{k}" for k in range(len(kinds))]  # the ids' own names may clash with others
    texts = spread(documents.select(F.col(doc_id).alias("d"), F.col(text).alias("x")))

    def passed(sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items.of(sent.value, split)
            ids, xs, size = [], [], 0

            def rows() -> pa.RecordBatch:
                found = search(items, ids, xs)
                parts = list(zip(*found)) if found else [[]] * len(kinds)
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(parts, kinds)], names=names)

            for batch in batches:
                for d, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids.append(d)
                    xs.append(x)
                    size += len(x or "")
                    if size >= SHARD_CHARS:
                        yield rows()
                        ids, xs, size = [], [], 0
            if ids:
                yield rows()

        internal = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, schema.fields)])
        return texts.mapInArrow(run, internal)

    out = None
    for block in _blocks(evaluation, item_id, item_text):
        own = passed(documents.sparkSession.sparkContext.broadcast(block))
        out = own if out is None else out.unionByName(own)
    return out.toDF(*schema.names)


def leaks(documents: DataFrame, evaluation: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
          item_text: str = "item_text", min_share: float = MIN_SHARE) -> DataFrame:
    """(``doc_id``, ``item_id``, ``share``, ``matching``, ``longest``, ``item_from``, ``item_to``): one row per document and
    item of which at least ``min_share`` of the words stand in one place of the document.

    Items are sent to the tasks in blocks of bounded size, each a pass over the texts. Defined results: null and empty texts
    and items match nothing; an item shorter than MIN_WORDS words isn't searched; items with equal texts are reported
    each; copies of a document are reported each; texts are searched whole, comments included. Empty tables give an empty result.
    """
    columns = [("share", T.DoubleType()), *((n, T.LongType()) for n in ("matching", "longest", "item_from", "item_to"))]
    return _searched(documents, evaluation, doc_id, text, item_id, item_text, columns, words, lambda items, ids, xs: shard_leaks(items, ids, xs, min_share))


def longest_matches(documents: DataFrame, evaluation: DataFrame, min_words: int, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text") -> DataFrame:
    """(``doc_id``, ``item_id``, ``longest``): for every document and item the words of their longest verbatim match, if it has at least
    ``min_words`` (MIN_WORDS or more); by plain words, that is runs of letters and digits without regard to markup. Nulls and empty tables as in ``leaks``."""
    if min_words < MIN_WORDS:
        raise ValueError(f"matches of fewer than {MIN_WORDS} words aren't searched")
    return _searched(documents, evaluation, doc_id, text, item_id, item_text, [("longest", T.LongType())], plain_words, lambda items, ids, xs: shard_longest(items, ids, xs, min_words))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def without_leaks(documents: DataFrame, evaluation: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """The documents that hold no passage of an item."""
    return documents.join(leaks(documents, evaluation, doc_id=doc_id, **how).select(doc_id).distinct(), doc_id, "left_anti")
