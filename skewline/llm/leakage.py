"""Evaluation texts leaking into training text (problem 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skewline.llm.subtitles import WORD, cue_texts, folded, lines_of, repaired

#: Successive words of an item that make a leak, damaged words among them that are borne, words of an exact piece.
RUN, BUDGET = 12, 3
PIECE = RUN // (BUDGET + 1)
#: All rows of a column of distances against RUN words.
FULL = (1 << RUN) - 1
#: Where the rows found by two successive words stand above those found by the last one.
TWICE = 1 << RUN + 1
#: Empty places between two items, and between two documents.
AFTER = RUN + PIECE
#: Exact pieces that are walked from at once.
SEEDS = 30_000
#: Words of documents that are searched at once.
WORDS_HELD = 200_000
#: Place without a word among the items' words.
EMPTY = -5
#: Items indexed at once; more are taken in blocks.
BLOCK = 5_000


def advanced(eq, plus, minus, full):
    """The next column of Myers' bit-parallel distance: (plus, minus) hold where it rises and falls from row to row.

    eq: the rows whose symbol is the text's next one. For whole numbers as for arrays of them, one column each.
    """
    diagonal = ((((eq | minus) & plus) + plus) ^ plus) | eq | minus
    up = minus | (~(diagonal | plus) & full)
    down = plus & diagonal
    # a text longer by one symbol costs one more in the row above the first
    up, down = (up << 1 | 1) & full, down << 1 & full
    return down | (~(diagonal | up) & full), up & diagonal


def myers(pattern: str, text: str) -> int:
    """Edit distance of two strings by Myers' bit-parallel method (one machine word of ``pattern``, or a long integer)."""
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(pattern)) - 1
    plus, minus = full, 0
    for c in text:
        plus, minus = advanced(masks.get(c, 0), plus, minus, full)
    return len(text) + plus.bit_count() - minus.bit_count()


def edits_borne(word: str) -> int:
    """Edits of a word of the item that count as damage."""
    return 0 if len(word) < 3 else 1 if len(word) < 7 else 2


class Items:
    """The items of one block (id, text, whether its first line is an instruction): their words as numbers and the places of every piece."""

    def __init__(self, items: list[tuple[int, str, bool]]):
        self.ids, words = [], []
        for item, text, instructed in items:
            text = lines_of(text).strip()
            if instructed:
                text = text.partition("\n")[2]
            own = WORD.findall(folded(repaired(text)))
            if len(own) >= RUN:
                self.ids.append(item)
                words.append(own)
        self.number: dict[str, int] = {}
        for own in words:
            for w in own:
                self.number.setdefault(w, len(self.number) + 1)
        self.base = len(self.number) + 1
        # items stand apart, so that no piece and no step leads from one to another
        self.words = np.concatenate([np.full(AFTER, EMPTY), *[a for w in words for a in (np.array([self.number[x] for x in w], np.int64), np.full(AFTER, EMPTY))]])
        self.item = np.concatenate([np.full(AFTER, -1), *[a for i, w in enumerate(words) for a in (np.full(len(w), i), np.full(AFTER, -1))]])
        self.pieces = {}
        for size in range(1, PIECE + 1):
            place, keys = self._keys(self.words, size)
            order = np.argsort(keys, kind="stable")
            self.pieces[size] = keys[order], place[order]
        self.parts: dict[tuple[int, str], list[str]] = {}
        for w in self.number:
            for part in self._parts(w):
                self.parts.setdefault(part, []).append(w)
        self.letters = {w: frozenset(w) for w in self.number}
        self.known: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def _parts(word: str) -> Iterator[tuple[int, str]]:
        k = edits_borne(word) + 1
        cut = [len(word) * i // k for i in range(k + 1)]
        for i in range(k):
            yield cut[i], word[cut[i] : cut[i + 1]]

    def _keys(self, words: np.ndarray, size: int, where: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(place, key) of each ``size`` words side by side that items have, of those that start ``where``."""
        n = max(len(words) - size + 1, 0)
        whole = np.ones(n, bool) if where is None else where[:n].copy()
        for i in range(size):
            whole &= words[i : i + n] > 0
        place = np.flatnonzero(whole)
        key = np.zeros(len(place), np.int64)
        for i in range(size):
            key = key * self.base + words[place + i]
        return place, key

    def near(self, word: str) -> tuple[int, ...]:
        """Numbers of all item words, other than ``word`` itself, that ``word`` may be a damaged form of."""
        found = self.known.get(word)
        if found is None:
            seen = set()
            for k in (1, 2):
                for size in range(len(word) - k, len(word) + k + 1):
                    if size < 3 or (1 if size < 7 else 2) != k:
                        continue
                    cut = [size * i // (k + 1) for i in range(k + 2)]
                    for i in range(k + 1):
                        for shift in range(-k, k + 1):
                            at = cut[i] + shift
                            if at >= 0:
                                seen.update(self.parts.get((cut[i], word[at : at + cut[i + 1] - cut[i]]), ()))
            seen.discard(word)
            # an edit takes one letter away and adds one at most
            own = frozenset(word)
            near = ((w, edits_borne(w)) for w in seen if len(self.letters[w] ^ own) <= 2 * edits_borne(w))
            found = tuple(self.number[w] for w, k in near if abs(len(w) - len(word)) <= k and myers(w, word) <= k)
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = found
        return found

    def hits(self, words: np.ndarray, size: int = PIECE, where: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``words``, place in the items) of each exact piece of ``size`` words."""
        own, place = self.pieces[size]
        at, keys = self._keys(words, size, where)
        nth, who = _spread(np.searchsorted(own, keys, "left"), np.searchsorted(own, keys, "right"))
        return at[who], place[nth]


class Texts:
    """The words of a batch of documents, and the items, as they are walked in one direction."""

    def __init__(self, items: Items, numbers: np.ndarray, codes: np.ndarray, near: np.ndarray, doc: np.ndarray, cue: np.ndarray, back: bool):
        """codes: numbers of the different words; near: sorted code * base + number of the item words each may stand for."""
        turned = slice(None, None, -1 if back else 1)
        self.words, self.item, self.base = items.words[turned], items.item[turned], items.base
        self.numbers, self.codes, self.near, self.doc = numbers[turned], codes[turned], near, doc[turned]
        cue = cue[turned]
        self.ends = np.concatenate((cue[1:] != cue[:-1], [True]))
        self.resembling = np.searchsorted(near, np.arange(codes.max() + 1) * self.base) < np.searchsorted(near, np.arange(1, codes.max() + 2) * self.base)
        # by document and number of unknown words at the start of a cue: the item words that the word behind them may stand for
        at = np.flatnonzero(np.concatenate(([True], self.ends[:-1])) & (self.doc >= 0))
        starts = []
        for lost in range(BUDGET + 1):
            code = self.codes[at]
            nth, who = _spread(np.searchsorted(near, code * self.base), np.searchsorted(near, (code + 1) * self.base))
            some = self.numbers[at] > 0
            place, word = np.concatenate((at[some], at[who])), np.concatenate((self.numbers[at][some], near[nth] - code[who] * self.base))
            starts.append(self._key(place, lost, word) + place)
            at = at[(self.numbers[at] == 0) & (self.doc[np.minimum(at + 1, len(self.doc) - 1)] == self.doc[at])] + 1
        self.starts = np.sort(np.concatenate(starts))

    def _key(self, x: np.ndarray, lost: int, word: np.ndarray) -> np.ndarray:
        return ((self.doc[x] * (BUDGET + 1) + lost) * self.base + word) * len(self.doc)

    def later(self, x: np.ndarray, word: np.ndarray, lost: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Range in ``starts`` of the cues behind the next word of the document of ``x`` that start with ``word`` after ``lost`` unknown words."""
        key = self._key(x, lost, word)
        low = np.searchsorted(self.starts, key + x + 2 + lost)
        return low, np.maximum(low, np.searchsorted(self.starts, key + len(self.doc)))

    def follows(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether a later cue starts with the word behind place ``y`` of the items."""
        low, high = self.later(x, np.maximum(self.words[y + 1], 0))
        return (self.words[y + 1] > 0) & (high > low)

    def reached(self, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        """(n, BUDGET + 1): item words that the text behind ``at`` carries on from ``place``, by the edits between them.

        Edits are Myers' bit-parallel distance with words as symbols: of each text the column against the next RUN words of the
        item goes on word by word. Words follow one another in the document, or lie at the start of any later cue where one
        ends: cues between are skipped. A word is an item's word if it is the same or, by Myers' distance of their characters, a
        damaged form of it. A word that other items have and the passage has nowhere near ends the text: only words that no item has are
        borne as lost, and only such words shift the text against the item (one stands for two run together, two for one divided):
        words left out or added in good spelling are no damage. A passage ends in a found word, after a shift in an exact piece.
        """
        whole = np.zeros((len(at), BUDGET + 1), np.int64)
        # a known word that is no form of the item's next one, inside a cue, ends the text at once
        same, bearable = self._same(self.numbers[at + 1], self.codes[at + 1], self.words[place + 1])
        some = np.flatnonzero(same | bearable | self.ends[at])
        for part in range(0, len(some), SEEDS):
            now = some[part : part + SEEDS]
            whole[now] = self._walked(at[now], place[now])
        return whole

    def _walked(self, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        """``reached`` of pieces whose text doesn't end at once, step by step for all of them."""
        best = np.zeros((len(at), BUDGET + 1), np.int64)
        pattern = self.words[np.minimum(place[:, None] + 1 + np.arange(RUN), len(self.words) - 1)]
        # an item's end is no word
        length = np.argmax(np.concatenate([pattern <= 0, np.ones((len(at), 1), bool)], axis=1), axis=1)
        n = len(at)
        todo = (np.arange(n), at, np.full(n, FULL), *(np.zeros(n, np.int64) for _ in range(5)))
        while len(todo[0]):
            left = []
            while len(todo[0]):
                end = self.ends[todo[1]]
                left.append(tuple(c[end] for c in todo))
                h, x, *column = todo
                todo = self._next(at, pattern, length, best, h, x + 1, *column)
            todo = tuple(np.concatenate(c) for c in zip(*left, strict=True))
            h, x, *column = self._jumps(pattern, length, *todo)
            if not len(h):
                break
            once = _distinct(h * len(self.doc) + x, *column)
            todo = self._next(at, pattern, length, best, h[once], x[once], *(c[once] for c in column))
        return np.maximum.accumulate(best, axis=1)

    def _same(self, number, code, word):
        """(same, bearable): whether each word of the document is the item's, or a damaged form of it that no item has; whether it is
        that, a word of the items that may be a damaged form of it, or a word no item has."""
        same = number == word
        close = np.flatnonzero(self.resembling[code] & ~same)
        bearable = same | (number == 0)
        if len(close):
            key = code[close] * self.base + word[close]
            close = close[self.near[np.minimum(np.searchsorted(self.near, key), len(self.near) - 1)] == key]
            same[close] = number[close] == 0
            bearable[close] = True
        return same, bearable

    def _next(self, at, pattern, length, best, h, x, plus, minus, used, before, odd, off):
        """The states behind the word at ``x``: those whose distance is still within BUDGET; what they reach is noted in ``best``."""
        x = np.minimum(x, len(self.doc) - 1)
        good = np.flatnonzero((self.doc[x] == self.doc[at[h]]) & (used < RUN + BUDGET))
        # most texts end here: known words that nothing resembles
        number, code, row = self.numbers[x[good]], self.codes[x[good]], np.minimum(used[good], RUN - 1)
        going = np.flatnonzero((number == 0) | (number == pattern[h[good], row]) | (odd[good] > 0) | self.resembling[code])
        good, number, code, row = good[going], number[going], code[going], row[going]
        h, x, plus, minus, used, before, odd, off = (c[good] for c in (h, x, plus, minus, used, before, odd, off))
        # while all words are the same the distance is 0 and the column is known
        same, bearable = self._same(number, code, pattern[h, row])
        same &= used < length[h]
        exact = np.flatnonzero(same & (odd == 0))
        np.maximum.at(best, (h[exact], 0), used[exact] + 1)
        ones = (2 << used[exact]) - 1
        going = (h[exact], x[exact], FULL & ~ones, ones, used[exact] + 1, (1 << used[exact]) * (1 + (used[exact] > 0) * TWICE), odd[exact], off[exact])
        rest = np.flatnonzero((odd > 0) | (~same & bearable))
        if not len(rest):
            return going
        h, x, plus, minus, used, before, odd, off, number, code, bearable = (c[rest] for c in (h, x, plus, minus, used, before, odd, off, number, code, bearable))
        eq = np.zeros(len(h), np.int64)
        # rows that the odd words so far can't have led to needn't be looked at
        shifts = range(-min(BUDGET, int(odd.max()) + 1), min(BUDGET, int(odd.max()) + 1) + 1)
        for shift in shifts:
            row = used + shift
            some = np.flatnonzero((row >= 0) & (row < length[h]) & (abs(shift) <= odd + 1))
            eq[some] |= self._same(number[some], code[some], pattern[h[some], row[some]])[0].astype(np.int64) << row[some]
        plus, minus = advanced(eq, plus, minus, FULL)
        off = off + (eq >> np.minimum(used, RUN) & 1 == 0)
        used, odd = used + 1, odd + ((eq & ((before % TWICE << 1) | (1 << np.minimum(used, RUN)))) == 0)
        least = np.full(len(h), RUN)
        for shift in shifts:
            row = used + shift
            rows = (1 << np.clip(row, 0, RUN)) - 1
            distance = used + np.bitwise_count(plus & rows) - np.bitwise_count(minus & rows).astype(np.int64)
            inside = (row > 0) & (row <= RUN) & (abs(shift) <= odd)
            least = np.where(inside, np.minimum(least, distance), least)
            last = np.maximum(row - 1, 0)
            # off the main diagonal a found word counts behind two others; on it no more than BUDGET words may differ
            beside = (off <= BUDGET) if shift == 0 else ((before // TWICE >> np.maximum(last - 1, 0) & 1 > 0) & (last > 0))
            found = np.flatnonzero(inside & beside & (eq >> last & 1 > 0) & (distance <= BUDGET))
            np.maximum.at(best, (h[found], distance[found]), row[found])
        good = ((eq > 0) | bearable) & (least <= BUDGET) & (odd <= BUDGET)
        eq = eq + (eq & before % TWICE << 1) * TWICE
        return tuple(np.concatenate([g, c[good]]) for g, c in zip(going, (h, x, plus, minus, used, eq, odd, off), strict=True))

    def _jumps(self, pattern, length, h, x, plus, minus, used, before, odd, off):
        """The states at the starts of later cues that go on with the item's next word, after up to BUDGET unknown words.

        Next is the word behind the row of the least distance; ``x`` becomes the place of the cue's first word.
        """
        least, row = np.where(odd == 0, 0, RUN), np.where(odd == 0, used, 0)
        for shift in sorted(range(-BUDGET, BUDGET + 1), key=abs):
            k = used + shift
            rows = (1 << np.clip(k, 0, RUN)) - 1
            distance = used + np.bitwise_count(plus & rows) - np.bitwise_count(minus & rows).astype(np.int64)
            better = (k >= 0) & (k <= RUN) & (abs(shift) <= odd) & (distance < least)
            least, row = np.where(better, distance, least), np.where(better, k, row)
        out = []
        for lost in range(BUDGET + 1):
            to = row + lost
            some = np.flatnonzero((to < length[h]) & (np.maximum(least, odd) + lost <= BUDGET))
            nth, who = _spread(*self.later(x[some], pattern[h[some], to[some]], lost))
            who = some[who]
            out.append((h[who], self.starts[nth] % len(self.doc) - lost, plus[who], minus[who], used[who], before[who], odd[who], off[who]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, i) of each n in the range from low[i] to high[i]."""
    many = high - low
    return np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many), np.repeat(np.arange(len(low)), many)


def _distinct(*columns: np.ndarray) -> np.ndarray:
    """Places of the distinct rows."""
    order = np.lexsort(columns)
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    return order[new]


def leaks_of(items: Items, words: list[str], doc: np.ndarray, cue: np.ndarray, least: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(document, item) of each leak among the words of a batch of documents, in order."""
    code = {w: c for c, w in enumerate(dict.fromkeys(words))}
    codes = np.fromiter(map(code.__getitem__, words), np.int64, len(words))
    numbers = np.array([items.number.get(w, 0) for w in code], np.int64)[codes]
    near = np.sort(np.array([c * items.base + v for w, c in code.items() for v in items.near(w)], np.int64))
    ahead, back = (Texts(items, numbers, codes, near, doc, cue, b) for b in (False, True))
    out = []
    for size, at, place in _seeds(items, numbers, ahead, back):
        right = ahead.reached(at + size - 1, place + size - 1)
        left = back.reached(len(doc) - 1 - at, len(items.words) - 1 - place)
        longest = size + np.max([left[:, e] + right[:, BUDGET - e] for e in range(BUDGET + 1)], axis=0)
        leaked = longest >= least
        out.append(np.stack([doc[at][leaked], items.item[place][leaked]], axis=1))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.concatenate(out), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _seeds(items: Items, numbers: np.ndarray, ahead: Texts, back: Texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(words, places in the documents, places in the items) of the exact pieces from which runs are sought on either side."""
    at, place = items.hits(numbers)
    # of pieces side by side on one diagonal the first leads to all others; a jump may also enter where a cue starts
    order = np.lexsort((at, place - at))
    at, place = at[order], place[order]
    first = np.flatnonzero((numbers[at - 1] != items.words[place - 1]) | ahead.ends[at - 1])
    size = np.diff(np.append(first, len(at))) + PIECE - 1
    at, place = at[first], place[first]
    # within one cue they are one long piece; over a cue's end the first is walked from, as other cues may follow there
    ends = np.cumsum(ahead.ends)
    yield np.where(ends[at + size - 2] > ends[at - 1], PIECE, size), at, place
    # pieces divided by a cue end, with the rest of them at the edge of any other cue: 2|1, 1|2, 1|1|1
    ends = ahead.ends
    starts = np.concatenate(([True], ends[:-1]))
    for size, where, left, right in ((2, np.append(ends[1:], False), False, True), (2, starts, True, False), (1, starts & ends, True, True)):
        at, place = items.hits(numbers, size, where)
        if right:
            some = ahead.follows(at + size - 1, place + size - 1)
            at, place = at[some], place[some]
        if left:
            some = back.follows(len(numbers) - 1 - at, len(items.words) - 1 - place)
            at, place = at[some], place[some]
        yield np.full(len(at), size), at, place


def _put(held: tuple[list, list[str], list[int], list[int]], words: list[str], doc: int) -> None:
    """Adds the words of one cue: the list of words grows by them, the lists of cues' lengths and documents by one."""
    _, every, lengths, docs = held
    every.extend(words)
    lengths.append(len(words))
    docs.append(doc)


def _search(block: list[tuple[int, str, bool]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(block)
        held: tuple[list, list[str], list[int], list[int]] = ([], [], [], [])

        def found() -> pa.RecordBatch:
            ids, words, lengths, docs = held
            d, i = leaks_of(items, words, np.repeat(np.array(docs, np.int64), lengths), np.repeat(np.arange(len(lengths)), lengths))
            return pa.RecordBatch.from_arrays([pa.array([ids[k] for k in d], pa.int64()), pa.array([items.ids[k] for k in i], pa.int64())], names=["_doc", "_item"])

        apart = [""] * AFTER
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, words, _, _ = held
                if not words:
                    _put(held, apart, -1)
                for own in folded("\n\f".join(cue_texts(repaired(text)))).split("\f"):
                    _put(held, WORD.findall(own), len(ids))
                _put(held, apart, -1)
                ids.append(doc_id)
                if len(words) > WORDS_HELD:
                    if items.ids:
                        yield found()
                    held = ([], [], [], [])
        if held[1] and items.ids:
            yield found()

    return run


def _instructed(items: DataFrame) -> DataFrame:
    """``items`` with ``_instructed``: whether the first line of ``_text`` is one that more than two of all items open with."""
    text = F.regexp_replace(F.regexp_replace("_text", "\r\n?", "\n"), "^[\\s\ufeff]+|\\s+$", "")
    head = F.when(F.contains(text, F.lit("\n")), F.regexp_replace(F.substring_index(text, "\n", 1), "\\s+$", ""))
    shared = F.count(F.lit(1)).over(Window.partitionBy("_head")) > 2
    return items.withColumn("_head", head).withColumn("_instructed", F.col("_head").isNotNull() & shared).drop("_head")


def leaked_passages(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(``doc_id``, ``item_id``) of each document that carries at least RUN successive words of the item.

    Words are compared under the subtitle layout, in lower case, without accents and with characters that recognition
    confuses folded. Whole cues may lie between two successive words (a repetition, a sound, an advert); words of
    the item may be damaged, divided, run together or lost. A first line that more than two items share is an instruction and is no passage.

    Method: pigeonhole edit matching. Of RUN words with BUDGET edits, one of BUDGET + 1 pieces of PIECE words stands exactly:
    every piece of the items at any offset is looked up in the documents' words, pieces that cue ends divide as well. Each hit
    is verified by Myers' bit-parallel distance, words as symbols, between the item's words around the piece and those of the
    document, over any cues that lie between (``Texts.reached``): RUN words within BUDGET edits are a leak. Two words are the same symbol
    also if Myers' distance of their characters bears it (looked up among all item words behind a pigeonhole index of word parts).

    Scale: the items are the query set. Each block of BLOCK items goes with the task; documents are read once per block,
    where they lie, and nothing is shuffled. Null or empty texts and items shorter than RUN words have no leaks; a null id
    is left out. Documents that appear twice give their rows twice only if their ids differ.
    """
    rows = documents.select(F.col(f"`{doc_id}`").cast("bigint").alias("_doc"), F.col(f"`{text}`").alias("_text")).where("_doc is not null and _text is not null and _text <> ''")
    queries = items.select(F.col(f"`{item_id}`").cast("bigint").alias("_item"), F.col(f"`{item_text}`").alias("_text")).where("_item is not null and _text is not null")
    out, block = None, []

    def search(block):
        found = rows.mapInArrow(_search(block), "_doc bigint, _item bigint")
        return found if out is None else out.unionByName(found)

    for r in _instructed(queries).orderBy("_item").toLocalIterator():
        block.append((r["_item"], r["_text"], r["_instructed"]))
        if len(block) == BLOCK:
            out, block = search(block), []
    if block or out is None:
        out = search(block)
    return out.select(F.col("_doc").alias(doc_id), F.col("_item").alias(item_id)).distinct()
