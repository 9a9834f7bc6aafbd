"""Evaluation passages inside documents, by the q-gram lemma over diagonal bands.

Texts are folded to their words (runs of letters and digits; case, accents, punctuation,
layout and invisible format characters don't matter) joined by single spaces. The items are
a stated query set: their index is built once, in blocks of ``block_chars`` characters, and
shared with all tasks; the documents stream past all blocks in one pass, without a shuffle.
Items of more than ``pass_chars`` characters take further passes, so what is shared is bounded.

Diagonals (place in the document less place in the item) are cut into bands of width 2w that
overlap by w, so an alignment that drifts by at most w >= k lies wholly in one band. A band is
looked at if a seed of the item stands in it: of each passage of ``min_words`` words the rarest
q-gram, or k + 1 that don't overlap, one of which k edits leave whole. There, all shared q-grams
are counted: a passage of L characters with at most k edits keeps at least L - q + 1 - k q of
its q-grams (the q-gram lemma), and passages below that bound are dropped. The others are
verified by a banded local alignment, whose score a passage within the budget can't fail.
``near_leaks`` stops there; ``leaks`` asks last that the words stand there one by one.

Passages that many items share (an instruction in front of every question) are indexed
once, and seed hits are worked through HIT_BLOCK at a time, so neither multiplies memory.

Defined results: null and empty texts match nothing; items with fewer than ``min_words``
words can't leak; a document or item that stands twice is reported once; a document leaks
an item once, however often the passage stands in it. Very long documents are read in
overlapping pieces, as a whole. Passages too short for k + 1 seeds have as many as fit.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS, Q, EDITS = 13, 16, 1
#: Characters of item text in one index, and in all those that are shared with the tasks at once.
BLOCK_CHARS, PASS_CHARS = 1_000_000, 16_000_000
#: Seed hits that are held at once.
HIT_BLOCK = 1_000_000
#: Characters of documents looked at together; a longer document is cut with overlap.
PIECE_CHARS = 1_000_000
MATCH, PENALTY = 1, 2
_BASE = 0x9E3779B97F4A7C15
_BITS = 22


class _Fold(dict):
    """The folded form of every character, worked out when it is first met."""

    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", chr(code)).casefold()):
            category = unicodedata.category(c)
            if category[0] in "LN":
                out += c
            elif category[0] != "M" and category != "Cf":
                out += " "
        self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str | None) -> str:
    """The words of a text, in folded form, joined by single spaces."""
    return " ".join(text.translate(_FOLD).split()) if text else ""


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q-gram (q a power of two) that starts at each place."""
    h, factor, have = codes, _BASE, 1
    while have < q:
        h = h[: len(h) - have] * np.uint64(factor) + h[have:]
        factor, have = factor * factor % (1 << 64), have * 2
    return h


class Index:
    """A block of items: their distinct passages, each with all the items that hold it, and the q-grams that seed them.

    A passage (``min_words`` consecutive words) that stands in many items is looked for under the
    first of them only. Of each passage the rarest q-grams that don't overlap are seeds: one if
    it has to stand word by word in the end (``exact``), else ``edits`` + 1, as so many edits
    can't touch them all. So q-grams that very many passages share seed nothing as long as the
    passage has rarer ones.
    """

    def __init__(self, items: list[tuple[int, str]], q: int, edits: int, min_words: int, *, exact: bool = True) -> None:
        self.q, self.edits, self.width, self.wanted = q, edits, max(16, edits), 1 if exact else edits + 1
        self.ids: list[int] = []
        self.codes: list[np.ndarray] = []
        self.grams: list[np.ndarray] = []
        #: per item the start and end of its passages, and their numbers
        self.spans: list[np.ndarray] = []
        self.owners: list[list[int]] = []
        number: dict[str, int] = {}
        for item_id, text in items:
            words = text.split()
            if len(words) < min_words:
                continue
            at, here = np.cumsum([0, *(len(w) + 1 for w in words)]), []
            for i in range(len(words) - min_words + 1):
                passage = text[at[i] : at[i + min_words] - 1]
                if len(passage) < q:
                    raise ValueError(f"a passage of {min_words} words has under q={q} characters; choose a smaller q")
                if passage not in number:
                    number[passage] = len(number)
                    self.owners.append([])
                    here.append((at[i], at[i + min_words] - 1, number[passage]))
                if not self.owners[number[passage]] or self.owners[number[passage]][-1] != item_id:
                    self.owners[number[passage]].append(item_id)
            if here:
                self.ids.append(item_id)
                self.codes.append(_codes(text))
                self.grams.append(_hashes(self.codes[-1], q))
                self.spans.append(np.array(here, dtype=np.int64))
        if not self.ids:
            return
        self.exact = exact
        self.every = np.concatenate(self.grams)
        self.sizes = np.array([len(g) for g in self.grams], dtype=np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        #: q-grams of an item's shortest passage
        self.run = np.array([int((sp[:, 1] - sp[:, 0]).min()) - q + 1 for sp in self.spans], dtype=np.int64)
        _, back, count = np.unique(self.every, return_inverse=True, return_counts=True)
        places, offset = count[back], 0
        seeds, owner, place = [], [], []
        for at, (grams, spans) in enumerate(zip(self.grams, self.spans, strict=True)):
            mine = self._seeds(places[offset : offset + len(grams)], spans)
            offset += len(grams)
            seeds.append(grams[mine])
            owner.append(np.full(len(mine), at, dtype=np.int64))
            place.append(mine)
        h, owner_, place_ = map(np.concatenate, (seeds, owner, place))
        order = np.argsort(h, kind="stable")
        self.owner, self.place = owner_[order], place_[order]
        self.seeds, self.start, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << _BITS, dtype=bool)
        self.seen[(self.seeds >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def _seeds(self, places: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """Places of the seeds of all passages; a passage keeps those of the one before it that lie in it."""
        out: set[int] = set()
        held: list[int] = []
        for start, end, _ in spans.tolist():
            held = [p for p in held if p >= start]
            if len(held) < self.wanted:
                free = places[start : end - self.q + 1].copy()
                none = np.iinfo(free.dtype).max
                for p in held:
                    free[max(0, p - start - self.q + 1) : p - start + self.q] = none
                while len(held) < self.wanted and (best := int(free.argmin())) >= 0 and free[best] != none:
                    held.append(start + best)
                    free[max(0, best - self.q + 1) : best + self.q] = none
                held.sort()
                out.update(held)
        return np.array(sorted(out), dtype=np.int64)

    def seeded(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in the text, item, place in the item) of every seed hit, at most HIT_BLOCK or one place's hits at a time."""
        at = np.flatnonzero(self.seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        g = np.searchsorted(self.seeds, h[at])
        g[g == len(self.seeds)] = 0
        hit = self.seeds[g] == h[at]
        at, g = at[hit], g[hit]
        upto = np.cumsum(self.count[g])
        begun = 0
        while begun < len(at):
            end = max(begun + 1, int(np.searchsorted(upto, (upto[begun - 1] if begun else 0) + HIT_BLOCK, side="right")))
            a, b = at[begun:end], g[begun:end]
            n = self.count[b]
            ref = np.repeat(self.start[b], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(a, n), self.owner[ref], self.place[ref]
            begun = end

    def regions(self, text: str, starts: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, int, int]]:
        """(document, item, lowest diagonal, passages that meet the bound, first, last place) for newline-joined documents that begin at ``starts``.

        Bands of diagonals are those that hold a seed hit; in them every shared q-gram is counted.
        """
        if not self.ids or len(text) < self.q:
            return
        h, ends = _hashes(_codes(text), self.q), np.append(starts[1:], len(text) + 1) - 1
        seen: set[tuple[int, int, int]] = set()
        for doc_at, item, item_at in self.seeded(h):
            if self.exact:
                # a passage that stands word by word is a run of shared q-grams: with the seed at 0, its
                # half on one side at least is shared too, which hardly any chance hit has
                half = self.run[item] - 1
                on = self._same(h, doc_at, item, item_at, half - half // 2) | self._same(h, doc_at, item, item_at, -(half // 2))
                doc_at, item, item_at = doc_at[on], item[on], item_at[on]
            if not len(doc_at):
                continue
            doc = np.searchsorted(starts, doc_at, side="right") - 1
            band = (doc_at - item_at) // self.width
            lowest_band = int(band.min()) - 1
            span = int(band.max()) - lowest_band + 1
            key = (doc * len(self.ids) + item) * span + band - lowest_band
            # bands overlap by half: a diagonal is in the band that starts at it and in the one before
            for k in np.unique(np.concatenate([key, key - 1])).tolist():
                pair, b = divmod(k, span)
                d, i = divmod(pair, len(self.ids))
                b += lowest_band
                if (d, i, b) in seen:
                    continue
                seen.add((d, i, b))
                lowest = b * self.width
                shared = self._shared(h, i, lowest, int(starts[d]), int(ends[d]))
                upto = np.append(0, np.cumsum(shared))
                spans = self.spans[i]
                grams = spans[:, 1] - self.q + 1
                # the q-gram lemma: so many of a passage's q-grams are left after ``edits`` edits
                need = np.maximum(1, grams - spans[:, 0] - self.edits * self.q)
                met = spans[upto[grams] - upto[spans[:, 0]] >= need]
                if len(met):
                    yield d, i, lowest, met, max(int(starts[d]), lowest + int(met[:, 0].min())), min(int(ends[d]), lowest + 2 * self.width + int(met[:, 1].max()))

    def _same(self, h: np.ndarray, doc_at: np.ndarray, item: np.ndarray, item_at: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Whether the q-grams ``step`` places on are the same as well."""
        a, b = doc_at + step, item_at + step
        on = (a >= 0) & (a < len(h)) & (b >= 0) & (b < self.sizes[item])
        return on & (h[np.where(on, a, 0)] == self.every[self.begins[item] + np.where(on, b, 0)])

    def _shared(self, h: np.ndarray, item: int, lowest: int, start: int, end: int) -> np.ndarray:
        """Per place of the item, whether its q-gram stands in the document within the band."""
        g = self.grams[item]
        at = np.arange(len(g)) + np.arange(lowest, lowest + 2 * self.width)[:, None]
        on = (at >= start) & (at <= end - self.q)
        return ((h[np.where(on, at, 0)] == g) & on).any(axis=0)

    def verified(self, item: int, text: str, lowest: int, met: np.ndarray, first: int, last: int, start: int, end: int, *, exact: bool, known: Callable[[int], bool] = lambda _: False) -> Iterator[tuple[int, int]]:
        """(passage, edits at most) of the passages that the banded alignment of a region accepts and, if ``exact``, that stand there word by word.

        A passage that is ``known`` when its turn comes would tell nothing new and is passed over.
        """
        slack = self.q + 2 * self.width
        lo, hi = max(start, first - slack), min(end, last + slack)
        region = text[lo:hi]
        codes = _codes(region)
        padded = f" {'' if lo == start or text[lo - 1] == ' ' else chr(0)}{region}{'' if hi == end or text[hi : hi + 1] == ' ' else chr(0)} "
        for begin, stop, number in met.tolist():
            if known(number):
                continue
            size = stop - begin
            lost = size * MATCH - self.score(self.codes[item][begin:stop], codes, lo - begin, lowest)
            # an edit costs a match and a penalty at most, so no passage within the budget fails
            if lost > self.edits * (MATCH + PENALTY):
                continue
            if not exact or f" {self._text(item, begin, stop)} " in padded:
                yield number, -(-lost // (MATCH + PENALTY))

    def _text(self, item: int, begin: int, stop: int) -> str:
        return self.codes[item][begin:stop].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")

    def score(self, a: np.ndarray, b: np.ndarray, offset: int, lowest: int) -> int:
        """The best local alignment of a passage with a region, within the band of diagonals [lowest, lowest + 2w)."""
        wide = 2 * self.width
        # cell (i, j): passage place i, region place j = i + lowest - offset + column
        shift = lowest - offset
        i0, i1 = max(0, -shift - wide), min(len(a), len(b) - shift)
        if i1 <= i0:
            return 0
        # region places that the band's cells of passage places i0..i1 look at; outside the region nothing is equal
        left, right = max(0, -(i0 + shift)), max(0, i1 + shift + wide - len(b))
        filled = np.concatenate([np.zeros(left, dtype=np.uint64), b[max(0, i0 + shift) : i1 + shift + wide], np.zeros(right, dtype=np.uint64)])
        equal = np.lib.stride_tricks.sliding_window_view(filled, wide)[: i1 - i0] == a[i0:i1, None]
        gain = np.where(equal, MATCH, -PENALTY).astype(np.int32)
        ramp = np.arange(wide, dtype=np.int32) * PENALTY
        rows = np.zeros((i1 - i0 + 1, wide), dtype=np.int32)
        for i, step in enumerate(gain):
            row, new = rows[i], rows[i + 1]
            step += row
            # down: same region place, next passage place, one column to the left
            np.maximum(step[:-1], row[1:] - PENALTY, out=step[:-1])
            np.maximum(step, 0, out=step)
            # along the row: skipped region places
            step += ramp
            np.maximum.accumulate(step, out=new)
            new -= ramp
        return int(rows.max())


def _pieces(ids: list[int], texts: list[str], overlap: int) -> Iterator[tuple[list[int], list[str]]]:
    """Documents gathered up to PIECE_CHARS; longer ones cut at spaces, with the overlap a passage needs."""
    out_ids, out, size = [], [], 0
    for doc_id, text in zip(ids, texts, strict=True):
        at = 0
        while True:
            end = len(text) if len(text) - at <= PIECE_CHARS + overlap else text.find(" ", at + PIECE_CHARS + overlap)
            end = len(text) if end < 0 else end
            out_ids.append(doc_id)
            out.append(text[at:end])
            size += end - at
            if size >= PIECE_CHARS:
                yield out_ids, out
                out_ids, out, size = [], [], 0
            if end >= len(text):
                break
            at = text.rfind(" ", at, end - overlap) + 1
    if out:
        yield out_ids, out


def _search(shared, exact: bool):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks: list[Index] = shared.value
        overlap = 2 * max([0, *(len(c) for index in blocks for c in index.codes)]) + 2 * max([0, *(index.q for index in blocks)])
        for batch in batches:
            found: dict[tuple[int, int], int] = {}
            for ids, texts in _pieces(batch.iloc[:, 0].tolist(), [fold(t) for t in batch.iloc[:, 1]], overlap):
                lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
                starts = np.cumsum(lengths) - lengths
                text = "\n".join(texts)
                for index in blocks:
                    for doc, item, lowest, met, first, last in index.regions(text, starts):
                        start, doc_id = int(starts[doc]), ids[doc]
                        # all items of the passage are told of this document already, as near as can be
                        known = lambda n: all(found.get((doc_id, o)) == 0 for o in index.owners[n])  # noqa: B023, E731
                        for number, edits in index.verified(item, text, lowest, met, first, last, start, start + len(texts[doc]), exact=exact, known=known):
                            for owner in index.owners[number]:
                                pair = doc_id, owner
                                found[pair] = min(0 if exact else edits, found.get(pair, edits))
            yield pd.DataFrame([(d, i, e) for (d, i), e in found.items()], columns=["doc_id", "item_id", "edits"]).astype("int64")

    return search


def _found(documents: DataFrame, items: DataFrame, q: int, edits: int, min_words: int, block_chars: int, pass_chars: int, exact: bool, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    if q < 2 or q & (q - 1):
        raise ValueError("q has to be a power of two")
    context = documents.sparkSession.sparkContext
    docs = documents.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("__gw_text")).where("doc_id is not null and __gw_text is not null")
    narrow = items.select(F.col(f"`{item_col}`").cast("bigint").alias("i"), F.col(f"`{item_text_col}`").alias("t")).where("i is not null and t is not null")
    parts: list[DataFrame] = []

    def search(blocks: list[Index]) -> None:
        # at most ``pass_chars`` characters of items are shared with the tasks at once
        parts.append(docs.mapInPandas(_search(context.broadcast(blocks), exact), "doc_id bigint, item_id bigint, edits bigint"))

    blocks, block, size, whole = [], {}, 0, 0
    for row in narrow.toLocalIterator():
        item = row["i"], fold(row["t"])
        if item in block or len(item[1]) < q:
            continue
        block[item] = None
        size += len(item[1])
        if size >= block_chars:
            blocks.append(Index(list(block), q, edits, min_words, exact=exact))
            block, whole, size = {}, whole + size, 0
            if whole >= pass_chars:
                search(blocks)
                blocks, whole = [], 0
    if block or blocks or not parts:
        search([*blocks, Index(list(block), q, edits, min_words, exact=exact)])
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def leaks(
    documents: DataFrame, items: DataFrame, *, q: int = Q, edits: int = EDITS, min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS, pass_chars: int = PASS_CHARS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(doc_id, item_id), distinct: the documents that hold ``min_words`` consecutive words of an item, word by word."""
    return _found(documents, items, q, edits, min_words, block_chars, pass_chars, True, id_col, text_col, item_col, item_text_col).select("doc_id", "item_id").distinct()


def near_leaks(
    documents: DataFrame, items: DataFrame, *, q: int = Q, edits: int = EDITS, min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS, pass_chars: int = PASS_CHARS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(doc_id, item_id, edits): as ``leaks``, but the alignment decides: passages with at most ``edits`` edits of letters count too.

    ``edits`` of the result is that of the closest passage, as the alignment tells it (0: word by word but for the passage's ends).
    """
    return _found(documents, items, q, edits, min_words, block_chars, pass_chars, False, id_col, text_col, item_col, item_text_col).groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))
