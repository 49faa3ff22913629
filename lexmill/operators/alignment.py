"""Where the annotated regions of a source are found in an extracted text: q-grams vote for places, edit distance decides.

Every q-gram that a region shares with the text votes for the place where the region would begin. Only around the places
with the most votes is the nearest stretch searched, by edit distance with the rows of its table in the bits of an
integer; so the work follows the regions' lengths, not the text's times theirs. Regions are placed in order, as text that
one has taken is no other's: headings first, by the headings of the extracted text, then every other region between the
headings around it, behind the region before it. Documents are independent of each other, so Spark deals them out, each
with its regions in a row.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Generator, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.edits import common, commons, nearest_end, nearest_ends

# The least similarity of a match and of a heading, and the least share of a region that needs no edit.
LEAST, LEAST_HEADING, LEAST_UNEDITED = 0.3, 0.5, 0.5
#: Characters of a q-gram, and of the one that is tried where none of the longer is shared.
GRAMS = (6, 3)
#: Places of q-grams that vote for a region, the rarest q-grams first. All of one vote, however many it has.
MOST_VOTES = 1_000_000
#: Votes that are counted at once, about.
COUNTED = 50_000
#: Places around which a region is searched in each stretch of the text, and the similarity that needs no look at further ones.
TRIED, SURE = 4, 0.8
#: Characters of texts and regions that are aligned side by side, about, and the least number of windows that are searched together.
TOGETHER, FEW = 8_000_000, 12
#: Pairs of titles of a document that are compared together, about.
MOST_TITLES = 10_000

_HEADING = re.compile(r"(#{1,6})\s+(.+)$")
_WORD = re.compile(r"\S+")
#: Without one of these there is no mark.
_MARKED = re.compile(r"[*_`~#]")
_MARKS = re.compile(r"\*{1,3}|_{1,3}|`{1,3}|~~|^#{1,6}$")
_OPENING = ("#", "`", "~")
#: By code point, the last for all that follow: white space, and signs that marks are made of.
_BLANK, _MARK = np.array([chr(c).isspace() for c in range(0x3002)]), np.array([chr(c) in "*_`~#" for c in range(0x80)])
RESULT = "array<struct<region_id:string,matched:string,start:int,similarity:double,coverage:double,failure:string>>"
_ARROW = pa.list_(pa.struct([("region_id", pa.string()), ("matched", pa.string()), ("start", pa.int32()), ("similarity", pa.float64()), ("coverage", pa.float64()), ("failure", pa.string())]))


def plain(text: str) -> str:
    """Without marks of markdown, with single spaces, in lower case."""
    words = text.split()
    if _MARKED.search(text):
        words = filter(None, (_MARKS.sub("", w) if _MARKED.search(w) else w for w in words))
    return " ".join(words).lower()


def similarity(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths; 1 for equal texts."""
    return 1.0 if a == b else 2 * common(a, b) / (len(a) + len(b))


def _grams(text: str, q: int) -> np.ndarray:
    """A number for each run of q characters. Runs that share one by chance only add votes."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    found = np.zeros(max(0, len(codes) - q + 1), np.uint64)
    for i in range(q):
        found = found * np.uint64(1_000_003) + codes[i : i + len(found)]
    return found


class _Taken:
    """Stretches of a text that are taken. They don't overlap, but for equal ones."""

    def __init__(self):
        self.starts, self.ends = [], []

    def free(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return not before or self.ends[before - 1] <= start

    def add(self, start: int, end: int) -> None:
        at = bisect_left(self.starts, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)


class _Text:
    """An extracted text as plain words, with the places of its q-grams and headings."""

    def __init__(self, text: str):
        self.text = text
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        blank = np.ones(len(codes) + 2, bool)
        blank[1:-1] = _BLANK.take(codes, mode="clip")
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        starts, ends = edges[::2], edges[1::2]
        parts = text.lower().split()
        marked = np.flatnonzero(_MARK.take(codes, mode="clip"))
        for i in np.unique(np.searchsorted(starts, marked, "right") - 1).tolist():
            parts[i] = plain(text[starts[i] : ends[i]])
        if not all(parts):
            full = [i for i, word in enumerate(parts) if word]
            parts, starts, ends = [parts[i] for i in full], starts[full], ends[full]
        begins = np.zeros(len(parts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1, out=begins[1:])
        self.plain, self.starts, self.ends, self.begins = " ".join(parts), starts.tolist(), ends.tolist(), begins[:-1].tolist()
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.windows: dict[str, dict[int, tuple[float, int, int]]] = {}  # by region, then place; they hold whatever is taken
        self.likely: dict[str, dict[tuple[int, int, int], list[int]]] = {}  # by region, then length of q-grams, first word and word behind the last
        self.headings, self.taken = [], _Taken()  # (start, end, plain title)
        at, fenced = 0, False
        for line in text.split("\n"):
            if (first := line.lstrip()[:3])[:1] in _OPENING:
                if first in ("```", "~~~"):
                    fenced = not fenced
                elif not fenced and (found := _HEADING.match(line.strip())):
                    self.headings.append((at, at + len(line), plain(found[2])))
            at += len(line) + 1
        self.titles: dict[str, int] = {}
        for i, (_, _, title) in enumerate(self.headings):
            self.titles.setdefault(title, i)

    def like(self, title: str) -> list[str]:
        """The titles that may be like another."""
        n = len(title)
        return [t for t in self.titles if 2 * min(n, len(t)) > LEAST_HEADING * (n + len(t))] if title not in self.titles else []

    def heading(self, title: str, alike: dict[tuple[str, str], float]) -> dict | None:
        """The heading most like a title, the first of equals."""
        value, i = 1.0, self.titles.get(title)
        if i is None:
            value, i = max(((alike[title, t], -self.titles[t]) for t in self.like(title)), default=(0.0, 0))
            i = -i
        if value <= LEAST_HEADING:
            return None
        start, end, _ = self.headings[i]
        self.taken.add(start, end)
        return {"matched": self.text[start:end].strip(), "start": start, "similarity": value, "coverage": 1.0}

    def grams(self, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The text's different q-grams in order, where the places of each begin, how many they are, and these places."""
        if q not in self.sorted:
            grams = _grams(self.plain, q)
            order = np.argsort(grams)
            held = grams[order]
            first = np.flatnonzero(np.append(True, held[1:] != held[:-1])[: len(held)])
            self.sorted[q] = held[first], first.astype(np.int32), np.diff(np.append(first, len(held))).astype(np.int32), order.astype(np.int32)
        return self.sorted[q]

    def window(self, asked: str, about: int, slack: int) -> tuple[float, int, int]:
        """(similarity, first word, word behind the last) of the whole words most like a region around a place."""
        low, near = self._around(asked, about, slack)
        end, edits = nearest_end(asked, near)
        if edits > (1 - LEAST_UNEDITED) * len(asked):
            return 0.0, 0, 0
        back, _ = nearest_end(asked[::-1], near[:end][::-1], anchored=True)
        return max((similarity(asked, self.plain[self.begins[i] : self._end(j)]), -i, j) for i, j in self._words(low + end - back, low + end))

    def _around(self, asked: str, about: int, slack: int) -> tuple[int, str]:
        low = max(0, about - slack)
        return low, self.plain[low : about + len(asked) + 2 * slack]

    def _words(self, start: int, end: int) -> list[tuple[int, int]]:
        """The stretches of whole words that may be those of a place in the plain text."""
        a = max(0, bisect_right(self.begins, start) - 1)
        b = max(a + 1, bisect_left(self.begins, end))
        return [(i, j) for i in (a, a + 1) for j in (b, b - 1) if i < j <= len(self.begins)]

    def _end(self, word: int) -> int:
        """Where the word before a word ends in the plain text."""
        return self.begins[word] - 1 if word < len(self.begins) else len(self.plain)

    def region(self, asked: str, spans: list[tuple[int, int]], least: float, taken: _Taken) -> Generator[list, None, dict | None]:
        """The place of a plain region in the first of the spans of text that has one of at least a similarity. It yields the places and windows that it lacks."""
        n = asked.count(" ") + 1
        if not asked or not self.starts:
            return None
        if same := self._verbatim(asked, n, *spans[0], taken):
            return self._take(*same, 1.0, n, taken)
        windows = self.windows.setdefault(asked, {})
        likely = self.likely.setdefault(asked, {})
        edges = [(bisect_left(self.starts, low), bisect_left(self.starts, high)) for low, high in spans]
        for q in dict.fromkeys(min(q, len(asked)) for q in GRAMS):
            known: dict[int, tuple[float, int, int]] = {}
            keys = [(q, first, last) for first, last in edges]
            for (low, high), key in zip(spans, keys, strict=True):
                if key not in likely:
                    yield [(self, asked, *k) for k in (keys if known or q != GRAMS[0] else [key]) if k not in likely]
                for place in likely[key]:
                    if place not in known:
                        if place not in windows:
                            # where the first place isn't sure, the others will most likely be asked for
                            if known and (lacking := [(self, asked, *k) for k in keys if k not in likely]):
                                yield lacking
                            places = dict.fromkeys(p for k in keys for p in likely[k]) if known else [place]
                            yield [(self, asked, p) for p in places if p not in windows]
                        known[place] = windows[place]
                    if known[place][0] >= SURE:
                        break
                for value, a, b in sorted(known.values(), key=lambda f: (-f[0], -f[1])):
                    if value < least:
                        break
                    if self._free(-a, b, low, high, taken):
                        return self._take(-a, b, value, n, taken)
        return None

    def _free(self, a: int, b: int, low: int, high: int, taken: _Taken) -> bool:
        start, end = self.starts[a], self.ends[b - 1]
        return start >= low and end <= high and taken.free(start, end)

    def _take(self, a: int, b: int, value: float, n: int, taken: _Taken) -> dict:
        start, end = self.starts[a], self.ends[b - 1]
        taken.add(start, end)
        return {"matched": " ".join(self.text[start:end].split()), "start": start, "similarity": value, "coverage": min(1.0, (b - a) / n), "end": end}

    def _verbatim(self, asked: str, n: int, low: int, high: int, taken: _Taken) -> tuple[int, int] | None:
        """The first words of a stretch that are those of a region, one for one, and no other's."""
        first, last = bisect_left(self.starts, low), bisect_left(self.starts, high)
        at = self.plain.find(asked, self.begins[first], self._end(last)) if first < last else -1
        while at >= 0:
            a = bisect_left(self.begins, at)
            if a + n <= last and self.begins[a] == at and self._end(a + n) == at + len(asked) and self._free(a, a + n, low, high, taken):
                return a, a + n
            at = self.plain.find(asked, at + 1, self._end(last))
        return None


def _slack(asked: str) -> int:
    return 8 + len(asked) // 8


def _located(wanted: Iterable[tuple[_Text, str, int, int, int]]) -> None:
    """For each (text, region, q, first word, word behind the last) the places with the most votes, at most TRIED, the first of equals before the others."""
    asked: dict[tuple[int, int], tuple[_Text, int, dict[str, dict[tuple[int, int], None]]]] = {}
    for page, region, q, first, last in wanted:
        if first >= last:
            page.likely[region][q, first, last] = []
        else:
            asked.setdefault((id(page), q), (page, q, {}))[2].setdefault(region, {})[first, last] = None
    held: list[tuple] = []
    votes = 0
    for page, q, regions in asked.values():
        values, begins, counts, order = page.grams(q)
        if not len(values):
            for region, spans in regions.items():
                page.likely[region].update({(q, *span): [] for span in spans})
            continue
        # a q-gram that holds a line break is of no region
        names = list(regions)
        own = _grams("\n".join(names), q)
        at = np.minimum(np.searchsorted(values, own), len(values) - 1)
        lengths = np.array([len(name) + 1 for name in names])
        ends = np.cumsum(lengths)
        begin = ends - lengths
        number = np.repeat(np.arange(len(names)), lengths)[: len(own)]
        place = np.arange(len(own)) - begin[number]
        shared = np.flatnonzero((values[at] == own) & (place <= lengths[number] - 1 - q))
        number, place, at = number[shared], place[shared], at[shared]
        count = counts[at]
        totals = np.bincount(number, count, len(names))
        for k in np.flatnonzero(totals > MOST_VOTES).tolist():
            # the rarest as far as votes go
            rare = np.flatnonzero(number == k)
            rare = rare[np.argsort(count[rare], kind="stable")]
            dropped = rare[max(1, int(np.searchsorted(np.cumsum(count[rare]), MOST_VOTES, "right"))) :]
            number, place, at, count = (np.delete(x, dropped) for x in (number, place, at, count))
        # as many regions at once as have some votes
        low = 0
        for k in [*(np.flatnonzero(np.diff((np.cumsum(totals) + votes) // COUNTED)) + 1).tolist(), len(names)]:
            first, last = np.searchsorted(number, (low, k)).tolist()
            held.append((page, q, [(name, list(regions[name])) for name in names[low:k]], order, number[first:last] - low, begins[at[first:last]], count[first:last], place[first:last]))
            votes += totals[low:k].sum()
            low = k
            if votes > COUNTED:
                _count(held)
                held, votes = [], 0
    _count(held)


def _count(parts: list[tuple]) -> None:
    """Counts the votes of regions, given by text with their spans and the shared q-grams: whose they are, where their places begin in an order, how many they are, where they are in the region."""
    if not parts:
        return
    held = [(page, name, q, spans) for page, q, regions, *_ in parts for name, spans in regions]
    sizes = [len(p[4]) for p in parts]
    region, begin, count, place = (np.concatenate([p[i] for p in parts]) for i in (4, 5, 6, 7))
    region += np.repeat(np.cumsum([0] + [len(p[2]) for p in parts[:-1]]), sizes)
    bases: dict[int, int] = {}
    orders, size = [], 0
    for _, _, _, order, *_ in parts:
        if id(order) not in bases:
            bases[id(order)] = size
            orders.append(order)
            size += len(order)
    begin = begin + np.repeat([bases[id(p[3])] for p in parts], sizes)
    # the rarest q-grams first, and each with one vote in all; of equally rare ones any order gives the same sums
    rare = np.argsort(region << 32 | count)
    begin, count, place, region = begin[rare], count[rare], place[rare], region[rare]
    weight, own = 1.0 / count, np.repeat(np.arange(len(count), dtype=np.int32), count)
    nth = np.arange(len(own))
    nth += (begin - (np.cumsum(count) - count)).take(own)
    at_text = np.concatenate(orders).take(nth)
    for k in range(max(len(h[3]) for h in held)):
        chosen = [h for h in held if len(h[3]) > k]
        slack = np.array([_slack(h[1]) for h in chosen])
        lows = np.array([h[0].begins[h[3][k][0]] for h in chosen]) - 2 * slack
        sizes = np.array([h[0]._end(h[3][k][1]) for h in chosen]) + slack - lows
        # bins as wide as a place may be off; neighbours count together, as votes for one place may stand on both sides of an edge. Behind a region's bins is an empty one
        bins = (sizes - 1) // slack + 2
        first = np.cumsum(bins) - bins
        # what holds for a region by its q-grams; those without such a span have none inside
        number = np.full(len(held), len(chosen))
        number[[i for i, h in enumerate(held) if len(h[3]) > k]] = np.arange(len(chosen))
        of = number[region]
        begins, limit, width, bin_at = (np.append(x, last).astype(np.int32)[of] for x, last in ((lows, 0), (sizes, 0), (slack, 1), (first, 0)))
        nth = (at_text - (place + begins).astype(np.int32).take(own)).view(np.uint32)
        inside = np.flatnonzero(nth < limit.view(np.uint32).take(own))
        gram = own.take(inside)
        nth = nth.take(inside)
        nth //= width.view(np.uint32).take(gram)
        nth += bin_at.view(np.uint32).take(gram)
        votes = np.bincount(nth, weight.take(gram), int(bins.sum()))
        votes[:-1] += votes[1:]
        votes[first + bins - 1] = 0.0
        at: list[list[int]] = [[] for _ in chosen]
        for _ in range(TRIED):
            most = np.maximum.reduceat(votes, first)
            hits = np.flatnonzero(votes == np.repeat(most, bins))
            hits = hits[np.searchsorted(hits, first)]
            voted = np.flatnonzero(most > 0)
            if not len(voted):
                break
            hits = hits[voted]
            for i, about_there in zip(voted.tolist(), (lows[voted] + (hits - first[voted] + 1) * slack[voted]).tolist(), strict=True):
                at[i].append(about_there)
            votes[hits - 1] = votes[hits] = votes[hits + 1] = 0.0
        for (page, asked, q, spans), found in zip(chosen, at, strict=True):
            page.likely[asked][(q, *spans[k])] = found


def _searched(wanted: Iterable[tuple[_Text, str, int]]) -> None:
    """`_Text.window` of each (text, region, place), all together."""
    wanted = list({(id(page), asked, place): (page, asked, place) for page, asked, place in wanted}.values())
    if len(wanted) < FEW:
        for page, asked, place in wanted:
            page.windows[asked][place] = page.window(asked, place, _slack(asked) * 3 // 2)
        return
    nears = [page._around(asked, place, _slack(asked) * 3 // 2) for page, asked, place in wanted]
    ends = nearest_ends([(asked, near) for (_, asked, _), (_, near) in zip(wanted, nears, strict=True)])
    held = []
    for (page, asked, place), (low, near), (end, edits) in zip(wanted, nears, ends, strict=True):
        if edits > (1 - LEAST_UNEDITED) * len(asked):
            page.windows[asked][place] = 0.0, 0, 0
        else:
            held.append((page, asked, place, low + end, near[max(0, end - len(asked) - edits) : end]))
    backs = nearest_ends([(asked[::-1], near[::-1]) for _, asked, _, _, near in held], anchored=True)
    tries: list[tuple[str, str, tuple[int, ...]]] = []
    words = []
    for (page, asked, place, end, _), (back, _) in zip(held, backs, strict=True):
        stretches: dict[int, list[int]] = {}
        for i, j in page._words(end - back, end):
            stretches.setdefault(i, []).append(j)
        for i, js in stretches.items():
            begin = page.begins[i]
            lengths = tuple(page._end(j) - begin for j in js)
            tries.append((asked, page.plain[begin : begin + max(lengths)], lengths))
        words.append(stretches)
    shared = iter(zip(tries, commons(tries), strict=True))
    for (page, asked, place, _, _), stretches in zip(held, words, strict=True):
        found = []
        for i, js in stretches.items():
            (_, _, lengths), counts = next(shared)
            found += [(2 * count / (len(asked) + length), -i, j) for j, length, count in zip(js, lengths, counts, strict=True)]
        page.windows[asked][place] = max(found)


def _together(runs: Iterable[Generator[list, None, None]]) -> Generator[list, None, None]:
    """Runs side by side: what they lack is yielded at once, windows when no run lacks anything else, so that they are many."""
    ready, waiting, windows = list(runs), [], []
    while ready:
        lacking, still = [], []
        for run in ready:
            if (more := next(run, None)) is None:
                continue
            if len(more[0]) == 3:
                windows += more
                waiting.append(run)
            else:
                lacking += more
                still.append(run)
        if lacking:
            yield lacking
        elif windows:
            yield windows
            still, waiting, windows = waiting, [], []
        ready = still


def _aligned(regions: list[dict], text: str | None, alike: dict[tuple[str, str], float], found: list[dict]) -> Generator[list, None, None]:
    """Adds a result for every region (region_id, content) of a document, in their order. It yields places, windows and pairs of titles that it lacks."""
    if not (text or "").strip():
        found += [{"region_id": r["region_id"], "failure": "extracted text is empty"} for r in regions]
        return
    page, hits = _Text(text), []
    titles = [_HEADING.match((r["content"] or "").strip().split("\n")[0].strip()) for r in regions]
    titles = [title and plain(title[2]) for title in titles]
    lacking: dict[tuple[str, str], None] = {}
    for title in dict.fromkeys(t for t in titles if t is not None):
        lacking |= dict.fromkeys((title, t) for t in page.like(title) if (title, t) not in alike)
        if len(lacking) > MOST_TITLES:
            yield list(lacking)
            lacking = {}
    if lacking:
        yield list(lacking)
    for title in titles:
        hits.append((page.heading(title, alike) or {"failure": "no matching heading"}) if title is not None else None)
    # the nearest headings before and behind each region; headings that the text has in another order bound by the widest stretch
    lows, highs, low, high = [], [], 0, len(text)
    for title, hit in zip(titles, hits, strict=True):
        low = max(low, hit["start"]) if title is not None and "start" in hit else low
        lows.append(low)
    for title, hit in zip(reversed(titles), reversed(hits), strict=True):
        high = min(high, hit["start"]) if title is not None and "start" in hit else high
        highs.append(high)
    highs.reverse()
    asked = [plain(r["content"] or "") if title is None else "" for r, title in zip(regions, titles, strict=True)]

    def spans(i: int, behind: int) -> list[tuple[int, int]]:
        return list(dict.fromkeys([(max(behind, lows[i]), highs[i]), (lows[i], highs[i]), (0, len(text))]))

    guessed: dict[int, tuple[list[tuple[int, int]], dict | None, bool]] = {}

    def ahead(chosen: range) -> Generator[list, None, None]:
        """Places regions in a row as if those before them stood before their heading and took nothing of theirs."""
        behind, taken = 0, _Taken()
        for i in chosen:
            if titles[i] is None:
                hit = yield from page.region(asked[i], about := spans(i, behind), SURE, taken)
                guessed[i] = about, hit, i == chosen[0]
                behind = hit["end"] if hit else behind
            elif i == chosen[0]:
                guessed[i] = [], None, True

    # where there is no text between the headings around a region, it doesn't matter where those before it stand
    edges = [0, *(i for i in range(1, len(lows)) if lows[i] > lows[i - 1] or lows[i] >= highs[i]), len(lows)]
    yield from _together(ahead(range(*edge)) for edge in pairwise(edges))
    # what is sure goes first, so that a region that the text lacks doesn't take another's place
    for least in (SURE, LEAST):
        behind, same = 0, False
        for i, title in enumerate(titles):
            about, hit, first = guessed.pop(i, (None, None, False))
            # a guess holds where all of its row before it did, and what it takes is free: what else is taken now could only take places from it
            same |= first
            if title is None and not hits[i]:
                now = spans(i, behind)
                if same := same and about == now and not (hit and not page.taken.free(hit["start"], hit["end"])):
                    hits[i] = hit
                    if hit:
                        page.taken.add(hit["start"], hit["end"])
                else:
                    hits[i] = yield from page.region(asked[i], now, least, page.taken)
            behind = hits[i]["end"] if hits[i] and "end" in hits[i] else behind
    for r, hit in zip(regions, hits, strict=True):
        hit = hit or {"failure": "no sufficiently similar region"}
        hit.pop("end", None)
        found.append({"region_id": r["region_id"]} | hit)


def align_documents(documents: Iterable[tuple[list[dict], str | None]]) -> list[list[dict]]:
    """The results of `align_document` for each (regions, text).

    Documents are aligned side by side: each goes on until it lacks windows of its text, and those that all of them lack are searched together.
    """
    alike: dict[tuple[str, str], float] = {}
    found: list[list[dict]] = []

    def run(regions: list[dict], text: str | None) -> Generator[list, None, None]:
        found.append(own := [])
        return _aligned(regions, text, alike, own)

    for lacking in _together([run(*d) for d in documents]):
        pairs = list(dict.fromkeys(x for x in lacking if len(x) == 2))
        for (a, b), (count,) in zip(pairs, commons([(a, b, (len(b),)) for a, b in pairs]), strict=True):
            alike[a, b] = 2 * count / (len(a) + len(b))
        _located(x for x in lacking if len(x) == 5)
        _searched(x for x in lacking if len(x) == 3)
    return found


def align_document(regions: list[dict], text: str | None) -> list[dict]:
    """A result for every region (region_id, content) of a document, in their order."""
    return align_documents([(regions, text)])[0]


def align(documents: DataFrame, regions: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, region_id, feature, matched, start, similarity, coverage and failure of every region of (key, place, feature, region_id, content).

    Regions of documents that are not there fail. A document and its regions meet in one row.
    """
    held = regions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "region_id", "feature", "content"))).alias("regions"))
    rows = held.join(documents.select(key, F.col(text).alias("text")), key, "left")

    def task(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        # some batches are read ahead, as more documents side by side take less time each
        documents, sizes, length = [], [], 0

        def ready() -> Iterator[pa.Array]:
            at = np.cumsum([len(t or "") + sum(len(r["content"] or "") for r in rs) for rs, t in documents]) // TOGETHER
            found: list[list[dict]] = []
            for low, high in pairwise([0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(documents)]):
                found += align_documents(documents[low:high])
            for low, high in pairwise(np.cumsum([0, *sizes]).tolist()):
                yield pa.array(found[low:high], _ARROW)

        for asked, texts in batches:
            documents += zip(asked.to_pylist(), texts.to_pylist(), strict=True)
            sizes.append(len(texts))
            length += asked.nbytes + texts.nbytes
            if length >= TOGETHER:
                yield from ready()
                documents, sizes, length = [], [], 0
        if sizes:
            yield from ready()

    task.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    matched = rows.select(key, "regions", F.arrow_udf(task, RESULT)("regions", "text").alias("found"))
    both = matched.select(key, F.explode(F.arrays_zip("regions", "found")).alias("m"))
    return both.select(key, F.col("m.regions.region_id").alias("region_id"), F.col("m.regions.feature").alias("feature"), *[F.col(f"m.found.{c}").alias(c) for c in ("matched", "start", "similarity", "coverage", "failure")])
