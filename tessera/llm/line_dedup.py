"""Line deduplication with a segment-partition edit join.

A line goes if an equal line, or one within a bound of edits that grows with
the length of the shorter line, stands earlier in the corpus, by doc_id and
line number of its first occurrence. Near lines are found by the pigeonhole
principle: lines are dealt into classes by length, with one bound each; the
characters that all lines of a class have are cut into bound + 1 segments, the
first half counted from the start of a line and the other from its end, and a
line within that many edits, of the same length or longer, contains one of
them whole, near its place. Every line is indexed under its segments and probes
the segments of its class and of those just below, with the substrings that can
align with them. Candidates are verified with a banded bit-parallel edit
distance: one word holds the band of a column, and a batch of pairs goes
through its columns together.

A line is known by a 64-bit BLAKE2b hash and its CRC-32. Segments and
substrings are hashed from prefix sums over a batch of texts, which can only
add candidates, and (key, line) pairs move as packed columns. With each goes a 32-bit histogram of
the line's characters; edits move it little, so that most false candidates end
where they are found, before any text is fetched. Equal lines are one line
throughout; a batch sends one entry for each of its distinct lines.

Hot keys. One earlier line is proof enough, so a key that many lines share
yields no pairs but those with its earliest few lines. Lines that this leaves
standing are compared with the lines before them in jobs of bounded size, to
which each line of the key brings its text once; a job stops at the first proof
of a line and reports lines, not pairs. Entries carry their place, rounded but
in order, to find the earliest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, BASE_INVERSE, constants, join_by_id, join_salted, materialize, mix, pack, partitions, release, route, runs, split_by_part, unpack

CELL = "kind int, part long, cell binary"
ENTRY, PLACE, GONE, FIRST, PAIR, OPEN = range(6)
#: The CRC-32 in the code of a line.
CHECK = (1 << 32) - 1
#: An entry of a key that many lines share, for the second round.
OPENED = "key long, line long, histogram long, roles int"
#: The jobs that a line of a hot key is dealt to.
JOBS = "array<struct<side:int,i:bigint,j:bigint>>"


# --- edit distance --------------------------------------------------------------


def _advance(d0_of, vp, vn, ones):
    """One column of the band (Myers' recurrences, Hyyro's sliding band): D0, HP, HN and the next VP, VN."""
    d0 = (((d0_of & vp) + vp) ^ vp) | d0_of | vn
    hp, hn = vn | (~(d0 | vp) & ones), d0 & vp
    return d0, hp, hn, hn | (~((d0 >> 1) | hp) & ones), (d0 >> 1) & hp


def within_edits(a: str, b: str, most: int) -> bool:
    """Whether the edit distance of two strings is at most ``most``, for a band of any width.

    Bit r of the band of column j stands for place j + r - most of the shorter
    string, so the band holds every cell within ``most`` of the diagonal.
    """
    if len(a) > len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if n - m > most:
        return False
    if a == b or n <= most:
        return True
    width = 2 * most + 1
    ones = (1 << width) - 1
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << (i + most)
    vp, vn, score = ones & ~((1 << most) - 1), 0, most
    if m <= most:  # the last row lies in the band from the start
        score, low = m, most + m - 1
    else:
        low = width - 1
    for j, c in enumerate(b):
        matches = (masks.get(c, 0) >> j) & ones
        d0, hp, hn, vp, vn = _advance(matches, vp, vn, ones)
        if j + most < m:  # down the band's lower edge
            score += not d0 >> (width - 1) & 1
        else:  # along the last row
            low = most + m - 1 - j
            score += (hp >> low & 1) - (hn >> low & 1) if low >= 0 else 1
        if score > 2 * most + n - m:
            return False
    return score <= most


def near_pairs(texts: list[str], left: np.ndarray, right: np.ndarray, most: np.ndarray, cells: int = 1 << 21) -> np.ndarray:
    """Whether texts[left] and texts[right] are within ``most`` edits, for all pairs at once.

    Pairs of one bound go by length in groups, whose tables of characters hold
    at most ``cells`` entries. A band that fits no 64-bit word goes alone.
    """
    size = np.array([len(t) for t in texts], np.int64)
    swap = size[left] > size[right]
    left, right = np.where(swap, right, left), np.where(swap, left, right)
    same = np.zeros(len(left), bool)
    close = size[right] - size[left] <= most
    alone = close & ((most > 31) | (size[left] <= most))
    for i in np.flatnonzero(alone).tolist():
        same[i] = within_edits(texts[left[i]], texts[right[i]], int(most[i]))
    todo = np.flatnonzero(close & ~alone)
    if not len(todo):
        return same
    used = np.unique(np.r_[left[todo], right[todo]])
    flat = np.frombuffer("".join(texts[i] for i in used.tolist()).encode("utf-32-le"), np.uint32)
    present = np.zeros(int(flat.max(initial=0)) + 1, bool)
    present[flat] = True
    sigma, flat = int(present.sum()) + 1, (np.cumsum(present) - 1)[flat]
    starts = np.zeros(len(texts), np.int64)
    starts[used] = np.cumsum(size[used]) - size[used]
    todo = todo[np.lexsort((-size[right[todo]], most[todo]))]
    at = 0
    while at < len(todo):
        k, longest = int(most[todo[at]]), int(size[right[todo[at]]])
        step = max(1, cells // max(sigma, longest))
        some = todo[at : at + step]
        some = some[most[some] == k]
        same[some] = _near_group(flat, sigma, k, *(x[y[some]] for y in (left, right) for x in (starts, size)))
        at += len(some)
    return same


def _near_group(flat: np.ndarray, sigma: int, k: int, a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``within_edits`` for pairs of a[:m] and b[:n], longest b first, one column of all pairs at a time.

    A pair has a mask for each character, in which place i of a has the bit i
    modulo 64; places come and go as the band moves.
    """

    def characters(start: np.ndarray, size: np.ndarray, rows: int) -> np.ndarray:
        """The character of each place and pair; behind the end, one that no text has."""
        place = np.arange(rows)[:, None]
        return np.where(place < size, flat[np.minimum(start + place, len(flat) - 1)], sigma - 1)

    width = 2 * k + 1
    one, ones, lowest = np.uint64(1), np.uint64((1 << width) - 1), np.uint64(width - 1)
    same, pair = np.zeros(len(a), bool), np.arange(len(a))
    own, other = characters(a, m, int(n.max()) + k), characters(b, n, int(n.max()))
    vp, vn = np.full(len(a), int(ones) & ~((1 << k) - 1), np.uint64), np.zeros(len(a), np.uint64)
    score, bound, base = np.full(len(a), k), 2 * k + n - m, np.arange(len(a)) * sigma
    table = np.zeros(len(a) * sigma, np.uint64)
    for i in range(k):
        table[own[i] + base] |= one << np.uint64(i)
    for j in range(int(n.max())):
        if j == int(n[-1]) or (j % 16 == 0 and j and (score > bound).mean() > 0.2):  # what has ended or lost leaves
            ended = n <= j
            same[pair[ended]] = score[ended] <= k
            rest = np.flatnonzero(~ended & (score <= bound))
            if not len(rest):
                return same
            table = table.reshape(-1, sigma)[rest].ravel()
            own, other, base = own[:, rest], other[:, rest], base[: len(rest)]
            pair, m, n, vp, vn, score, bound = (x[rest] for x in (pair, m, n, vp, vn, score, bound))
        table[own[j + k] + base] |= one << np.uint64((j + k) & 63)
        if j > k:
            table[own[j - k - 1] + base] &= ~(one << np.uint64((j - k - 1) & 63))
        table[sigma - 1 :: sigma] = 0
        turn = (j - k) & 63
        x = table[other[j] + base]
        x = (x >> np.uint64(turn) | x << np.uint64(64 - turn) if turn else x) & ones
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & ones
        hp, hn = vn | (~(d0 | vp) & ones), d0 & vp
        half = d0 >> one
        vp, vn = hn | (~(half | hp) & ones), half & hp
        down = j + k < m
        score = score + (down & ((d0 >> lowest & one) == 0))
        if not down.all():  # along the last row
            low = (k + m - 1 - j).clip(0, 63).astype(np.uint64)
            along = (hp >> low & one).astype(np.int64) - (hn >> low & one).astype(np.int64)
            score += np.where(down, 0, along)
    same[pair] = score <= k
    return same


# --- entries ----------------------------------------------------------------------


def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of an even partition; longer segments last."""
    small, longer = divmod(length, parts)
    sizes = [small] * (parts - longer) + [small + 1] * longer
    return [(sum(sizes[:i]), s) for i, s in enumerate(sizes)]


def classes(longest: int, least: int) -> list[int]:
    """The least length of every class of lines up to the longest, and of the one beyond."""
    floors = [max(1, least)]
    while floors[-1] <= longest:
        floors.append(floors[-1] + max(8, floors[-1] // 8))
    return floors


def bound(floor, edits: int):
    """Edits within which lines are near, by the least length of the class of the shorter one: 0.3 times its root."""
    return np.maximum(edits, (0.3 * np.sqrt(floor)).astype(np.int64))


def bounds(size: np.ndarray, edits: int, least: int) -> np.ndarray:
    """The bounds of lines by their lengths."""
    floors = np.array(classes(int(size.max(initial=0)), least))
    return bound(floors, edits)[np.searchsorted(floors, size, "right") - 1]


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least the first n + 1 powers of BASE and of its inverse; kept for the next batch, which is about as long."""
    if not _POWERS or len(_POWERS[0]) <= n:
        _POWERS[:] = [np.full(n + 1, base, np.uint64) for base in (BASE, BASE_INVERSE)]
        for p in _POWERS:
            p[0] = 1
            np.multiply.accumulate(p, out=p)
    return _POWERS[0], _POWERS[1]


class Lines:
    """The eligible lines of a batch of texts: positions in one array of code points."""

    def __init__(self, texts: list[str], least: int):
        self.flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([0, *map(len, texts)])
        cuts = np.flatnonzero(self.flat == 10)
        first = np.searchsorted(cuts, ends) + np.arange(len(ends))  # the number of lines before each text
        doc = np.repeat(np.arange(len(texts)), np.diff(first))
        start, stop = np.sort(np.r_[ends[:-1], cuts + 1]), np.sort(np.r_[cuts, ends[1:]])
        keep = np.flatnonzero(stop - start >= least)
        self.doc, self.start, self.stop = doc[keep], start[keep], stop[keep]
        self.number = keep - first[self.doc]
        places = zip(self.doc.tolist(), (self.start - ends[self.doc]).tolist(), (self.stop - ends[self.doc]).tolist(), strict=True)
        own = [texts[i][a:b].encode() for i, a, b in places]
        self.hash = np.frombuffer(b"".join([blake2b(line, digest_size=8).digest() for line in own]), np.uint64)
        self.code = self.number << 32 | np.array([zlib.crc32(line) for line in own], np.int64)
        n = len(self.flat)
        up, self.down = powers(n)
        self.sums = np.zeros(n + 1, np.uint64)
        odd, shift = constants(2, 61)
        np.cumsum((self.flat.astype(np.uint64) * odd + shift) * up[:n], out=self.sums[1:])

    def part(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start])

    def histogram(self, rows: np.ndarray) -> np.ndarray:
        """Eight 4-bit counts of the characters of each line, in classes by code."""
        out = np.zeros(len(rows), np.uint32)
        size = self.stop[rows] - self.start[rows]
        for at in range(0, len(rows), 1 << 12):
            some = slice(at, at + (1 << 12))
            owner = np.repeat(np.arange(len(size[some])), size[some])
            place = np.arange(len(owner)) + np.repeat(self.start[rows[some]] - (np.cumsum(size[some]) - size[some]), size[some])
            cls = (self.flat[place] * np.uint32(2654435761)) >> np.uint32(29)
            count = np.bincount(owner * 8 + cls, minlength=8 * len(size[some])).reshape(-1, 8).astype(np.uint32) & np.uint32(15)
            out[some] = (count << (4 * np.arange(8, dtype=np.uint32))).sum(1, dtype=np.uint32)
        return out

    def entries(self, rows: np.ndarray, edits: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, keys) of every segment and every probing substring of the lines.

        Bit 0 of a key is 1 for a probe, bits 1 to 7 hold the bound of its class, as far as they can.
        """
        rows = rows[np.argsort(self.stop[rows] - self.start[rows], kind="stable")]
        length = self.stop[rows] - self.start[rows]
        floors = classes(int(length[-1]), least) if len(rows) else []
        salt = constants(1, 67)[0]

        def keys(some: np.ndarray, size: np.ndarray, table: list[tuple[int, int, int]], role: int) -> tuple[np.ndarray, np.ndarray]:
            """Keys of the parts (place, width, number) of lines; a place below 0 counts from the end."""
            at, width, number = np.array(table, np.int64).T
            at = np.where(at < 0, size[:, None] + at, at)
            fits = (at >= 0) & (at + width <= size[:, None])
            begin = (self.start[some][:, None] + at)[fits]
            salts = np.broadcast_to(np.uint64(floor) * salt + order[number], fits.shape)[fits]
            key = mix(self.part(begin, begin + np.broadcast_to(width, fits.shape)[fits]) + salts)
            key = (key & ~np.uint64(255)) | np.uint64(min(most, 127) << 1 | role)
            return np.repeat(some, fits.sum(1)), key

        for floor, beyond in zip(floors, floors[1:], strict=False):
            most = int(bound(floor, edits))
            order = constants(most + 1, 71)
            lo, hi, reach = np.searchsorted(length, (floor, beyond, beyond + most))
            if lo == reach:
                continue
            # the segments of the second half lie where they do counted from the end
            cuts = [(at if 2 * i <= most else at - floor, n, i) for i, (at, n) in enumerate(segments(floor, most + 1)) if n]
            yield keys(rows[lo:hi], length[lo:hi], cuts, 0)
            # some segment i is whole with i edits before it and at most most - i behind: it moves that far from its end at most
            shifted = [
                (at + d, n, i) for at, n, i in cuts for d in range(-min(i, most - i), min(i, most - i) + 1) if (at < 0 and at + n + d <= 0) or (at >= 0 and at + d >= 0)
            ]
            step = max(1, (1 << 20) // len(shifted))
            for x in range(int(lo), int(reach), step):
                y = min(x + step, int(reach))
                yield keys(rows[x:y], length[x:y], shifted, 1)


def _scan(edits: int, least: int, parts: int, limit: int = 1 << 20):
    """Cells of one pass over the texts: entries by key, places of lines by hash, and lines that repeat in the batch."""

    def cells(ids: list[int], texts: list[str]) -> pa.RecordBatch:
        lines, rows = Lines(texts, least), []
        ids = np.array(ids, np.int64)
        doc = ids[lines.doc] if len(lines.doc) else np.zeros(0, np.int64)
        order = np.lexsort((lines.code, doc, lines.code & CHECK, lines.hash))
        starts, again = _repeats(lines.hash[order], doc[order], lines.code[order])
        own, again = np.sort(order[starts]), np.sort(order[again])
        for part, arrays in split_by_part(route(lines.hash[own], parts), lines.hash[own], doc[own], lines.code[own]):
            rows.append((PLACE, part, pack(*arrays)))
        for part, arrays in split_by_part(route(doc[again].view(np.uint64), parts), doc[again], lines.code[again]):
            rows.append((GONE, parts + part, pack(*arrays)))
        histogram = np.zeros(len(lines.doc), np.uint32)
        histogram[own] = lines.histogram(own)
        keys, refs = [], []
        for some, key in lines.entries(own, edits, least):
            keys.append(key)
            refs.append(some)
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)  # the lowest bit tells probes from segments
        ref = np.concatenate(refs) if refs else np.zeros(0, np.int64)
        place = doc.astype(np.float32)  # rounding keeps the order, but for ties
        for part, arrays in split_by_part(route(key >> np.uint64(1), parts), key, lines.hash[ref], histogram[ref], place[ref]):
            rows.append((ENTRY, 2 * parts + part, pack(*arrays)))
        return _cells(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                value = text.as_py() or ""
                ids.append(doc)
                texts.append(value)
                held += len(value)
                if held >= limit:
                    yield cells(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield cells(ids, texts)

    return run


def _repeats(line: np.ndarray, doc: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places sorted by line and CRC-32: the first of each line, and those that repeat it elsewhere.

    Rows that repeat a doc_id may hold the first occurrence once more; that is no repeat.
    """
    check = code & CHECK
    new = np.r_[True, (line[1:] != line[:-1]) | (check[1:] != check[:-1])] if len(line) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    head = np.repeat(starts, np.diff(np.r_[starts, len(line)]))
    return starts, np.flatnonzero((doc != doc[head]) | (code != code[head]))


def _cells(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds, parts, cells = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.int32()), pa.array(parts, pa.int64()), pa.array(cells, pa.binary())], ["kind", "part", "cell"]
    )


def _bytes(histogram: np.ndarray) -> np.ndarray:
    """The eight counts of each histogram, one in each byte of a 64-bit word."""
    x = histogram.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F)):
        x = (x | x << np.uint64(shift)) & np.uint64(mask)
    return x


def _apart(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Whether two histograms differ by more than ``most`` edits can explain: each edit moves two counts by one."""
    each = np.uint64(0x0101010101010101)
    d = (_bytes(a) + np.uint64(16) * each - _bytes(b)) & np.uint64(15) * each  # modulo 16, in all bytes at once
    far = (d >> np.uint64(3) & each) * np.uint64(31)
    d ^= (d ^ (np.uint64(16) * each - d)) & far  # the way round, where it is shorter
    return ((d * each) >> np.uint64(56)).astype(np.int64) > 2 * most


def _candidates(
    edits: int, key: np.ndarray, line: np.ndarray, histogram: np.ndarray, place: np.ndarray, full: int, pivots: int = 4,
) -> tuple[np.ndarray, list[np.ndarray]]:
    """Pairs of lines that share a key as segment and probe and whose histograms are near, each once; and what is open.

    A key with more pairs than ``full`` for each of its entries yields only
    those with its ``pivots`` earliest segments and probes, and its lines stay
    open (arrays like ``OPENED``; roles has bit 1 for a segment, 2 for a probe).
    """
    order = np.argsort(key)
    starts, sizes = runs(key[order] >> np.uint64(1))
    role = key[order] & np.uint64(1)
    order = order[np.repeat((role[starts] == 0) & (role[starts + sizes - 1] == 1), sizes)]  # keys that are segment and probe, the few
    order = order[np.lexsort((place[order], line[order], key[order]))]
    key, line, histogram, place = key[order], line[order], histogram[order], place[order]
    fresh = np.r_[True, (key[1:] != key[:-1]) | (line[1:] != line[:-1])] if len(key) else np.zeros(0, bool)
    key, line, histogram, place = key[fresh], line[fresh], histogram[fresh], place[fresh]
    starts, sizes = runs(key >> np.uint64(1))
    most = np.maximum(edits, (key >> np.uint64(1) & np.uint64(127)).astype(np.int64))
    left, right, held = [], [], []
    # a key of one segment and few probes, the usual case, in one go
    for width in (2, 3):
        some = starts[sizes == width]
        for x in range(width):
            for y in range(width):
                i, j = some + x, some + y
                ok = ((key[i] & np.uint64(1)) == 0) & ((key[j] & np.uint64(1)) == 1) & (line[i] != line[j])
                ok[ok] = ~_apart(histogram[i[ok]], histogram[j[ok]], most[i[ok]])
                left.append(line[i[ok]])
                right.append(line[j[ok]])

    def cross(i: np.ndarray, j: np.ndarray) -> None:
        near = ~_apart(histogram[i][:, None], histogram[j][None, :], most[lo]) & (line[i][:, None] != line[j][None, :])
        x, y = np.nonzero(near)
        left.append(line[i][x])
        right.append(line[j][y])

    for lo, n in zip(starts[sizes > 3].tolist(), sizes[sizes > 3].tolist(), strict=True):
        cut = lo + int(np.searchsorted(key[lo : lo + n] & np.uint64(1), 1))
        own, probes = np.arange(lo, cut), np.arange(cut, lo + n)
        if len(own) * len(probes) <= full * n:
            cross(own, probes)
            continue
        cross(own[np.argsort(place[own], kind="stable")[:pivots]], probes)
        cross(own, probes[np.argsort(place[probes], kind="stable")[:pivots]])
        held.append(np.arange(lo, lo + n))
    a = np.concatenate(left) if left else np.zeros(0, np.uint64)
    b = np.concatenate(right) if right else np.zeros(0, np.uint64)
    pairs = _pairs(a, b)
    rows = np.concatenate(held) if held else np.zeros(0, np.int64)
    rows = rows[np.lexsort((line[rows], key[rows] >> np.uint64(1)))]
    home, own, role = key[rows] >> np.uint64(1), line[rows], 1 << (key[rows] & np.uint64(1)).astype(np.int32)
    start = np.flatnonzero(np.r_[True, (home[1:] != home[:-1]) | (own[1:] != own[:-1])]) if len(rows) else rows
    roles = np.add.reduceat(role, start) if len(rows) else role
    return pairs, [home[start].view(np.int64), own[start].view(np.int64), histogram[rows[start]].astype(np.int64), roles.astype(np.int32)]


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct unordered pairs, in two columns."""
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), a.dtype)


def _proved(text, group: np.ndarray, left: np.ndarray, right: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether each group has a near pair. Groups ascend from 0; a proof spares the pairs behind it, of which the next few go at a time."""
    counts = np.bincount(group)
    rank = np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)
    near, tried, deep = np.zeros(len(counts), bool), 0, 1
    while (some := ~near & (counts > tried)).any():
        pick = np.flatnonzero(some[group] & (rank >= tried) & (rank < tried + deep))
        used, at = np.unique(np.r_[left[pick], right[pick]], return_inverse=True)
        same = near_pairs([text(u) for u in used.tolist()], at[: len(pick)], at[len(pick) :], most[pick])
        near[group[pick[same]]] = True
        tried, deep = tried + deep, 4 * deep
    return near


class _Shared:
    """Which lines of a job meet under another key too, as a segment of one and a probe of the other."""

    def __init__(self, segments: pa.ListArray, probes: pa.ListArray):
        values = [x.flatten().to_numpy() for x in (segments, probes)]
        self.owner = [np.repeat(np.arange(len(x)), x.value_lengths().to_numpy()) for x in (segments, probes)]
        self.keys = np.intersect1d(*values)
        known = [np.isin(v, self.keys) for v in values]
        self.owner = [o[k] for o, k in zip(self.owner, known, strict=True)]
        self.code = [np.searchsorted(self.keys, v[k]) for v, k in zip(values, known, strict=True)]
        self.size = len(segments)

    def _matrix(self, role: int, rows: np.ndarray, first: int, width: int) -> np.ndarray:
        at = np.full(self.size, -1)
        at[rows] = np.arange(len(rows))
        own, code = at[self.owner[role]], self.code[role] - first
        some = (own >= 0) & (code >= 0) & (code < width)
        out = np.zeros((len(rows), width), np.float32)
        out[own[some], code[some]] = 1
        return out

    def __call__(self, left: np.ndarray, right: np.ndarray, step: int = 1024) -> np.ndarray:
        met = np.zeros((len(left), len(right)), bool)
        for first in range(0, len(self.keys), step):
            width = min(step, len(self.keys) - first)
            for role in (0, 1):
                met |= self._matrix(role, left, first, width) @ self._matrix(1 - role, right, first, width).T > 0
        return met


def _standing(edits: int, least: int, block: int = 256, width: int = 4096):
    """Lines of a job's side 0 that are near an earlier line of its side 1.

    A row lists the smaller keys of its line; two lines that meet under one of those are left to its job.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, line, doc, code, roles, size = (table.column(c).to_numpy() for c in ("side", "line", "doc_id", "code", "roles", "size"))
        histogram, text = table.column("histogram").to_numpy().astype(np.uint32), table.column("text").chunk(0)
        shared = _Shared(table.column("segments").chunk(0), table.column("probes").chunk(0))
        most = bounds(size, edits, least)
        later, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        other, gone = other[np.lexsort((code[other], doc[other]))], []
        for at in range(0, len(later), block):
            left = later[at : at + block]
            for to in range(0, len(other), width):
                i, j = left[:, None], other[None, to : to + width]
                ok = ((roles[i] & 1) & (roles[j] >> 1)) | ((roles[i] >> 1) & (roles[j] & 1)) > 0
                ok &= (doc[j] < doc[i]) | ((doc[j] == doc[i]) & (code[j] < code[i]))
                ok &= np.abs(size[i] - size[j]) <= np.minimum(most[i], most[j])
                if ok.any():
                    ok &= ~shared(left, j[0])
                x, y = np.nonzero(ok)
                a, b = left[x], j[0, y]
                within = np.minimum(most[a], most[b])
                close = ~_apart(histogram[a], histogram[b], within)
                rows, group = np.unique(x[close], return_inverse=True)
                if len(rows):
                    near = rows[_proved(lambda u: text[u].as_py(), group, a[close], b[close], within[close])]
                    gone.append(left[near])
                    left = np.delete(left, near)
        found = np.concatenate(gone) if gone else np.zeros(0, np.int64)
        return pa.table({"doc_id": pa.array(doc[found], pa.int64()), "code": pa.array(code[found], pa.int64())})

    return run


def _match(edits: int, parts: int, full: int):
    """First places of lines and lines that repeat, or candidate pairs and open entries, of one part."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        if kind == GONE:
            return table.select(["kind", "part", "cell"])
        columns = [np.concatenate(c) for c in zip(*map(unpack, table.column("cell").to_pylist()), strict=True)]
        if kind == ENTRY:
            pairs, held = _candidates(edits, *columns, full)
            rows = [(PAIR, 0, pack(*pairs.view(np.int64).T))] if len(pairs) else []
            rows += [(OPEN, 0, pack(*(a[at : at + (1 << 16)] for a in held))) for at in range(0, len(held[0]), 1 << 16)]
            return pa.Table.from_batches([_cells(rows)])
        line, doc, code = columns
        order = np.lexsort((code, doc, code & CHECK, line))
        line, doc, code = line[order], doc[order], code[order]
        starts, again = _repeats(line, doc, code)
        rows = [(FIRST, 0, pack(line[starts].view(np.int64), doc[starts], code[starts]))]
        rows += [(GONE, 0, pack(doc[again], code[again]))]
        return pa.Table.from_batches([_cells(rows)])

    return run


def _rows(cells: DataFrame, kind: int, spec: str) -> DataFrame:
    """The rows packed into the cells of one kind."""
    names = [f.split()[0] for f in spec.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in unpack(cell.as_py())], names)

    return cells.where(F.col("kind") == kind).select("cell").mapInArrow(run, spec)


def _near(edits: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, texts = batch.num_rows, [batch.column("a_text"), batch.column("b_text")]
            if not n:
                continue
            a, b = (pc.utf8_length(t).to_numpy().astype(np.int64) for t in texts)
            most = bounds(np.minimum(a, b), edits, least)
            place = np.stack([batch.column("later").field(f).to_numpy() for f in ("doc_id", "code", "line")], 1)
            _, head, group = np.unique(place, axis=0, return_index=True, return_inverse=True)
            group = group.ravel()
            order = np.lexsort((np.abs(a - b), group))  # the likeliest proof first
            near = _proved(lambda u: texts[u // n][u % n].as_py(), group[order], order, order + n, most[order])
            yield batch.select(["later"]).take(pa.array(head[near]))

    return run


def line_code(number, line):
    """A line of a document as one long: its number, and the CRC-32 of its text, which rows of one doc_id may not share."""
    return F.shiftleft(number.cast("long"), 32).bitwiseOR(F.crc32(line))


def gone_lines(
    documents: DataFrame, *, edits: int = 2, least: int = 32, small: int = 200_000, full: int = 8,
    job_chars: tuple[int, int] = (1 << 20, 1 << 23),
) -> DataFrame:
    """doc_id, code (see ``line_code``) of every line that goes; see ``dedup_lines``."""
    spark = documents.sparkSession
    parts = partitions(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    cells = materialize(
        docs.mapInArrow(_scan(edits, least, parts), CELL).groupBy("part").applyInArrow(_match(edits, parts, full), CELL)
    )
    gone = _rows(cells, GONE, "doc_id long, code long")
    first = _rows(cells, FIRST, "line long, doc_id long, code long")
    place = F.struct("doc_id", "code", "line").alias("place")

    def texts_of(places: DataFrame) -> DataFrame:
        """doc_id, code, text of the lines at the given places (doc_id, code)."""
        owners = places.select("doc_id").distinct()
        owners = F.broadcast(owners) if owners.count() <= small else owners.hint("shuffle_hash")
        lines = docs.join(owners, "doc_id", "left_semi").select("doc_id", F.posexplode(F.split("text", "\n")).alias("number", "text"))
        lines = lines.where(F.length("text") >= least).select("doc_id", line_code(F.col("number"), F.col("text")).alias("code"), "text")
        return materialize(places.join(lines, ["doc_id", "code"]).groupBy("doc_id", "code").agg(F.min("text").alias("text")))

    pairs = _rows(cells, PAIR, "a long, b long").distinct()
    placed = materialize(
        pairs.join(first.select(F.col("line").alias("a"), place.alias("pa")), "a")
        .join(first.select(F.col("line").alias("b"), place.alias("pb")), "b")
        .select(F.least("pa", "pb").alias("earlier"), F.greatest("pa", "pb").alias("later"))
    )
    texts = texts_of(placed.select("earlier.doc_id", "earlier.code").unionByName(placed.select("later.doc_id", "later.code")).distinct())

    def text_at(side: str) -> DataFrame:
        return texts.select(F.col("doc_id").alias(f"{side}_doc"), F.col("code").alias(f"{side}_code"), F.col("text").alias(f"{side}_text"))

    judged = (
        placed.select(F.col("earlier.doc_id").alias("a_doc"), F.col("earlier.code").alias("a_code"), F.col("later.doc_id").alias("b_doc"), F.col("later.code").alias("b_code"), "later")
        .join(text_at("a"), ["a_doc", "a_code"]).join(text_at("b"), ["b_doc", "b_code"])
        .select("later", "a_text", "b_text")
        .mapInArrow(_near(edits, least), "later struct<doc_id:long,code:long,line:long>")
    )
    near = materialize(judged.select("later.*").distinct())
    release(placed, texts)
    gone = gone.unionByName(near.select("doc_id", "code"))
    opened = _rows(cells, OPEN, OPENED)
    met = opened.groupBy("line").agg(F.max("histogram").alias("histogram"), F.collect_list(F.struct("key", "roles")).alias("met"))
    places = materialize(met.join(first, "line"))
    lines = texts = None
    if not places.isEmpty():
        standing = near.withColumn("standing", F.lit(False))
        texts = texts_of(places.select("doc_id", "code"))
        lines = materialize(
            places.join(texts, ["doc_id", "code"]).join(standing, ["line", "doc_id", "code"], "left")
            .withColumn("standing", F.coalesce("standing", F.lit(True))).withColumn("size", F.length("text").cast("long"))
        )
        gone = gone.unionByName(_judge_open(lines, edits, least, *job_chars))
    found = materialize(gone.distinct())
    release(cells, near, places, texts, lines)
    return found


def _judge_open(lines: DataFrame, edits: int, least: int, later_chars: int, other_chars: int) -> DataFrame:
    """doc_id, code of the standing lines of open keys that are near an earlier line of the same key.

    The standing lines of a key, and all of its lines, are dealt into parts by
    their characters; a job compares one part with another. Two lines that meet
    under several keys are compared under the smallest.
    """
    weight = F.col("size") + 64
    facts = lines.select("line", "size", "standing", F.explode("met").alias("of")).select("*", "of.*")
    counts = facts.groupBy("key").agg(
        F.ceil(F.sum(F.when(F.col("standing"), weight)) / later_chars).alias("blocks"), F.ceil(F.sum(weight) / other_chars).alias("others")
    )
    rows = join_salted(facts.select("key", "line", "roles"), counts.where("blocks > 0"), "key", "line").join(lines, "line")
    deal = lambda seed, n: F.pmod(F.xxhash64("line", F.lit(seed)), F.col(n))
    each = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    job = lambda side, i, j: F.struct(F.lit(side).alias("side"), i.alias("i"), j.alias("j"))
    later = F.when(F.col("standing"), F.transform(each("others"), lambda j: job(0, deal(0, "blocks"), j)))
    other = F.transform(each("blocks"), lambda i: job(1, i, deal(1, "others")))
    under = lambda bit: F.filter("met", lambda m: (m["key"] < F.col("key")) & (m["roles"].bitwiseAND(bit) > 0))["key"]
    smaller = [under(1).alias("segments"), under(2).alias("probes")]
    columns = ("key", "line", "histogram", "roles", "doc_id", "code", "size", "text", *smaller)
    dealt = rows.select(*columns, F.explode(F.concat(F.coalesce(later, F.array().cast(JOBS)), other)).alias("job")).select("*", "job.*").drop("job")
    return dealt.groupBy("key", "i", "j").applyInArrow(_standing(edits, least), "doc_id long, code long")


def dedup_lines(documents: DataFrame, *, edits: int = 2, least: int = 32, **options) -> DataFrame:
    """``documents`` with lines_gone: the numbers of the lines that go, ascending, or an empty array.

    Lines are the pieces of a text between line feeds; only those of at least
    ``least`` characters take part, shorter ones always stay. A line goes if a
    line that is equal, or near, first occurs earlier, by doc_id and line number.
    Lines are near within ``edits`` edits, or 0.3 times the root of the length
    of the shorter one if that is more: its length rounded down to its class
    (``classes``), the product to a whole number (``bound``). Whether that earlier line itself goes doesn't
    matter, so the result depends on the corpus alone and not on any order of
    work.

    Null and empty texts have no such lines. Rows without doc_id take no part
    and keep their lines. Rows that repeat a doc_id are one document: a line of
    a number that goes, goes in each of them that has the same line there, and
    a line's first occurrence stays in each. Other columns pass through;
    lines_gone is replaced if it is there. An empty table gives an empty result.

    None of the ``options`` of ``gone_lines`` changes the result: ``small``
    bounds the ids that may be broadcast, ``full`` the pairs that a key yields
    for each of its entries, ``job_chars`` the characters of either side of a
    job that compares the lines of a hot key.
    """
    docs = documents.drop(*[c for c in documents.columns if c.lower() == "lines_gone"])
    lists = gone_lines(docs, edits=edits, least=least, **options).groupBy("doc_id").agg(F.collect_set("code").alias("lines_gone"))
    none = F.array().cast("array<int>")
    own = F.transform(F.split(docs["text"].cast("string"), "\n"), lambda line, i: line_code(i, line))
    numbers = F.sort_array(F.transform(F.array_intersect("lines_gone", own), lambda c: F.shiftright(c, 32).cast("int")))
    return join_by_id(docs, lists, "left").select(
        *[docs[c] for c in docs.columns], F.coalesce(F.when(F.col("lines_gone").isNotNull(), numbers), none).alias("lines_gone")
    )


def without_lines(text, gone):
    """A text (Column) without the lines of the given numbers (Column of array<int>)."""
    kept = F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains(gone, i))
    return F.when(F.size(gone) > 0, F.array_join(kept, "\n")).otherwise(text)
