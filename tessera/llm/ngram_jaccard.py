"""N-gram Jaccard self-join with token-combination prefixes.

Two documents link when the Jaccard similarity of their sets of distinct word
shingles reaches ``percent``. Candidates come from a prefix filter: tokens
(shingle hashes) have one global order, rare first; a document indexes only
the first tokens of its set. Tokens of low frequency are indexed singly.
Frequent tokens are dealt into classes, and only combinations of k tokens of
one class are indexed, pairs of frequent tokens and triples of the most
frequent ones; a class of c tokens then accounts for c - k + 1 possible
differences rather than c, so the prefix is extended until all classes
together account for one more difference than two linked documents can have.
By the pigeonhole principle linked documents share an indexed key. Every
candidate is verified on the complete sets.

The order needs frequencies. Counting all tokens would move the whole corpus,
so only the tokens whose hash falls into the lowest ``universe`` share are
counted, exactly and over all documents, and these come first in the order; a
prefix nearly always ends among them. A token that occurs in one document only
takes its place in the prefix but can't yield a candidate and isn't indexed.

Hot groups. Equal sets collapse to one representative before the join. A key
yields candidates only against its head, the document with the smallest share
of tokens of its own, in blocks. After these links are merged, just the
documents outside the component of their head are open. If they are at most a
few blocks, they are compared with the rest of their group. If they are more, the
combination that they share is extended by one token: a document that misses
the head can link only with those that share enough tokens outside the head
with it (see ``_residual``), so each of the rarest of these tokens, together
with the head, is a longer key, and the search goes on with these keys and
their heads until no group is open.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    WHITE_SPACE,
    WordHasher,
    constants,
    join_salted,
    materialize,
    mix,
    pack,
    partitions,
    release,
    route,
    runs,
    split_by_part,
    text_windows,
    unpack,
)
from .components import connected_components

CELL = "kind int, part long, cell binary"
SET = "doc_id long, n long, h1 long, h2 long, tokens binary"
#: A member's side in a job: left 0, right 1, or both.
BOTH = 2
SIGNATURE = "doc_id long, n long, h1 long, h2 long, silent long, keys array<long>"


# --- sets -------------------------------------------------------------------


class ShingleSets:
    """The sorted distinct shingle hashes of each text of a batch, A-Z lower-cased.

    A shingle's hash mixes those of its words one after the other.
    """

    def __init__(self, size: int, window: int = 1 << 18):
        self.size, self.words = size, WordHasher(WHITE_SPACE, window)
        self.step, self.whole = constants(1, 41)[0], constants(size, 43)

    def _chained(self, parts: list[np.ndarray]) -> np.ndarray:
        s = parts[0].copy()
        for part in parts[1:]:
            s *= self.step
            s ^= s >> np.uint64(32)
            s += part
        return mix(s)

    def __call__(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        k = self.size
        for first, data, offsets in text_windows(texts):
            hashes, bounds = self.words(data, offsets)
            count = len(hashes) - k + 1
            shingles = self._chained([hashes[j : j + count] for j in range(k)]) if count > 0 else hashes[:0]
            for row, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                if hi - lo >= k:
                    s = np.sort(shingles[lo : hi - k + 1])
                    yield first + row, s[np.r_[True, s[1:] != s[:-1]]]
                elif hi > lo:
                    yield first + row, self._chained([*hashes[lo:hi, None], self.whole[hi - lo : hi - lo + 1]])
                else:
                    yield first + row, hashes[:0]


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that identify a set."""
    one, two = mix(tokens ^ np.uint64(0xA5A5)), mix(tokens + np.uint64(0x5851F42D4C957F2D))
    return int(one.sum().view(np.int64)), int(two.sum().view(np.int64))


def _allowed(n: int, percent: int) -> int:
    """Tokens of a set of n that a linked set may lack."""
    return n - -(-percent * n // 100)


def _lonely(n: int, percent: int) -> bool:
    """Whether a set of n can link with equal sets only."""
    return _allowed(n, percent) == 0 and n * 100 // percent == n


def _tiers(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(tier, number of token classes for pairs, and for triples) under which a set of n indexes combinations.

    The numbers of classes follow the size, and linked sets may lie on two
    sides of a step, so a set near the next step indexes under both. Classes
    take up no more than a quarter of a set, so its prefix always ends; small
    sets have no triples.
    """
    own, above = n.bit_length() - 1, (n * 100 // percent).bit_length() - 1
    return [(t, max(1, (1 << t) // 8), (1 << t) // 16) for t in sorted({own, above})]


# --- first pass: lowest hashes of every document ------------------------------


def _emit(size: int, percent: int, universe: float, parts: int, flush: int = 1 << 20):
    ceiling = np.uint64(int(universe * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = ShingleSets(size)
        docs, metas, chunks, owners, held = [], [], [], [], 0

        def drain() -> pa.RecordBatch:
            rows = []
            ids = np.array(docs, np.int64)
            if chunks:
                tokens = np.concatenate(chunks)
                owner = np.repeat(np.arange(len(owners), dtype=np.uint16), owners)
                for part, (t, o) in split_by_part(route(tokens, parts), tokens, owner):
                    rows.append((0, part, pack(ids, t, o)))
            table = np.array(metas, np.int64).reshape(-1, 6)
            for part, (t,) in split_by_part(route(table[:, 0].view(np.uint64), parts), table):
                rows.append((1, parts + part, pack(*t.T)))
            return _cells(rows)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, s in sets(batch.column(1)):
                n = len(s)
                take = low = 0
                if not _lonely(n, percent):
                    low = int(np.searchsorted(s, ceiling))
                    take = min(n, max(low, _allowed(n, percent) + 1 + max(two + 2 * three for _, two, three in _tiers(n, percent))))
                docs.append(ids[row])
                owners.append(take)
                metas.append((ids[row], n, *_digest(s), low, take))
                if take:
                    chunks.append(s[:take])
                    held += take
                if held >= flush or len(docs) == 60000:
                    yield drain()
                    docs, metas, chunks, owners, held = [], [], [], [], 0
        if docs:
            yield drain()

    return run


def _cells(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds, parts, cells = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.int32()), pa.array(parts, pa.int64()), pa.array(cells, pa.binary())],
        ["kind", "part", "cell"],
    )


# --- second pass: frequencies of shared tokens, sent back to their documents ---


def _count(parts: int):
    def run(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == 1:
            return table.select(["kind", "part", "cell"])
        tokens, docs = [], []
        for cell in table.column("cell").to_pylist():
            ids, t, o = unpack(cell)
            tokens.append(t)
            docs.append(ids[o])
        tokens, docs = np.concatenate(tokens), np.concatenate(docs)
        order = np.argsort(tokens, kind="stable")
        tokens, docs = tokens[order], docs[order]
        _, lengths = runs(tokens)
        frequency = np.repeat(lengths, lengths)
        shared = frequency > 1
        tokens, docs, frequency = tokens[shared], docs[shared], frequency[shared].astype(np.int32)
        rows = [
            (0, parts + part, pack(*arrays))
            for part, arrays in split_by_part(route(docs.view(np.uint64), parts), docs, tokens, frequency)
        ]
        return pa.Table.from_batches([_cells(rows)])

    return run


# --- third pass: index keys of every document ----------------------------------


def index_keys(
    n: int, silent: int, low: np.ndarray, low_frequency: np.ndarray, high: np.ndarray,
    high_frequency: np.ndarray, percent: int, frequent: int, hot: int,
) -> np.ndarray:
    """Keys of one set: single rare tokens, and pairs or triples of frequent tokens of one class.

    ``low``/``high`` are its shared tokens inside and above the counted
    universe; ``silent`` is how many of its universe tokens no other set has.
    """
    need = _allowed(n, percent) + 1
    if silent >= need:
        return np.zeros(0, np.int64)
    first = np.lexsort((low, low_frequency))
    second = np.argsort(high)
    tokens = [*low[first].tolist(), *high[second].tolist()]
    counts = [*low_frequency[first].tolist(), *high_frequency[second].tolist()]
    single: set[int] = set()
    combined: dict[int, list[tuple[int, ...]]] = {2: [], 3: []}
    for tier, two, three in _tiers(n, percent):
        got, groups = silent, {}
        for token, count in zip(tokens, counts, strict=True):
            if got >= need:
                break
            if count <= frequent:
                single.add(token)
                got += 1
                continue
            k = 3 if count > hot and three else 2
            group = groups.setdefault((k, (token >> 7) % (three if k == 3 else two)), [])
            got += len(group) >= k - 1
            combined[k] += [(tier, token, *others) for others in combinations(group, k - 1)]
            group.append(token)
    keys = [mix(np.fromiter(single, np.uint64, len(single)) ^ np.uint64(0x517CC1B727220A95))]
    for found in combined.values():
        if found:  # the tokens of a combination stand in the global order
            columns, w = np.array(found, np.uint64).T, constants(2, 47)
            key = columns[0] * w[0]
            for column in columns[1:]:
                key = mix(key + column * w[1])
            keys.append(key)
    return np.unique(np.concatenate(keys)).view(np.int64)


def _sign(percent: int, universe: float, frequent: int, hot: int):
    ceiling = np.uint64(int(universe * 2**64))

    def run(table: pa.Table) -> pa.Table:
        metas, docs, tokens, frequency = [], [], [], []
        for kind, cell in zip(table.column("kind").to_pylist(), table.column("cell").to_pylist(), strict=True):
            if kind == 1:
                metas.append(np.stack(unpack(cell), 1))
            else:
                d, t, f = unpack(cell)
                docs.append(d)
                tokens.append(t)
                frequency.append(f)
        meta = np.concatenate(metas) if metas else np.zeros((0, 6), np.int64)
        meta = meta[np.lexsort((meta[:, 3], meta[:, 2], meta[:, 1], meta[:, 0]))]
        last = np.r_[meta[1:, 0] != meta[:-1, 0], True] if len(meta) else np.zeros(0, bool)
        meta = meta[last]  # one row for each doc_id
        if docs:
            docs, tokens, frequency = map(np.concatenate, (docs, tokens, frequency))
            order = np.lexsort((tokens, docs))
            docs, tokens, frequency = docs[order], tokens[order], frequency[order]
            fresh = np.r_[True, (docs[1:] != docs[:-1]) | (tokens[1:] != tokens[:-1])]
            docs, tokens, frequency = docs[fresh], tokens[fresh], frequency[fresh]
        else:
            docs, tokens, frequency = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        lo, hi = np.searchsorted(docs, meta[:, 0]), np.searchsorted(docs, meta[:, 0], "right")
        keys, silent = [], []
        for (_, n, _, _, lows, _), a, b in zip(meta.tolist(), lo, hi, strict=True):
            t, f = tokens[a:b], frequency[a:b]
            cut = int(np.searchsorted(t, ceiling))
            silent.append(max(0, lows - cut))
            own = (n, silent[-1], t[:cut], f[:cut], t[cut:], f[cut:])
            keys.append(index_keys(*own, percent, frequent, hot) if b > a else np.zeros(0, np.int64))
        ends = np.cumsum([0, *map(len, keys)])
        values = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))
        columns = {c: pa.array(meta[:, i], pa.int64()) for i, c in enumerate(("doc_id", "n", "h1", "h2"))}
        return pa.table({**columns, "silent": pa.array(silent, pa.int64()), "keys": lists})

    return run


# --- verification ---------------------------------------------------------------


def overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of all intersections of the sets of two blocks, by products of 0/1 matrices."""
    out = np.zeros((len(left), len(right)), np.float64)
    if not left or not right:
        return out
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(a, b)
    if not len(common):
        return out

    def places(flat: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        keep = common[at] == flat
        return row[keep], at[keep]

    (ra, ca), (rb, cb) = places(a, left), places(b, right)
    for lo in range(0, len(common), width):
        size = min(width, len(common) - lo)
        x, y = np.zeros((len(left), size), np.float32), np.zeros((len(right), size), np.float32)
        u, v = (ca >= lo) & (ca < lo + size), (cb >= lo) & (cb < lo + size)
        x[ra[u], ca[u] - lo] = 1
        y[rb[v], cb[v] - lo] = 1
        out += x @ y.T
    return out


def _verify(percent: int):
    """Links between the left and the right members of a job, as a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        side = table.column("side").to_numpy()
        cells = table.column("tokens").to_pylist()
        sets = [np.frombuffer(c, np.uint64) for c in cells]
        rows = [np.flatnonzero((side == s) | (side == BOTH)) for s in (0, 1)]
        left, right = ([sets[i] for i in r] for r in rows)
        inter = overlaps(left, right)
        union = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :] - inter
        x, y = np.nonzero((100 * inter >= percent * union) & (union > 0) & (rows[0][:, None] != rows[1][None, :]))
        a, b = ids[rows[0][x]], ids[rows[1][y]]
        parent: dict[int, int] = {}

        def root(v: int) -> int:
            while (up := parent.setdefault(v, v)) != v:
                parent[v] = v = parent[up]
            return v

        links = []
        for p, q in zip(a.tolist(), b.tolist(), strict=True):
            r, s = root(p), root(q)
            if r != s:
                parent[max(r, s)] = min(r, s)
                links.append((p, q))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _overlap(a: int, b: int, percent: int) -> int:
    """Tokens that linked sets of a and b have in common at least."""
    return -(-percent * (a + b) // (100 + percent))


def _residual(percent: int, parts: int):
    """Cells of the members of a job: their tokens outside their head, by key, and what is known of each.

    Let x be open, that is not linked with its head h, and y link with x. Then
    at least |x & y| - |x & h| of the tokens that they share lie outside h.
    That is one at least if y is no smaller than h, for |x & h| is too little
    for a link of x with a set of that size. So x takes part with its rarest
    tokens outside h, all but as many as it must share less one; others, which
    any open document may link with, take part with all of them.
    """

    def run(table: pa.Table) -> pa.Table:
        side, tokens = table.column("side").to_numpy(), table.column("tokens").to_pylist()
        h = np.frombuffer(tokens[int(np.argmin(side))], np.uint64)
        head = table.column("head")[0].as_py()
        ids, n, own, out, least = (table.column(c).to_numpy() for c in ("doc_id", "n", "own", "out", "least"))
        scope = mix(np.array([head], np.int64).view(np.uint64))[0]
        members, found = [], []
        for i in np.flatnonzero((side == 1) & ((out == 1) | (n >= len(h)))).tolist():
            x = np.frombuffer(tokens[i], np.uint64)
            more = np.setdiff1d(x, h, assume_unique=True)
            least_partner = max(int(least[i]), -(-percent * len(x) // 100))
            shared = max(1, _overlap(len(x), least_partner, percent) - (len(x) - len(more))) if out[i] else 1
            if len(more) >= shared:
                members.append((head, ids[i], n[i], own[i], out[i], len(more), len(more) - shared + 1))
                found.append(more)
        rows = []
        if members:
            meta = np.array(members, np.int64)
            doc = np.repeat(meta[:, 1], meta[:, 5])
            key = mix(np.concatenate(found) ^ scope)
            for part, arrays in split_by_part(route(key, parts), key, np.full(len(key), head), doc):
                rows.append((0, part, pack(*arrays)))
            for part, (some,) in split_by_part(route(_member(meta[:, 0], meta[:, 1]), parts), meta):
                rows.append((1, parts + part, pack(*some.T)))
        return pa.Table.from_batches([_cells(rows)])

    return run


def _member(head: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(head.view(np.uint64)) ^ doc.view(np.uint64)


def _shared(parts: int):
    """Keys that several members have, with their counts, sent back to their members."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == 1:
            return table.select(["kind", "part", "cell"])
        key, head, doc = (np.concatenate(c) for c in zip(*map(unpack, table.column("cell").to_pylist()), strict=True))
        order = np.argsort(key, kind="stable")
        key, head, doc = key[order], head[order], doc[order]
        _, lengths = runs(key)
        count = np.repeat(lengths, lengths)
        some = count > 1
        arrays = head[some], doc[some], key[some], count[some]
        rows = [(0, parts + part, pack(*own)) for part, own in split_by_part(route(_member(*arrays[:2]), parts), *arrays)]
        return pa.Table.from_batches([_cells(rows)])

    return run


MEMBER = "head long, doc_id long, n long, own long, out long, keys array<long>"


def _extend(table: pa.Table) -> pa.Table:
    """The longer keys of every member of a part: of its rarest tokens outside the head those that others have too."""
    metas, entries = [], [[np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64), np.zeros(0, np.int64)]]
    for kind, cell in zip(table.column("kind").to_pylist(), table.column("cell").to_pylist(), strict=True):
        if kind == 1:
            metas.append(np.stack(unpack(cell), 1))
        else:
            entries.append(unpack(cell))
    meta = np.concatenate(metas) if metas else np.zeros((0, 7), np.int64)
    meta = meta[np.lexsort((meta[:, 1], meta[:, 0]))]
    head, doc, key, count = (np.concatenate(c) for c in zip(*entries, strict=True))
    order = np.lexsort((key, count, doc, head))
    head, doc, key, count = head[order], doc[order], key[order], count[order]
    starts = np.flatnonzero(np.r_[True, (head[1:] != head[:-1]) | (doc[1:] != doc[:-1])]) if len(head) else np.zeros(0, np.int64)
    own = {(head[a], doc[a]): (a, b) for a, b in zip(starts.tolist(), np.r_[starts[1:], len(head)].tolist(), strict=False)}
    keys = []
    for row in meta.tolist():
        a, b = own.get((row[0], row[1]), (0, 0))
        alone = row[5] - (b - a)  # tokens that no other member has come first
        keys.append(key[a : a + min(b - a, max(0, row[6] - alone))])
    ends = np.cumsum([0, *map(len, keys)])
    values = np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)
    columns = {c: pa.array(meta[:, i], pa.int64()) for i, c in enumerate(("head", "doc_id", "n", "own", "out"))}
    return pa.table({**columns, "keys": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))})


def _sets(size: int):
    """The sets of texts whose rows are the chosen ones of their doc_id, by size and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = ShingleSets(size)

        def made(rows: list[tuple]) -> pa.RecordBatch:
            ids, cells = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cells, pa.binary())], ["doc_id", "tokens"])

        for batch in batches:
            ids, n, h1, h2 = (batch.column(c).to_pylist() for c in ("doc_id", "n", "h1", "h2"))
            rows, held = [], 0
            for row, s in sets(batch.column("text")):
                if (len(s), *_digest(s)) == (n[row], h1[row], h2[row]):
                    rows.append((ids[row], s.tobytes()))
                    held += s.nbytes
                if held > 1 << 23:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)

    return run


def signatures(docs: DataFrame, size: int, percent: int, universe: float, frequent: int, hot: int) -> DataFrame:
    """doc_id, set size n, set digest h1 h2, tokens of its own and index keys of every document."""
    parts = partitions(docs.sparkSession)
    return (
        docs.mapInArrow(_emit(size, percent, universe, parts), CELL)
        .groupBy("part").applyInArrow(_count(parts), CELL)
        .groupBy("part").applyInArrow(_sign(percent, universe, frequent, hot), SIGNATURE)
    )


def _star(entries: DataFrame) -> DataFrame:
    """doc_id, n, own, head, head_n of all documents that share a key (key, doc_id, n, own, out) with its head, once each.

    Keys without a document that is out yield nothing.
    """
    heads = (
        entries.groupBy("key").agg(F.min(F.struct("own", "doc_id", "n")).alias("head"), F.count(F.lit(1)).alias("c"), F.max("out").alias("out"))
        .where("c > 1 and out > 0").select("key", F.col("head.doc_id").alias("head"), F.col("head.n").alias("head_n"))
    )
    return entries.join(heads, "key").where("doc_id <> head").select("doc_id", "n", "own", "head", "head_n").distinct()


def _deal(column: str, seed: int, count, block: int):
    """A block of a group for every row, by a hash of the column."""
    return F.pmod(F.xxhash64(column, F.lit(seed)), F.ceil(count / block)).cast("long")


def ngram_jaccard(
    documents: DataFrame, *, size: int = 5, percent: int = 80, universe: float = 1 / 3,
    frequent: int = 64, hot: int = 2048, block: int = 256, small: int = 200_000,
) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    ``documents`` has doc_id and text; other columns are ignored. Words are
    ``[^\\x20\\x09-\\x0D]+`` of the whole text with A-Z lower-cased; a document's
    set is its distinct ``size``-word shingles, or the whole sequence as one if
    it has fewer words. Documents link when 100 * intersection >= percent *
    union. component_id is the smallest doc_id reachable by links.

    Null or empty texts have an empty set and link with nothing. Rows without a
    doc_id are left out. Rows that repeat a doc_id count as one document, with
    the largest of their sets. A very long text is hashed in slices; its set is
    whole. An empty table gives an empty result.

    None of these changes the result: ``small`` bounds the ids that may be
    broadcast (40 bytes each), beyond it they are joined by shuffle; ``frequent``
    and ``hot`` are the frequencies from which tokens are indexed in pairs and
    triples; ``block`` is the side of a verified block, and a group with more
    open documents than four blocks gets longer keys.
    """
    if percent <= 50:
        raise ValueError("percent must be over 50")
    parts = partitions(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    meta = materialize(signatures(docs, size, percent, universe, frequent, hot))
    classes = materialize(
        meta.where("n > 0").groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n", "silent", "keys"), "doc_id").alias("s"))
        .select("h1", "h2", "rep", "s.*")
    )
    # the share of tokens of its own, roughly; among equals, who has more keys has more that others have too
    own = F.floor(F.col("silent") * 64 / F.col("n")) * (1 << 32) - F.size("keys")
    star = materialize(_star(classes.select(F.explode("keys").alias("key"), F.col("rep").alias("doc_id"), "n", own.alias("own"), F.lit(1).alias("out"))))
    needed = star.select("doc_id").unionByName(star.select(F.col("head").alias("doc_id"))).distinct()
    needed = classes.select(F.col("rep").alias("doc_id"), "n", "h1", "h2").join(needed, "doc_id", "left_semi")
    needed = F.broadcast(needed) if needed.count() <= small else needed.hint("shuffle_hash")
    sets = materialize(docs.join(needed, "doc_id").select("doc_id", "text", "n", "h1", "h2").mapInArrow(_sets(size), "doc_id long, tokens binary"))

    def verified(jobs: DataFrame) -> DataFrame:
        """Links (a, b) between the sides of the jobs (job, doc_id, side)."""
        return jobs.join(sets, "doc_id").groupBy("job").applyInArrow(_verify(percent), "a long, b long")

    def merged(label: DataFrame | None, links: DataFrame) -> DataFrame:
        found = connected_components(links if label is None else links.unionByName(label), small)
        release(label, links)
        return found

    def job(i, j, *sizes):
        return F.struct("head", i.alias("i"), j.alias("j"), *sizes).alias("job")

    def told(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner") -> DataFrame:
        """``rows`` with the facts (a stored table) of their key, which may hold a third of them."""
        if facts.count() <= small:
            return rows.join(F.broadcast(facts), key, how)
        return join_salted(rows, facts, key, "doc_id", how)

    def opened(members: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The groups (head, head_n, doc_id, n, own) with documents that are out, that is outside the component of their head, and facts of them."""
        groups = told(members, label.select(F.col("a").alias("doc_id"), F.col("b").alias("component")), "doc_id", "left")
        groups = told(groups, label.select(F.col("a").alias("head"), F.col("b").alias("top")), "head", "left")
        groups = groups.withColumn("out", F.coalesce("component", "doc_id") != F.coalesce("top", "head"))
        facts = materialize(groups.groupBy("head").agg(
            F.sum(F.col("out").cast("long")).alias("outside"), F.count(F.lit(1)).alias("c"), F.min("n").alias("least"),
            F.count_if(F.col("n") < F.col("head_n")).alias("below"),
        ).where("outside > 0 and c > 2"))
        return told(groups, facts, "head"), facts

    none, whole = F.lit(-1).cast("long"), F.lit(-1).cast("long")
    label, open_rows, most = None, None, 4 * block
    while True:
        # every candidate against the head of its key
        sized = star.where(f"least(n, head_n) * 100 >= {percent} * greatest(n, head_n)")
        counts = materialize(sized.groupBy("head").agg(F.count(F.lit(1)).alias("c")))
        counted = told(sized, counts, "head")
        near = counted.select(job(_deal("doc_id", 0, F.col("c"), block), none), "doc_id", "head")
        heads_of = near.select("job", F.col("head").alias("doc_id")).distinct().withColumn("side", F.lit(0))
        links = materialize(verified(near.select("job", "doc_id", F.lit(1).alias("side")).unionByName(heads_of)))
        label = merged(label, links)

        members = (
            star.select("head", "head_n", "doc_id", "n", "own")
            .unionByName(star.selectExpr("head", "head_n", "head AS doc_id", "head_n AS n", "0L AS own").distinct())
        )
        rows, facts = opened(members, label)
        rows = materialize(rows)
        # a small group is one job that gets each member once
        in_one = F.col("c") <= block
        jobs = rows.where(in_one).select(job(whole, whole), "doc_id", F.when(F.col("out"), BOTH).otherwise(1).alias("side"))
        # in a larger one those that are out, block by block, meet the others, or only those that are smaller than the head
        part = F.col("outside") <= most
        blocks = rows.where(~in_one).withColumn("met", F.when(part, F.col("c")).otherwise(F.col("below"))).where("met > 0")
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(n / block) - 1))
        left = blocks.where("out").withColumn("i", _deal("doc_id", 2, F.col("outside"), block)).withColumn("j", each(F.col("met")))
        right = blocks.where(part | (F.col("n") < F.col("head_n"))).withColumn("j", _deal("doc_id", 1, F.col("met"), block)).withColumn("i", each(F.col("outside")))
        jobs = (
            jobs.unionByName(left.select(job(F.col("i"), F.col("j")), "doc_id", F.lit(0).alias("side")))
            .unionByName(right.select(job(F.col("i"), F.col("j")), "doc_id", F.lit(1).alias("side")))
        )
        links = materialize(verified(jobs))
        label = merged(label, links)

        # the larger groups get longer keys, as long as that leaves half of what is open
        many = rows.where(~in_one & ~part & (F.col("doc_id") != F.col("head")))
        open_rows, before = many.where("out").count(), open_rows
        if not open_rows:
            release(star, rows, facts, counts)
            break
        if before is not None and 2 * open_rows > before:
            most = 1 << 62
        many = many.select(
            job(_deal("doc_id", 3, F.col("c"), block), none), "head", "doc_id", "n", "own", F.col("out").cast("long").alias("out"), "least", F.lit(1).alias("side")
        )
        heads_of = many.select("job", "head").distinct().selectExpr("job", "head", "head AS doc_id", "0L AS n", "0L AS own", "0L AS out", "0L AS least", "0 AS side")
        longer = materialize(
            many.unionByName(heads_of).join(sets, "doc_id").groupBy("job").applyInArrow(_residual(percent, parts), CELL)
            .groupBy("part").applyInArrow(_shared(parts), CELL).groupBy("part").applyInArrow(_extend, MEMBER)
        )
        release(star, rows, facts, counts)
        star = materialize(_star(longer.select(F.explode("keys").alias("key"), "doc_id", "n", "own", "out")))
        release(longer)
    release(sets)
    named = classes.select("h1", "h2", "rep").join(
        label.select(F.col("a").alias("rep"), F.col("b").alias("component")), "rep", "left"
    ).select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    return meta.join(named, ["h1", "h2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
    )
