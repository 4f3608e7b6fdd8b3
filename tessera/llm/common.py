"""Shared parts of the training-data operators.

* ``materialize`` cuts lineage with a Parquet table in the shared checkpoint
  folder, so that a lost executor costs a re-read, not a recomputation.
* ``WordHasher`` hashes every word of a batch of texts with numpy, in bounded
  windows, whatever the length of a text.
* ``pack`` / ``unpack`` move numpy columns through Spark as one binary cell, so
  that a shuffle handles a few large rows instead of millions of small ones.
"""

from __future__ import annotations

import struct
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, removed when the JVM ends.

    Only a local master may go without that setting; it then gets a temporary
    folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _LOCAL_DIRS.setdefault(app, tempfile.mkdtemp(prefix="tessera-"))
    path = f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return hadoop.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again; see ``release``."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    df.write.parquet(f"{folder}/t")
    table = spark.read.schema(df.schema).parquet(f"{folder}/t")
    table._tessera_folder = folder
    return table


def release(*tables: DataFrame | None) -> None:
    """Delete the files of tables that ``materialize`` returned and that nothing will read again."""
    for table in tables:
        if table is not None:
            jvm, conf = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
            path = jvm.org.apache.hadoop.fs.Path(table._tessera_folder)
            path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_salted(rows: DataFrame, facts: DataFrame, key: str, spread: str, how: str = "inner", salts: int = 64) -> DataFrame:
    """``rows`` with the ``facts`` of their key, one row a key.

    A key may hold a third of all rows, so the facts go to the parts of each
    key that occur, dealt by the column ``spread``, and rows meet them there;
    no task gets a whole key.
    """
    salted = rows.withColumn("part", F.pmod(F.xxhash64(spread), F.lit(salts)))
    spread_out = salted.select(key, "part").distinct().join(facts, key, how)
    return salted.join(spread_out, [key, "part"], how).drop("part")


def join_by_id(docs: DataFrame, facts: DataFrame, how: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` joined with ``facts`` (one row a key, few columns) by shuffle, at every size alike.

    Rows without the key find nothing; they are spread by their text, so that
    they don't meet in one task.
    """
    spread = F.when(F.col(key).isNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))
    keyed = facts.withColumn("__spread", F.lit(0).cast("long")).hint("shuffle_hash")
    return docs.withColumn("__spread", spread).join(keyed, [key, "__spread"], how).drop("__spread")


# --- numpy columns in one binary cell ---------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: their count, then per array dtype, length and data."""
    out = [struct.pack("<i", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        code = a.dtype.str.encode().ljust(4)
        out += [code, struct.pack("<q", len(a)), a.tobytes()]
    return b"".join(out)


def unpack(cell: bytes) -> list[np.ndarray]:
    (count,), at, out = struct.unpack_from("<i", cell, 0), 4, []
    for _ in range(count):
        kind = np.dtype(bytes(cell[at : at + 4]).decode().strip())
        (n,) = struct.unpack_from("<q", cell, at + 4)
        out.append(np.frombuffer(cell, kind, n, at + 12))
        at += 12 + n * kind.itemsize
    return out


def route(keys: np.ndarray, parts: int) -> np.ndarray:
    """A part in ``range(parts)`` for every 64-bit key."""
    return ((mix(keys) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def split_by_part(part: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The arrays' rows, dealt out by part; parts without rows are left out."""
    few = part.max(initial=0) < 1 << 16 and part.min(initial=0) >= 0
    order = np.argsort(part.astype(np.uint16) if few else part, kind="stable")  # short integers sort in linear time
    part = part[order]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    ends = np.r_[cuts[1:], len(part)]
    arrays = [a[order] for a in arrays]
    for lo, hi in zip(cuts, ends, strict=False):
        yield int(part[lo]), [a[lo:hi] for a in arrays]


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return starts, np.diff(np.r_[starts, len(sorted_keys)])


# --- hashing ----------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit constants made by rule from a seed."""
    steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(steps + np.uint64(seed)) | np.uint64(1)


BASE = int(constants(1, 11)[0])
BASE_INVERSE = pow(BASE, -1, 1 << 64)
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


WHITE_SPACE = byte_set((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


PRIME = (1 << 31) - 1
#: Two bases of polynomials modulo PRIME.
BASES = tuple(int(b) % PRIME for b in constants(2, 13))


def _reduced(x: np.ndarray) -> np.ndarray:
    """Numbers below 2^62 modulo PRIME, or PRIME itself for some that are 0."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def _accumulated(base: int, n: int) -> np.ndarray:
    """The powers base ** 0 .. base ** n modulo PRIME, by doubling."""
    powers = np.ones(1, np.uint64)
    while len(powers) <= n:
        powers = np.concatenate([powers, _reduced(powers * np.uint64(pow(base, len(powers), PRIME)))])
    return powers[: n + 1]


class WordHasher:
    """62-bit hashes of the words of UTF-8 texts, A-Z lower-cased.

    A word is a maximal run of bytes outside ``separators`` (ASCII bytes only,
    so no character is cut). A word's hash is made of two polynomials over its
    bytes modulo a prime, of different bases, taken from prefix sums that are
    scaled back to the word's start; with a prime there are no texts that
    collide at every base. Memory is about 80 bytes for each byte of a window; a
    window ends at a separator, so it is longer than ``window`` only for a
    single longer word.
    """

    def __init__(self, separators: np.ndarray, window: int = 1 << 18):
        self.separators, self.window = separators, window
        self.values = [_reduced(constants(256, seed) >> np.uint64(2))[ASCII_LOWER] for seed in (23, 29)]
        self._powers(window)

    def _powers(self, n: int) -> None:
        self.up = [_accumulated(b, n) for b in BASES]
        self.down = [_accumulated(pow(b, -1, PRIME), n) for b in BASES]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and each text's first word (one more entry at the end)."""
        hashes, starts, at, n = [], [], 0, len(data)
        while at < n:
            end = self._cut(data, offsets, at)
            first, h = self._window(data[at:end], offsets[(offsets >= at) & (offsets <= end)] - at)
            starts.append(first + at)
            hashes.append(h)
            at = end
        words = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.searchsorted(words, offsets)

    def _cut(self, data: np.ndarray, offsets: np.ndarray, at: int) -> int:
        reach = self.window
        while at + reach < len(data):
            stop = at + reach
            text = offsets[np.searchsorted(offsets, stop, "right") - 1]
            gaps = np.flatnonzero(self.separators[data[at:stop]])
            cut = max(int(text), at + int(gaps[-1]) + 1 if len(gaps) else 0)
            if cut > at:
                return cut
            reach *= 2
        return len(data)

    def _window(self, data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if n >= len(self.up[0]):
            self._powers(n)
        gap = self.separators[data]
        begins, ends = np.ones(n, bool), np.ones(n, bool)
        begins[1:], ends[:-1] = gap[:-1], gap[1:]
        begins[breaks[breaks < n]] = True
        ends[breaks[breaks > 0] - 1] = True
        first, last = np.flatnonzero(~gap & begins), np.flatnonzero(~gap & ends) + 1
        halves, sums = [], np.zeros(n + 1, np.uint64)
        for values, up, down in zip(self.values, self.up, self.down, strict=True):
            x = values[data] * up[:n]
            np.cumsum((x & np.uint64(PRIME)) + (x >> np.uint64(31)), out=sums[1:])
            halves.append(_reduced(_reduced(sums[last] - sums[first]) * down[first]))
        # equal up to bytes of value 0 at the end, which the length tells apart
        return first, mix(halves[0] << np.uint64(32) | halves[1]) ^ mix((last - first).astype(np.uint64))


def text_windows(column: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: first row, bytes, offsets. Null counts as empty."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    column = column.fill_null(b"")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, len(column))
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
