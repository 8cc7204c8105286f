"""Product quantisation: vectors become short codes; the nearest codebook entry is found by intersecting bitmasks of slices."""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.storage import materialise

#: Entries of a codebook: one bit each in an unsigned 64-bit mask.
ENTRIES = 64
#: Integer components stop here on either side, so that squared distances fit in 64 bits.
LIMIT = 1 << 28
#: Labels that hold more than one row in so many are joined by broadcast, so at most this many are.
HEAVY = 1000


@dataclass
class Slices:
    """For each dimension of a codebook (entries x dimensions): the order of its coordinates, they themselves, and the mask of the entries
    before each place."""

    entries: np.ndarray
    order: np.ndarray
    coordinates: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray) -> "Slices":
        order = np.argsort(entries, axis=0, kind="stable")
        bits = np.left_shift(np.uint64(1), order.astype(np.uint64))
        before = np.zeros((len(entries) + 1, entries.shape[1]), dtype=np.uint64)
        before[1:] = np.bitwise_or.accumulate(bits, axis=0)
        return cls(entries, order, np.take_along_axis(entries, order, axis=0), before)

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Of each row of ``x`` the mask of the entries that lie within ``radius`` of it in every dimension."""
        mask = np.full(len(x), np.iinfo(np.uint64).max, dtype=np.uint64)
        for d in range(x.shape[1]):
            low = np.searchsorted(self.coordinates[:, d], x[:, d] - radius, "left")
            high = np.searchsorted(self.coordinates[:, d], x[:, d] + radius, "right")
            mask &= self.before[high, d] ^ self.before[low, d]
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (ties to the lower one) and squared distance, for each row of ``x``.

        The initial radius is the distance to the best of the entries that stand next to the row in each dimension. No nearer entry
        lies farther off than that in any dimension, so the masks' intersection holds the nearest one and all its ties."""
        first = np.full(len(x), np.iinfo(np.int64).max)
        for d in range(x.shape[1]):
            place = np.minimum(np.searchsorted(self.coordinates[:, d], x[:, d]), len(self.entries) - 1)
            np.minimum(first, ((x - self.entries[self.order[place, d]]) ** 2).sum(axis=1), out=first)
        # One more than the floating root is at least the true one.
        mask = self.candidates(x, np.sqrt(first.astype(np.float64)).astype(np.int64) + 1)
        held = np.unpackbits(mask.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, entry = np.nonzero(held)
        distance = ((x[row] - self.entries[entry]) ** 2).sum(axis=1)
        starts = np.searchsorted(row, np.arange(len(x)))
        least = np.minimum.reduceat(distance, starts) if len(x) else first
        hit = np.flatnonzero(distance == least[row])
        return entry[hit[np.searchsorted(row[hit], np.arange(len(x)))]], least


def _integers(flat: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(flat * scale), -LIMIT, LIMIT).astype(np.int64)


def _batches(frames, width: int, scale: int):
    """Each Arrow batch with its vectors as integers, continued with zeros to ``width``."""
    for batch in frames:
        vectors = batch.column("vec")
        sizes = np.diff(vectors.offsets.to_numpy())
        x = np.zeros((len(sizes), width))
        x[np.arange(width) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
        yield batch, _integers(x, scale)


def _assign(x: np.ndarray, slices: list[Slices]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x parts) and squared distances summed over parts."""
    dims = x.shape[1] // len(slices)
    found = [s.nearest(x[:, p * dims:(p + 1) * dims]) for p, s in enumerate(slices)]
    return np.stack([f[0] for f in found], axis=1), sum(f[1] for f in found)


def _codebooks(vectors: DataFrame, width: int, parts: int, rounds: int, scale: int) -> np.ndarray:
    """Entries as integers (parts x entries x dimensions), after ``rounds`` of assigning all vectors and averaging.

    Only the first vectors and, each round, one sum for every component of every entry reach the driver."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(ENTRIES).select("vec").collect()
    start = np.zeros((len(first), width))
    for k, row in enumerate(first):
        start[k, :len(row["vec"])] = row["vec"]
    dims = width // parts
    books = _integers(start, scale).reshape(len(first), parts, dims).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        slices = [Slices.of(b) for b in books]

        def sums(frames, slices=slices):
            total, n = np.zeros((parts, len(slices[0].entries), dims), dtype=np.int64), np.zeros((parts, len(slices[0].entries)), dtype=np.int64)
            for _, x in _batches(frames, width, scale):
                codes, _ = _assign(x, slices)
                for p in range(parts):
                    n[p] += np.bincount(codes[:, p], minlength=n.shape[1])
                    for d in range(dims):  # a batch's sums are far below 2^53, so doubles hold them exactly
                        total[p, :, d] += np.bincount(codes[:, p], x[:, p * dims + d], n.shape[1]).astype(np.int64)
            part, entry = np.nonzero(n)
            flat = np.arange(dims)
            yield pa.RecordBatch.from_pydict({
                "part": np.repeat(part, dims).astype(np.int32), "entry": np.repeat(entry, dims).astype(np.int32), "at": np.tile(flat, len(part)).astype(np.int32),
                "total": total[part, entry].ravel(), "n": np.repeat(n[part, entry], dims)})

        merged = vectors.select("vec").mapInArrow(sums, "part int, entry int, at int, total long, n long").groupBy("part", "entry", "at").agg(
            F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        for row in merged.collect():  # at most one row for each component of the codebooks
            books[row["part"], row["entry"], row["at"]] = int(row["total"]) // row["n"]
    return books


def compress(vectors: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label", parts: int = 16, rounds: int = 2,
             scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors, and the codebooks (parts x entries x dimensions) that they refer to.

    Rows: ``vec_id``, ``label``, ``code`` (an index for each part), ``error`` (squared distances summed over parts). Components become
    floor(``scale`` * x). Each part's codebook starts as that part of the 64 smallest ids' vectors and is averaged ``rounds`` times
    over all vectors, rounding down; unused entries stay.

    Vectors that are null or hold null or non-finite components have no row. Rows without an id come last in the order of ids; of rows that
    share an id, the vector that sorts first goes first, and each is an entry and a row of its own. Fewer than 64 vectors make fewer entries.
    Widths that differ, or that the parts don't divide, are continued with zeros to the next multiple above the widest; empty vectors are
    zeros. Integer components stop at 2^28 on either side. An empty table gives no rows; further columns are ignored."""
    finite = F.col("vec").isNotNull() & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    base = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label"),
                          F.col(f"`{vec}`").cast("array<double>").alias("vec")).where(finite)
    widest = base.agg(F.max(F.size("vec"))).first()[0]
    width = max(-(-(widest or 0) // parts), 1) * parts
    books = _codebooks(base, width, parts, rounds, scale)
    slices = [Slices.of(b) for b in books]

    def coded(frames):
        for batch, x in _batches(frames, width, scale):
            codes, error = _assign(x, slices) if len(x) else (np.zeros((0, parts), np.int64), np.zeros(0, np.int64))
            flat = pa.array(codes.astype(np.int32).ravel())
            code = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * parts), flat)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), code, pa.array(error)], ["vec_id", "label", "code", "error"])

    kind = base.schema["label"].dataType.simpleString()
    return base.mapInArrow(coded, f"vec_id long, label {kind}, code array<int>, error long"), books


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``, the error summed over rows of equal label, nulls together.

    Labels that hold more than a thousandth of all rows, so at most a thousand, are joined by broadcast; the others hold too few rows
    each to burden a task."""
    codes = materialise(codes, "codes")
    sums = materialise(codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    share = sums.agg(F.sum("n")).first()[0] or 0
    heavy = sums.where(F.col("n") * HEAVY > share).select(F.col("label").alias("heavy"), F.col("label_error").alias("heavy_error"), F.lit(True).alias("found"))
    near = codes.join(F.broadcast(heavy), F.col("label").eqNullSafe(F.col("heavy")), "left")
    rest = sums.where(F.col("n") * HEAVY <= share).select(F.col("label").alias("light"), "label_error")
    columns = codes.columns
    return near.where("found").select(*columns, F.col("heavy_error").alias("label_error")).unionByName(
        near.where("found is null").join(rest, F.col("label").eqNullSafe(F.col("light"))).select(*columns, "label_error"))


def hex_code(code: Column) -> Column:
    return F.lower(F.array_join(F.transform(code, lambda c: F.lpad(F.hex(c), 2, "0")), ""))


def codebooks_text(books: np.ndarray) -> str:
    """All components in decimal, by part, entry, and position within the part."""
    return ",".join(map(str, books.ravel().tolist()))


def digest_columns(vectors: DataFrame, **options) -> DataFrame:
    """Hexadecimal codes, errors and the codebooks' digest of :func:`compress`."""
    codes, books = compress(vectors, **options)
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    return with_label_error(codes).select("vec_id", hex_code(F.col("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
