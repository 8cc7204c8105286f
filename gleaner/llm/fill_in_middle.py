"""Fill-in-the-middle: texts are cut into line units and assembled in another order by secondary sorting of pieces."""

import hashlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches

# Marks of the assembled text.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Order of the segments in a text, and in the output of each form.
TEXT_ORDER = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
FORMS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: Bytes of a piece at most, unless one line is longer; and of the pieces of one Arrow batch.
PIECE, BATCH = 1 << 16, 4 << 20
# row: the row a piece belongs to; at: its place in the output. Place -1 has no bytes but tells of the whole row.
PIECES = "row_part int, row_at long, at int, doc_id string, n long, form string, prefix_chars long, middle_chars long, piece binary"
NAMES = [c.split()[0] for c in PIECES.split(", ")]
ROW = ["row_part", "row_at"]


def n_chars(data: bytes) -> int:
    """Code points of UTF-8 text."""
    return int(np.count_nonzero(np.frombuffer(data, dtype=np.uint8) & 0xC0 != 0x80))


def draws(seed: int, doc_id: str) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]


def cut(data: bytes, doc_id: str, seed: int, share: int, spm_share: int):
    """Number of units, form, and the byte bounds and unit bounds of the three segments (None for plain)."""
    ends = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10) + 1
    if len(data) and not data.endswith(b"\n"):
        ends = np.append(ends, len(data))
    n = len(ends)
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not n or h3 % 100 >= share or any(mark in data for mark in TEXT_ORDER):
        return n, "plain", ends, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, "spm" if h4 % 100 < spm_share else "psm", ends, (0, a, b, n)


def _pieces(data: bytes, ends: np.ndarray, first: int, last: int):
    """Units ``first`` to ``last`` in chunks of whole units of up to PIECE bytes; a longer unit is cut."""
    at = int(ends[first - 1]) if first else 0
    stop = int(ends[last - 1]) if last else 0
    while at < stop:
        k = np.searchsorted(ends[first:last], at + PIECE, "right")
        end = int(ends[first + k - 1]) if k and ends[first + k - 1] > at else min(at + PIECE, stop)
        yield data[at:end]
        at = end


class _Rows:
    """Rows of PIECES, handed on in frames of bounded size."""

    def __init__(self):
        self.rows, self.size = [], 0

    def add(self, *row):
        self.rows.append(row)
        self.size += len(row[-1] or b"") + 64
        if self.size >= BATCH:
            yield self.frame()

    def frame(self) -> pd.DataFrame:
        out = pd.DataFrame(self.rows, columns=NAMES, dtype=object)
        self.rows, self.size = [], 0
        return out


def fill_in_middle(docs: DataFrame, doc: str = "doc_id", text: str = "text", seed: int = 7, share: int = 100, spm_share: int = 50) -> DataFrame:
    """The transformed texts as ordered pieces, rows of ``PIECES``: chunks of units and marks, partitioned by row and sorted by their
    place in the output, so that a reader streams each output from front to back.

    A text of n lines is cut after two drawn numbers of lines. ``share`` per cent of the texts are transformed, ``spm_share`` per cent of
    these put the suffix first; texts that are empty or contain a mark stay plain. Place -1 stands before each row's pieces.

    Pieces are dealt out by their row, not by id, so rows that share an id are independent, and repeated rows are returned as
    often as they come. Null texts are empty; a null id counts as an empty one in the draw; an empty table gives no pieces; further columns are
    ignored. This is a secondary sort: repartition by row, and sort within partitions by row and place."""
    bounded_batches(docs.sparkSession)

    def emit(frames):
        part, row, rows = TaskContext.get().partitionId(), 0, _Rows()
        for frame in frames:
            for i, data in zip(frame["doc_id"], frame["text"]):
                i, data = None if pd.isna(i) else i, bytes(data) if data is not None else b""
                n, form, ends, bounds = cut(data, i or "", seed, share, spm_share)
                chars = [None, None]
                if bounds:
                    edge = [int(ends[b - 1]) if b else 0 for b in bounds]
                    segments = {m: (bounds[k], bounds[k + 1]) for m, k in TEXT_ORDER.items()}
                    chars = [n_chars(data[edge[0]:edge[1]]), n_chars(data[edge[1]:edge[2]])]
                yield from rows.add(part, row, -1, i, n, form, *chars, None)
                at = 0
                for mark in FORMS.get(form, (None,)):
                    if mark:
                        yield from rows.add(part, row, at, None, None, form, None, None, mark)
                        at += 1
                    for piece in _pieces(data, ends, *(segments[mark] if mark else (0, n))):
                        yield from rows.add(part, row, at, None, None, form, None, None, piece)
                        at += 1
                row += 1
        yield rows.frame()

    chosen = docs.select(F.col(f"`{doc}`").cast("string").alias("doc_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    return chosen.mapInPandas(emit, PIECES).repartition(*ROW).sortWithinPartitions(*ROW, "at")


class _Reader:
    """Reads one output from front to back and tells for each stretch of bytes its place in the text; holds two bytes at most."""

    def __init__(self, form: str):
        self.left, self.segment, self.held = list(FORMS.get(form, ())), 0 if form in FORMS else None, b""

    def feed(self, data: bytes, last: bool = False):
        """(segment, bytes) of what is settled. A mark may be split over pieces, so the end of one waits for the next."""
        data, self.held = self.held + data, b""
        while self.left and (found := data.find(self.left[0])) >= 0:
            if found:
                yield self.segment, data[:found]
            self.segment, data = TEXT_ORDER[self.left.pop(0)], data[found + 3:]
        if self.left and not last:
            data, self.held = data[:-2], data[-2:]
        if data:
            yield self.segment or 0, data


def restore(pieces: DataFrame) -> DataFrame:
    """The texts rebuilt from output and form alone: ``pieces`` of :func:`fill_in_middle`, whose outputs are read as streams, parted at the
    marks, and resorted within their partitions by place in the text.

    Place -1 of each row tells, besides what it told, ``output_sha256`` of the output that was read."""

    def read(frames):
        rows, row, reader, digest, told, places = _Rows(), None, None, None, None, None

        def tag(found):
            for segment, data in found:
                places[segment] += 1
                yield from rows.add(*row, segment << 28 | places[segment], None, None, None, None, None, data)

        def close():
            if row is not None:
                yield from tag(reader.feed(b"", last=True))
                yield from rows.add(*row, -1, *told, digest.hexdigest().encode())

        for frame in frames:
            clean = frame.astype(object).where(frame.notna(), None)
            for part, k, at, *about, piece in clean.itertuples(index=False, name=None):
                if (part, k) != row:
                    yield from close()
                    row, told, reader, digest, places = (part, k), about, _Reader(about[2]), hashlib.sha256(), [0, 0, 0]
                if at >= 0:
                    digest.update(piece)
                    yield from tag(reader.feed(bytes(piece)))
        yield from close()
        yield rows.frame()

    return pieces.mapInPandas(read, PIECES).sortWithinPartitions(*ROW, "at")


def _streams(pieces: DataFrame, schema: str, opened, grown, closed) -> DataFrame:
    """A row for each row's pieces, which come in order: ``opened()`` makes a state, ``grown(state, piece)`` adds to it, and
    ``closed(told, state)`` is the row."""

    def run(frames):
        names = [c.split()[0] for c in schema.split(", ")]
        row, state, told = None, None, None
        for frame in frames:
            out = []
            clean = frame.astype(object).where(frame.notna(), None)
            for part, k, at, *about, piece in clean.itertuples(index=False, name=None):
                if (part, k) != row:
                    if row is not None:
                        out.append(closed(told, state))
                    row, told, state = (part, k), (*about, piece), opened()
                if at >= 0:
                    grown(state, piece)
            if out:
                yield pd.DataFrame(out, columns=names, dtype=object)
        if row is not None:
            yield pd.DataFrame([closed(told, state)], columns=names, dtype=object)

    return pieces.mapInPandas(run, schema)


def assemble(pieces: DataFrame) -> DataFrame:
    """One row for each text: ``doc_id``, ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and the whole ``text`` that the pieces make, of
    :func:`fill_in_middle` the output, of :func:`restore` the text it came from."""
    schema = "doc_id string, n long, form string, prefix_chars long, middle_chars long, text binary"
    return _streams(pieces, schema, bytearray, lambda text, piece: text.extend(piece),
                    lambda told, text: (*told[:5], bytes(text))).withColumn("text", F.col("text").cast("string"))


def digest_columns(docs: DataFrame, doc: str = "doc_id", **options) -> DataFrame:
    """``doc_id``, ``n``, ``form``, lengths, and digests of output and rebuilt text, each taken piece by piece."""

    schema = "doc_id string, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    found = _streams(restore(fill_in_middle(docs, doc, **options)), schema, hashlib.sha256, lambda digest, piece: digest.update(piece),
                     lambda told, digest: (*told[:5], bytes(told[5]).decode(), digest.hexdigest()))
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc].dataType))
