"""Fill-in-middle transformation over a Roaring-style set of unit boundaries.

A text is cut into units: runs of ASCII letters, and every other code point alone.  The
code point offsets at which a unit ends, and 0, form a set of integers.  The set is kept as
containers of ``CHUNK`` offsets, each in the smallest of three forms: a sorted array, a bit
map, or runs of consecutive offsets.  Cumulative cardinalities say how many members stand
before each container, so the offset after k units (the member of rank k) is a binary search
for the container and a select inside it; both cuts of a text come from one call.

A text is read in slices of one container, so a very long one needs little more than itself.
Which texts stay plain, the order of the parts and the two cuts are drawn from a hash of the
row's id: reruns agree, whatever the partitioning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Offsets a container spans, and the bytes of its bit map.
CHUNK = 1 << 16
BITMAP_BYTES = CHUNK // 8
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int64)


class Container(NamedTuple):
    """Members of one chunk, as offsets from its base.  ``kind``: array (sorted offsets), bitmap
    (a bit per offset) or run (first offsets; ``ends`` counts the members up to each run's end,
    for a bitmap those up to each byte's end)."""
    kind: str
    base: int
    data: np.ndarray
    ends: np.ndarray | None = None

    @classmethod
    def of(cls, base: int, members: np.ndarray) -> Container:
        """The smallest form of the sorted ``members``: 2 bytes a member, 4 a run, or all bits."""
        first = np.flatnonzero(np.diff(members, prepend=-2) != 1)
        best = min(2 * len(members), 4 * len(first), BITMAP_BYTES)
        if best == 4 * len(first):
            return cls("run", base, members[first].astype(np.uint16),
                       np.append(first[1:], len(members)).astype(np.int64))
        if best == 2 * len(members):
            return cls("array", base, members.astype(np.uint16))
        mask = np.zeros(CHUNK, np.uint8)
        mask[members] = 1
        packed = np.packbits(mask)
        return cls("bitmap", base, packed, np.cumsum(_BITS[packed]))

    def select(self, k: int) -> int:
        """The member of rank ``k`` inside this container."""
        if self.kind == "array":
            return self.base + int(self.data[k])
        at = int(np.searchsorted(self.ends, k, side="right"))
        inside = k - (int(self.ends[at - 1]) if at else 0)
        if self.kind == "run":
            return self.base + int(self.data[at]) + inside
        bits = np.flatnonzero(np.unpackbits(self.data[at:at + 1]))
        return self.base + 8 * at + int(bits[inside])

    def __len__(self) -> int:
        return len(self.data) if self.kind == "array" else int(self.ends[-1])


class BoundarySet:
    """0 and the end of every unit of a text, in code points."""

    def __init__(self, text: str):
        self.containers: list[Container] = []
        counts = []
        before = False  # the code point before the slice is a letter
        for base in range(0, len(text) + 1, CHUNK):
            # A slice decides offsets base .. base + CHUNK - 1; offset i ends a unit unless
            # the code points at i - 1 and i are both letters.
            part = np.frombuffer(text[base:base + CHUNK].encode("utf-32-le", "surrogatepass"), "<u4")
            letter = ((part | 32) - 97) < 26
            left = np.concatenate([[before], letter])[:min(CHUNK, len(text) + 1 - base)]
            right = np.append(letter, False)[:len(left)]
            members = np.flatnonzero(~(left & right))
            before = bool(letter[-1]) if len(letter) else False
            if len(members):
                self.containers.append(Container.of(base, members))
                counts.append(len(members))
        self.cumulative = np.cumsum(counts)

    def __len__(self) -> int:
        return int(self.cumulative[-1])

    def select(self, ranks: Iterable[int]) -> list[int]:
        """The members of ``ranks``: container search, then local select."""
        ranks = list(ranks)
        where = np.searchsorted(self.cumulative, ranks, side="right")
        return [self.containers[c].select(k - (int(self.cumulative[c - 1]) if c else 0))
                for k, c in zip(ranks, where)]


class Cut(NamedTuple):
    units: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def transform(text: str, draws: tuple[int, int, int, int], plain: int = 10, spm: int = 20) -> Cut:
    """The transformed text.  ``draws``: two for the cuts, then the percentages (of 100) that
    decide whether the text stays plain and whether its suffix comes first."""
    units = BoundarySet(text)
    n = len(units) - 1
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or draws[2] % 100 >= 100 - plain:
        return Cut(n, "plain", None, None, text)
    a, b = units.select(sorted(d % (n + 1) for d in draws[:2]))
    head, mid, tail = text[:a], text[a:b], text[b:]
    if draws[3] % 100 < spm:
        return Cut(n, "spm", a, b - a, f"{SUFFIX}{tail}{PREFIX}{head}{MIDDLE}{mid}")
    return Cut(n, "psm", a, b - a, f"{PREFIX}{head}{SUFFIX}{tail}{MIDDLE}{mid}")


def draws_of(row_id: str, seed: int = 1) -> tuple[int, int, int, int]:
    """The first four 32-bit groups of the SHA-256 of ``seed:id``."""
    h = hashlib.sha256(f"{seed}:{row_id}".encode()).digest()
    return tuple(int.from_bytes(h[4 * i:4 * i + 4], "big") for i in range(4))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1,
                   plain: int = 10, spm: int = 20) -> DataFrame:
    """Per row: id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output.

    A text that is null (read as empty), empty or holds a sentinel stays plain, as do ``plain``
    percent of the others by hash; of the rest ``spm`` percent have their suffix first.  A plain
    row's cuts are null.  A null id is drawn as the empty text; repeated rows each return and
    equal ids draw alike; an empty table returns no rows; other columns are ignored."""
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_seed"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    names = [id_col, "n", "form", "prefix_chars", "middle_chars", "output"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [transform(t.as_py(), draws_of(i.as_py(), seed), plain, spm)
                    for i, t in zip(b.column(1), b.column(2))]
            cols = list(zip(*rows)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]], names=names)
    return src.mapInArrow(run, f"`{id_col}` {kind}, n long, form string, prefix_chars long, "
                               "middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text behind ``output``: no part holds a sentinel, so the sentinels cut it exactly."""
    parts = F.split(F.substr(output, F.lit(len(PREFIX) + 1)), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, third = (F.get(parts, F.lit(i)) for i in range(3))
    return F.when(form == "plain", output).when(
        form == "psm", F.concat(first, third, second)).otherwise(F.concat(second, third, first))


def fim_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """``fill_in_middle`` with the digests of the output and of the text rebuilt from it."""
    out = fill_in_middle(docs, id_col, text_col, seed)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(id_col, "n", "form", "prefix_chars", "middle_chars",
                      digest(F.col("output")).alias("output_sha256"),
                      digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
