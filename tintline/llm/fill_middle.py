"""Fill-in-the-middle texts, cut by rank and select on packed boundary bits.

A batch's texts lie end to end. One bit for each byte says whether a token begins there,
another whether a code point does. A directory of the bits' counts by block answers in a
few steps how many bits stand before a byte (rank) and where the k-th bit is (select). So
a text's number of tokens is a difference of two ranks, the byte at which a token begins
is one select, and the code points between two bytes are again two ranks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS
from .packed import binary_buffers

#: Markers before the prefix, the suffix and the middle.
MARKERS = ("<P>", "<S>", "<M>")
#: Bytes of text that are handled at once.
SLICE_BYTES = 8 << 20
#: 64-bit words of a block of the directory.
BLOCK_WORDS = 8

_WHITE = np.zeros(256, bool)
_WHITE[[ord(c) for c in WS]] = True


class Bits:
    """A bit vector with rank and select."""

    def __init__(self, bits: np.ndarray) -> None:
        size = 64 * BLOCK_WORDS
        packed = np.packbits(bits, bitorder="little")
        full = np.zeros((len(bits) // size + 1) * size // 8, np.uint8)  # a word is left beyond the end
        full[: len(packed)] = packed
        self.words = full.view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int64).reshape(-1, BLOCK_WORDS)
        within = np.cumsum(counts, axis=1)
        self.within = (within - counts).astype(np.uint16)
        self.before = np.concatenate([[0], np.cumsum(within[:, -1])])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        word = at >> 6
        low = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word // BLOCK_WORDS] + self.within.reshape(-1)[word] + np.bitwise_count(low)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The places of the k-th set bits, counted from 0."""
        block = np.searchsorted(self.before, k, "right") - 1
        rest = k - self.before[block]
        inner = (self.within[block] <= rest[:, None]).sum(axis=1) - 1
        rest = rest - self.within[block, inner]
        word = block * BLOCK_WORDS + inner
        bits = np.unpackbits(self.words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return word * 64 + (np.cumsum(bits, axis=1) > rest[:, None]).argmax(axis=1)


def token_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a token begins at each byte; texts lie from ``at[k]`` to ``at[k + 1]``.

    A token is white space, if any, with the word behind it; white space that ends a text is one, too.
    """
    white = _WHITE[data]
    starts = white.copy()
    starts[1:] &= ~white[:-1]
    starts[at[:-1][at[:-1] < at[1:]]] = True
    return starts


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    at, begin = binary_buffers(batch.column(1))[0], 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(at, at[begin] + SLICE_BYTES, "right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


def _arranged(markers: tuple[str, str, str]):
    p, s, m = (x.encode() for x in markers)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, data = binary_buffers(batch.column(1))
        data, at = data[at[0] : at[-1]], at - at[0]
        one_cut, other_cut = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
        wanted = batch.column(4).to_pylist()
        bits, points = Bits(token_starts(data, at)), Bits((data & 0xC0) != 0x80)
        first = bits.rank(at[:-1])
        n = bits.rank(at[1:]) - first
        a, b = one_cut % (n + 1), other_cut % (n + 1)
        low, high = np.minimum(a, b), np.maximum(a, b)

        def bytes_at(token: np.ndarray) -> np.ndarray:
            out, inside = at[1:].copy(), token < n
            out[inside] = bits.select((first + token)[inside])
            return out

        begin, left, right, past = at[:-1], bytes_at(low), bytes_at(high), at[1:]
        chars = [points.rank(right) - points.rank(left), points.rank(left) - points.rank(begin)]
        forms, outputs, whole = [], [], data.tobytes()
        for i0, i1, i2, i3, form in zip(begin.tolist(), left.tolist(), right.tolist(), past.tolist(), wanted, strict=True):
            text = whole[i0:i3]
            if form == "plain" or not text or p in text or s in text or m in text:
                form, out = "plain", text
            else:
                parts = (p, whole[i0:i1]), (s, whole[i2:i3]), (m, whole[i1:i2])
                out = b"".join(marker + part for marker, part in (parts if form == "psm" else (parts[1], parts[0], parts[2])))
            forms.append(form)
            outputs.append(out)
        plain = np.array([f == "plain" for f in forms], bool)
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(chars[1], pa.int64(), mask=plain),
                   pa.array(chars[0], pa.int64(), mask=plain), pa.array(outputs, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["row", "n", "form", "prefix_chars", "middle_chars", "output"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(one, _slices(batch))

    return run


def fill_middle(
    docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, markers: tuple[str, str, str] = MARKERS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Turn texts into prefix, suffix and middle, so that a model learns to fill in.

    A text's tokens are its words with the white space before them, and white space that
    ends it. The sha256 of "seed:id" gives four numbers of 32 bits: the first two, modulo
    the number of tokens plus one, are the two cuts; ``rate`` of a hundred texts by the
    third are changed, and of those ``spm_rate`` of a hundred by the fourth become
    suffix-prefix-middle ("spm"), others prefix-suffix-middle ("psm"). A text that is empty,
    or holds a marker already, stays as it is ("plain").

    Returns for every row of ``docs``: row (the whole row as a struct, so other columns may
    have any names), n (tokens), form, prefix_chars and middle_chars (code points; null if
    plain) and output. ``restored`` undoes it. A null text counts as empty, a null id as
    the string "null"; rows that share an id get the same numbers. Rows are handled by
    themselves, so nothing is shuffled; a very long text is one slice of its own, in memory
    of a few times its size.
    """
    if len({*markers}) < 3 or "" in markers or {x[0] for x in markers} & {*"".join(x[1:] for x in markers)}:
        raise ValueError("markers: three different texts are asked for, whose first characters come in none of them again")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"), 256)
    h = [F.conv(F.substring("_h", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    form = F.when(h[2] % 100 >= rate, "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    rows = docs.select(whole, F.col(text_col).cast("binary").alias("text"), digest.alias("_h")).select("row", "text", h[0].alias("a"), h[1].alias("b"), form.alias("form"))
    schema = rows.schema[:1]
    for name, kind in (("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "binary")):
        schema = schema.add(name, kind)
    return rows.mapInArrow(_arranged(markers), schema).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that ``output`` was made of. No marker can begin within a part and end in a marker."""
    parts = F.split(output, "|".join(rf"\Q{x}\E" for x in markers), -1)
    a, b, c = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(a, c, b)).when(form == "spm", F.concat(b, c, a)).otherwise(output)
