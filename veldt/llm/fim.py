"""Fill-in-the-middle transformation by block rotation inside one buffer.

A text is cut into units (a run of ASCII letters, or any other single
character).  Two cuts drawn from the hash of the document's id divide it into
prefix, middle and suffix.  The three sentinels are inserted into the text's
bytearray in front of the three parts, and two neighbouring blocks of that
buffer change places by three reversals (each block, then both together), so a
block of any length moves without a second text.  The same rotation with the
blocks' new lengths undoes it, and :func:`restore` rebuilds the text from the
output and its form alone.

Forms: ``psm`` is prefix, suffix, middle; ``spm`` suffix, prefix, middle;
``plain`` leaves the text as it is (empty texts, texts that hold a sentinel,
and the share ``plain_percent`` of all others).

Defined cases: null text counts as empty; a null doc_id draws its cuts from
the hash of the word ``null``; repeated rows each get the same output; texts
of any length are taken whole; other columns do not matter; an empty input
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.llm import common as C

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1:"
PLAIN_PERCENT = 10
SPM_PERCENT = 20

_P, _S, _M = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
#: bytes that start a code point
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False


# ------------------------------------------------------------- one buffer

def _reverse(v: np.ndarray, a: int, b: int) -> None:
    """Reverse v[a:b] where it stands; half of it is held beside it."""
    half = (b - a) // 2
    left = v[a:a + half].copy()
    v[a:a + half] = v[b - half:b][::-1]
    v[b - half:b] = left[::-1]


def rotate(buf: bytearray, a: int, b: int, c: int) -> None:
    """Exchange the neighbouring blocks buf[a:b] and buf[b:c] by three reversals."""
    v = np.frombuffer(buf, np.uint8)
    _reverse(v, a, b)
    _reverse(v, b, c)
    _reverse(v, a, c)


def exchange(text: bytes, first: int, second: int, form: str) -> bytearray:
    """The output for byte cuts ``first <= second``."""
    buf = bytearray(text)
    if form != "plain":
        buf[second:second] = _S
        buf[first:first] = _M
        buf[0:0] = _P
        start, end = len(_P) + first, len(_P) + second + len(_M)
        rotate(buf, start if form == "psm" else 0, end, len(buf))
    return buf


def rebuild(output: bytes, form: str) -> bytearray:
    """The text that :func:`exchange` was given, from its output."""
    buf = bytearray(output)
    if form != "plain":
        if form == "psm":
            start, turn = buf.index(_S), buf.index(_M)
        else:
            start, turn = 0, buf.index(_P)
        rotate(buf, start, turn, len(buf))
        for mark in (_S, _M, _P):  # from the back, so that the places before stay
            at = buf.index(mark)
            del buf[at:at + len(mark)]
    return buf


# ------------------------------------------------------------- in tasks

def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where units begin: a letter after no letter of its row, any other code point."""
    letter = _LETTER[data]
    start = _LEAD[data]
    start[1:] &= ~(letter[1:] & letter[:-1])
    rows = offsets[:-1][np.diff(offsets) > 0]
    start[rows] = True
    return np.flatnonzero(start)


_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                     ("middle_chars", pa.int64()), ("output", pa.string())])


def _transform(plain_percent: int, spm_percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = C.utf8(b.column(1))
            h = [b.column(k).to_numpy() for k in range(2, 6)]
            for i, j in C.slices(off):
                part, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
                starts = unit_starts(part, o)
                first = np.searchsorted(starts, o)
                n = np.diff(first)
                one, two = h[0][i:j] % (n + 1), h[1][i:j] % (n + 1)
                cut = np.append(starts, len(part))
                forms, before, between, outputs = [], [], [], []
                for r in range(j - i):
                    a, e = int(o[r]), int(o[r + 1])
                    text = part[a:e].tobytes()
                    plain = e == a or int(h[2][i + r]) % 100 >= 100 - plain_percent or _P in text or _S in text or _M in text
                    form = "plain" if plain else "spm" if int(h[3][i + r]) % 100 < spm_percent else "psm"
                    x, y = (int(min(cut[first[r] + t], e)) - a for t in sorted((int(one[r]), int(two[r]))))
                    forms.append(form)
                    before.append(None if plain else int(np.count_nonzero(_LEAD[part[a:a + x]])))
                    between.append(None if plain else int(np.count_nonzero(_LEAD[part[a + x:a + y]])))
                    outputs.append(text if plain else bytes(exchange(text, x, y, form)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(before, pa.int64()),
                     pa.array(between, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string())], schema=_SCHEMA)

    return run


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, how = b.schema.get_field_index("output"), b.schema.get_field_index("form")
        data, off = C.utf8(b.column(at))
        for i, j in C.slices(off):
            forms = b.column(how).slice(i, j - i).to_pylist()
            texts = [bytes(rebuild(data[off[i + r]:off[i + r + 1]].tobytes(), f)) for r, f in enumerate(forms)]
            part = b.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary()).cast(pa.string())],
                                             names=[*part.schema.names, "restored"])


# ------------------------------------------------------------- operator

def fill_in_middle(docs: DataFrame, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT,
                   key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n (units), form, prefix_chars, middle_chars (null if plain), output."""
    C.small_batches(docs.sparkSession)
    hexed = F.sha2(F.concat(F.lit(SEED), F.coalesce(F.col(key).cast("string"), F.lit("null"))), 256)
    parts = [F.conv(F.substring(hexed, 1 + 8 * k, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)]
    own = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), *parts)
    return own.mapInArrow(_transform(plain_percent, spm_percent), _OUT)


def restore(transformed: DataFrame) -> DataFrame:
    """Rows of :func:`fill_in_middle` (form, output and any others) with ``restored``, the text read back."""
    C.small_batches(transformed.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in transformed.schema.fields)
    return transformed.mapInArrow(_restore, f"{fields}, restored string")
