"""Fill-in-the-middle: documents rearranged so that a model learns to fill a gap.

A text is cut into units, two units are drawn as cuts, and prefix, suffix and middle are
joined in one of two orders behind sentinels.  All work on texts is a chain of
``pyarrow.compute`` calls on an Arrow batch: units become list arrays, are flattened
with the indices of their rows, numbered, filtered by role, made to lists again and
joined.  Nothing is shuffled; the draws are hashes of the key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: sentinels before prefix, suffix and middle
SENTINELS = ("<P>", "<S>", "<M>")
#: of 100 documents so many are rearranged, and of 100 of those so many with the suffix first
RATE, SUFFIX_FIRST = 50, 80
#: bytes of text that are worked on together (one text at least)
BLOCK_BYTES = 4_000_000

#: the place between two units, in bytes: no white space, then white space
_BORDER = r"([^\x20\x09-\x0D])([\x20\x09-\x0D])"
#: a byte that UTF-8 never has
_MARK = b"\xff"
_BINARY = pa.large_binary()
_FIELDS = [
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()),
]


def draws(key: Column, seed: str) -> list[Column]:
    """Four unsigned 32-bit numbers from the sha256 of seed, colon and key; a NULL key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _numbers(array: pa.Array) -> np.ndarray:
    return array.to_numpy(zero_copy_only=False).astype(np.int64)


def unit_lists(texts: pa.Array) -> pa.Array:
    """The units of every text as a list of bytes; an empty text has the empty unit alone."""
    marked = pc.replace_substring_regex(texts, pattern=_BORDER, replacement=b"\\1" + _MARK + b"\\2")
    return pc.split_pattern(marked, _MARK)


def rearranged(text: pa.Array, h: Sequence[np.ndarray], sentinels: Sequence[str], rate: int, suffix_first: int) -> list[pa.Array]:
    """Columns n, form, prefix_chars, middle_chars and output of a block of texts."""
    raw = pc.fill_null(text.cast(_BINARY), b"")
    units = unit_lists(raw)
    empty = pc.equal(pc.binary_length(raw), 0)
    n = np.where(empty.to_numpy(zero_copy_only=False), 0, _numbers(pc.list_value_length(units)))
    cut = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), axis=0)

    flat = pc.list_flatten(units)
    parent = _numbers(pc.list_parent_indices(units))
    first = np.concatenate([[0], np.cumsum(_numbers(pc.list_value_length(units)))])
    ordinal = np.arange(len(flat)) - first[parent]
    bounds = [np.zeros_like(n), cut[0], cut[1], n]
    pieces = []
    for lo, hi in zip(bounds, bounds[1:]):
        role = pa.array((ordinal >= lo[parent]) & (ordinal < hi[parent]))
        rows = pa.array(np.concatenate([[0], np.cumsum(hi - lo)]), pa.int64())
        pieces.append(pc.binary_join(pa.LargeListArray.from_arrays(rows, pc.filter(flat, role)), pa.scalar(b"", _BINARY)))
    prefix, middle, suffix = pieces

    plain = pc.or_(empty, pa.array(h[2] % 100 >= rate))
    for s in sentinels:
        plain = pc.or_(plain, pc.match_substring(raw, s.encode()))
    spm = pa.array(h[3] % 100 < suffix_first)
    p, s, m = (pa.scalar(x.encode(), _BINARY) for x in sentinels)
    none = pa.scalar(b"", _BINARY)
    moved = pc.if_else(
        spm, pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none), pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none)
    )
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    missing = pa.scalar(None, pa.int64())
    chars = [pc.if_else(plain, missing, pc.utf8_length(x.cast(pa.large_string())).cast(pa.int64())) for x in (prefix, middle)]
    return [pa.array(n, pa.int64()), form.cast(pa.string()), *chars, pc.if_else(plain, raw, moved).cast(pa.large_string()).cast(pa.string())]


def restored(output: pa.Array, form: pa.Array, sentinels: Sequence[str]) -> pa.Array:
    """The texts again, from output and form alone."""
    raw = pc.fill_null(output.cast(_BINARY), b"")
    p, s, m = (x.encode() for x in sentinels)
    spm, psm = pc.equal(form, "spm"), pc.equal(form, "psm")
    moved = pc.or_(spm, psm)
    # rows in plain form get sentinels to be cut at; what they give is not used
    raw_cut = pc.if_else(moved, raw, pa.scalar(p + s + m, _BINARY))
    ends = pc.split_pattern(raw_cut, m, max_splits=1)
    head, middle = pc.list_element(ends, 0), pc.list_element(ends, 1)
    # behind the sentinel at the start: prefix, then suffix, or the other way round
    first = pc.if_else(spm, pc.replace_substring(head, s, b"", max_replacements=1), pc.replace_substring(head, p, b"", max_replacements=1))
    parts = pc.if_else(spm, pc.split_pattern(first, p, max_splits=1), pc.split_pattern(first, s, max_splits=1))
    left, right = pc.list_element(parts, 0), pc.list_element(parts, 1)
    prefix, suffix = pc.if_else(spm, right, left), pc.if_else(spm, left, right)
    joined = pc.binary_join_element_wise(prefix, middle, suffix, pa.scalar(b"", _BINARY))
    return pc.if_else(moved, joined, raw).cast(pa.large_string()).cast(pa.string())


def _blocks(part: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``BLOCK_BYTES``."""
    size = pc.fill_null(pc.binary_length(part.column(column)), 0)
    ends = np.cumsum(_numbers(size))
    row = 0
    while row < part.num_rows:
        before = int(ends[row - 1]) if row else 0
        last = max(row + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, side="right")))
        yield part.slice(row, last - row)
        row = last


def fill_in_middle(
    df: DataFrame, key: str = "doc_id", text: str = "text", seed: str = "42",
    sentinels: Sequence[str] = SENTINELS, rate: int = RATE, suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """Every row rearranged: row (all columns but the text), n units, form, prefix_chars, middle_chars, output.

    Units are white space with the word behind it, or white space at the end.  A NULL
    text is empty.  Empty texts and texts that hold a sentinel stay as they are, in form
    ``plain``, with NULL characters.  Rows that repeat a key are cut at the same draws; a
    NULL key draws like an empty one.  Other columns, whatever their names, are in
    ``row``; a table without rows gives none.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c != text]
    narrow = df.select(F.struct(*others).alias("row"), F.col(text).alias("text"), *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col(key), seed))])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for block in _blocks(part, "text"):
                h = [_numbers(block.column(f"h{i}")) for i in range(4)]
                made = rearranged(block.column("text"), h, sentinels, rate, suffix_first)
                yield pa.RecordBatch.from_arrays([block.column("row"), *made], names=["row", *[f.name for f in _FIELDS]])

    return narrow.mapInArrow(batches, T.StructType([narrow.schema["row"], *_FIELDS]))


def restore(df: DataFrame, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """What ``fill_in_middle`` returns with the column ``restored``: the text before, from output and form."""
    schema = T.StructType([*df.schema.fields, T.StructField("restored", T.StringType())])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for block in _blocks(part, "output"):
                back = restored(block.column("output"), block.column("form"), sentinels)
                yield pa.RecordBatch.from_arrays([*block.columns, back], names=schema.names)

    return df.mapInArrow(batches, schema)


FIM_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
  SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM d
), c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS lo,
    greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS hi FROM u
), p AS (
  SELECT *, array_to_string(units[1:lo], '') AS prefix, array_to_string(units[lo + 1:hi], '') AS middle,
    array_to_string(units[hi + 1:n], '') AS suffix,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM c
)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
