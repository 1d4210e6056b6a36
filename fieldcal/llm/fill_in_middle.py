"""Fill-in-the-middle examples: a document is cut at two places and its middle put last.

A text is a row of units: a word with the blanks before it, or the blanks at the end. All documents of an Arrow batch are cut
at once by ``pyarrow.compute``: the units become one list array, its values are flattened next to the number of their
document, each unit's ordinal in its document says whether it belongs to prefix, middle or suffix, the units of each role
are gathered into lists again, and the lists are joined to pieces. There is no loop over rows.

Both cuts and the form come from a hash of seed and id, so a rerun gives the same examples on any cluster. The forms are
``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) and ``plain`` (the text unchanged). A text that holds a
marker stays plain, so that every output can be taken apart again: ``restored`` does it.

Defined results: a null text counts as empty, and empty texts are plain with 0 units; bytes that are no UTF-8 become U+FFFD;
rows that share an id are cut by the same hash, each by its own number of units; a null id hashes as an empty one; rows
repeated whole give a row each; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcal.llm.tokens import blocks, buffers

#: Markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Blanks before a word belong to it; what is left is a unit of blanks.
_UNIT = rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: A byte that no UTF-8 text holds ends each unit.
_END = b"\xff"
_BLOCK_BYTES = 1 << 22
_SCHEMA = "id {id}, n long, form string, prefix_chars long, middle_chars long, output string"


def _draws(seed: int, key: Column) -> list[Column]:
    """Four whole numbers of 32 bits from the hash of seed and id."""
    digest = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), "UTF-8"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def units(texts: pa.BinaryArray) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray]:
    """All units in turn, the number of each unit's document, and the number of units of each document."""
    marked = pc.replace_substring_regex(texts, pattern=_UNIT, replacement=rb"\0" + _END)
    lists = pc.split_pattern(marked, pattern=_END)
    parent, values = pc.list_parent_indices(lists), pc.list_flatten(lists)
    real = pc.greater(pc.binary_length(values), 0)  # behind the last mark stands an empty value
    parent = parent.filter(real).to_numpy()
    return values.filter(real), parent, np.bincount(parent, minlength=len(texts)).astype(np.int64)


def _piece(values: pa.BinaryArray, parent: np.ndarray, chosen: np.ndarray, n: int) -> pa.BinaryArray:
    """The chosen units of each document, joined."""
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(parent[chosen], minlength=n), out=offsets[1:])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), values.filter(pa.array(chosen))), b"")


def _joined(*pieces: pa.Array | str) -> pa.Array:
    parts = [pa.scalar(p.encode(), pa.binary()) if isinstance(p, str) else p for p in pieces]
    return pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.binary()))


def _chars(piece: pa.BinaryArray, plain: pa.BooleanArray) -> pa.Array:
    return pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(piece.cast(pa.string())).cast(pa.int64()))


def _examples(batches: Iterator[pa.RecordBatch], rate: int, spm: int) -> Iterator[pa.RecordBatch]:
    """id, text, four draws → rows of ``_SCHEMA``."""
    for batch in batches:
        _, offsets = buffers(batch.column(1))
        for a, b in blocks(offsets, _BLOCK_BYTES):
            part = batch.slice(a, b - a)
            texts = part.column(1)
            first, second, form, order = (part.column(i).to_numpy() for i in range(2, 6))
            values, parent, n = units(texts)
            cuts = first % (n + 1), second % (n + 1)
            low, high = np.minimum(*cuts)[parent], np.maximum(*cuts)[parent]
            ordinal = np.arange(len(parent)) - np.repeat(np.cumsum(n) - n, n)
            roles = ordinal < low, (ordinal >= low) & (ordinal < high), ordinal >= high
            before, middle, after = (_piece(values, parent, role, len(n)) for role in roles)
            plain = pc.or_(pa.array(n == 0), pa.array(form % 100 >= rate))
            for marker in (PREFIX, SUFFIX, MIDDLE):
                plain = pc.or_(plain, pc.match_substring(texts, pattern=marker.encode()))
            is_spm = pa.array(order % 100 < spm)
            output = pc.if_else(
                is_spm, _joined(SUFFIX, after, PREFIX, before, MIDDLE, middle), _joined(PREFIX, before, SUFFIX, after, MIDDLE, middle)
            )
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array(n), pc.if_else(plain, "plain", pc.if_else(is_spm, "spm", "psm")),
                    _chars(before, plain), _chars(middle, plain), pc.if_else(plain, texts, output).cast(pa.string()),
                ],
                ["id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80
) -> DataFrame:
    """id_col, n (units), form, prefix_chars, middle_chars, output for each document.

    ``rate`` of 100 documents are cut, ``spm`` of 100 of those with the suffix first.
    """
    text = F.make_valid_utf8(F.coalesce(F.col(text_col), F.lit(""))).cast("binary").alias("text")
    drawn = docs.select(F.col(id_col).alias("id"), text, *[h.alias(f"h{i}") for i, h in enumerate(_draws(seed, F.col(id_col)))])
    schema = _SCHEMA.format(id=drawn.schema["id"].dataType.simpleString())
    return drawn.mapInArrow(lambda b: _examples(b, rate, spm), schema).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""

    def side(text: Column, marker: str, last: bool) -> Column:
        return F.get(F.split(text, marker, 2), F.lit(int(last)))

    inner = F.substring(output, len(PREFIX) + 1, 2**31 - 1)  # without the first marker
    one, two = side(inner, F.when(form == "spm", PREFIX).otherwise(SUFFIX), False), side(
        inner, F.when(form == "spm", PREFIX).otherwise(SUFFIX), True
    )
    inside, middle = side(two, MIDDLE, False), side(two, MIDDLE, True)
    whole = F.when(form == "spm", F.concat(inside, middle, one)).otherwise(F.concat(one, middle, inside))
    return F.when(form == "plain", output).otherwise(whole)
