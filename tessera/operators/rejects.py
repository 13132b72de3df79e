"""Rows that fail to parse, told apart from loadable rows by a structural index.

One pass over each Arrow batch: the records' ends are the offsets of their array, byte masks find quotes and
delimiters, the parity of the quotes before a delimiter within its record tells whether it separates, and the field
boundaries that follow give the number of fields, the state of the quoting and, with quotes and separators masked out, the unquoted
values as one contiguous Arrow array. Counts, quoting and value checks then work on whole columns.
Nothing loops over rows, nothing is shuffled, and a batch is all that is held in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTING, COLUMNS, VALUE = "quoting", "columns", "value"

_ISSN = r" *[0-9]{4}-[0-9]{3}[0-9xX] *"
# Kind: pattern of a non-empty value (RE2, whole value) and the Spark type it loads as.
KINDS: dict[str, tuple[str | None, str]] = {
    "text": (None, "string"),
    "whole": (r"^[+-]?[0-9]+$", "bigint"),
    "decimal": (r"^[+-]?[0-9]+(?:\.[0-9]+)?$", "decimal(18,4)"),
    "date": (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "date"),
    "flag": (r"^(?i:true|false)$", "boolean"),
    "isbn13": (r"^[0-9]{13}$", "string"),
    "issns": (rf"^{_ISSN}(?:;{_ISSN})*$", "string"),
    "zdb": (r"^[0-9]+-[0-9xX]$", "string"),
    "year": (r"^[0-9]{4}$", "int"),
    "duration": (r"^[0-9]+:[0-5][0-9]:[0-5][0-9]$", "string"),
}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "text"
    required: bool = False


@dataclass(frozen=True)
class LineFormat:
    """delimiter and quote are single ASCII characters; quote None makes quotes ordinary characters.
    strip holds the characters that are not part of a value at its ends."""

    fields: tuple[Field, ...]
    delimiter: str
    quote: str | None = None
    strip: str = " "


@dataclass(frozen=True)
class Index:
    """counts: fields of each record; torn: records whose quoting is broken; starts, ends: of the fields,
    in bytes; values: the fields without quotes; first: number of each record's first field."""

    counts: np.ndarray
    torn: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    values: pa.Array
    first: np.ndarray


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def structural_index(texts: pa.Array, delimiter: str, quote: str | None) -> Index:
    """Index of an array of records. A null counts as an empty record; callers look at nulls themselves."""
    data, off = _bytes(texts)
    n = len(off) - 1
    cuts = np.flatnonzero(data == ord(delimiter))
    row_of_cut = np.searchsorted(off, cuts, "right") - 1
    quotes = np.flatnonzero(data == ord(quote)) if quote else np.zeros(0, np.int64)
    if len(quotes):
        before = np.searchsorted(quotes, cuts) - np.searchsorted(quotes, off[row_of_cut])
        outside = before % 2 == 0
        cuts, row_of_cut = cuts[outside], row_of_cut[outside]
    counts = 1 + np.bincount(row_of_cut, minlength=n).astype(np.int64)
    # Equal positions are interchangeable, so sorting pairs each start with its end.
    starts = np.sort(np.concatenate([off[:-1], cuts + 1]))
    ends = np.sort(np.concatenate([off[1:], cuts]))
    first = np.cumsum(counts) - counts
    torn = np.zeros(n, bool)
    dropped = np.zeros(len(starts), np.int64)
    keep = np.ones(len(data), bool)
    keep[cuts] = False
    if len(quotes):
        field = np.searchsorted(starts, quotes, "right") - 1
        held = np.bincount(field, minlength=len(starts))
        lead = np.searchsorted(quotes, starts)
        place = np.arange(len(quotes)) - lead[field]
        quoted = np.flatnonzero(held)
        a, b = quotes[lead[quoted]], quotes[lead[quoted] + held[quoted] - 1]
        sound = (held[quoted] % 2 == 0) & (a == starts[quoted]) & (b == ends[quoted] - 1)
        inner = (place % 2 == 1) & (place < held[field] - 1)
        lone = inner.copy()
        lone[:-1] &= quotes[1:] != quotes[:-1] + 1
        bad = np.zeros(len(starts), bool)
        bad[quoted] = ~sound
        bad[field[lone]] = True
        torn[np.searchsorted(first, np.flatnonzero(bad), "right") - 1] = True
        outer = (place == 0) | (place == held[field] - 1)
        gone = outer | inner
        keep[quotes[gone]] = False
        dropped = np.bincount(field[gone], minlength=len(starts))
    lengths = ends - starts - dropped
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    values = pa.LargeStringArray.from_buffers(
        len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[keep]))
    )
    return Index(counts, torn, starts, ends, values, first)


def _real_dates(values: pa.Array) -> np.ndarray:
    """For values of the shape YYYY-MM-DD: whether the day exists."""
    part = lambda a, b: pc.utf8_slice_codeunits(values, a, b).cast(pa.int32()).to_numpy(zero_copy_only=False)
    y, m, d = part(0, 4), part(5, 7), part(8, 10)
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    last = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(m, 0, 12)] + ((m == 2) & leap)
    return (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= last)


def _sound(values: pa.Array, field: Field) -> np.ndarray:
    """Whether each stripped value is allowed in the field."""
    filled = pc.not_equal(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    pattern = KINDS[field.kind][0]
    good = np.ones(len(values), bool)
    if pattern:
        good = pc.match_substring_regex(values, pattern).to_numpy(zero_copy_only=False).copy()
        if field.kind == "date" and good.any():
            good[good] = _real_dates(values.filter(pa.array(good)))
    return good & filled if field.required else good | ~filled


def classify(texts: pa.Array, fmt: LineFormat) -> tuple[np.ndarray, list[pa.Array], np.ndarray]:
    """Reasons ("" for a valid record) of the records, and the stripped columns and numbers of those
    that have the right shape."""
    index = structural_index(texts, fmt.delimiter, fmt.quote)
    n, width = len(texts), len(fmt.fields)
    absent = texts.is_null().to_numpy(zero_copy_only=False)
    reason = np.full(n, "", dtype=object)
    reason[absent | (index.counts != width)] = COLUMNS
    reason[index.torn & ~absent] = QUOTING
    shaped = np.flatnonzero(reason == "")
    columns, good = [], np.ones(len(shaped), bool)
    for k, field in enumerate(fmt.fields):
        column = index.values.take(pa.array(index.first[shaped] + k))
        column = pc.utf8_trim(column, characters=fmt.strip)
        good &= _sound(column, field)
        columns.append(column)
    reason[shaped[~good]] = VALUE
    return reason, columns, shaped


def parse_records(lines: DataFrame, text: str, fmt: LineFormat, keep: list[str], rejects_only: bool = False) -> DataFrame:
    """One row for each row of lines: the columns keep, reason (null for a valid record, else quoting,
    columns or value, the first that applies) and fields, the stripped values as an array (null for rejects).

    A null record fails with ``columns``; an empty one has one empty field. With rejects_only, valid
    records are left out and fields with them. An empty table gives an empty result; columns of lines
    other than keep and text are not read. Repeated rows stay repeated.
    """
    schema = T.StructType([lines.schema[k] for k in keep] + [T.StructField("reason", T.StringType())])
    if not rejects_only:
        schema.add("fields", T.ArrayType(T.StringType()))
    width = len(fmt.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            reason, columns, shaped = classify(batch.column(len(keep)), fmt)
            kept = [batch.column(k) for k in range(len(keep))]
            reasons = pa.array([r or None for r in reason], pa.string())
            if rejects_only:
                bad = pa.array(np.flatnonzero(reason != ""))
                yield pa.RecordBatch.from_arrays([*(c.take(bad) for c in kept), reasons.take(bad)], [*keep, "reason"])
                continue
            good = reason[shaped] == ""
            pick = np.flatnonzero(good)
            # Column after column, then read across: entry r * width + c lies at c * rows + r.
            flat = pa.concat_arrays([c.take(pa.array(pick)) for c in columns]) if width else pa.array([], pa.large_string())
            order = (np.arange(len(pick))[:, None] + np.arange(width)[None, :] * len(pick)).ravel()
            flat = flat.take(pa.array(order)).cast(pa.string())
            sizes = np.zeros(batch.num_rows, np.int64)
            sizes[shaped[pick]] = width
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat, mask=pa.array(sizes == 0))
            yield pa.RecordBatch.from_arrays([*kept, reasons, lists], [*keep, "reason", "fields"])

    return lines.select(*[F.col(k) for k in keep], F.col(text)).mapInArrow(run, schema)


def _held(c: Column, kind: str) -> Column:
    """Whether the field's type holds a valid value exactly; true for an empty one."""
    to = KINDS[kind][1]
    if to not in ("bigint", "decimal(18,4)"):
        return F.lit(True)
    exact = c.try_cast(to).isNotNull()
    if to != "bigint":
        exact &= c.rlike(r"^[+-]?[0-9]+(\.[0-9]{1,4}0*)?\z")
    return (c == "") | exact


def _typed(c: Column, kind: str) -> Column:
    to = KINDS[kind][1]
    value = F.when(c != "", c)
    if to == "boolean":
        return F.lower(value) == "true"
    return value if to == "string" else F.when(_held(c, kind), value.try_cast(to))


def load_records(parsed: DataFrame, fmt: LineFormat, keep: list[str]) -> DataFrame:
    """The valid records of parse_records as typed columns, named as in the format; empty values are null.

    Whole numbers beyond bigint and decimals beyond decimal(18,4) are valid but don't fit; their columns are null and
    unheld has them as text, one line of name=value for each. It is null where every value is held.
    """
    at = [(F.col("fields")[k], f) for k, f in enumerate(fmt.fields)]
    cells = [_typed(c, f.kind).alias(f.name) for c, f in at]
    lines = [F.when(~_held(c, f.kind), F.concat(F.lit(f"{f.name}="), c)) for c, f in at if KINDS[f.kind][1] in ("bigint", "decimal(18,4)")]
    unheld = F.concat_ws("\n", *lines)
    return parsed.filter(F.col("reason").isNull()).select(*keep, *cells, F.when(unheld != "", unheld).alias("unheld"))


def _fields(text: str) -> tuple[Field, ...]:
    out = []
    for word in text.split():
        name, _, kind = word.partition(":")
        out.append(Field(name, kind.rstrip("!") or "text", word.endswith("!")))
    return tuple(out)


LICENCE_LIST = LineFormat(
    _fields(
        "ezb_id:whole! titel:! ampelfarbe:whole verlag fach e_issn:issns p_issn:issns zdb_nummer:zdb frontdoor_url typ"
        " preistyp zugangsbedingung link_zur_zeitschrift anchor erstes_jahr:year erstes_volume erstes_issue"
        " letztes_jahr:year letztes_volume letztes_issue moving_wall verfuegbar"
    ),
    "\t",
    None,
    " \r",
)
TITLE_REPORT = LineFormat(
    _fields(
        "ebl_id:whole! title:! publisher pubdate:date eisbn:isbn13 isbn:isbn13 category dewey lcc visible:flag owned:flag"
        " fund_code copies:whole purchase_type purchase_price:decimal lending_model date_purchased:date renewal_date:date"
        " owned_loans:whole total_owned_loan_days:whole current_loan_days_remaining:whole unowned_loans:whole"
        " browse_sessions:whole total_browse_time:duration read_online_sessions:whole total_read_online_time:duration"
        " total_downloads:whole total_days_downloaded:whole avg_download_length:whole total_turnaways:whole"
        " total_pages_printed:whole total_pages_copied:whole total_unique_users:whole ebook_status:flag"
    ),
    ",",
    '"',
)
