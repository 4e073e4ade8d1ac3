"""Numeric features of words and sentences, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters counted: code points 97 to 128.
FIRST, LAST = 97, 128
#: Value of all components of a word that has no vector.
UNKNOWN = 0.0001


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: inside a lambda it would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def histogram(word: Column) -> Column:
    """32 counts of a word's characters from 'a' on, as doubles."""
    codes = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), F.ascii)
    return bind(codes, lambda cs: F.transform(F.sequence(F.lit(FIRST), F.lit(LAST)), lambda k: F.size(F.filter(cs, lambda c: c == k)).cast("double")))


def binarized(counts: Column) -> Column:
    """Counts over their maximum, rounded half to even; zeros stay."""
    scaled = lambda cs, top: F.when(top == 0, cs).otherwise(F.transform(cs, lambda c: F.bround(c / top, 0)))
    return bind(counts, lambda cs: bind(F.array_max(cs), lambda top: scaled(cs, top)))


def matrix(words: Column, width: int, rows: int, feature: Callable[[Column], Column]) -> Column:
    """Features of the first `rows` words, one after the other, padded by zeros."""
    pad = F.array_repeat(F.lit(0.0), width)
    cells = lambda word: F.when(word.isNull(), pad).otherwise(feature(word))
    places = F.sequence(F.lit(0), F.lit(rows - 1))
    return bind(words, lambda ws: F.flatten(F.transform(places, lambda i: bind(F.get(ws, i), cells))))


def positions(n: int, seed: Column, salt: str) -> Column:
    """0..n-1 in an order given by a hash of the seed."""
    keyed = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.md5(F.concat_ws(":", F.lit(salt), seed, i).cast("binary")).alias("key"), i.alias("at"))
    )
    return F.transform(F.array_sort(keyed), lambda s: s["at"])


def _rows_of(cells: Column, width: int, row: Callable[[Column, Column], Column]) -> Column:
    """row(cells, i) of all rows of a flat matrix, one after the other; cells are computed once."""
    places = lambda cs: F.sequence(F.lit(0), F.ceil(F.size(cs) / width).cast("int") - 1)
    return bind(cells, lambda cs: F.when(F.size(cs) > 0, F.flatten(F.transform(places(cs), lambda i: row(cs, i)))).otherwise(cs))


def _zeroed(cells: Column, width: int, gone: Column) -> Column:
    """Zero the rows of a flat matrix that `gone` lists."""
    kept = lambda cs, i: F.slice(cs, i * width + 1, F.lit(width))
    row = lambda cs, g, i: F.when(F.array_contains(g, i), F.transform(kept(cs, i), lambda _: F.lit(0.0))).otherwise(kept(cs, i))
    return bind(gone, lambda g: _rows_of(cells, width, lambda cs, i: row(cs, g, i)))


def drop_rows(cells: Column, width: int, n: int, seed: Column, rows: int = 16) -> Column:
    """Zero n distinct rows of a flat matrix, picked by the seed."""
    return _zeroed(cells, width, F.slice(positions(rows, seed, "drop"), 1, n))


def drop_drawn_rows(cells: Column, width: int, n: int, seed: Column, rows: int = 16) -> Column:
    """Zero the rows of a flat matrix that n draws with replacement pick, so between 1 and n of them, by the seed."""
    draw = lambda k: F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("draw"), seed, k).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(rows)).cast("int")
    return _zeroed(cells, width, F.transform(F.sequence(F.lit(1), F.lit(n)), draw) if n else F.array().cast("array<int>"))


def swap_rows(cells: Column, width: int, n: int, seed: Column, rows: int = 16) -> Column:
    """Permute n distinct rows of a flat matrix in a cycle; equal seeds permute alike, so x and its target can share one."""

    def source(picked: Column, row: Column) -> Column:
        return bind(F.array_position(picked, row).cast("int"), lambda at: F.when(at == 0, row).otherwise(F.element_at(picked, F.when(at == F.size(picked), F.lit(1)).otherwise(at + 1))))

    def moved(picked: Column, cs: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.slice(cs, source(picked, r) * width + 1, F.lit(width))))

    return bind(F.slice(positions(rows, seed, "swap"), 1, n), lambda picked: bind(cells, lambda cs: moved(picked, cs)))


def rescale(values: Column, low: float, high: float, to_low: float, to_high: float) -> Column:
    """Linear from [low, high] to [to_low, to_high], clamped."""
    slope = (to_high - to_low) / (high - low)
    return F.transform(values, lambda v: F.greatest(F.lit(to_low), F.least(F.lit(to_high), (v - F.lit(low)) * F.lit(slope) + F.lit(to_low))))


def threshold(values: Column, t: float = 0.5) -> Column:
    """1 where a value is above t."""
    return F.transform(values, lambda v: F.when(v > t, 1).otherwise(0))


def fraction_digits(number: Column, places: int = 16) -> Column:
    """Binary digits of the fraction of |number|."""
    part = F.abs(number) - F.floor(F.abs(number))
    return F.transform(F.sequence(F.lit(1), F.lit(places)), lambda i: F.pmod(F.floor(part * F.pow(F.lit(2.0), i)), F.lit(2)).cast("int"))


def vector_digits(vector: Column, places: int = 16) -> Column:
    """fraction_digits of all components, one after the other."""
    return F.flatten(F.transform(vector, lambda v: fraction_digits(v, places)))


def resized(vector: Column, n: int) -> Column:
    """The first n of the vector's components, which start again where they end; zeros for an empty one."""
    times = F.ceil(F.lit(n) / F.greatest(F.size(vector), F.lit(1))).cast("int")
    return F.when(F.size(vector) > 0, F.slice(F.flatten(F.array_repeat(vector, times)), 1, n)).otherwise(F.array_repeat(F.lit(0.0), n))


def float_bits(vector: Column) -> Column:
    """The 32 bits of each component as IEEE-754 single, highest first, one after the other; components are not null. A
    single number counts as a vector of one."""

    @F.arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        nested = pa.types.is_list(rows.type)
        cells = (rows.flatten() if nested else rows.drop_null()).to_numpy(zero_copy_only=False).astype(">f4")
        text = (np.unpackbits(cells.view(np.uint8)) + ord("0")).astype(np.uint8).tobytes()  # 32 digits for each cell
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy() if nested else rows.is_valid().to_numpy(zero_copy_only=False).astype(int)
        ends = np.concatenate(([0], np.cumsum(sizes * 32))).astype(np.int32)
        found = pa.StringArray.from_buffers(len(rows), pa.py_buffer(ends.tobytes()), pa.py_buffer(text))
        return pc.if_else(rows.is_valid(), found, None)

    return run(vector)
