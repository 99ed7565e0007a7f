"""Scalar functions: masks, the mixing hash, sizes of values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The hash's multipliers (fixed values).
MIX_1 = 0xED558CCD
MIX_2 = 0x1A85EC53
_LOW = 0xFFFFFFFF


def null_if(value: Column, mask: Column) -> Column:
    """Null where the mask is true; a null mask counts as false."""
    return F.when(~F.coalesce(mask, F.lit(False)), value)


def if_else(mask: Column, yes: Column, no: Column) -> Column:
    return F.when(mask, yes).otherwise(no)


def _times(x: Column, k: int) -> Column:
    """x * k modulo 2**64 for 0 <= x, k < 2**32, in parts that cannot overflow a signed long."""
    low, high = x * (k & 0xFFFF), x * (k >> 16)
    s = low.bitwiseAND(_LOW) + F.shiftleft(high.bitwiseAND(0xFFFF), 16)
    top = F.shiftrightunsigned(low, 32) + F.shiftrightunsigned(high, 16) + F.shiftrightunsigned(s, 32)
    return F.shiftleft(top.bitwiseAND(_LOW), 32).bitwiseOR(s.bitwiseAND(_LOW))


#: Types that mix_hash knows.
HASHED = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _bits(value: Column) -> Column:
    """The 64 bits of a double as a long."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.coalesce(value.cast("double"), F.lit(0.0)))
    return F.when(value.isNotNull(), bits.cast("long"))


def mix_hash(value: Column, dtype: str = "bigint") -> Column:
    """64-bit hash of an integer or of a floating-point number's bits: shift, multiply the low half, twice; as a signed long."""
    fold = lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 33))
    steps = [fold, lambda v: _times(v.bitwiseAND(_LOW), MIX_1), fold, lambda v: _times(v.bitwiseAND(_LOW), MIX_2), fold]
    if dtype in ("float", "double"):
        # a call by reflection is never shared between uses, so each step binds what it uses to a variable
        return reduce(F.transform, steps, F.array(_bits(value)))[0]
    return reduce(lambda v, step: step(v), steps, value.cast("long"))


_WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "date": 4}


def value_bytes(col: Column, dtype: str | T.DataType) -> Column:
    """Bytes that a value takes: its width; 4 for the offset and the length of a string, binary, array or map; the fields of a struct."""
    kind = T.DataType.fromDDL(dtype) if isinstance(dtype, str) else dtype
    name = kind.simpleString()

    def each(items: Column, inner: T.DataType) -> Column:
        return F.coalesce(F.aggregate(F.transform(items, lambda x: value_bytes(x, inner).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0))

    if name in ("string", "binary"):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 4
    if isinstance(kind, T.DecimalType):
        return F.lit(16)
    if name.startswith("timestamp"):
        return F.lit(8)
    if isinstance(kind, T.ArrayType):
        return 4 + each(col, kind.elementType)
    if isinstance(kind, T.MapType):
        return 4 + each(F.map_keys(col), kind.keyType) + each(F.map_values(col), kind.valueType)
    if isinstance(kind, T.StructType):
        return sum((value_bytes(col[f.name], f.dataType) for f in kind.fields), F.lit(0))
    if name not in _WIDTHS:
        raise TypeError(f"no size for {name}")
    return F.lit(_WIDTHS[name])


def random_text(number: Column, words: list[str], pattern: str, share: float, seed: str = "calyxa") -> Column:
    """A text of two to nine of the words, always the same for a number; with probability `share` the pattern stands behind the first."""

    def digit(what: str, k: Column | int) -> Column:
        """A number from 0 to 65,535."""
        digest = F.md5(F.concat_ws(":", F.lit(seed), F.lit(what), number.cast("string"), F.lit(k) if isinstance(k, int) else k.cast("string")).cast("binary"))
        return F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")

    from_list = lambda k: F.get(F.array(*[F.lit(w) for w in words]), digit("word", k) % len(words))
    rest = F.transform(F.sequence(F.lit(1), digit("length", 0) % 8 + 1), from_list)
    marked = F.when(digit("pattern", 0) < int(share * 65_536), F.array(F.lit(pattern))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(from_list(F.lit(0))), marked, rest), " ")
