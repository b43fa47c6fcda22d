"""Keys and bounds as column predicates.

Keys compare as Spark compares them: binary and string keys bytewise and unsigned. ``signed_byte_key`` maps a key so that this order is the
signed order of its bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bound:
    """One end of a range: unbounded, included or excluded."""

    kind: str
    key: object = None

    def __post_init__(self):
        if self.kind not in ("unbounded", "included", "excluded"):
            raise ValueError(f"no such bound: {self.kind}")
        if self.kind != "unbounded" and self.key is None:
            raise ValueError(f"an {self.kind} bound needs a key")

    @classmethod
    def parse(cls, kind: str, key: object = None) -> Bound:
        """From a name in any case; unknown names raise ValueError."""
        return cls(kind.strip().lower(), key)


UNBOUNDED = Bound("unbounded")


def included(key: object) -> Bound:
    return Bound("included", key)


def excluded(key: object) -> Bound:
    return Bound("excluded", key)


def within(key: Column, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED) -> Column:
    """True where the key lies in the range. An excluded key excludes all its versions, as predicates never look at versions."""
    out = F.lit(True)
    if lower.kind != "unbounded":
        out = key >= F.lit(lower.key) if lower.kind == "included" else key > F.lit(lower.key)
    if upper.kind != "unbounded":
        end = key <= F.lit(upper.key) if upper.kind == "included" else key < F.lit(upper.key)
        out = end if lower.kind == "unbounded" else out & end
    return out


def overlaps(first: Column, last: Column, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED) -> Column:
    """True where a run that spans ``[first, last]`` may hold keys of the range."""
    return within(last, lower, UNBOUNDED) & within(first, UNBOUNDED, upper)


def prefix_successor(prefix: bytes) -> bytes | None:
    """The least key above all keys with the prefix; None if there is none."""
    stem = prefix.rstrip(b"\xff")
    return stem[:-1] + bytes([stem[-1] + 1]) if stem else None


def with_prefix(key: Column, prefix: str | bytes) -> Column:
    return key.startswith(prefix) if isinstance(prefix, str) else F.startswith(key, F.lit(prefix))


def prefix_overlaps(first: Column, last: Column, prefix: str) -> Column:
    """True where a run that spans ``[first, last]`` may hold keys with the prefix."""
    above = prefix_successor(prefix.encode("utf-8"))
    out = last >= F.lit(prefix)
    return out if above is None else out & (first.cast("binary") < F.lit(above))


def signed_byte_key(key: Column) -> Column:
    """A hexadecimal key whose order is the signed order of the key's bytes: the top bit of each byte is flipped."""
    text = F.hex(key.cast("binary"))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) / 2 - 1, F.lit(0)).cast("int")), lambda i: F.concat(F.translate(F.substr(text, 2 * i + 1, F.lit(1)), "0123456789ABCDEF", "89ABCDEF01234567"), F.substr(text, 2 * i + 2, F.lit(1))))
    return F.when(F.length(text) == 0, F.lit("")).otherwise(F.array_join(pairs, ""))


def delimiter_prefixes(key: Column, delimiter: str) -> Column:
    """All prefixes of a key that end before a delimiter, shortest first."""
    parts = F.split(key, F.lit("\\Q" + delimiter + "\\E"), F.lit(-1))
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), delimiter))
    return F.when(F.size(parts) > 1, every).otherwise(F.array().cast("array<string>"))
