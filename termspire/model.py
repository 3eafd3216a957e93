"""The index as four DataFrames, and the rule that places a term in a bucket."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from termspire.functions.keys import hash_bucket, shift_bucket


@dataclass(frozen=True)
class Layout:
    """How postings are split into buckets: "none", "hash" (modulus) or "shift" (bits).

    The rule is stored with the index. A reader that used another modulus than the writer would
    look in the wrong bucket and return nothing, without an error.
    """

    kind: str = "none"
    param: int = 0

    def bucket(self, termid: Column) -> Column | None:
        if self.kind == "hash":
            return hash_bucket(termid, self.param)
        if self.kind == "shift":
            return shift_bucket(termid, self.param)
        return None


@dataclass(frozen=True)
class Index:
    """One version of an index.

    `unique_docs` is True when every docid has one row in `docs`. Raw loads may hold a document
    several times; joins on docid then repeat rows, and the ranking takes care of that.
    """

    postings: DataFrame
    dict: DataFrame
    docs: DataFrame
    stats: DataFrame
    layout: Layout = Layout()
    unique_docs: bool = True

    def __post_init__(self) -> None:
        # Without its rule the bucket of a term is unknown, and a search would find nothing.
        if "thash" in self.postings.columns and self.layout.kind == "none":
            raise ValueError("the postings are in buckets, but the layout has no rule for them")

    @property
    def has_lengths(self) -> bool:
        return "len" in self.postings.columns

    def tables(self) -> dict[str, DataFrame]:
        return {
            "postings": self.postings,
            "dict": self.dict,
            "docs": self.docs,
            "stats": self.stats,
        }
