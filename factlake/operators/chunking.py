"""Sections into chunks: by separators, by stride, by blank lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters, cut at the first separator that the text has, the
    separator at the beginning of the next piece; pieces still too long are cut at later ones.
    Pieces are put together up to `size`, and the last `overlap` characters' worth begins the next."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, rest = separators[at], separators[at + 1 :]
    parts = list(text) if sep == "" else [p for i, x in enumerate(text.split(sep)) if (p := (sep if i else "") + x)]
    out: list[str] = []
    held: list[str] = []
    length = 0

    def close() -> None:
        if joined := "".join(held).strip():
            out.append(joined)

    for p in parts:
        if len(p) > size and rest:
            if held:
                close()
            held, length = [], 0
            out += split_text(p, size, overlap, rest)
            continue
        if held and length + len(p) > size:
            close()
            while held and (length > overlap or length + len(p) > size):
                length -= len(held.pop(0))
        held.append(p)
        length += len(p)
    if held:
        close()
    return out


def recursive_chunks(sections: DataFrame, key: str, size: int = 3000, overlap: int = 300) -> DataFrame:
    """key, chunk_idx, chunk. Short sections are one chunk and never leave the JVM; long ones go to Python
    a hundred at a time, as a plain function of a row does, not by batches of ten thousand."""
    short = sections.where(F.length("text") <= size).select(key, F.lit(0).alias("chunk_idx"), F.col("text").alias("chunk"))
    pieces = F.udf(lambda t: split_text(t, size, overlap), "array<string>", useArrow=False)
    long = sections.where(F.length("text") > size).select(key, F.posexplode(pieces("text")).alias("chunk_idx", "chunk"))
    return short.unionByName(long)


def stride_chunks(sections: DataFrame, key: str, size: int, overlap: int) -> DataFrame:
    """Chunks of a fixed length, each beginning `size - overlap` after the one before."""
    last = F.greatest(F.ceil((F.length("text") - overlap) / F.lit(size - overlap)).cast("int"), F.lit(1))
    rows = sections.select(key, "text", F.explode(F.sequence(F.lit(0), last - 1)).alias("chunk_idx"))
    return rows.select(key, "chunk_idx", F.substring("text", F.col("chunk_idx") * (size - overlap) + 1, F.lit(size)).alias("chunk"))


def paragraphs(text: Column, least: int = 50) -> Column:
    """Blank-line parts of a text that have at least `least` characters."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: F.length(p) >= least)
