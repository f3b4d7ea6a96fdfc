"""Cut long sequences into fixed tiles so that one sequence is many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 4096


def pieces(seq: str | Column, width: int) -> Column:
    """Consecutive pieces of ``width`` letters, the last one shorter."""
    col = F.col(seq) if isinstance(seq, str) else seq
    return F.regexp_extract_all(col, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))


def tile_width(overlap: int, width: int = TILE) -> int:
    """Letters that a tile owns: the overlap must fit into the next tile."""
    return max(width, overlap)


def tile_rows(df: DataFrame, seq: str = "seq", overlap: int = 0, width: int = TILE) -> DataFrame:
    """Replace ``seq`` by ``tile_start0`` and ``tile``.

    Each tile also carries the first ``overlap`` letters that follow it, so a
    pattern of ``overlap + 1`` letters is found in the tile where it starts.
    """
    width = tile_width(overlap, width)
    cut = df.withColumn("_pieces", pieces(seq, width))
    if overlap:
        tail = lambda i: F.coalesce(F.substring(F.get(F.col("_pieces"), i + 1), 1, overlap), F.lit(""))
        tiles = F.transform("_pieces", lambda t, i: F.concat(t, tail(i)))
    else:
        tiles = F.col("_pieces")
    rest = [c for c in df.columns if c != seq]
    return cut.select(*rest, F.posexplode(tiles).alias("_i", "tile")).select(
        *rest, (F.col("_i").cast("long") * width).alias("tile_start0"), "tile"
    )


def letter_rows(df: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per letter with a zero-based ``pos``."""
    tiles = tile_rows(df, seq)
    rest = [c for c in tiles.columns if c not in ("tile", "tile_start0")]
    return tiles.select(*rest, "tile_start0", F.posexplode(F.regexp_extract_all("tile", F.lit("(?s)."), F.lit(0))).alias("_i", "ch")).select(
        *rest, (F.col("tile_start0") + F.col("_i")).alias("pos"), "ch"
    )


def kmer_rows(df: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """One row per overlapping window of ``k`` letters with its ``pos``."""
    if k < 1:
        raise ValueError("k must be >= 1")
    tiles = tile_rows(df, seq, overlap=k - 1)
    rest = [c for c in tiles.columns if c not in ("tile", "tile_start0")]
    # a letter is taken after every look ahead, so that none starts inside a letter beyond 16 bits
    windows = F.regexp_extract_all("tile", F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1))
    return tiles.select(*rest, "tile_start0", F.posexplode(windows).alias("_i", "kmer")).select(
        *rest, (F.col("tile_start0") + F.col("_i")).alias("pos"), "kmer"
    )
