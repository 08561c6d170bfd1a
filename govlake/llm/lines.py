"""Line dedup: drop lines that many documents share, in DataFrame functions only.

Exploded normalised lines are reduced to a 128-bit hash, counted per hash over
distinct documents, and the documents are put together again by position from
the lines that stay.  Each step is a partial aggregation or an equi-join; a
line that a third of all documents hold is combined before the shuffle, and
the join back is split by AQE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Space and 0x09-0x0D.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_CHARS = 40
MIN_DOCS = 5


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, UPPER.lower())


def key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(F.lit(1), key).alias("h1"), F.xxhash64(F.lit(2), key).alias("h2"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All rows and columns of ``docs`` plus ``n_lines``, ``n_dropped`` (long)
    and ``kept_text``; columns of these names are replaced.

    A line's key is the line without white space at its ends and with A-Z
    lower-cased.  Keys of at least ``min_chars`` code points found in at least
    ``min_docs`` documents lose their lines in every document but the one with
    the largest id.  A null or empty text is one empty line; repeated lines of
    one document count once; rows that share an id count as one document; a
    row whose id is null counts for nothing and keeps its lines; no rows give
    no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def long_keys(t: Column) -> Column:
        keys = F.transform(F.split(F.translate(t, UPPER, UPPER.lower()), "\n", -1),
                           lambda x: F.btrim(x, F.lit(WHITE)))
        return F.array_distinct(F.filter(keys, lambda x: F.length(x) >= min_chars))

    pairs = (docs.filter(F.col(id_col).isNotNull())
             .select(F.col(id_col).alias("_id"), F.explode(long_keys(text)).alias("_key"))
             .select("_id", key_hash(F.col("_key")).alias("_h")).select("_id", "_h.*").distinct())
    shared = (pairs.groupBy("h1", "h2").agg(F.count("*").alias("_n"), F.max("_id").alias("_holder"))
              .filter(F.col("_n") >= min_docs).drop("_n"))
    drops = (pairs.join(shared, ["h1", "h2"]).filter("_id != _holder")
             .groupBy("_id").agg(F.collect_set(F.struct("h1", "h2")).alias("_drops")))
    # the documents' own columns are named through "d", so none can clash with a helper
    out = docs.alias("d").join(drops.alias("x"), F.col(f"d.`{id_col}`") == F.col("x._id"), "left")
    text = F.coalesce(F.col(f"d.`{text_col}`"), F.lit(""))
    gone = F.col("x._drops")
    lines = F.split(text, "\n", -1)

    def stays(line: Column) -> Column:
        key = line_key(line)
        return ~((F.length(key) >= min_chars) & F.array_contains(gone, key_hash(key)))

    kept = F.filter(lines, stays)
    n_lines = F.size(lines).cast("bigint")
    new = {"n_lines": n_lines,
           "n_dropped": F.when(gone.isNull(), F.lit(0)).otherwise(n_lines - F.size(kept)).cast("bigint"),
           "kept_text": F.when(gone.isNull(), text).otherwise(F.array_join(kept, "\n"))}
    own = [F.col(f"d.`{c}`") for c in docs.columns if c not in new]
    return out.select(*own, *(c.alias(n) for n, c in new.items()))
