"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches of falling doc_id. The lines seen so far are kept as
runs: tables of (line hash, number of documents, holder), sorted by hash. A
new batch is merge-anti-joined with the runs; its unseen lines become a run of
their own, whose holder is the largest doc_id that has the line, as later
batches hold smaller ids only. Lines of the batch that are in a run already
are added to a table of hits. When ``fan_in`` runs of one level have gathered,
they are compacted into one run of the next level. Runs and hits together count
the documents of every line; a line found in at least ``min_docs`` documents is
dropped wherever it stands except in its holder.

Only DataFrame functions are used. Line keys are compared by two 64-bit hashes.

Defined results: null text is one empty line; empty lines and short lines are
never dropped; several copies of a line within its holder all stay; documents
that repeat a doc_id count as one document; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerscope.llm.common import ASCII_SPACE, free_name, null_safe_text, union_all, written

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_array(text_col: str = "text") -> Column:
    return F.split(null_safe_text(text_col), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case.

    ``lower`` does the same on ASCII lines and is much faster there.
    """
    bare = F.btrim(line, F.lit(ASCII_SPACE))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def line_hashes(docs: DataFrame, min_chars: int = 20, text_col: str = "text",
                id_col: str = "doc_id") -> DataFrame:
    """(doc_id, version, pos, h1, h2) of every line whose key has ``min_chars`` code points.

    ``version`` tells rows apart that repeat a doc_id with another text.
    """
    lines = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("version"),
                        F.posexplode(line_array(text_col)).alias("pos", "line"))
    keyed = (lines.where(F.char_length("line") >= min_chars)
             .select("doc_id", "version", "pos", line_key(F.col("line")).alias("key"))
             .where(F.char_length("key") >= min_chars))
    return keyed.select("doc_id", "version", "pos", F.xxhash64("key").alias("h1"),
                        F.xxhash64(F.lit(1), "key").alias("h2"))


def _as_run(df: DataFrame, name: str) -> DataFrame:
    return written(df.sortWithinPartitions("h1", "h2"), name)


def _compact(runs: list[DataFrame], name: str) -> DataFrame:
    """Merge runs into one. Their lines are disjoint, so rows are only regrouped."""
    return _as_run(union_all(runs).repartition("h1", "h2"), name)


def count_lines(lines: DataFrame, batches: int = 4, fan_in: int = 2) -> DataFrame:
    """(h1, h2, n_docs, holder) of every line, through the levelled runs."""
    cuts = lines.agg(F.percentile_approx(
        "doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
    bounds = [None, *sorted(set(cuts), reverse=True), None]
    levels: list[list[DataFrame]] = [[]]
    hits: list[DataFrame] = []
    for upper, lower in zip(bounds, bounds[1:]):
        batch = lines
        if upper is not None:
            batch = batch.where(F.col("doc_id") <= upper)
        if lower is not None:
            batch = batch.where(F.col("doc_id") > lower)
        # two steps, so that a line that one third of all rows share is summed in the map tasks
        seen = (batch.select("h1", "h2", "doc_id").distinct()
                .groupBy("h1", "h2").agg(F.count("doc_id").alias("n_docs"),
                                         F.max("doc_id").alias("holder")))
        runs = [run for level in levels for run in level]
        if not runs:
            levels[0].append(_as_run(seen, "line-run"))
        else:
            seen = written(seen, "line-batch")
            known = union_all(runs).select("h1", "h2")
            levels[0].append(_as_run(seen.join(known, ["h1", "h2"], "left_anti"), "line-run"))
            hits.append(seen.join(known, ["h1", "h2"], "left_semi"))
        for depth, level in enumerate(levels):
            if len(level) >= fan_in:
                merged = _compact(level, f"line-level{depth + 1}")
                if depth + 1 == len(levels):
                    levels.append([])
                levels[depth + 1].append(merged)
                level.clear()
    entries = union_all([run for level in levels for run in level] + hits)
    return entries.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"),
                                           F.max("holder").alias("holder"))


def repeated_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = 4,
                   salts: int = 32, text_col: str = "text") -> DataFrame:
    """(doc_id, version, drop): the positions of the lines that each text loses."""
    lines = written(line_hashes(docs, min_chars, text_col).where(F.col("doc_id").isNotNull()),
                    "line-hashes")
    heavy = count_lines(lines, batches).where(F.col("n_docs") >= min_docs)
    # a line may stand in a third of all documents: its rows are dealt over salts
    spread = heavy.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    lost = salted.join(spread, ["h1", "h2", "salt"]).where("doc_id != holder")
    return lost.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("drop"))


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, batches: int = 4,
                text_col: str = "text") -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped`` added.

    (Names that ``docs`` has already are replaced.) Rows without a doc_id keep
    all their lines.
    """
    gone = repeated_lines(docs, min_docs, min_chars, batches, text_col=text_col)
    key, text_key, drop = (free_name(docs, stem) for stem in ("_lost_id", "_lost_version", "_drop"))
    gone = gone.select(F.col("doc_id").alias(key), F.col("version").alias(text_key),
                       F.col("drop").alias(drop))
    joined = docs.join(gone, (F.col("doc_id") == F.col(key))
                       & (F.xxhash64(text_col) == F.col(text_key)), "left").drop(key, text_key)
    lines = line_array(text_col)
    last = F.size(lines) - 1
    stay = F.array_except(F.sequence(F.lit(0), last), F.col(drop))
    kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    return (joined
            .withColumn("kept_text", F.when(F.col(drop).isNull(), null_safe_text(text_col))
                        .otherwise(kept))
            .withColumn("n_lines", F.size(lines).cast("long"))
            .withColumn("n_dropped", F.when(F.col(drop).isNull(), F.lit(0))
                        .otherwise(F.size(lines) - F.size(stay)).cast("long"))
            .drop(drop))
