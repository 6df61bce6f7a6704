"""Blocks of lines that a source repeats in many of its documents.

Each line is an identifier (the hash of its words of letters); a source's
documents are one long sequence of identifiers.  Its suffixes are grouped by
common prefix with prefix doubling, the distributed way to sort a suffix
array: round 0 groups suffixes that share one line, each further round joins
the group of a position with the group of the position 2**j lines on, so groups
share 2**(j+1) lines.  Only positions whose group still spans enough documents go
on, so rounds shrink fast, and they go on until none is left.

The exact common prefix lies between the last power that was repeated and the
next one.  A block of 2**j + d lines is its first and its last 2**j lines, so
the largest repeated d of every position is found by halving, from the groups of
round j alone: positions ask for their d, all positions of the same group
answer, and the documents of equal answers are counted.  One step per bit, for
all lengths at once.

Groups are counted in two steps (distinct documents, then their number), both
with map-side combining, and the positions of a group are spread over salts when
the counts are joined back: a line that stands in a third of all rows is never
gathered in one task.  The lines are read and hashed once, into a table of small
rows.

Defined results: lines end at ``\\n``; words are runs of letters in lower case;
lines without a word are no identifiers and end no block; rows without text,
source or document have no lines; a row that occurs twice counts once per
document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galley.session import materialize, parallelism

MIN_WORDS = 4
MIN_DOCUMENTS = 4
SALTS = 16


def line_positions(df: DataFrame, key: str, document: str, text: str, sources: DataFrame) -> DataFrame:
    """One row per line with a word: r (the row, by its content), k, doc, line_no, pos (among these lines), group, n_words, reach.

    ``group`` is the hash of source and words; ``reach`` the number of lines from
    here that have ``MIN_WORDS`` words together.  ``sources`` has the source of each
    document (doc, src).  Lines are hashed before they meet it, so no text is
    shuffled.
    """
    body = F.col(text).cast("string")
    plain = F.split(F.regexp_replace(F.lower(body), r"[^\p{L}\n]+", " "), "\n")
    k, doc = F.col(key).cast("long"), F.col(document).cast("long")
    x = df.select(F.xxhash64(k, doc, body).alias("r"), k.alias("k"), doc.alias("doc"), F.transform(plain, lambda w: F.btrim(w)).alias("ws")).where("doc is not null and ws is not null")
    count = lambda w: (F.length(w) - F.length(F.translate(w, " ", "")) + 1).cast("int")
    x = x.select("r", "k", "doc", F.filter(F.transform("ws", lambda w, i: F.when(w != "", F.struct(i.cast("int").alias("line_no"), F.xxhash64(w).alias("words"), count(w).alias("n")))), lambda s: s.isNotNull()).alias("lines"))
    by_doc = sources.where(F.col("src").isNotNull()).groupBy(F.col("doc").cast("long").alias("doc")).agg(F.xxhash64(F.min("src")).alias("src"))
    x = x.where(F.size("lines") > 0).join(by_doc, "doc").dropDuplicates(["doc", "r"]).select("r", "k", "doc", "src", "lines", F.posexplode("lines").alias("pos", "l"))
    ahead = lambda i: F.coalesce(F.get("lines", F.col("pos") + i)["n"], F.lit(0))
    n = F.col("l.n")
    reach = F.when(n >= MIN_WORDS, 1).when(n + ahead(1) >= MIN_WORDS, 2).when(n + ahead(1) + ahead(2) >= MIN_WORDS, 3).otherwise(MIN_WORDS)
    return x.select("r", "k", "doc", "l.line_no", "pos", F.xxhash64("src", "l.words").alias("group"), n.alias("n_words"), reach.alias("reach"))


def repeated_groups(positions: DataFrame, min_documents: int) -> DataFrame:
    """The groups that stand in at least ``min_documents`` documents, with that number."""
    pairs = positions.select("group", "doc").distinct()
    return pairs.groupBy("group").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_documents)


def keep_groups(positions: DataFrame, groups: DataFrame, by: str = "k", salts: int | None = None) -> DataFrame:
    """Positions whose group is kept, with ``n_docs``; a group's positions are spread by ``by`` over as many tasks as ``salts``.

    The number grows with the session's shuffle partitions, so with the cluster.
    """
    salts = salts or max(SALTS, parallelism(positions.sparkSession) // 8)
    salted = positions.withColumn("salt", F.pmod(F.col(by), F.lit(salts)).cast("int"))
    spread = groups.select("group", "n_docs", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return salted.join(spread, ["group", "salt"]).drop("salt")


def _doubled(positions: DataFrame, min_documents: int) -> list[DataFrame]:
    """Per round j the positions (r, doc, pos, group, n_docs) from which 2**j lines are repeated; until none is left."""
    rounds, current, step = [], positions.select("r", "doc", "pos", "group"), 1
    while True:
        kept = materialize(keep_groups(current, repeated_groups(current, min_documents), "r").select("r", "doc", "pos", "group", "n_docs"), "round")
        if rounds and kept.isEmpty():
            return rounds
        rounds.append(kept)
        after = kept.select("r", (F.col("pos") - step).alias("pos"), F.col("group").alias("next"))
        current = kept.select("r", "doc", "pos", "group").join(after, ["r", "pos"]).select("r", "doc", "pos", F.xxhash64("group", "next", F.lit(step)).alias("group"))
        step *= 2


def _exact(rounds: list[DataFrame], min_documents: int) -> DataFrame:
    """r, pos, n_lines, n_docs: the longest repeated block from each position; n_first: the documents of its first line."""
    if len(rounds) == 1:
        return rounds[0].select("r", "pos", F.lit(1).alias("n_lines"), "n_docs", F.col("n_docs").alias("n_first"))
    levels = rounds[0].select(F.lit(0).alias("j"), "*")
    for j, x in enumerate(rounds[1:], 1):
        levels = levels.unionByName(x.select(F.lit(j).alias("j"), "*"))
    best = levels.groupBy("r", "pos").agg(F.max(F.struct("j", "group", "n_docs")).alias("b"), F.max(F.when(F.col("j") == 0, F.col("n_docs"))).alias("n_first"))
    current = best.select("r", "pos", "n_first", "b.j", F.col("b.group").alias("start"), "b.n_docs", F.lit(0).alias("d"))
    last = levels.select("j", "r", F.col("pos").alias("at"), F.col("group").alias("end"))
    block, at = F.xxhash64("j", "start", "d2", "end"), F.col("pos") + F.col("d2")
    for bit in reversed(range(len(rounds) - 1)):
        current = materialize(current, "lengths")
        tried = current.where(F.col("j") > bit).withColumn("d2", F.col("d") + (1 << bit))
        asked = tried.select(F.xxhash64("j", "start").alias("group"), "d2").distinct().groupBy("group").agg(F.collect_set("d2").alias("n_docs"))
        answers = keep_groups(levels.select("j", "r", "doc", "pos", F.col("group").alias("start"), F.xxhash64("j", "group").alias("group")), asked, "r")
        answers = answers.select("j", "r", "doc", "pos", "start", F.explode("n_docs").alias("d2")).withColumn("at", at).join(last, ["j", "r", "at"])
        good = repeated_groups(answers.select("doc", block.alias("group")), min_documents)
        mine = tried.withColumn("at", at).join(last, ["j", "r", "at"])
        longer = keep_groups(mine.select("r", "pos", "d2", block.alias("group")), good, "r").select("r", "pos", F.col("d2").alias("_d"), F.col("n_docs").alias("_n"))
        current = current.join(longer, ["r", "pos"], "left").select("r", "pos", "n_first", "j", "start", F.coalesce("_n", "n_docs").alias("n_docs"), F.coalesce("_d", "d").alias("d"))
    return current.select("r", "pos", (F.expr("shiftleft(1, j)") + F.col("d")).cast("int").alias("n_lines"), "n_docs", "n_first")


def _blocks(df: DataFrame, key: str, document: str, text: str, sources: DataFrame, min_documents: int) -> DataFrame:
    positions = materialize(line_positions(df, key, document, text, sources), "positions")
    found = _exact(_doubled(positions, min_documents), min_documents)
    return positions.join(found, ["r", "pos"])


def repeated_blocks(df: DataFrame, key: str, document: str, text: str, sources: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``key``, line_no, n_lines, n_documents: for each line with a word the longest block that begins there and is repeated, and in how many documents."""
    x = _blocks(df, key, document, text, sources, min_documents)
    return x.select(F.col("k").alias(key), "line_no", "n_lines", F.col("n_docs").alias("n_documents"))


def repeated_lines(df: DataFrame, key: str, document: str, text: str, sources: DataFrame, min_words: int = MIN_WORDS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``key``, line_no and n_documents (that have the line) of the lines of ``min_words`` or more that repeated blocks cover.

    A block covers the lines behind its first one too; each of them begins a
    repeated block itself, so the lines from which one begins are all that are covered.
    """
    x = _blocks(df, key, document, text, sources, min_documents).where(F.col("n_words") >= min_words)
    return x.select(F.col("k").alias(key), "line_no", F.col("n_first").alias("n_documents"))


def standing_lines(df: DataFrame, key: str, document: str, text: str, sources: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``key`` and line_no of all lines, short ones too, that a repeated block of ``MIN_WORDS`` words or more covers: what is deleted."""
    x = _blocks(df, key, document, text, sources, min_documents)
    reached = F.max(F.when(F.col("n_lines") >= F.col("reach"), F.col("pos") + F.col("n_lines"))).over(Window.partitionBy("r").orderBy("pos"))
    return x.withColumn("_to", reached).where("_to > pos").select(F.col("k").alias(key), "line_no")


def without_lines(df: DataFrame, key: str, text: str, lines: DataFrame) -> DataFrame:
    """``df`` with the listed lines (``key``, line_no) taken out of ``text``; other columns stay as they are."""
    gone = lines.groupBy(F.col(key).alias("_k")).agg(F.collect_set("line_no").alias("_gone"))
    out = df.join(gone, F.col(key) == F.col("_k"), "left")
    parts = F.transform(F.split(F.col(text), "\n"), lambda line, i: F.struct(i.alias("i"), line.alias("l")))
    kept = F.transform(F.filter(parts, lambda p: ~F.array_contains(F.col("_gone"), p["i"])), lambda p: p["l"])
    return out.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).select(*df.columns)
