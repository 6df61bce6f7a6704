"""Queries of the training-data operators, and the SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.boilerplate import furniture_lines
from galley.llm.near_duplicates import near_duplicates
from galley.llm.packing import pack
from galley.llm.repeated_lines import repeated_blocks, repeated_lines, standing_lines, without_lines
from galley.llm.residue import residue
from galley.llm.splitting import split_oversized
from galley.llm.tokens import encode, token_counts
from galley.operators.timestamps import sender_address
from galley.session import table

SECTION_LIMIT, CHUNK_LIMIT = 8000, 14000
CAPACITY = 2048


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Groups of sections that carry one story: first_id and each other section_id."""
    sections = table(spark, root, "email_sections").select(F.col("id").alias("section_id"), "text")
    return near_duplicates(sections, "section_id", "text", shingle=3, threshold=0.5)


def _pieces(spark: SparkSession, root: str) -> DataFrame:
    sections = split_oversized(table(spark, root, "email_sections"), "id", "text", SECTION_LIMIT)
    chunks = split_oversized(table(spark, root, "map_reduce_chunks"), "chunk_id", "text", CHUNK_LIMIT)
    both = sections.select(F.lit("email_sections").alias("src"), F.col("id").alias("item_id"), "piece_no", "n_pieces", "start", "piece")
    return both.unionByName(chunks.select(F.lit("map_reduce_chunks").alias("src"), F.col("chunk_id").alias("item_id"), "piece_no", "n_pieces", "start", "piece"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """The texts that had to be split: src, item_id."""
    return _pieces(spark, root).where("piece_no = 0").select("src", "item_id")


def p4_pieces(spark: SparkSession, root: str) -> DataFrame:
    """The pieces of the split texts, each after the first beginning with the end of the one before."""
    return _pieces(spark, root)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """The lines of page furniture: section_id, line_no."""
    found = furniture_lines(table(spark, root, "email_sections").select("id", "email_id", "heading", "text"), table(spark, root, "emails").select("id", "sender"))
    return found.select(F.col("id").alias("section_id"), "line_no")


def p5_texts(spark: SparkSession, root: str) -> DataFrame:
    """The main body of every section: section_id, n_chars_before, n_chars_after, text."""
    sections = table(spark, root, "email_sections").select("id", "email_id", "heading", "text")
    found = furniture_lines(sections, table(spark, root, "emails").select("id", "sender"))
    kept = without_lines(sections.select("id", "text", F.length("text").alias("before")), "id", "text", found)
    return kept.select(F.col("id").alias("section_id"), F.col("before").alias("n_chars_before"), F.length("text").alias("n_chars_after"), "text")


def _senders(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "emails").select(F.col("id").alias("doc"), sender_address(F.col("sender")).alias("src"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """The lines a sender repeats: section_id, line_no."""
    sections = table(spark, root, "email_sections")
    found = repeated_lines(sections, "id", "email_id", "text", _senders(spark, root))
    return found.select(F.col("id").alias("section_id"), "line_no")


def p6_blocks(spark: SparkSession, root: str) -> DataFrame:
    """Repeated blocks of lines: section_id, line_no, n_lines, n_documents."""
    sections = table(spark, root, "email_sections")
    return repeated_blocks(sections, "id", "email_id", "text", _senders(spark, root)).withColumnRenamed("id", "section_id")


def p6_texts(spark: SparkSession, root: str) -> DataFrame:
    """The sections without the blocks their sender repeats: section_id, n_chars_before, n_chars_after, text."""
    sections = table(spark, root, "email_sections").select("id", "email_id", "text")
    found = standing_lines(sections, "id", "email_id", "text", _senders(spark, root))
    kept = without_lines(sections.withColumn("before", F.length("text")), "id", "text", found)
    return kept.select(F.col("id").alias("section_id"), F.col("before").alias("n_chars_before"), F.length("text").alias("n_chars_after"), "text")


def p7_ids(spark: SparkSession, root: str) -> DataFrame:
    """Token ids of every document."""
    return encode(table(spark, root, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, root: str) -> DataFrame:
    """Documents in containers of 2,048 tokens: container, doc_id, piece_no, tokens."""
    return pack(token_counts(table(spark, root, "documents"), "doc_id", "text"), "doc_id", "n_tokens", CAPACITY)


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """The documents that are residue: doc_id."""
    return residue(table(spark, root, "documents")).select("doc_id").distinct()


def p9_kinds(spark: SparkSession, root: str) -> DataFrame:
    """The documents that are residue, with the kind: doc_id, kind."""
    return residue(table(spark, root, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p5_found": p5_found,
    "p5_texts": p5_texts,
    "p6_found": p6_found,
    "p6_blocks": p6_blocks,
    "p6_texts": p6_texts,
    "p7_ids": p7_ids,
    "p8_containers": p8_containers,
    "p9_found": p9_found,
    "p9_kinds": p9_kinds,
}

# The white space that a text may carry at its ends, and the address of a sender, as SQL.
_STRIP = r"regexp_replace(text, '^[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g')"

# The lines with a word of every section whose mail has a sender: src, doc, id, place among them, line number, words, their number.
_LINES = r"""senders AS (
            SELECT id AS email_id, CASE WHEN regexp_extract(lower(sender), '<\s*([^<>\s]+@[^<>\s]+)\s*>', 1) <> '' THEN regexp_extract(lower(sender), '<\s*([^<>\s]+@[^<>\s]+)\s*>', 1)
                   ELSE nullif(regexp_extract(lower(sender), '([^\s<>"''(),;:]+@[^\s<>"''(),;:]+)', 1), '') END AS src FROM emails),
        raw AS (SELECT s.id, s.email_id, u.line, u.line_no FROM email_sections s, LATERAL (SELECT unnest(string_split(s.text, chr(10))) AS line, generate_subscripts(string_split(s.text, chr(10)), 1) - 1 AS line_no) u),
        worded AS (SELECT r.id, r.email_id AS doc, r.line_no, e.src, trim(regexp_replace(lower(r.line), '[^\p{L}]+', ' ', 'g')) AS w FROM raw r JOIN senders e USING (email_id) WHERE e.src IS NOT NULL),
        lines AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line_no) AS pos, length(w) - length(replace(w, ' ', '')) + 1 AS n FROM worded WHERE w <> ''),
        texts AS (SELECT id, doc, src, list(w ORDER BY pos) AS ws, list(n ORDER BY pos) AS ns, list(line_no ORDER BY pos) AS nos FROM lines GROUP BY ALL),
        starts AS (SELECT *, unnest(range(1, len(ws) + 1)) AS a FROM texts), parts AS (SELECT *, unnest(range(a, len(ws) + 1)) AS b FROM starts), keyed AS (SELECT id, doc, src, nos[a] AS line_no, a, b, md5(array_to_string(ws[a:b], chr(10))) AS h, list_sum(ns[a:b]) AS n_words FROM parts),
        rep AS (SELECT src, h, count(DISTINCT doc) AS n_documents FROM keyed GROUP BY 1, 2 HAVING count(DISTINCT doc) >= 4), hit AS (SELECT k.*, r.n_documents FROM keyed k JOIN rep r USING (src, h))"""

ORACLE = {
    "p6_blocks": f"WITH {_LINES} SELECT id AS section_id, line_no::INT AS line_no, max(b - a + 1)::INT AS n_lines, arg_max(n_documents, b) AS n_documents FROM hit GROUP BY 1, 2",
    "p6_texts": f"""WITH {_LINES}, gone AS (SELECT DISTINCT l.id, l.line_no FROM lines l JOIN hit h ON h.id = l.id AND l.pos BETWEEN h.a AND h.b WHERE h.n_words >= 4),
        per AS (SELECT id, list(line_no + 1) AS g FROM gone GROUP BY 1), t AS (SELECT s.id, length(s.text) AS before, CASE WHEN g IS NULL THEN s.text ELSE array_to_string(list_filter(string_split(s.text, chr(10)), lambda x, i: NOT list_contains(g, i)), chr(10)) END AS text FROM email_sections s LEFT JOIN per USING (id))
        SELECT id AS section_id, before AS n_chars_before, length(text) AS n_chars_after, text FROM t""",
    "p4_found": f"""
        SELECT 'email_sections' AS src, id AS item_id FROM email_sections WHERE length({_STRIP}) > {SECTION_LIMIT}
        UNION ALL
        SELECT 'map_reduce_chunks' AS src, chunk_id AS item_id FROM map_reduce_chunks WHERE length({_STRIP}) > {CHUNK_LIMIT}""",
    "p6_found": r"""
        WITH senders AS (
            SELECT id AS email_id, CASE WHEN regexp_extract(lower(sender), '<\s*([^<>\s]+@[^<>\s]+)\s*>', 1) <> '' THEN regexp_extract(lower(sender), '<\s*([^<>\s]+@[^<>\s]+)\s*>', 1)
                   ELSE nullif(regexp_extract(lower(sender), '([^\s<>"''(),;:]+@[^\s<>"''(),;:]+)', 1), '') END AS src FROM emails),
        lines AS (SELECT s.id, s.email_id, u.line, u.line_no FROM email_sections s, LATERAL (SELECT unnest(string_split(s.text, chr(10))) AS line, generate_subscripts(string_split(s.text, chr(10)), 1) - 1 AS line_no) u),
        keyed AS (SELECT l.id, l.email_id, l.line_no, e.src, trim(regexp_replace(lower(l.line), '[^\p{L}]+', ' ', 'g')) AS w FROM lines l JOIN senders e USING (email_id) WHERE e.src IS NOT NULL),
        long AS (SELECT * FROM keyed WHERE w <> '' AND length(w) - length(replace(w, ' ', '')) + 1 >= 4),
        rep AS (SELECT src, w FROM long GROUP BY src, w HAVING count(DISTINCT email_id) >= 4)
        SELECT l.id AS section_id, CAST(l.line_no AS INTEGER) AS line_no FROM long l JOIN rep USING (src, w)""",
}
