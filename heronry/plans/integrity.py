"""Queries on references to records that do not exist (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronry.operators.integrity import media_reference_counts, media_references, orphan_rows
from heronry.session import Scratch
from heronry.sources.tables import table


def _tables(spark, folder):
    return [table(spark, folder, n) for n in ("media_tags", "face_embeddings", "people")]


def _counts(spark, folder: str):
    """The library as two changes, cut at the median date of its files."""
    files = table(spark, folder, "media_files")
    middle = files.agg(F.percentile_approx("created_at", 0.5)).first()[0]
    return media_reference_counts(Scratch(spark, "p5"), *_tables(spark, folder), files, before=middle)


def p5_found(spark, folder: str) -> DataFrame:
    """(ref_table, row_id): every row whose reference is not null and names no record."""
    return orphan_rows(media_references(*_tables(spark, folder)), _counts(spark, folder).orphan_keys())


def p5_report(spark, folder: str) -> DataFrame:
    """(ref_table, period, orphan_rows, orphan_keys) per table and month of created_at."""
    return _counts(spark, folder).report()


_ORPHANS = """
SELECT 'media_tags' AS ref_table, id AS row_id, file_id AS k, created_at FROM media_tags WHERE file_id IS NOT NULL AND file_id NOT IN (SELECT id FROM media_files WHERE id IS NOT NULL)
UNION ALL
SELECT 'face_embeddings', id, person_id, created_at FROM face_embeddings WHERE person_id IS NOT NULL AND person_id NOT IN (SELECT id FROM people WHERE id IS NOT NULL)
UNION ALL
SELECT 'people', id, cover_face_id, created_at FROM people WHERE cover_face_id IS NOT NULL AND cover_face_id NOT IN (SELECT id FROM face_embeddings WHERE id IS NOT NULL)
"""

QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
SQL = {
    "p5_found": f"SELECT ref_table, row_id FROM ({_ORPHANS})",
    "p5_report": f"SELECT ref_table, strftime(created_at, '%Y-%m') AS period, count(*) AS orphan_rows, count(DISTINCT k) AS orphan_keys FROM ({_ORPHANS}) GROUP BY 1, 2",
}
