import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMAS = {
    "media_files": "id long, path string, filename string, extension string, size_bytes long, created_at timestamp_ntz",
    "image_info": "info_id long, path string, hash string, resolution long, scanned_at timestamp_ntz",
    "duplicate_groups": "group_id long, scan_id string, hash string, paths array<string>, best_path string, created_at timestamp_ntz",
    "media_tags": "id long, file_id long, category_id int, confidence double, source string, run_id string, created_at timestamp_ntz",
    "face_embeddings": "id long, person_id long, file_id long, embedding array<float>, confidence double, created_at timestamp_ntz",
    "people": "id long, name string, cover_face_id long, created_at timestamp_ntz",
    "watcher_events": "id long, watcher_config_id long, file_path string, detected_at timestamp_ntz, triggered_job_id string, status string, error_message string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, file_id long, created_at timestamp_ntz",
    "eval_items": "item_id long, suite string, lang string, text string",
    "doc_labels": "doc_id long, label string, labelled_by string",
}


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables of dict rows, all others empty; every table has two more columns of clashing names."""
    from pyspark.sql import types as T

    def write(**tables):
        for name, ddl in SCHEMAS.items():
            schema = T._parse_datatype_string(ddl)
            df = spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in tables.get(name, [])], schema)
            df.selectExpr("*", "'x' AS h", "1 AS v", "'y' AS pkey").write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
