"""The registered queries as they are registered: columns, whole tables, and their SQL."""

import os

import duckdb
import pytest

from velarium.llm.oracles import ORACLES
from velarium.llm.queries import QUERIES

from ..test_oracles import TABLES, rows

COLUMNS = {
    "op1_toxicity": "doc_id held_out score predicted",
    "op2_topk": "query_id rank vec_id score",
    "op3_url_filter": "page_id host path rule verdict",
    "op4_mixing": "doc_id size source_size target taken",
    "op5_audio": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op6_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op7_token_files": "doc_id start n_tokens ids_crc32",
    "op8_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op9_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op10_minhash": "doc_id n_shingles component_id kept",
    "op11_chat": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op12_structure": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    "op13_fim": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
    "pipeline": "doc_id piece start length ids_crc32 sequence_id offset",
}


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf_dir, db, name):
    out = QUERIES[name](spark, sf_dir)
    assert out.columns == COLUMNS[name].split()
    if name in ORACLES:
        assert rows(out.toPandas()) == rows(db.execute(ORACLES[name]).df())
    elif name not in ("op8_packing", "pipeline"):
        assert out.count() == db.execute("SELECT count(*) FROM documents").fetchone()[0]
    else:
        ids = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
        known = {i for (i,) in db.execute("SELECT doc_id FROM documents").fetchall()}
        assert ids == known if name == "op8_packing" else ids and ids <= known
