"""The queries of this package and their SQL."""

from __future__ import annotations

from . import bpe, exact_dedup, language_id, media, near_dedup, packing, secret_scan, substring_dedup, token_counts, warc

QUERIES = {
    "op1_simhash": near_dedup.op1_simhash,
    "op2_packing": packing.op2_packing,
    "op3_language_id": language_id.op3_language_id,
    "op4_media": media.op4_media,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_bpe": bpe.op6_bpe,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_warc": warc.op10_warc,
}

#: DuckDB SQL; the others have tokens, fingerprints, models or codecs that SQL can't express, and tests against brute force.
ORACLE_SQL = {
    "op9_exact_dedup": exact_dedup.ORACLE_SQL,
    "op10_warc": warc.ORACLE_SQL,
}
