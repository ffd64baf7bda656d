"""The queries of this subpackage and the SQL that DuckDB checks them against."""

from __future__ import annotations

from sparkloom.llm import bpe, crf, ego_join, exact_dedup, langid, lpf, packing, simhash, sstable, warc

QUERIES = {
    "op1_near_vectors": ego_join.op1_near_vectors,
    "op2_sstable": sstable.op2_sstable,
    "op3_warc": warc.op3_warc,
    "op4_quality": crf.op4_quality,
    "op5_repeats": lpf.op5_repeats,
    "op6_packing": packing.op6_packing,
    "op7_bpe": bpe.op7_bpe,
    "op8_langid": langid.op8_langid,
    "op9_simhash": simhash.op9_simhash,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}

ORACLE_SQL = {
    "op1_near_vectors": ego_join.ORACLE_SQL,
    "op3_warc": warc.ORACLE_SQL,
    "op5_repeats": lpf.ORACLE_SQL,
    "op10_exact_dedup": exact_dedup.ORACLE_SQL,
}
