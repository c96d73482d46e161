"""The queries of this package and their SQL."""

from __future__ import annotations

from . import chat, langid, media, mixing, packing, pii, quality, repair, repeats, shards, simhash, trie, warc


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_pii": pii.query,
    "op2_warc": warc.query,
    "op3_language": langid.query,
    "op4_simhash": simhash.query,
    "op5_mixing": mixing.query,
    "op6_packing": packing.query,
    "op7_quality": quality.query,
    "op8_shards": shards.query,
    "op9_media": media.query,
    "op10_chat": chat.query,
    "op11_trie": trie.query,
    "op12_repair": repair.query,
    "op13_repeats": repeats.query,
    "pipeline": _pipeline,
}

ORACLES = {"op2_warc": warc.ORACLE, "op7_quality": quality.ORACLE, "op8_shards": shards.ORACLE, "op9_media": media.ORACLE, "op10_chat": chat.ORACLE, "op11_trie": trie.ORACLE, "op12_repair": repair.ORACLE, "op13_repeats": repeats.ORACLE}
