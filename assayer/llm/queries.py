"""The queries of the numbered operators and the SQL that states their results."""

from __future__ import annotations

from assayer.llm import (
    alignment, bpe, chat, codes, imatch, langid, licenses, linededup, packing, quality, simhash, subwords, urls,
)
from assayer.llm.tables import small_batches
from assayer.session import configure

_BUILDS = (
    chat.op1_chat_formatting,
    linededup.op2_line_dedup,
    imatch.op3_imatch,
    quality.op4_quality_rules,
    licenses.op5_license_scan,
    urls.op6_url_filters,
    packing.op7_curve_packing,
    subwords.op8_sentencepiece,
    simhash.op9_covering_simhash,
    langid.op10_language_id,
    alignment.op11_alignment,
    bpe.op12_bpe,
    codes.op13_vector_codes,
)
SQL = {
    "op1_chat_formatting": chat.OP1_SQL,
    "op4_quality_rules": quality.OP4_SQL,
    "op5_license_scan": licenses.OP5_SQL,
    "op6_url_filters": urls.OP6_SQL,
    "op13_vector_codes": codes.OP13_SQL,
}


def _named(build):
    def run(spark, sf_dir):
        return build(small_batches(configure(spark)), sf_dir)

    return run


QUERIES = {build.__name__: _named(build) for build in _BUILDS}
