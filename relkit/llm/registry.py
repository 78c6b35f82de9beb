"""The queries of this subpackage, and the SQL of those that SQL can express."""

from relkit.llm import decontaminate, html_wrapper, langid, line_dedup, media, omh_dedup, pii, sentencepiece_scan, substring_dedup, warc
from relkit.llm._text import small_batches


def _bounded(query):
    def run(spark, sf_dir):
        small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_langid": langid.query,
    "op2_decontaminate": decontaminate.query,
    "op3_line_dedup": line_dedup.query,
    "op4_media": media.query,
    "op5_pii": pii.query,
    "op6_sentencepiece": sentencepiece_scan.query,
    "op7_html_wrapper": html_wrapper.query,
    "op8_omh_dedup": omh_dedup.query,
    "op9_substring_dedup": substring_dedup.query,
    "op10_warc": warc.query,
}
QUERIES = {name: _bounded(query) for name, query in QUERIES.items()}

ORACLES = {
    "op2_decontaminate": decontaminate.ORACLE,
    "op3_line_dedup": line_dedup.ORACLE,
    "op9_substring_dedup": substring_dedup.ORACLE,
    "op10_warc": warc.ORACLE,
}
