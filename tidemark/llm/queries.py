"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from . import decontaminate, html, katz, licenses, lines, neighbours, packing, quality, simhash, urls
from .common import table


def queries() -> dict:
    return {
        "op1_quality_classifier": lambda s, d: quality.digest(table(s, d, "documents"), table(s, d, "labels")),
        "op2_url_filters": lambda s, d: urls.judge(table(s, d, "pages")),
        "op3_line_dedup": lambda s, d: lines.digest(table(s, d, "documents")),
        "op4_license_scan": lambda s, d: licenses.scan(table(s, d, "documents")),
        "op5_lm_scoring": lambda s, d: katz.score(table(s, d, "documents")),
        "op6_simhash_near_dedup": lambda s, d: simhash.digest(table(s, d, "documents")),
        "op7_nearest_neighbours": lambda s, d: neighbours.search(table(s, d, "embeddings")),
        "op8_decontamination": lambda s, d: decontaminate.digest(table(s, d, "documents"), table(s, d, "benchmark")),
        "op9_best_fit_packing": lambda s, d: packing.packed(table(s, d, "documents")),
        "op10_html_extraction": lambda s, d: html.main_texts(table(s, d, "pages")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": lines.ORACLE_SQL, "op4_license_scan": licenses.ORACLE_SQL, "op8_decontamination": decontaminate.ORACLE_SQL}
