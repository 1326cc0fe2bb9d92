"""Queries opN_<name> of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate as m7
from . import fill_in_middle as m11
from . import html_text as m2
from . import language_id as m5
from . import license_scan as m10
from . import line_dedup as m3
from . import near_dedup as m4
from . import packing as m8
from . import periodic_runs as m13
from . import piece_codec as m12
from . import quality as m1
from . import top_k as m9
from . import toxicity as m6


def queries() -> dict:
    return {"op1_quality": m1.op1_quality, "op2_html_text": m2.op2_html_text, "op5_language_id": m5.op5_language_id, "op6_toxicity": m6.op6_toxicity, "op3_line_dedup": m3.op3_line_dedup, "op4_near_dedup": m4.op4_near_dedup, "op7_decontaminate": m7.op7_decontaminate, "op8_packing": m8.op8_packing, "op9_top_k": m9.op9_top_k, "op10_license_scan": m10.op10_license_scan, "op11_fill_in_middle": m11.op11_fill_in_middle, "op12_piece_codec": m12.op12_piece_codec, "op13_periodic_runs": m13.op13_periodic_runs}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": m3.OP3_SQL, "op7_decontaminate": m7.OP7_SQL, "op9_top_k": m9.OP9_SQL, "op11_fill_in_middle": m11.OP11_SQL}
