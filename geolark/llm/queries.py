"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .htmltext import op10_html_text
from .imagecopies import op5_image_copies
from .importance import OP13_SQL, op13_importance
from .jaccard import OP12_SQL, op12_jaccard
from .langid import op7_langid
from .linededup import op2_line_dedup
from .merkle import OP11_SQL, op11_merkle
from .mixing import OP8_SQL, op8_mixing
from .packing import op9_packing
from .pii import op3_pii
from .secretscan import OP4_SQL, op4_secrets
from .simhash import op6_simhash
from .vector_topk import OP1_SQL, op1_exact_topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_topk": op1_exact_topk,
    "op2_line_dedup": op2_line_dedup,
    "op3_pii": op3_pii,
    "op4_secrets": op4_secrets,
    "op5_image_copies": op5_image_copies,
    "op6_simhash": op6_simhash,
    "op7_langid": op7_langid,
    "op8_mixing": op8_mixing,
    "op9_packing": op9_packing,
    "op10_html_text": op10_html_text,
    "op11_merkle": op11_merkle,
    "op12_jaccard": op12_jaccard,
    "op13_importance": op13_importance,
}
ORACLE_SQL: dict[str, str] = {"op1_exact_topk": OP1_SQL, "op4_secrets": OP4_SQL, "op8_mixing": OP8_SQL, "op11_merkle": OP11_SQL, "op12_jaccard": OP12_SQL, "op13_importance": OP13_SQL}
