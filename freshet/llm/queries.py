"""Queries of this package, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import quality, topk, warc
from .bitpacked import op9_bitpacked
from .bpe_transducer import op1_bpe
from .language import op4_language
from .packing import op3_packing
from .quality import op8_quality
from .simhash import op6_simhash
from .topk import op2_topk
from .urls import op7_url_filter
from .warc import op10_warc
from .wrappers import op5_main_text


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_bpe, op2_topk, op3_packing, op4_language, op5_main_text, op6_simhash, op7_url_filter, op8_quality, op9_bitpacked, op10_warc]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return quality.ORACLE_SQL | topk.ORACLE_SQL | warc.ORACLE_SQL
