"""All registered queries of this subpackage."""

from tickforge.llm import bpe, fingerprint, importance, language, lm_score, mixing, near_dedup, page_text, preference, quality, sharding, token_align, url_filter  # noqa: F401  (registration)
from tickforge.llm.common import ORACLE, QUERIES  # noqa: F401
