"""All queries of this subpackage; importing the operators registers them."""

from formline.llm import audit, codes, language, licenses, neardup, phrases, pieces, secrets, sharding, tokenfiles, toxicity, urls, vectors  # noqa: F401
from formline.llm.registry import ORACLES, QUERIES  # noqa: F401
