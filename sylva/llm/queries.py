"""All queries of this subpackage, and their SQL."""

from sylva.llm import centroids, classlm, hnsw, infill, langid, neardup, packing, pieces, secrets, sketch, topk, toxicity, warc  # noqa: F401
from sylva.llm.common import ORACLE, QUERIES  # noqa: F401
