"""Lexical search and ranking on Spark DataFrames."""

_HOME = {
    **dict.fromkeys(("BM25", "BM25F", "BM25L", "AsyncBatchMixin", "BM25Adpt", "BM25Plus", "CompressedBM25", "InvertedIndex", "SortedPostings", "MmapBM25", "StreamingBM25Builder"), "models"),
    **dict.fromkeys(("ENGLISH_STOPWORDS", "Tokenizer"), "functions.tokenize"),
    "RRFScorer": "operators.fusion",
}
__all__ = list(_HOME)


def __getattr__(name: str):  # Python workers import the package too and need none of these
    if name not in _HOME:
        raise AttributeError(name)
    import importlib

    return getattr(importlib.import_module(f"sparklex.{_HOME[name]}"), name)
