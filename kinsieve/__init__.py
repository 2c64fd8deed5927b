"""kinsieve: record linkage, vector search and evaluation as DataFrame plans."""

from importlib import import_module

#: Public names and their modules, which are imported when a name is first used: workers need few of them.
_NAMES = {
    "Comparison": "operators.comparison",
    "Embedder": "operators.embedding",
    "HashedNGramEmbedder": "operators.embedding",
    "Level": "operators.comparison",
    "LinkModel": "operators.model",
    "ModelEmbedder": "operators.embedding",
    "ParquetStore": "sources.store",
    "PersistableStore": "sources.store",
    "ReferenceStore": "sources.store",
    "Resolver": "plans.resolve",
    "SearchService": "plans.resolve",
    "calibrate": "operators.training",
    "default_comparisons": "operators.comparison",
    "knn_join": "operators.knn",
    "knn_join_blocks": "operators.knn",
    "link": "operators.scoring",
    "train": "operators.training",
    "voter_comparisons": "operators.comparison",
    "weaken_comparison": "operators.comparison",
}
__all__ = sorted(_NAMES)


def __getattr__(name: str):
    if name in _NAMES:
        return getattr(import_module(f"kinsieve.{_NAMES[name]}"), name)
    raise AttributeError(name)
