"""The query catalogue, one module per topic."""

from importlib import import_module

TOPICS = ["scoring", "leads", "normalize", "crawl", "extract", "imports", "streams", "gaps"]


def load() -> None:
    for topic in TOPICS:
        import_module(f"{__name__}.{topic}")
