"""Evidence curation over large crawl corpora, written as Spark DataFrame operators."""

__version__ = "0.1.0"
