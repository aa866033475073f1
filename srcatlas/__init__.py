"""srcatlas: source-corpus analytics (selection, chunking, dependency graphs, vector search,
prompt tables and reply parsing) as Spark DataFrame jobs keyed by repository."""

__version__ = "0.1.0"
