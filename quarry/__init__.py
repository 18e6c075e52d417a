"""quarry: a PySpark-native retrieval and index-analytics engine for code and text."""

from .api import Service
from .config import Config
from .operators.chunk import Chunker, CodeChunker, FunctionChunker, ParagraphChunker, SectionChunker
from .operators.embed import Embedder, HashingEmbedder
from .operators.filters import Filters
from .plans.indexing import Indexer, IndexReport
from .plans.retrieval import SearchOptions
from .progress import ProgressEvent
from .store import ChunkStore
from .streaming.feed import Watcher
from .streaming.listing import TreePoller

__version__ = "0.1.0"
__all__ = [
    "ChunkStore", "Chunker", "CodeChunker", "Config", "Embedder", "Filters", "FunctionChunker", "HashingEmbedder", "IndexReport", "Indexer",
    "ParagraphChunker", "ProgressEvent", "SearchOptions", "SectionChunker", "Service", "TreePoller", "Watcher",
]
