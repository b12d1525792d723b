"""Spark-native analytics over a corpus of source code.

Every public function takes and returns DataFrames (or Columns); the jobs in
``sourceloom.plans`` compose them into indexing, search, report and reset.
"""

from sourceloom.functions.encoder import HashingEncoder, ModelEncoder
from sourceloom.plans.index import index_files, index_folder
from sourceloom.plans.report import report, write_report
from sourceloom.plans.reset import reset
from sourceloom.plans.search import search, search_display
from sourceloom.plans.summary import index_preview, index_summary
from sourceloom.sources.store import CorpusStore
from sourceloom.streaming.incremental import index_stream

__all__ = [
    "CorpusStore",
    "HashingEncoder",
    "ModelEncoder",
    "index_files",
    "index_folder",
    "index_preview",
    "index_stream",
    "index_summary",
    "report",
    "reset",
    "search",
    "search_display",
    "write_report",
]
