"""A Spark-native crawl, search and corpus analytics engine."""

import sys

from pyspark import cloudpickle

from .config import AnswerConfig, CrawlConfig, load_crawl_config
from .session import build_session

__all__ = ["AnswerConfig", "CrawlConfig", "build_session", "load_crawl_config"]

# Functions that run inside tasks travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
