"""tabsift: data-quality assessment of tabular datasets as Spark plans."""

from tabsift.config import CONFIG, merge_metadata
from tabsift.dataset import Dataset

__all__ = ["CONFIG", "Dataset", "merge_metadata"]
