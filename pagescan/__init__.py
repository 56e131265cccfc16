"""Spark scans of web pages for hidden links, hidden elements and suspicious code."""

import sys

from pyspark import cloudpickle

from pagescan.operators.detectors import page_detector
from pagescan.plans.run import run_scan, scan_targets
from pagescan.plans.scan import detect, scan, scan_errors
from pagescan.rules.loaders import custom_rules, load_custom_rules, load_keywords

__all__ = ["custom_rules", "detect", "load_custom_rules", "load_keywords", "page_detector", "run_scan", "scan", "scan_errors", "scan_targets"]

# Functions that run in Python workers travel with the plan, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
