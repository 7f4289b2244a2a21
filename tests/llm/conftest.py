"""Puts this folder on the path, for helpers that tests share."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
